"""Benchmarks whose items share stems, and texts that quote many items."""

import random

from skein.llm import decontaminate
from skein.llm.common import materialise

STEM = "which of the following statements about"


def made(spark, n):
    rng = random.Random(n)
    parts = [f"{a}{b}{c}" for a in "bcdfgl" for b in ("a", "en", "ir") for c in ("ta", "mo")]
    words = [a + b for a in parts for b in parts]
    items = [(k, f"{STEM} {' '.join(rng.sample(words, 8))} item{k} holds") for k in range(n)]
    return rng, items, spark.createDataFrame(items, "item_id long, text string")


def pairs_of(spark, texts, bench):
    base = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text_key", decontaminate.text_key("text"))
    items = materialise(decontaminate.distinct_items(bench.withColumn("item_key", decontaminate.text_key("text"))), "items")
    return decontaminate.candidates(base.select("text_key", "text"), items).selectExpr("size(of) as n").collect()


def test_a_stem_alone_makes_no_candidates(spark):
    for n in (50, 100):
        _, _, bench = made(spark, n)
        assert pairs_of(spark, [(k, f"note {k}: {STEM} it") for k in range(n)], bench) == []


def test_items_that_share_a_stem_are_found(spark):
    rng, items, bench = made(spark, 90)
    texts, want = [], set()
    for k in range(90):
        words = items[k][1].split()
        for p in rng.sample(range(len(words)), k % 4):  # 16 words, so 3 edits at most
            words[p] = "edited"
        texts.append((k, " ".join(["before it", *words, f"after it {k}"])))
        want.add((k, k))
    texts.append((1000, " and ".join(t for _, t in items)))
    want |= {(1000, k) for k in range(90)}
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & want) >= 0.97 * len(want)
    assert {(k, k) for k in range(0, 90, 4)} <= found and {(1000, k) for k in range(90)} <= found
    sizes = [r.n for r in pairs_of(spark, texts, bench)]
    assert sum(sizes) <= 3 * len(want) and max(sizes) <= 2 * decontaminate.TOGETHER
