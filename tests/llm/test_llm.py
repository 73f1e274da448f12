"""Each corpus operator on small cases: against brute force, round trips or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.common import ROW, WordMemo, word_hash
from skein.llm import components, decontaminate, html, mixing, neardup, privacy, quality, sharding, spans, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source=None):
    rows = [(k, t, "en", source(k) if source else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Null and empty texts, null ids and sources, repeated rows, a long text, and a column with an operator's own name."""
    long = " ".join(f"w{k}" for k in range(30_000)) + "."
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "one two three four five", "en", "a", 1), (3, "same text here. and more of it.", "en", "a", 1), (3, "same text here. and more of it.", "en", "a", 1), (4, long, "en", None, 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("uid", F.lit("mine")).withColumn("host", F.lit("x"))


def prose(rng, n, words=None):
    words = words or [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "en", "ir", "os", "ut", "ay")]
    out = []
    for k in range(n):
        out.append(rng.choice(words) + ("." if k % 9 == 8 else "") + ("\n" if k % 40 == 39 else ""))
    return " ".join(out)


# op1


def page(main, menu="x"):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>{menu}</a></nav><div class='ad'>buy</div><article><h1>Head</h1>{main}</article><div id=comments><p>nice</p></div><footer>f</footer></body></html>"


def test_main_text_of_an_article_page(spark):
    rows = [(k, f"http://h.org/{k}", page(f"<p>Body {k}&nbsp;&amp; <b>bo</b>ld<p>Next\n\n line<!-- no -->", menu=str(k))) for k in range(6)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"Head Body {k} & bold Next line" and got[k].n_chars == len(got[k].text) for k in range(6))


def test_templates_remove_furniture_without_a_main_container(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><div class=top><p>Welcome here</p></div><div class=links><a href=1>one {k}</a> <a href=2>two</a></div><div class=text><p>Story number {k} goes on.</p></div></body>") for k in range(8)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story number {k} goes on." for k in range(8)}


def texts_of(spark, pages):
    rows = [(k, f"http://h.org/{k}", p) for k, p in enumerate(pages)]
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_hosts_of_two_layouts(spark):
    new = [page(f"<p>Body {k}</p>").replace("Head", f"Head {k}") for k in range(12)]
    old = [f"<body><div class=top><p>Welcome here</p></div><div class=links><a href=1>one {k}</a> <a href=2>two</a></div><div class=text><p>Story number {k} goes on.</p></div></body>" for k in range(8)]
    got = texts_of(spark, new + old)
    assert got == {k: f"Head {k} Body {k}" if k < 12 else f"Story number {k - 12} goes on." for k in range(20)}
    few = texts_of(spark, new + old[:2])
    assert "Story number 0 goes on." in few[12] and "Story number 1 goes on." in few[13]


def test_unnamed_notices_inside_the_container(spark):
    body = lambda k: "".join(f"<p>Story {k} part {j}.</p>" for j in range(k % 4 + 1))
    pages = [f"<body><div>x<ul>{'<li>i' * (k % 3)}</ul></div><article><h1>Title {k}</h1>{body(k)}<p>Tell your friends about us.</p><div><p>All rights reserved.</p></div></article></body>" for k in range(12)]
    want = {k: " ".join([f"Title {k}", *(f"Story {k} part {j}." for j in range(k % 4 + 1))]) for k in range(12)}
    assert texts_of(spark, pages) == want
    # copies of one page are no template of it
    assert texts_of(spark, ["<body><article><h1>A</h1><p>Only text.</p></article></body>"] * 12) == dict.fromkeys(range(12), "A Only text.")


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "no url", "<p>x"), (3, "http://a/", "<article>a<article>b</p></i>&lt;"), (3, "http://a/", "plain & text"), (4, "http://a/", "<" * 2000 + "'\"" * 2000)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 1] == [""] and [r.text for r in got if r.page_id is None] == ["x"]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# op2


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    docs = frame(spark, [prose(rng, rng.randrange(1, 200)) for _ in range(300)], lambda k: "big" if k % 3 == 0 else f"s{k % 4}")
    got = mixing.mix(docs).collect()
    assert len(got) == 300
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.words
        taken[r.source] = taken.get(r.source, 0) + r.words * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and r.source_size > 0
    total, left, fixed = sum(sizes.values()), dict(enumerate(sorted(sizes))), {}
    while True:  # the targets by hand
        free = [k for k in left if left[k] not in fixed]
        share = {k: (total - sum(fixed.values())) * (k % 3 + 1) / sum(j % 3 + 1 for j in free) for k in free}
        over = [k for k in free if share[k] >= 3 * sizes[left[k]]]
        if not over:
            break
        fixed |= {left[k]: 3.0 * sizes[left[k]] for k in over}
    want = fixed | {left[k]: v for k, v in share.items()}
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= max(15, 0.01 * target[s])
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mixed_rows_repeat(spark):
    docs = awkward(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("text is null or text = ''").count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_newton_on_two_constraints(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 20.0), ("b", "x", 30.0), ("b", "y", 40.0)], "s string, l string, words double")
    t = {"s": [("a", 50.0), ("b", 50.0)], "l": [("x", 30.0), ("y", 70.0)]}
    frames = {c: spark.createDataFrame(v, "value string, target double") for c, v in t.items()}
    m = {c: {r.value: r.multiplier for r in f.collect()} for c, f in mixing.entropy_multipliers(cells, frames).items()}
    rate = {(r.s, r.l): r.words * np.exp(m["s"][r.s] + m["l"][r.l]) for r in cells.collect()}
    assert sum(v for (s, _), v in rate.items() if s == "a") == pytest.approx(50, rel=1e-6)
    assert sum(v for (_, x), v in rate.items() if x == "x") == pytest.approx(30, rel=1e-6)


# op3


def test_contamination_exact_and_edited(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, 40)) for k in range(20)] + [(100, "Short item text"), (101, None), (102, "")]
    docs, want = [], set()
    for k in range(60):
        body = prose(rng, 120).split()
        if k < 40:
            words = items[k % 20][1].split()
            if k >= 20:
                for p in rng.sample(range(40), 5):
                    words[p] = "changed"
            body[50:50] = words
            want.add((k, k % 20))
        docs.append(" ".join(body))
    docs.append("a short ITEM, text inside")
    want.add((60, 100))
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.distance == (5 if 20 <= r.doc_id < 40 else 0) or r.distance < 5 for r in got)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontaminate.clean_documents(frame(spark, docs), bench).collect()} == set(range(40, 60))
    assert decontaminate.clean_documents(awkward(spark), bench).count() == 6
    assert decontaminate.contaminated(awkward(spark), bench.limit(0)).count() == 0


def edited(rng, words, edits, only=None):
    out = list(words)
    for k in range(edits):
        p = rng.randrange(len(out))
        way = rng.randrange(3) if only is None else only
        out[p : p + (way != 2)] = [f"new{k}"] if way != 0 else []
    return out


def hits_of(items, texts):
    """What the keys and the verification find, item by text, without Spark."""
    memo = WordMemo()
    hashed = [word_hash(memo, w) for w in items]
    keys = [dict((k[-1], at) for at, k in reversed(decontaminate.item_keys(w))) for w in hashed]
    every = [x for w in hashed for _, k in decontaminate.item_keys(w) for x in k]
    made = decontaminate.Filter(len(every))
    made.put(np.array(every, np.int64))
    out = []
    for k, (found, spots) in enumerate(decontaminate.found_keys(made, True, texts, memo)):
        both = [(x, p) for x, p in zip(found.tolist(), spots.tolist()) if x in keys[k]]
        if len({x for x, _ in both}) >= max(1, len(items[k]) // decontaminate.MATCH_WORDS):
            words = word_hash(memo, texts[k].split())
            out.append(decontaminate.best_place(hashed[k], words, [p - keys[k][x] for x, p in both], decontaminate.edits_of(len(items[k]), decontaminate.EDITS)))
        else:
            out.append(None)
    return out


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row)


@pytest.mark.parametrize("way", [0, 1, 2, None])
@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 20, 30, 48, 60, 100])
def test_recall_by_item_length(n, way):
    """Items at their full share of edits: removed (0), put in (2), replaced (1) or any of these words."""
    rng = random.Random(n)
    items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(300)]
    around = lambda: [f"y{rng.randrange(3000)}" for _ in range(30)]
    texts = [" ".join(around() + edited(rng, w, n // 5, way) + around()) for w in items]
    found = hits_of(items, texts)
    assert np.mean([f is not None for f in found]) >= (0.9 if n < 12 else 0.97)
    for item, text, hit in list(zip(items, texts, found))[:10]:
        if hit:
            assert hit[0] == plain_distance(item, text.split()) <= n // 5


def test_edit_distance_by_bits():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
            row = new
        return min(row), row.index(min(row))

    rng = np.random.default_rng(0)
    for _ in range(300):
        p, t = rng.integers(1, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(1, 4, rng.integers(0, 30)).astype(np.uint64)
        assert decontaminate.nearest(p, t) == plain(p.tolist(), t.tolist())


# op4

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_by_hand(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and privacy.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(t) if good[k](m)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@.-_%+ 0123()49\né") for _ in range(rng.randrange(45)))
        assert privacy.base_spans(t) == base_by_hand(t)
    assert privacy.base_spans("9" * 50_000 + "a" * 50_000 + "@") == []


def test_terms_that_disclose(spark):
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(300)]
    for k in range(5):
        texts[k] = f"{prose(rng, 15)} Zaphod write to z@beeb.org now {prose(rng, 15)}"
    found = {r.doc_id: r for r in privacy.personal_spans(frame(spark, texts)).collect()}
    for k in range(5):
        assert {"Zaphod", "write", "now"} <= {texts[k][s["start"] : s["end"]] for s in found[k].terms}
    assert all(not found[k].terms for k in range(5, 300))
    clean = {r.doc_id: r.text for r in privacy.sanitised(frame(spark, texts)).collect()}
    assert "z@beeb.org" not in clean[0] and "[EMAIL]" in clean[0] and "[Name]" in clean[0] and clean[7] == texts[7]
    assert privacy.personal_spans(awkward(spark)).count() == 6 and privacy.sanitised(awkward(spark)).count() == 6


# op5


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(1)
    bad = ["vile", "rotten", "filthy"]
    texts, labels = [], []
    for k in range(500):
        t = prose(rng, 80).split(" ")
        if k % 4 == 0:
            for _ in range(2):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        texts.append(" ".join(t))
        labels.append((k, 0, int(k % 4 == 0)))
    docs = frame(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.scored(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.toxicity.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.97
    for r in held:
        if r.doc_id % 4 == 0 and r.toxicity.score >= 0.5:
            words, ends = toxicity.sentences(r.text)
            begin = [0, *ends[:-1]]
            assert all(any(w.strip(".") in bad for w in words[begin[s] : ends[s]]) for s in r.toxicity.offending)
    out = toxicity.scored(awkward(spark), model)
    assert out.count() == 6 and {r.toxicity.score for r in out.where("text is null or text = ''").collect()} == {0.0}
    none = toxicity.train(docs, marks.limit(0))
    assert toxicity.scored(docs.limit(3), none).agg(F.max("toxicity.score")).first()[0] < 1e-9


# op6


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(8)
    texts = [prose(rng, 12) for _ in range(400)] + [t for k in range(30) for t in [f"copy {k}"] * (k % 5 + 2)] + ["huge"] * 150
    got = sharding.shard_documents(frame(spark, texts), shards=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(texts) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    small = [groups[zlib.crc32(f"copy {k}".encode())] for k in range(30)]
    assert sum(len(s) == 1 for s in small) >= 25
    assert sharding.sharded(awkward(spark), 4).count() == 6 and sharding.sharded(awkward(spark).limit(0), 4).count() == 0


# op7


def test_repeated_sentence_runs(spark):
    rng = random.Random(4)
    passage = " ".join(f"passage word number {k} stands here." for k in range(10))
    texts = [prose(rng, 90) for _ in range(30)]
    for k in (3, 11, 20):
        texts[k] = f"{prose(rng, 40)}.\n{passage}\n{prose(rng, 40)}"
    got = {r.doc_id: r for r in spans.repeated_spans(frame(spark, texts)).collect()}
    assert {k for k in got if got[k].n_removed} == {11, 20}
    left = {r.doc_id: r.text for r in spans.deduplicated(frame(spark, texts)).collect()}
    assert passage in left[3] and "passage word" not in left[11] and left[5] == texts[5]
    out = spans.deduplicated(awkward(spark))
    assert out.count() == 6 and out.columns == awkward(spark).columns


def run_places(text):
    found = spans.units(text, WordMemo())
    return {h: (found[i][0], found[j][1]) for h, i, j in spans.runs(found)}


def test_passages_without_marks_at_every_offset():
    rng = random.Random(14)
    for trial in range(20):
        passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(60))
        strange = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
        texts = [f"{strange(k)} {passage} {strange(30)}" for k in range(30)]
        held = [run_places(t) for t in texts]
        for t, h in zip(texts[1:], held[1:]):
            both = [h[x] for x in set(h) & set(held[0])]
            assert both
            a, b = min(x for x, _ in both), max(x for _, x in both)
            assert len(t[a:b].split()) >= 20 and t[a:b] in passage


def test_the_last_sentences_of_a_passage_go(spark):
    rng = random.Random(15)
    passage = f"{prose(rng, 8).replace('.', '')} ends. " + " ".join(f"w{k}" for k in range(18)) + ". Three words here. Two more."
    texts = [f"First {k} of all. {passage} {' '.join(f'z{k}{j}' for j in range(22))}." for k in range(2)]
    left = {r.doc_id: r.text for r in spans.deduplicated(frame(spark, texts)).collect()}
    assert left[0] == texts[0] and "Two more" not in left[1] and "First 1 of all." in left[1] and "z121." in left[1]


def test_run_order():
    rng = random.Random(17)
    for _ in range(300):
        found = spans.runs([(0, 0, rng.choice((1, 2, 3, 19, 24)), k) for k in range(rng.randrange(12))])
        assert [x[2] for x in found] == sorted(x[2] for x in found) and [x[1] for x in found] == sorted(x[1] for x in found)


# op8


def test_records_round_trip_and_audit(spark):
    rows = [(k, f"http://h/{k}", f"<p>é {k}\r\n\r\nx") for k in range(3000)] + [(5000, None, None), (5001, "http://h/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = pages.select("page_id", "url", "html", warc.parse_record(warc.record_bytes(F.col("url"), F.col("html"), F.col("page_id"))).alias("r"))
    assert all(r.r.page_id == str(r.page_id) and r.r.url == (r.url or "") and r.r.html == (r.html or "") for r in back.collect())
    laid = warc.materialise(warc.manifest(pages), "laid")
    bad, gone = {17, 1200, 2999}, {40}
    hurt = laid.where(~F.col("page_id").isin(*gone)).withColumn("digest", F.when(F.col("page_id").isin(*bad), F.lit("0" * 64)).otherwise(F.col("digest")))
    found = warc.audit(warc.merkle(laid, "a"), warc.merkle(hurt, "b")).join(laid.select("file", "ordinal", "page_id"), ["file", "ordinal"])
    assert {(r.page_id, r.status) for r in found.collect()} == {(k, "corrupt") for k in bad} | {(40, "missing")}
    assert warc.audit(warc.merkle(laid, "a"), warc.merkle(laid, "b")).count() == 0
    offsets = laid.where("file = 0").orderBy("ordinal").collect()
    assert all(a.offset + a.length == b.offset for a, b in zip(offsets, offsets[1:]))


# op9


def components_by_hand(texts, width, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(texts)):
        low[find(i)] = min(low.get(find(i), 1 << 60), ids[i])
    return [low[find(i)] for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = prose(rng, 60).split()
        for c in range(8):
            copy = list(base)
            for p in rng.sample(range(60), rng.randrange(0, 4)):
                copy[p] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(copy[: 60 - c // 3]))
    texts += ["", None, "one two", "one two", "ONE two", "one two three"]
    docs = frame(spark, texts).withColumn(ROW, F.col("doc_id"))
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, 4).collect()}
    want = components_by_hand(texts, 4, list(range(len(texts))))
    assert [got[k].component_id for k in range(len(texts))] == want
    assert all(got[k].kept == (want[k] == k) for k in got)
    one = neardup.unique_documents(frame(spark, texts), 4)
    assert {r.doc_id for r in one.collect()} == {k for k in range(len(texts)) if want[k] == k}
    assert neardup.unique_documents(awkward(spark)).count() == 5
    assert neardup.unique_documents(awkward(spark).limit(0)).count() == 0


def test_unique_documents_without_unique_ids(spark):
    rng = random.Random(16)
    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (9, c), (5, d), (5, e), (5, e), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in neardup.unique_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (7, c), (5, d), (5, e), (None, ""), (None, None)], key=repr)


def test_op9_with_repeated_rows(spark, tmp_path):
    rng = random.Random(26)
    a, b = prose(rng, 60), prose(rng, 60)
    near = a.rsplit(" ", 1)[0]
    rows = [(None, a)] * 40 + [(7, a)] * 30 + [(5, near)] * 30 + [(3, b), (3, b), (None, None), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, neardup.op9_signature_join(spark, str(tmp_path)).collect()), key=repr)
    n, m, k = (len(t.split()) - 3 for t in (a, near, b))
    want = [(None, n, 5, False)] * 40 + [(7, n, 5, False)] * 30 + [(5, m, 5, True)] * 30 + [(3, k, 3, True)] * 2 + [(None, 0, None, True), (2, 0, 2, True)]
    assert got == sorted(want, key=repr)


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 150)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[150] == got[200] == 100


# op10


def test_line_frequency(spark):
    rng = random.Random(7)
    menu = "home about contact us now"
    texts = [prose(rng, 70) + ("\n" + menu if k < 40 else "") for k in range(60)]
    texts.append("\n".join([menu] * 30 + [prose(rng, 10)]))
    texts.append("short")
    texts.append("a b c " * 40)
    got = {r.doc_id: r for r in quality.line_frequency_verdicts(frame(spark, texts, lambda k: "one")).collect()}
    assert got[0].removed_words == 5 and got[0].kept and got[50].removed_words == 0
    assert not got[60].kept and got[60].base_failed
    assert got[61].base_failed and got[62].base_failed and got[62].n_repeat_words == 120
    clean = {r.doc_id: r.text for r in quality.cleaned_texts(frame(spark, texts, lambda k: "one")).collect()}
    assert clean[0] == texts[0].removesuffix("\n" + menu) and clean[50] == texts[50] and 61 not in clean
    out = quality.line_frequency_verdicts(awkward(spark).drop("host"), "source").collect()
    assert len(out) == 6 and {r.n_words for r in out if r.doc_id in (1, 2)} == {0}


def test_repeat_words_by_hand(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality.line_frequency_verdicts(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
        assert got[k] == len(hit)


# pipeline


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [prose(rng, 80) for _ in range(80)]
    texts[5] = texts[4]
    item = prose(rng, 40)
    texts[9] += " " + item
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        now = quality.materialise(stage(spark, now, str(tmp_path)), f"t-{name}")
        counts.append(now.count())
        if name != "sharding":
            assert now.columns == docs.columns
    assert counts[:3] == [80, 79, 78]
    assert {"shard", "slot"} <= set(now.columns) and counts[4] == counts[3]
    assert hashlib and corpus_pipeline.run(spark, str(tmp_path)).count() == counts[4]
