"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and sentences of more than ``LONG`` words into pieces where their content says so: after
a word whose hash with the ``GRAM - 1`` words before it is the least among those of the ``NEAR`` words on either side. So
equal passages have equal pieces wherever they stand, but for the words at their two ends that strange words decide on.
From every sentence a run starts that takes in as many following sentences as it needs to have at least ``RUN``
sentences and ``WORDS`` words, and at every sentence one ends that takes in as many before it. The hashes of all runs of all documents meet in one join; of the places of a repeated run the
one with the smallest doc_id, then position, is the first, and the sentences of every other place are removed.

Cases. Null or empty text: no sentences. Null doc_id: comes before all others. Repeated rows: rows of their own, the later
one loses what it repeats. A run that one document repeats loses its later places. Fewer sentences or words than
a run needs: no runs. Very long texts are read whole. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ROW, WordMemo, documents, free_name, materialise, mix64, numbered, row_pass, word_hash

#: Sentences and words that a run has at least.
RUN = 2
WORDS = 20
#: Longer sentences are cut into pieces, of so many words at most.
LONG = 24
#: Words that a cut's hash reads, and words on either side that it is compared with: cuts are more than ``NEAR`` words apart.
GRAM = 3
NEAR = 3

_SENTENCE = re.compile(r"([^\n.!?…。！？]+)[.!?…。！？]*")
_WORD = re.compile(r"\S+")

_UNITS = "starts array<int>, ends array<int>, runs array<struct<h:bigint,first:int,last:int>>"


def cuts(words: np.ndarray) -> list[int]:
    """Ends of the pieces of a long sentence's hashed words."""
    n = len(words)
    h = np.full(n + 2 * NEAR, np.iinfo(np.uint64).max, np.uint64)
    gram = words[: n - GRAM + 1]
    for j in range(1, GRAM):
        gram = mix64(gram * np.uint64(0x9E3779B97F4A7C15) + words[j : n - GRAM + 1 + j])
    h[NEAR + GRAM - 1 : NEAR + n] = gram
    here = h[NEAR : NEAR + n]
    least = np.ones(n, bool)
    for j in range(1, NEAR + 1):
        least &= (here < h[NEAR - j : NEAR - j + n]) & (here <= h[NEAR + j : NEAR + j + n])
    out, last = [], 0
    for end in [*(np.flatnonzero(least) + 1).tolist(), n]:
        while end - last > LONG:  # words that repeat have no least
            last += LONG
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def units(text: str, memo: WordMemo) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each sentence or piece of one."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = m[1].lower().split()
        if not words:
            continue
        if len(words) <= LONG:
            out.append((m.start(), m.end(), len(words), xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))))
            continue
        at = [w.span() for w in _WORD.finditer(text, m.start(1), m.end(1))]
        words = [text[a:b].lower() for a, b in at]
        k = 0
        for end in cuts(word_hash(memo, words)):
            last = m.end() if end == len(at) else at[end - 1][1]
            out.append((at[k][0], last, end - k, xxhash.xxh64_intdigest(" ".join(words[k:end]).encode("utf-8", "surrogatepass"))))
            k = end
    return out


def runs(of: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(hash, first unit, last unit) of the shortest run from each unit on and of that up to each unit, where there are enough units and words.

    None of them lies within another's inside, so in order of their first units their last ones never fall.
    """
    flat = np.array([u[3] for u in of], "<u8").tobytes()
    total = [0]
    for u in of:
        total.append(total[-1] + u[2])
    enough = lambda i, j: j - i >= RUN and total[j] - total[i] >= WORDS
    places, j = set(), 0
    for i in range(len(of)):
        while j < len(of) and not enough(i, j):
            j += 1
        if not enough(i, j):
            break
        places.add((i, j))
    i = 0
    for j in range(1, len(of) + 1):
        if enough(i, j):
            while enough(i + 1, j):
                i += 1
            places.add((i, j))
    out = []
    for i, j in sorted(places):
        h = xxhash.xxh64_intdigest(flat[8 * i : 8 * j])
        out.append((h - (1 << 64) if h >> 63 else h, i, j - 1))
    return out


def document_runs(docs: DataFrame) -> DataFrame:
    """Sentences and runs of every row. docs: uid, doc_id, text."""

    def maker():
        memo = WordMemo()

        def make(texts):
            found = [units(t, memo) if t else [] for t in texts]
            return [[u[0] for u in x] for x in found], [[u[1] for u in x] for x in found], [[{"h": h, "first": i, "last": j} for h, i, j in runs(x)] for x in found]

        return make

    return row_pass(docs, ["text"], _UNITS, maker, ["uid", "doc_id"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_sentences, n_removed, spans (merged character ranges to remove) of every row of ``docs`` (doc_id, text).

    Runs of 24 bytes each are shuffled, not texts: once to find the first place of each repeated hash, once to find
    the others. A run that very many documents hold is one partial result a task in the first; in the
    second its rows meet one written row, so adaptive execution splits them.
    """
    uid = F.col(ROW).alias("uid") if ROW in docs.columns else F.monotonically_increasing_id().alias("uid")
    found = materialise(document_runs(docs.select(uid, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "runs")
    every = found.select("uid", "doc_id", F.explode("runs").alias("run")).select("uid", "doc_id", F.col("run.first").alias("k"), F.col("run.h").alias("h"), F.col("run.last").alias("last"))
    firsts = (
        every.groupBy("h").agg(F.min(F.struct("doc_id", "uid", "k")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("h", F.col("first.uid").alias("f_uid"), F.col("first.k").alias("f_k"))
    )
    firsts = materialise(firsts, "firsts")  # a join with what is written can be split where one run has very many places
    later = every.join(firsts, "h").where((F.col("uid") != F.col("f_uid")) | (F.col("k") != F.col("f_k")))
    covered = later.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "last"))).alias("covered"))
    # runs come in order of their first sentence and their ends never fall, so a run adds what the last one lacks
    fresh = F.transform(
        "covered",
        lambda r, i: F.when(i == 0, r["k"]).otherwise(F.greatest(r["k"], F.get(F.col("covered"), i - 1)["last"] + 1)),
    )
    numbers = F.flatten(F.transform(F.arrays_zip("covered", fresh.alias("fresh")), lambda x: F.when(x["fresh"] <= x["covered"]["last"], F.sequence(x["fresh"], x["covered"]["last"])).otherwise(F.array().cast("array<int>"))))
    joined = found.drop("runs").join(covered.select("uid", numbers.alias("gone")), "uid", "left")
    is_start = F.filter("gone", lambda g, i: (i == 0) | (F.get(F.col("gone"), i - 1) != g - 1))
    is_end = F.filter("gone", lambda g, i: F.coalesce(F.get(F.col("gone"), i + 1) != g + 1, F.lit(True)))
    joined = joined.withColumn("a", is_start).withColumn("b", is_end)
    spans = F.transform("a", lambda a, i: F.struct(F.get(F.col("starts"), a).alias("start"), F.get(F.col("ends"), F.get(F.col("b"), i)).alias("end")))
    return joined.select(
        "uid", "doc_id", F.size("starts").alias("n_sentences"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def op7_sentence_spans(spark, sf_dir: str) -> DataFrame:
    """What is removed from every document: number of sentences, and ranges of characters."""
    found = repeated_spans(documents(spark, sf_dir, "doc_id", "text"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("touched"), text.alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated spans of their texts."""
    rows = numbered(docs)
    cuts = free_name(docs, "cuts")
    spans = repeated_spans(rows).select(F.col("uid").alias(ROW), F.col("spans").alias(cuts))
    text = free_name(docs, "left")

    def maker():
        def one(t, spans):
            pos, out = 0, []
            for s in spans:
                out.append(t[pos : s["start"]])
                pos = s["end"]
            return "".join(out) + t[pos:]

        return lambda texts, spans: [[None if t is None else one(t, c) for t, c in zip(texts, spans, strict=True)]]

    found = row_pass(rows.join(spans, ROW), ["text", cuts], f"{text} string", maker, [c for c in docs.columns if c != "text"])
    return found.select(*(F.col(f"`{text}`").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
