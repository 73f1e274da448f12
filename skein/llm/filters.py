"""Filter interaction audit by a table-driven byte transducer.

One pass of a finite-state transducer over UTF-8 bytes feeds all filters: its input is a byte's class, its state whether
a word is open, its outputs open or close a word and count capitals, symbols and code points. The state after a byte
follows from that byte's class alone, so both tables are looked up for all bytes of a part at once. Closed words enter a
hash table of spans, where a span counts as seen only after its text, length and bytes are found equal; what enters anew is
the number of distinct words. Equal texts meet by a digest of 128 bits.

A document becomes the set of filters that it fails, and a part of the corpus the counts of these sets, 32 at most. What
any order of the filters keeps, removes and finds removed already follows from these counts.

Cases. Null text: the empty text (fails A; and E if a smaller doc_id is empty too). Null doc_id: has no smaller one, is
nobody's smaller one and has no label. Null source: part ''. Repeated rows count each, and don't fail E by each other, as
no doc_id of theirs is smaller. Several labels of one doc_id: any that marks it counts; null labels don't. Ties: every filter
is a comparison of whole numbers. Very long texts are read whole, hashes 256 KB of words at a time. An empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.bytescan import WHITE, parts, range_sums, text_bytes
from skein.llm.common import documents, materialise, mix64, need, read

LETTERS = "ABCDE"
MIN_WORDS = 200
#: Hundredths: fewest distinct words of all words, most capitals of all code points.
MIN_DISTINCT = 50
MAX_CAPITALS = 2
SYMBOLS = b"#$%&*|"

#: Bytes of text whose words share a hash table, and whose hashes are computed at once.
TABLE_BYTES = 1 << 20
HASH_BYTES = 1 << 18

# Classes of bytes, states, outputs
_OTHER, _WHITE, _CAPITAL, _SYMBOL, _LEAD, _TAIL = range(6)
_OUT, _IN = range(2)
_OPEN, _CLOSE, _IS_CAPITAL, _IS_SYMBOL, _IS_POINT = (1 << k for k in range(5))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of a byte, the state after a class, and the outputs by state and class."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[WHITE] = _WHITE
    kind[ord("A") : ord("Z") + 1] = _CAPITAL
    kind[list(SYMBOLS)] = _SYMBOL
    kind[0x80:0xC0] = _TAIL
    kind[0xC0:] = _LEAD
    state = np.full(6, _IN, np.uint8)
    state[_WHITE] = _OUT
    output = np.zeros((2, 6), np.uint8)
    output[:, [_OTHER, _WHITE, _CAPITAL, _SYMBOL, _LEAD]] |= _IS_POINT
    output[:, _CAPITAL] |= _IS_CAPITAL
    output[:, _SYMBOL] |= _IS_SYMBOL
    output[_OUT, state == _IN] |= _OPEN
    output[_IN, _WHITE] |= _CLOSE
    return kind, state, output.ravel()


CLASS, STATE, OUTPUT = _tables()


def transduce(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The outputs of every byte, and the starts and ends of all words in order. Texts start outside words and close an open one at their end."""
    kind = CLASS[data]
    after = STATE[kind]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    held = offsets[1:] > offsets[:-1]
    before[offsets[:-1][held]] = _OUT
    out = OUTPUT[before * np.uint8(6) + kind]
    last = offsets[1:][held]
    ends = np.concatenate([np.flatnonzero(out & _CLOSE), last[after[last - 1] == _IN]])
    return out, np.flatnonzero(out & _OPEN), np.sort(ends)


_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    all_of = np.full(n, base, np.uint64)
    all_of[:1] = 1
    return np.cumprod(all_of, dtype=np.uint64)


_UP, _DOWN = _powers(_STEP, HASH_BYTES + 1), _powers(_BACK, HASH_BYTES + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes: polynomials from one running sum, brought to one origin by the inverse power."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + HASH_BYTES, "right")))
        origin, size = starts[k], ends[j - 1] - starts[k]
        up, down = (_UP, _DOWN) if size <= HASH_BYTES else (_powers(_STEP, size + 1), _powers(_BACK, size + 1))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((data[origin : origin + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
        s, e = starts[k:j] - origin, ends[k:j] - origin
        out[k:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        k = j
    return mix64(out)


#: Spans of more bytes are compared one by one.
_LANES = 256


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at ``a`` and at ``b`` are equal, 8 bytes at a time. ``data`` has 8 bytes behind its last span."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    same = np.ones(len(a), bool)
    live = np.flatnonzero(size <= _LANES)
    k = 0
    while len(live):
        left = np.minimum(size[live] - k, 8)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64))
        same[live] = ((eight[a[live] + k] ^ eight[b[live] + k]) & keep) == 0
        k += 8
        live = live[same[live] & (size[live] > k)]
    for i in np.flatnonzero(size > _LANES):
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return same


def first_spans(data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span is the one of its row and bytes that the hash table holds.

    All spans probe at once: the free slots take one of the spans that ask for them, every span is verified against its slot's
    holder, and those that differ go on to the next slot.
    """
    n = len(starts)
    size = ends - starts
    h = span_hashes(data, starts, ends) ^ mix64(row.astype(np.uint64))
    data = np.append(data, np.zeros(8, np.uint8))
    mask = (1 << max(4, int(2 * n).bit_length())) - 1
    table = np.full(mask + 1, -1, np.int64)
    slot = (h & np.uint64(mask)).astype(np.int64)
    first = np.zeros(n, bool)
    waiting = np.arange(n)
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        table[at[free][::-1]] = waiting[free][::-1]
        holder = table[at]
        own = holder == waiting
        first[waiting[own]] = True
        alike = (h[holder] == h[waiting]) & (row[holder] == row[waiting]) & (size[holder] == size[waiting]) & ~own
        check = np.flatnonzero(alike)
        seen = own
        seen[check] = same_bytes(data, starts[waiting[check]], starts[holder[check]], size[waiting[check]])
        waiting = waiting[~seen]
        slot[waiting] = (slot[waiting] + 1) & mask
    return first


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


def counted(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of each text."""
    out, starts, ends = transduce(offsets, data)
    row = np.searchsorted(offsets, starts, "right") - 1
    n = len(offsets) - 1
    first = first_spans(data, row, starts, ends)
    outputs = [range_sums((out & bit) != 0, offsets) for bit in (_IS_CAPITAL, _IS_SYMBOL, _IS_POINT)]
    return [np.bincount(row, minlength=n), np.bincount(row[first], minlength=n), *outputs]


def document_counts(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, the ``COUNTS`` and text_key of every row of ``docs`` (doc_id, text, ``part``)."""
    rows = need(docs, doc_id=T.LongType(), text=T.StringType(), **{part: T.StringType()}).select("doc_id", F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), "text")

    def work(batches):
        for batch in batches:
            for some in parts(batch, "text", TABLE_BYTES):
                offsets, data = text_bytes(some.column("text"))
                whole = memoryview(data)
                keys = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                counts = [pa.array(c.astype(np.int64)) for c in counted(offsets, data)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("part"), *counts, pa.array(keys, pa.binary())], names=["doc_id", "part", *COUNTS, "text_key"])

    return rows.mapInArrow(work, f"doc_id long, part string, {', '.join(f'{c} long' for c in COUNTS)}, text_key binary")


def failed_filters(counts: DataFrame) -> DataFrame:
    """doc_id, part, failed: the filters that each document of ``counts`` fails, as bits from A = 1 on. counts: from ``document_counts``, materialised."""
    # written before it is joined back, so that adaptive execution can split a text that very many rows have
    lowest = materialise(counts.groupBy("text_key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    fails = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_chars"),
        F.col("n_symbols") > 0,
        F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)),
    ]
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return counts.join(lowest, "text_key", "left").select("doc_id", "part", bits.alias("failed"))


def interactions(failed: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of ``letters`` and their steps.

    failed: doc_id, part, failed (bits in the order of ``letters``); labels: doc_id, quality, toxic.
    """
    marks = need(labels, doc_id=T.LongType(), quality=T.LongType(), toxic=T.LongType()).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = failed.join(marks, "doc_id", "left")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sets = known.groupBy("part", "failed").agg(F.count("*").alias("n"), whole("good"), whole("toxic"))
    # one entry a set of filters: 2 to the number of filters at most
    profiles = sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for k, f in enumerate(order):
            steps.append(f"struct('{''.join(letters[x] for x in order)}', {k + 1}, {before}, {1 << f})")
            before |= 1 << f
    laid = profiles.select("part", "sets", F.expr(f"inline(array({', '.join(steps)})) as (filter_order, step, before, own)"))

    def total(condition, of="n"):
        return F.aggregate("sets", F.lit(0).cast("long"), lambda t, x: t + F.when(condition(x["failed"]), of(x) if callable(of) else x[of]).otherwise(0))

    before, own, orders = F.col("before"), F.col("own"), len(steps) // len(letters)
    fails = lambda m: m.bitwiseAND(own) != 0
    removed = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    # of the filters that a document fails, each comes first in an equal share of all orders
    share = lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["failed"])).cast("long")
    return laid.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def op12_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """The audit of all orders of the five filters, by source."""
    counts = materialise(document_counts(documents(spark, sf_dir, "doc_id", "text", "source")), "filter-counts")
    return interactions(failed_filters(counts), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS ws
  FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), sets AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS own, substr(filter_order, 1, s - 1) AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS s FROM orders)
), rows AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN translate(fails, before || own, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN bad ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows
"""
