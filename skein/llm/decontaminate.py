"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A CGK walk reads a sequence of words with random bits: at each step it emits the word under its pointer, and moves on if the
step's bit of that word is set. Sequences at a small edit distance walk in step but near their edits, so edit
distance becomes Hamming distance between the emitted sequences. Each of ``REPETITIONS`` walks has its own bits and its own sample of ``PLACES`` of every
``PERIOD`` steps; the sampled words of each period along the item's walk, from its first word to its last, are the item's keys under
that walk. The bits repeat with the period, so a document is walked for one period from every word, which covers all item-sized windows
at once: wherever a window's walk is at the start of a period, its key is among these. A walk stops as soon as the places sampled so far are
no item's (a table of all items' keys and their beginnings, of at most ``FILTER_SLOTS`` bytes, goes to the tasks).
Keys whose places lie on fewer than ``SPREAD`` words say little and are no item's, but in items of fewer than ``SHORT`` words, where one word less is enough.

The corpus is scanned once for its keys, whatever the number of items. Keys meet the items' in a join; a text and an item with
at least one match for every ``MATCH_WORDS`` words of the item, and one in any case, are a candidate. A key that more than
``COMMON_ITEMS`` items have (a stem that many begin with) joins no pairs by itself: of any ``most + 1`` distinct words of an
item, ``most`` being the edits it may have, one is left in a text that holds it, so its matches under common keys count in the texts that hold
one of the ``most + 1`` words of it that fewest items have; those pairs come from a join of these words. Candidates meet the
documents, at most ``TOGETHER`` of them in a row, which give the stretches around the matches; these meet the items, and the word edit distance between the item and the text around the matches decides, exactly, by bit-parallel dynamic programming.
Tests measure the recall at the full share of edits: at least 0.9 for items of every length, 0.97 from 12 words on.

Words are lower-cased runs of letters, digits and underscores. An item matches a stretch of a document if at most
``EDITS`` of its words have to be inserted, removed or replaced, rounded down; so items of fewer than five
words must occur exactly. Items without words match nothing.

Cases. Null or empty text: no hits. Null doc_id: hits with a null doc_id. Repeated rows: hits for each. Equal items:
each hits. Ties between places: the first. Very long texts are searched whole. Empty tables: no hits. Further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import WordMemo, documents, free_name, materialise, mix64, need, read, row_pass, word_hash

#: Share of an item's words that may be edited.
EDITS = 0.2
#: Walks, the steps after which their bits repeat, and the steps of them whose words make a key.
REPETITIONS = 6
PERIOD = 6
PLACES = 4
#: A candidate has a match for every so many words of the item.
MATCH_WORDS = 8
#: Words that the places of a key lie on at least, and the words of an item below which one less is enough.
SPREAD = 3
SHORT = 8
#: Items that have a key beyond which it is common; candidates that are verified in one row.
COMMON_ITEMS = 8
TOGETHER = 64
#: Most slots of the filter that goes to the tasks, a byte each: 16 MB.
FILTER_SLOTS = 1 << 24

_WORD = re.compile(r"\w+")


def places(repetition: int) -> list[int]:
    """The sampled steps of a walk's period: its first and some others, drawn by the number of the walk."""
    rng = np.random.default_rng([20, repetition])
    return [0, *sorted((1 + rng.permutation(PERIOD - 1)[: PLACES - 1]).tolist())]


def _bits(words: np.ndarray, repetition: int) -> np.ndarray:
    """The random bits of each word under a walk, one for each step of the period."""
    return mix64(words ^ mix64(np.array([repetition + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])


def _key(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(keys * np.uint64(0x9E3779B97F4A7C15) + words)


def _mixed(x: int) -> int:
    """``mix64`` of one number."""
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def item_keys(words: np.ndarray) -> list[tuple[int, list[int]]]:
    """(place in the item, keys) of every period of every walk over an item's hashed words; keys: of the first 1, 2, ... sampled places, the last one is looked up.

    A period that ends beyond the item has no key, unless the walk has no other: then the places that lie in the item make the first one's.
    """
    out, of = [], [int(w) for w in words]
    for r in range(REPETITIONS):
        bits, at, sampled, whole, cut = _bits(words, r).tolist(), 0, places(r), [], []
        while at < len(of):
            begin, key, keys, on = at, r + 1, [], set()
            for j in range(PERIOD):
                if at >= len(of):
                    break
                if j in sampled:
                    key = _mixed(key * 0x9E3779B97F4A7C15 + of[at])
                    keys.append(key - (1 << 64) if key >> 63 else key)
                    on.add(at)
                at += bits[at] >> j & 1
            if len(keys) == PLACES and len(on) >= SPREAD - (len(of) < SHORT):
                whole.append((begin, keys))
            elif begin == 0 and len(keys) < PLACES:
                cut.append((begin, keys))
            at += at == begin
        out += whole or cut
    return out


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item_key, words (hashed), n of the distinct items with words. benchmark: item_key, text."""

    def maker():
        memo = WordMemo()
        return lambda texts: [[word_hash(memo, _WORD.findall((t or "").lower())).view(np.int64) for t in texts]]

    one = benchmark.groupBy("item_key").agg(F.min("text").alias("text"))
    return row_pass(one, ["text"], "words array<long>", maker, ["item_key"]).withColumn("n", F.size("words")).where("n > 0")


def index_keys(items: DataFrame) -> DataFrame:
    """item_key, n and keys: struct(key, place, final: with fewer than PLACES places, first: its beginnings) of every item."""

    def maker():
        of = lambda words: [{"key": k[-1], "place": at, "final": len(k) < PLACES, "first": k} for at, k in item_keys(np.array(words, np.int64).view(np.uint64))]
        return lambda texts: [[of(w) for w in texts]]

    return row_pass(items, ["words"], "keys array<struct<key:bigint,place:int,final:boolean,first:array<bigint>>>", maker, ["item_key", "n"])


class Filter:
    """A table of key slots: a key that was put in is always found."""

    def __init__(self, n: int) -> None:
        self.slots = np.zeros(1 << max(12, min(FILTER_SLOTS.bit_length() - 1, int(16 * n + 1).bit_length())), bool)
        self.low = np.uint64(len(self.slots) - 1)

    def put(self, keys: np.ndarray) -> None:
        self.slots[(keys.view(np.uint64) & self.low).view(np.int64)] = True

    def some(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[(keys & self.low).view(np.int64)]


def slot_filter(keys: DataFrame, n: int) -> Filter:
    """The filter of n ``keys`` (key).

    Spark reduces the keys to the distinct slots that they fill, in rows of at most 8,192, and only these reach the driver: FILTER_SLOTS in all at most.
    """
    made = Filter(n)
    rows = keys.select(F.col("key").bitwiseAND(F.lit(len(made.slots) - 1)).alias("slot"))
    rows = rows.groupBy(F.shiftright("slot", 13).alias("part")).agg(F.collect_set("slot").alias("set"))
    for row in rows.toLocalIterator():
        made.put(np.array(row["set"], np.int64))
    return made


def telling_words(items: DataFrame, common: DataFrame, edits: float) -> DataFrame:
    """item_key, word: the ``most + 1`` distinct words that fewest items have, of every item that has a common key. items: item_key, n, words; common: item_key."""
    words = items.select("item_key", "n", F.explode(F.array_distinct("words")).alias("word"))
    held = materialise(words.groupBy("word").agg(F.count("*").alias("items")), "item-words")
    order = Window.partitionBy("item_key").orderBy("items", F.xxhash64("word"), "word")  # the words of one item
    ranked = words.join(common, "item_key", "left_semi").join(held, "word").withColumn("r", F.row_number().over(order))
    return ranked.where(F.col("r") <= F.floor(F.col("n") * edits + 1e-9) + 1).select("item_key", "word")


def found_keys(made: Filter, short: bool, texts: list[str | None], memo: WordMemo) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, places) of each text: those that the filter has, of every walk from every word."""
    gap = PERIOD + 1
    parts, begins, at = [], [], 0
    for t in texts:
        words = word_hash(memo, _WORD.findall(t.lower())) if t else np.zeros(0, np.uint64)
        begins.append(at)
        parts += [words, np.zeros(gap, np.uint64)]  # a walk can't cross the gap
        at += len(words) + gap
    stream = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    body = np.flatnonzero(stream)
    keys, spots = [], []
    for r in range(REPETITIONS):
        sampled, bits = places(r), _bits(stream, r)
        start = cur = body
        key = _key(np.full(len(body), r + 1, np.uint64), stream[body])
        for j in range(PERIOD):
            if j:
                cur = cur + ((bits[cur] >> np.uint64(j - 1)) & np.uint64(1)).astype(np.int64)
                if j in sampled:
                    key = _key(key, stream[cur])
            if j in sampled:
                ok = made.some(key)
                start, cur, key = start[ok], cur[ok], key[ok]
                if not len(start):
                    break
                if short or j == sampled[-1]:
                    keys.append(key.view(np.int64))
                    spots.append(start)
            if j == sampled[-1]:
                break
    if not keys:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(texts)
    key, spot = np.concatenate(keys), np.concatenate(spots)
    order = np.argsort(spot, kind="stable")
    key, spot = key[order], spot[order]
    ends = np.searchsorted(spot, [*begins[1:], at])
    cuts = [0, *ends.tolist()]
    return [(key[a:b], (spot[a:b] - begin).astype(np.int32)) for a, b, begin in zip(cuts, cuts[1:], begins)]


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance between the item and any stretch of the text, and the first end of such a stretch.

    Bit-parallel over the item's words (Myers 1999): one column of the table is two integers.
    """
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for j, w in enumerate(item.tolist()):
        masks[w] |= 1 << j
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for i, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def edits_of(n: int, edits: float) -> int:
    """Words of an item of n words that may be edited."""
    return int(edits * n + 1e-9)


def stretches(begins: list[int], n: int, most: int, size: int) -> list[tuple[int, int]]:
    """The parts of a text of ``size`` words where an item of n words that begins near one of the places may lie, those that touch as one."""
    out: list[tuple[int, int]] = []
    for place in sorted(set(begins)):
        lo, hi = max(0, place - most), min(size, place + n + most)
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def best_stretch(words: np.ndarray, parts: list[tuple[int, np.ndarray]], most: int) -> tuple[int, int, int] | None:
    """(distance, first word, end word) of the best place in the parts (first word, words) of a text, the first of equals, if it is close enough."""
    n, best, own = len(words), None, frozenset(words.tolist())
    for lo, text in parts:
        if sum(map(own.__contains__, text.tolist())) < n - most:
            continue  # every word that isn't edited is there
        distance, end = nearest(words, text)
        if distance <= most and (best is None or distance < best[0]):
            back, length = nearest(words[::-1], text[:end][::-1])
            best = (distance, max(0, lo + end - (length if back == distance else n)), lo + end)
    return best


def best_place(words: np.ndarray, text: np.ndarray, begins: list[int], most: int) -> tuple[int, int, int] | None:
    """``best_stretch`` of a whole text near the places where the item may begin."""
    return best_stretch(words, [(lo, text[lo:hi]) for lo, hi in stretches(begins, len(words), most, len(text))], most)


def text_key(text: Column) -> Column:
    """What tells texts apart in joins."""
    return F.unhex(F.md5(text))


def candidates(texts: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """text_key, of: struct(item_key, n, begins) of the items to verify in each text, some rows a text. texts: text_key, text; items: from ``distinct_items``."""
    keys = materialise(index_keys(items), "item-keys")
    flat = keys.select("item_key", "n", F.inline("keys"))
    n, cut = keys.agg(F.coalesce(F.sum(F.aggregate("keys", F.lit(0), lambda t, k: t + F.size(k["first"]))), F.lit(0)), F.coalesce(F.bool_or(F.exists("keys", lambda k: k["final"])), F.lit(False))).first()
    wanted = flat.select("item_key", "n", "key", "place").distinct()
    many = wanted.groupBy("key").agg(F.count_distinct("item_key").alias("items")).where(F.col("items") > COMMON_ITEMS).select("key", F.lit(True).alias("common"))
    wanted = materialise(wanted.join(many, "key", "left").withColumn("common", F.coalesce("common", F.lit(False))), "wanted-keys")
    common = wanted.where("common")
    telling = materialise(telling_words(items, common.select("item_key").distinct(), edits), "telling-words")
    tells = telling.select(F.col("word").alias("key")).distinct()
    shipped = texts.sparkSession.sparkContext.broadcast(
        (slot_filter(flat.select(F.explode("first").alias("key")), n), cut, slot_filter(common.select("key").distinct(), common.count()), slot_filter(tells, tells.count()))
    )

    def maker():
        memo = WordMemo()

        def make(texts):
            made, short, shared, telling = shipped.value
            found = found_keys(made, short, texts, memo)
            said = []
            for t, (k, _) in zip(texts, found, strict=True):
                words = np.zeros(0, np.uint64)
                if len(k) and shared.some(k.view(np.uint64)).any():
                    words = np.unique(word_hash(memo, _WORD.findall(t.lower())))
                    words = words[telling.some(words)]
                said.append(words.view(np.int64))
            return [f[0] for f in found], [f[1] for f in found], said

        return make

    found = row_pass(texts, ["text"], "keys array<long>, spots array<int>, said array<long>", maker, ["text_key"]).where(F.size("keys") > 0)
    found = materialise(found, "text-finds")
    # copies of a text have the same keys; where they meet in a task they are one row from here on
    held = found.select("text_key", F.inline(F.arrays_zip("keys", "spots"))).groupBy("text_key", F.col("keys").alias("key")).agg(F.collect_set("spots").alias("spots"))
    held = materialise(held, "text-keys")
    rare = held.join(wanted.where("not common").drop("common"), "key")
    said = found.where(F.size("said") > 0).select("text_key", F.explode("said").alias("word")).distinct()
    told = materialise(said.join(telling, "word").select("text_key", "item_key").distinct(), "told-pairs")
    shared = held.join(common.select("key").distinct(), "key", "left_semi").join(told, "text_key").join(common.drop("common"), ["item_key", "key"])
    begins = F.flatten(F.collect_list(F.transform("spots", lambda s: s - F.col("place"))))
    pairs = rare.unionByName(shared).groupBy("text_key", "item_key").agg(F.first("n").alias("n"), F.count("*").alias("matches"), F.array_distinct(begins).alias("begins"))
    pairs = pairs.where(F.col("matches") >= F.greatest(F.lit(1), F.floor(F.col("n") / MATCH_WORDS))).drop("matches")
    pairs = materialise(pairs, "pairs")
    sizes = materialise(pairs.groupBy("text_key").agg(F.count("*").alias("of")).where(F.col("of") > TOGETHER), "many-pairs")
    near = pairs.join(sizes, "text_key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("item_key"), F.ceil(F.col("of") / TOGETHER)), F.lit(0))).drop("of")
    return near.groupBy("text_key", "part").agg(F.collect_list(F.struct("item_key", "n", "begins")).alias("of")).drop("part")


def cut_out(rows: DataFrame, edits: float, keep: list[str]) -> DataFrame:
    """The columns ``keep``, item_key and parts: struct(lo, words, starts, ends) of each row and item of it, the stretches where the item may lie. rows: text, of (from ``candidates``)."""

    def maker():
        memo = WordMemo()

        def one(text, of):
            low, out = text.lower(), []
            words = word_hash(memo, _WORD.findall(low)).view(np.int64)
            spans = np.array([m.span() for m in _WORD.finditer(low)], np.int64).reshape(-1, 2) if len(low) == len(text) else None
            for c in of:
                parts = []
                for lo, hi in stretches(c["begins"], c["n"], edits_of(c["n"], edits), len(words)):
                    at = [spans[lo:hi, k] for k in (0, 1)] if spans is not None else [[], []]
                    parts.append({"lo": lo, "words": words[lo:hi], "starts": at[0], "ends": at[1]})
                out.append({"item_key": c["item_key"], "parts": parts})
            return out

        return lambda texts, of: [[one(t, c) for t, c in zip(texts, of, strict=True)]]

    cuts = "cuts array<struct<item_key:binary,parts:array<struct<lo:int,words:array<bigint>,starts:array<bigint>,ends:array<bigint>>>>>"
    return row_pass(rows, ["text", "of"], cuts, maker, keep).select(*keep, F.inline("cuts"))


def verified(cuts: DataFrame, items: DataFrame, edits: float, keep: list[str]) -> DataFrame:
    """The columns ``keep``, item_key, distance, n_item_words, first_char, end_char of the items that are close enough. cuts: from ``cut_out``; items: item_key, words."""

    def maker():
        def one(item, parts):
            item = np.array(item, np.int64).view(np.uint64)
            hit = best_stretch(item, [(p["lo"], np.array(p["words"], np.int64).view(np.uint64)) for p in parts], edits_of(len(item), edits))
            if not hit:
                return None
            at = (None, None)
            for p in parts:
                if p["starts"] and hit[2] > hit[1] >= p["lo"] and hit[2] <= p["lo"] + len(p["words"]):
                    at = (p["starts"][hit[1] - p["lo"]], p["ends"][hit[2] - 1 - p["lo"]])
            return {"distance": hit[0], "n_item_words": len(item), "first_char": at[0], "end_char": at[1]}

        return lambda words, parts: [[one(*x) for x in zip(words, parts, strict=True)]]

    rows = cuts.join(items.select("item_key", "words"), "item_key")
    found = row_pass(rows, ["words", "parts"], "hit struct<distance:int,n_item_words:int,first_char:int,end_char:int>", maker, [*keep, "item_key"])
    return found.where("hit is not null").select(*keep, "item_key", "hit.*")


def _items(benchmark: DataFrame) -> DataFrame:
    return need(benchmark, item_id=T.LongType(), text=T.StringType()).withColumn("item_key", text_key(F.col("text")))


def _hits(base: DataFrame, named: DataFrame, edits: float, keep: list[str]) -> DataFrame:
    """base: ``keep``, text, text_key. Out: from ``verified``, written."""
    items = materialise(distinct_items(named.where("text is not null")), "items")
    near = materialise(candidates(base.select("text_key", "text").where("text <> ''"), items, edits), "candidates")
    cuts = materialise(cut_out(base.join(near, "text_key").select(*keep, "text", "of"), edits, keep), "stretches")
    return materialise(verified(cuts, items, edits, keep), "hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, distance, n_item_words, first_char, end_char: the best place of each item in each row of ``docs``."""
    base = need(docs, doc_id=T.LongType(), text=T.StringType()).withColumn("text_key", text_key(F.col("text")))
    named = _items(benchmark)
    found = _hits(base, named, edits, ["doc_id"]).join(named.select("item_key", "item_id"), "item_key")
    return found.select("doc_id", "item_id", "distance", "n_item_words", "first_char", "end_char")


def clean_documents(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item."""
    key = free_name(docs, "text_key")
    base = docs.select(text_key(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    dirty = materialise(_hits(base, _items(benchmark), edits, ["text_key"]).select(F.col("text_key").alias(key)).distinct(), "dirty")
    return docs.withColumn(key, text_key(F.col("text").cast("string"))).join(dirty, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_cgk_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document."""
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), read(spark, sf_dir, "benchmark"))
