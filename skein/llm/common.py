"""What the corpus operators share: reading, words, stable hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions.scratch import materialise, shared_dir, spread

__all__ = [
    "ROW", "WORD", "WordMemo", "documents", "free_name", "materialise", "mix64", "need", "numbered", "ranked", "read", "row_pass", "shared_dir", "split_words", "spread", "word_hash",
]

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns asked for of ``documents``, over all cores."""
    return spread(read(spark, sf_dir, "documents").select(*columns))


def need(df: DataFrame, **kinds: T.DataType) -> DataFrame:
    """The named columns only, cast; further columns of the caller can't clash with ours."""
    missing = [c for c in kinds if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()))


#: A column that numbers rows; no table of the caller has it.
ROW = "_skein_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` in the shared folder with a number for each row, the same at every reread."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def split_words(text: Column) -> Column:
    """The words of a text as an array, empty for null: one pass of built-in functions."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(blank, " "), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Rows that a task holds as Python objects at once, whatever the session's Arrow batches hold.
PASS_ROWS = 512


def row_pass(df: DataFrame, inputs: Sequence[str], fields: str, maker: Callable[[], Callable], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` (all by default) and the ``fields`` that a function makes of ``inputs``.

    ``maker`` is called once a task; the function that it gives takes the inputs as lists, a part of a batch at a time,
    and returns a list for each field. Kept columns stay Arrow data: no value, null or number of 64 bits changes.
    """
    kept = list(df.columns if keep is None else keep)
    new = T.StructType.fromDDL(fields)
    kinds = to_arrow_schema(new)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            for k in range(0, batch.num_rows, PASS_ROWS):
                part = batch.slice(k, PASS_ROWS)
                made = make(*(part.column(c).to_pylist() for c in inputs))
                arrays = [part.column(c) for c in kept] + [pa.array(v, f.type, from_pandas=False) for v, f in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *kinds.names])

    return df.mapInArrow(work, T.StructType([*(df.schema[c] for c in kept), *new.fields]))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows that one task orders when rows are numbered.
BUCKET_ROWS = 20_000


def ranked(rows: DataFrame, by: Sequence[str], tie: Column, uid: str, name: str = "rank", limit: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``name``, 0, 1, ... within the columns ``by`` (null is a value), in an order that ``tie`` decides and ``uid`` completes.

    A group of more than ``limit`` rows is dealt to buckets by ``tie``, and a bucket that rows of one ``tie`` fill by
    ``uid``, so no task orders much more than ``limit`` rows; buckets follow each other by offsets.
    """
    g, t, b, n = "_skein_g", "_skein_t", "_skein_b", "_skein_n"
    keyed = rows.withColumn(g, F.xxhash64(*by, *(F.col(c).isNull() for c in by))).withColumn(t, tie)
    large = materialise(keyed.groupBy(g).agg(F.count("*").alias(n)).where(F.col(n) > limit), "large-groups")
    if not large.limit(1).count():
        one = Window.partitionBy(g).orderBy(t, uid)
        return keyed.withColumn(name, F.row_number().over(one) - 1).drop(g, t)
    deal = lambda by_column, share: F.coalesce(F.pmod(by_column, F.ceil(F.col(n) / share)), F.lit(0)).cast("long")
    keyed = keyed.join(large, g, "left").withColumn(b, deal(F.col(t), limit)).drop(n)
    full = materialise(keyed.join(large.select(g), g, "left_semi").groupBy(g, b).agg(F.count("*").alias(n)).where(F.col(n) > 4 * limit), "full-buckets")
    keyed = keyed.join(full, [g, b], "left").withColumn(b, F.col(b) * (1 << 32) + deal(F.xxhash64(uid), limit)).drop(n)
    sizes = materialise(keyed.join(large.select(g), g, "left_semi").groupBy(g, b).agg(F.count("*").alias(n)), "bucket-sizes")
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = materialise(sizes.select(g, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n)), "offsets")
    inside = F.row_number().over(Window.partitionBy(g, b).orderBy(t, uid)) - 1
    return keyed.withColumn(name, inside).join(offsets, [g, b], "left").withColumn(name, F.col(name) + F.coalesce(n, F.lit(0))).drop(g, t, b, n)


class WordMemo(dict):
    """The hashes of up to ``room`` words."""

    def __init__(self, room: int = 400_000) -> None:
        super().__init__()
        self.room = room

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hash(memo: WordMemo, words: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word. ``memo`` speeds up repeats and is emptied when it is full."""
    if len(memo) > memo.room:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
