"""Numbers and the smallest keys within groups of any size, without ordering a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scratch import materialise
from skein.functions.stats import shuffled

#: Rows that one task numbers or orders.
BUCKET_ROWS = 20_000
#: Bins of the first three digits of a hexadecimal key.
BIN_DIGITS = 3


def numbered_within(rows: DataFrame, by: Sequence[str], key: str, name: str = "position") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within ``by``, in an order that the hash of ``key`` and then ``key`` decide. No column of these is null.

    Groups are dealt to hashed buckets of about ``BUCKET_ROWS`` rows; a bucket's numbers start behind those of the buckets before it.
    """
    sizes = materialise(rows.groupBy(*by).agg(F.count("*").alias("_n")), "group-sizes")
    dealt = rows.join(sizes, list(by)).withColumn("_b", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / BUCKET_ROWS))).drop("_n")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(F.xxhash64(key), key)) - 1
    return dealt.withColumn(name, place).join(offsets, [*by, "_b"]).withColumn(name, F.col(name) + F.col("_from")).drop("_b", "_from")


def smallest(rows: DataFrame, by: Sequence[str], key: str, tie: Sequence[str], most: Column | int, name: str = "r") -> DataFrame:
    """The rows of each ``by`` with the ``most`` smallest hexadecimal ``key``s, and ``name``: 1, 2, ... in order of ``key`` and ``tie``.

    Counts by the first digits of the key say up to which bin the smallest ones lie; only rows of these bins are ordered, which are ``most``
    and a 4096th of the group at the most likely, and each bin by itself. ``most`` may be a column that is the same throughout a group.
    """
    most = F.lit(most) if isinstance(most, int) else most
    binned = rows.withColumn("_bin", F.substring(key, 1, BIN_DIGITS)).withColumn("_most", most)
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.first("_most").alias("_most"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where(F.col("_before") < F.col("_most"))
    before = materialise(before.select(*by, "_bin", "_before"), "bins")  # a row a group and bin, written, so that rows of a large group aren't dealt by the group
    kept = binned.join(before, [*by, "_bin"])
    order = Window.partitionBy(*by, "_bin").orderBy(key, *tie)
    return kept.withColumn(name, (F.row_number().over(order) + F.col("_before")).cast("long")).where(F.col(name) <= F.col("_most")).drop("_bin", "_most", "_before")


def ranks(rows: DataFrame, by: Sequence[str], key: str, tie: Sequence[str], name: str = "r") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within ``by`` in order of the hexadecimal ``key`` and ``tie``. Each bin of the key's first digits is ordered by itself, behind the rows of the bins before it."""
    binned = rows.withColumn("_bin", F.substring(key, 1, BIN_DIGITS))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    before = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(key, *tie))
    return binned.withColumn(name, place).join(before, [*by, "_bin"]).withColumn(name, F.col(name) + F.col("_from")).drop("_bin", "_from")


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """``rows`` with ``name``, the same as ``stats.rank_average``, for groups of any size. No value or ``by`` is null.

    Distinct values with their counts are dealt by ranges; a range is ordered by itself, behind the rows of the ranges before it, and ties share what their value has.
    """
    spark = rows.sparkSession
    counts = materialise(rows.groupBy(*by, value).agg(F.count("*").alias("_n")), "value-counts")
    dealt = counts.repartitionByRange(4 * spark.sparkContext.defaultParallelism, *by, value).withColumn("_b", F.spark_partition_id())
    dealt = materialise(dealt, "value-ranges")
    step = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(step("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = dealt.groupBy(*by, "_b").agg(F.sum("_n").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    upto = Window.partitionBy(*by, "_b").orderBy(step(value)).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_from") + F.coalesce(F.sum("_n").over(upto), F.lit(0)) + (F.col("_n") + 1) / 2.0
    placed = materialise(dealt.join(F.broadcast(offsets), [*by, "_b"]).select(*by, value, rank.alias(name)), "value-ranks")
    return rows.join(placed, [*by, value])


def drawn_ranks(layer_nodes: DataFrame, sizes: DataFrame, trials: int, seed: str) -> DataFrame:
    """layer, trial, node, r: the first nodes of every layer in the order of each trial's hash, up to the layer's largest n. sizes: layer, n."""
    most = materialise(sizes.groupBy("layer").agg(F.max("n").alias("most")), "most")
    draws = layer_nodes.crossJoin(layer_nodes.sparkSession.range(1, trials + 1).select(F.col("id").alias("trial")))  # trials is a parameter, not data
    keyed = draws.join(F.broadcast(most), "layer").withColumn("key", shuffled(seed, F.col("layer"), F.col("trial"), F.col("node")))  # a row a layer
    return smallest(keyed, ["layer", "trial"], "key", ["node"], F.col("most")).select("layer", "trial", "node", "r")


def drawn_sets(layer_nodes: DataFrame, sizes: DataFrame, trials: int, seed: str) -> DataFrame:
    """layer, n, trial, node: for every size of a layer the first n of its nodes in the order of a trial's hash. sizes: layer, n."""
    wanted = materialise(sizes.select("layer", "n").distinct(), "sizes")
    return drawn_ranks(layer_nodes, wanted, trials, seed).join(wanted, "layer").where("r <= n").select("layer", "n", "trial", "node")
