"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts on a shard dealt by hash; then, round by round,
the documents of a group on minority shards ask to move to the shard where most of their group is, weighed
with the room there, and a request is granted with the probability at which the shard's free quota suffices. At
the end, the rows beyond a shard's exact quota move to the shards that have room, unlinked ones first.
Law ``rows``: shard sizes differ by one row at most.

State is one row for each (group, shard), so a group of any size is a few rows and all moves of a round
are joins and sums over them; groups of one document never enter. Per-shard tables have one row a shard.

Documents are dealt and numbered by their doc_id and text, so a table gives one layout however it is split; only rows
equal in both may change places.

Cases. Null text: an empty text. Null doc_id: as any other value. Repeated rows: rows of their own, linked by
their text. Columns named ``shard`` or ``slot``: ``sharded`` puts its own in their place. Ties: the lower hash, then the lower shard. Fewer rows than shards: some shards are empty. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import ROW, documents, free_name, materialise, numbered, ranked

SHARDS = 40
ROUNDS = 6


def _share(key: Column, *salt: Column) -> Column:
    """A number in [0, 1) that only its arguments decide."""
    return F.pmod(F.xxhash64(key, *salt), F.lit(1 << 30)) / float(1 << 30)


def _quotas(n: int, shards: int) -> Column:
    """Rows of the shard in column ``shard``: n / shards, the first ones one more."""
    return F.lit(n // shards) + F.when(F.col("shard") < n % shards, 1).otherwise(0)


def propagate(cells: DataFrame, outside: DataFrame, n: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """New shards of grouped documents. cells: key, shard, n of the linked groups, one row each; outside: shard, n of the rest.

    Out: key, shard (before), to, moved share: the fraction of the cell's documents that moves to ``to``.
    The cells keep their first shard as ``origin``, so documents are only touched once, at the end.
    """
    state = cells.select("key", F.col("shard").alias("origin"), "shard", "n")
    capacity = max(1.0, n / shards)
    for turn in range(rounds):
        now = state.groupBy("key", "shard").agg(F.sum("n").alias("n"))
        loads = (
            state.select("shard", "n").unionByName(outside.select("shard", "n")).groupBy("shard").agg(F.sum("n").alias("load"))
        )
        group = Window.partitionBy("key").orderBy(F.desc("score"), F.xxhash64("key", "shard", F.lit(turn)), "shard")
        # a group has a row for each shard at most, so this window is bounded by the number of shards
        scored = now.join(F.broadcast(loads), "shard").withColumn("score", F.col("n") / F.sum("n").over(Window.partitionBy("key")) - 0.05 * F.col("load") / capacity)
        best = scored.withColumn("r", F.row_number().over(group)).where("r = 1").select("key", F.col("shard").alias("to"))
        asked = materialise(state.join(best, "key"), f"asked-{turn}")
        # what a shard takes in: its free quota and what its unlinked documents can vacate
        room = (
            loads.join(outside.withColumnRenamed("n", "free"), "shard", "left")
            .select(F.col("shard").alias("to"), F.greatest(F.lit(0.0), capacity - F.col("load") + F.coalesce("free", F.lit(0))).alias("room"))
        )
        wanted = asked.where("to <> shard").groupBy("to").agg(F.sum("n").alias("wanted"))
        grant = room.join(wanted, "to").select("to", (F.col("room") / F.col("wanted")).alias("grant"))
        granted = asked.join(F.broadcast(grant), "to", "left").withColumn(
            "go", (F.col("to") != F.col("shard")) & (_share(F.col("key"), F.col("to"), F.lit(turn)) < F.col("grant"))
        )
        # a whole group moves at once or, where it alone is more than the room, the part that fits
        big = (F.col("to") != F.col("shard")) & (F.col("n") > F.col("grant") * F.col("n")) & (F.col("n") > 0.5 * capacity) & (F.col("grant") < 1)
        part = F.floor(F.col("n") * F.least(F.lit(1.0), F.col("grant"))).cast("long")
        moves = granted.withColumn(
            "moving", F.when(big, part).when(F.coalesce("go", F.lit(False)), F.col("n")).otherwise(F.lit(0)).cast("long")
        )
        state = materialise(
            moves.select("key", "origin", F.inline(F.array(
                F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("moving")).alias("n")),
                F.struct(F.col("to").alias("shard"), F.col("moving").alias("n")),
            ))).where("n > 0").groupBy("key", "origin", "shard").agg(F.sum("n").alias("n")), f"cells-{turn}",
        )
        if not moves.where("moving > 0").limit(1).count():
            break
    return state


def assign(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """uid, shard, slot of each row. rows: uid, doc_id, key (equal for linked documents), materialised."""
    n = rows.count()
    order = F.xxhash64("doc_id", "key", F.lit(3))
    first = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", F.lit(1)), F.lit(shards)).cast("int"))
    # written before it is joined back, so that adaptive execution can split the rows of a very large group
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "members")
    linked = materialise(first.join(sizes, "key", "left"), "linked")
    cells = linked.where("members > 1").groupBy("key", "shard").agg(F.count("*").alias("n"))
    outside = materialise(linked.where("members is null").groupBy("shard").agg(F.count("*").alias("n")), "outside")
    moved = propagate(materialise(cells, "cells"), outside, n, shards, rounds)

    # the k-th document of (key, origin) goes where the running total of that cell's parts says
    pieces = moved.groupBy("key", F.col("origin").alias("shard")).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("parts"))
    pieces = materialise(pieces, "pieces")
    single = linked.where("members is null").select("uid", "doc_id", "key", "shard", F.lit(1).alias("loose"))
    whole = pieces.where(F.size("parts") == 1)
    grouped = linked.where("members > 1").select("uid", "doc_id", "key", "shard")
    simple = grouped.join(whole, ["key", "shard"]).select("uid", "doc_id", "key", F.col("parts")[0]["shard"].alias("shard"), F.lit(0).alias("loose"))
    split = grouped.join(pieces.where(F.size("parts") > 1), ["key", "shard"])
    split = ranked(split, ["key", "shard"], order, "uid")
    ends = F.transform("parts", lambda p, k: F.struct(p["shard"].alias("shard"), F.aggregate(F.slice("parts", 1, k + 1), F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("end")))
    split = split.select("uid", "doc_id", "key", F.filter(ends, lambda p: F.col("rank") < p["end"])[0]["shard"].alias("shard"), F.lit(0).alias("loose"))
    wanted = materialise(single.unionByName(simple).unionByName(split), "wanted")

    # exact quotas: unlinked rows have the last numbers of a shard, and those beyond its quota fill the other shards
    bound = wanted.groupBy("shard").agg(F.count_if(F.col("loose") == 0).alias("bound"))  # one row a shard
    placed = ranked(wanted, ["shard", "loose"], order, "uid").join(F.broadcast(bound), "shard")
    placed = materialise(placed.select("uid", "shard", F.when(F.col("loose") == 1, F.col("rank") + F.col("bound")).otherwise(F.col("rank")).alias("rank")), "ranked")
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(placed.groupBy("shard").agg(F.count("*").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"), _quotas(n, shards).alias("quota"))
    up_to = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loads = loads.withColumn("over", F.greatest(F.lit(0), F.col("load") - F.col("quota"))).withColumn("short", F.greatest(F.lit(0), F.col("quota") - F.col("load")))
    loads = materialise(
        loads.withColumn("over_from", F.sum("over").over(up_to) - F.col("over")).withColumn("short_from", F.sum("short").over(up_to) - F.col("short")).coalesce(1), "loads"
    )  # one row a shard
    stay = placed.join(F.broadcast(loads.select("shard", "quota", "over_from")), "shard")
    kept = stay.where("rank < quota").select("uid", "shard", F.col("rank").alias("slot"))
    leaving = stay.where("rank >= quota").select("uid", (F.col("over_from") + F.col("rank") - F.col("quota")).alias("place"))
    holes = F.broadcast(loads.where("short > 0").select("shard", "load", "short_from", "short"))
    filled = leaving.join(holes, (F.col("place") >= F.col("short_from")) & (F.col("place") < F.col("short_from") + F.col("short"))).select(
        "uid", "shard", (F.col("load") + F.col("place") - F.col("short_from")).alias("slot")
    )
    return kept.unionByName(filled)


def _described(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "uid", "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.md5(text), F.octet_length(text)).alias("key"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """uid, doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    uid = F.col(ROW).alias("uid") if ROW in docs.columns else F.monotonically_increasing_id().alias("uid")
    rows = materialise(_described(docs.select(uid, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "described")
    return rows.join(assign(rows.select("uid", "doc_id", "key"), shards, rounds), "uid")


def op6_label_propagation(spark, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, over 40 shards."""
    found = shard_documents(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with its own columns and shard, slot."""
    rows = numbered(docs)
    place = free_name(docs, "place")
    found = shard_documents(rows, shards).select(F.col("uid").alias(ROW), F.struct("shard", "slot").alias(place))
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.join(found, ROW).select(*own, F.col(f"`{place}`.shard").cast("int").alias("shard"), F.col(f"`{place}`.slot").cast("long").alias("slot"))
