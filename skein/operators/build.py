"""Networks from memberships, similarities and other networks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions.scratch import materialise

#: Sizes of the groups that make links in the thresholded network.
MIN_GROUP, MAX_GROUP = 2, 300


def canonical(el: DataFrame, a: str = "a", b: str = "b", distinct: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges without null ends and self-loops, ends in order; with ``distinct`` each pair once and without further columns."""
    kept = el.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    ends = [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    if distinct:
        return kept.select(*by, *ends).distinct()
    return kept.select(*ends, *(F.col(c) for c in el.columns if c not in (a, b)))


def graph_nodes(el: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of the graph view: ends of any edge, self-loops too, so a node with only a loop stays as an isolate."""
    return el.select(*by, F.col(a).alias("node")).union(el.select(*by, F.col(b).alias("node"))).where("node is not null").distinct()


def co_membership(members: DataFrame, least: int = MIN_GROUP, most: int | None = None) -> DataFrame:
    """layer, a, b, n: pairs that share a group, with the number of shared groups. members: layer, grp, node, distinct.

    Groups outside the sizes asked for are dropped before the self-join. Without ``most`` every group counts.
    """
    return _co_members(members, least, most).groupBy("layer", "a", "b").agg(F.count("*").alias("n"))


def co_member_pairs(members: DataFrame) -> DataFrame:
    """a, b: the pairs of ``co_membership`` in any layer, each once, in one shuffle of the pairs."""
    return _co_members(members, MIN_GROUP, None).select("a", "b").distinct()


def _co_members(members: DataFrame, least: int, most: int | None) -> DataFrame:
    """layer, a, b: a row for each pair and group that it shares."""
    fit = members
    if most is not None or least > 2:
        size = F.count("*").over(Window.partitionBy("layer", "grp"))
        fit = members.withColumn("size", size).where(F.col("size") >= least).where(F.lit(True) if most is None else F.col("size") <= most).drop("size")
    x, y = fit.alias("x"), fit.alias("y")
    pairs = x.join(y, (F.col("x.layer") == F.col("y.layer")) & (F.col("x.grp") == F.col("y.grp")) & (F.col("x.node") < F.col("y.node")))
    return pairs.select(F.col("x.layer").alias("layer"), F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def degrees(edges: DataFrame) -> DataFrame:
    """layer, node, k."""
    return both_ways(edges).groupBy("layer", F.col("src").alias("node")).agg(F.count("*").alias("k"))


def both_ways(edges: DataFrame) -> DataFrame:
    """layer, src, dst of every edge in both directions: one pass, no second scan."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return edges.select("layer", ends.alias("e")).select("layer", "e.src", "e.dst")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """name, layer, a, b: the edges whose ends are both members of the set. members: name, node."""
    first = edges.join(members.select("name", F.col("node").alias("a")), "a")
    return first.join(members.select("name", F.col("node").alias("b")), ["name", "b"]).select("name", "layer", "a", "b")


def multiplicity(edges: DataFrame) -> DataFrame:
    """a, b, layers: in how many layers an edge is."""
    return edges.groupBy("a", "b").agg(F.count("*").alias("layers"))


#: Vectors of a block; each pair of blocks is one matrix product in a task.
BLOCK = 512
#: Blocks of one side that a task meets with as many of the other: a side is read once for each so many blocks of the other.
BLOCKS_A_TASK = 64


def _block_products(vectors: DataFrame, block: int, further: list[str], made, fields: str) -> DataFrame:
    """What ``made(i, j, w, left, right)`` gives, as columns of ``fields``, for each pair of blocks: the nodes of both, their cosines, and the ``further`` columns of both.

    vectors: node (long), embedding, ``further`` (double). A task reads ``BLOCKS_A_TASK`` blocks of either side from the shared tables, so only the vectors themselves
    are shuffled, whatever the number of pairs; blocks stay Arrow data, in the numbers that the vectors come in, and become doubles in the task.
    """
    count = max(1, -(-vectors.count() // block))
    columns = ["node", *further]
    held = [F.collect_list(c).alias(c) for c in columns] + [F.collect_list("embedding").alias("rows")]
    blocks = vectors.where("embedding is not null").groupBy(F.pmod(F.xxhash64("node"), F.lit(count)).alias("block")).agg(*held)
    blocks = materialise(blocks, "blocks")
    names = [*columns, "rows"]
    parts = min(count, max(-(-count // BLOCKS_A_TASK), math.isqrt(4 * vectors.sparkSession.sparkContext.defaultParallelism) + 1))
    x, y = (blocks.repartition(parts, "block").select(*(F.col(c).alias(f"{side}_{c}") for c in names)) for side in "xy")
    kinds = to_arrow_schema(T.StructType.fromDDL(fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(batch: pa.RecordBatch, side: str, k: int) -> dict[str, np.ndarray]:
            out = {c: batch.column(f"{side}_{c}")[k].values.to_numpy(zero_copy_only=False) for c in columns}
            m = batch.column(f"{side}_rows")[k].values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(out["node"]), -1)
            return out | {"unit": m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)}

        for batch in batches:
            for k in range(batch.num_rows):
                left, right = of(batch, "x", k), of(batch, "y", k)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made(left["node"], right["node"], left["unit"] @ right["unit"].T, left, right), kinds, strict=True)], names=kinds.names)

    return x.crossJoin(y.hint("shuffle_replicate_nl")).mapInArrow(work, fields)  # every part of one side with every part of the other, no rows of pairs are dealt


def cosine_pairs(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """i, j, w: the positive cosine similarities of all ordered pairs of unlike nodes. vectors: node (long), embedding. Only pairs above zero leave a task."""

    def made(i, j, w, left, right):
        a, b = np.nonzero((w > 0) & (i[:, None] != j[None, :]))
        return i[a], j[b], w[a, b]

    return _block_products(vectors.select("node", "embedding"), block, [], made, "i long, j long, w double")


def _apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return i[:, None] != j[None, :]


def _floor(vectors: DataFrame, block: int) -> float:
    """The least positive cosine of a pair, rounded up to hundredths; infinite if no pair is positive."""

    def least(i, j, w, left, right):
        some = w[(w > 0) & _apart(i, j)]
        return ([some.min()],) if len(some) else ([],)

    low = _block_products(vectors, block, [], least, "w double").agg(F.ceil(F.min("w") * 100) / 100).first()[0]
    return float("inf") if low is None else float(low)


def _with_strengths(vectors: DataFrame, floor: float, block: int) -> DataFrame:
    """``vectors`` with s and k: the sum and the number of a node's cosines above ``floor``. A row a node and block leaves the tasks."""

    def sums(i, j, w, left, right):
        kept = (w > floor) & _apart(i, j)
        return j, (w * kept).sum(axis=0), kept.sum(axis=0)

    strength = _block_products(vectors, block, [], sums, "node long, s double, k long").groupBy("node").agg(F.sum("s").alias("s"), F.sum("k").cast("double").alias("k"))
    return vectors.join(materialise(strength, "strengths"), "node")


def strong_pairs(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """i, j, w: ``drop_weakest`` of ``cosine_pairs``, without writing these: block products are made for the least weight and again for the pairs above it."""
    vectors = materialise(vectors.select("node", "embedding"), "vectors")
    floor = _floor(vectors, block)

    def made(i, j, w, left, right):
        a, b = np.nonzero((w > floor) & _apart(i, j))
        return i[a], j[b], w[a, b]

    return _block_products(vectors, block, [], made, "i long, j long, w double")


def vector_disparity(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """i, j, w, p: ``disparity`` of ``strong_pairs``. Pairs go from the block products straight to the caller; only strengths are grouped."""
    vectors = materialise(vectors.select("node", "embedding"), "vectors")
    floor = _floor(vectors, block)
    full = _with_strengths(vectors, floor, block)

    def made(i, j, w, left, right):
        a, b = np.nonzero((w > floor) & _apart(i, j))
        v = w[a, b]
        return i[a], j[b], v, (1 - v / right["s"][b]) ** (right["k"][b] - 1)

    return _block_products(full, block, ["s", "k"], made, "i long, j long, w double, p double")


def vector_backbone(vectors: DataFrame, alpha: float = 0.05, block: int = BLOCK, width: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(i, j, w), (bin, n): the pairs i < j above the weakest that are significant from both ends, and all pairs above the weakest by ``width`` of the similarity.

    The same as ``backbone`` of ``disparity`` of ``drop_weakest`` of all pairs, without writing these: block products are made three times, for the least weight,
    for each node's strength and number of neighbours, and for the pairs, so what leaves the tasks is a number, a row a node and block, and significant pairs.
    These go to the caller and aren't written: their number may grow with the square of the vectors.
    """
    vectors = materialise(vectors.select("node", "embedding"), "vectors")
    floor = _floor(vectors, block)
    full = _with_strengths(vectors, floor, block)

    def pairs(i, j, w, left, right):
        kept = (w > floor) & (i[:, None] < j[None, :])
        a, b = np.nonzero(kept)
        v = w[a, b]
        p, q = (1 - v / right["s"][b]) ** (right["k"][b] - 1), (1 - v / left["s"][a]) ** (left["k"][a] - 1)
        both = (p < alpha) & (q < alpha)
        return i[a][both], j[b][both], v[both]

    def bins(i, j, w, left, right):
        at, n = np.unique(np.floor(w[(w > floor) & (i[:, None] < j[None, :])] / width).astype(np.int64), return_counts=True)
        return at, n

    counts = _block_products(vectors, block, [], bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return _block_products(full, block, ["s", "k"], pairs, "i long, j long, w double"), counts


def drop_weakest(weights: DataFrame, times: int = 1) -> DataFrame:
    """i, j, w without the diagonal and without what is at most the least weight rounded up to hundredths, ``times`` over."""
    left = weights.where("i <> j")
    for _ in range(times):
        floor = left.agg((F.ceil(F.min("w") * 100) / 100).alias("floor"))
        left = left.crossJoin(F.broadcast(floor)).where("w > floor").drop("floor")  # one row
    return left


def disparity(weights: DataFrame) -> DataFrame:
    """i, j, w, p with p = (1 - w / strength of j) ^ (neighbours of j - 1). weights: both directions of each pair."""
    of = Window.partitionBy("j")
    return weights.select("i", "j", "w", F.pow(1 - F.col("w") / F.sum("w").over(of), F.count("*").over(of) - 1).alias("p"))


def backbone(scored: DataFrame, alpha: float = 0.05) -> DataFrame:
    """i, j, w of the pairs that are significant in both directions."""
    kept = scored.where(F.col("p") < alpha)
    back = kept.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return kept.where("i < j").join(back, ["i", "j"], "left_semi").select("i", "j", "w")


def edge_key(a: Column, b: Column) -> Column:
    """One string for an undirected edge."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))
