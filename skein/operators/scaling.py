"""Planes from dissimilarities: classical scaling and Kruskal's non-metric scaling.

Dissimilarities stay a table of pairs; coordinates are a row an item, written every round. A round is a join of the two and sums, and only
sums of a few numbers, and the means by distinct dissimilarity, reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scratch import materialise

#: Columns of the subspace that is iterated, from which the best two directions are taken, and its rounds.
COLUMNS = 4
ROUNDS = 25
#: Digits to which dissimilarities are told apart when they are ranked, so that there are at most 10 ** DIGITS + 1 of them between 0 and 1.
DIGITS = 4


def both_orders(pairs: DataFrame) -> DataFrame:
    """i, j, d in both orders. pairs: i, j, d, each pair once."""
    return materialise(pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")), "both-orders")


def _centred(frame: DataFrame, columns: list[str]) -> DataFrame:
    means = frame.agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    return frame.crossJoin(F.broadcast(means)).select("i", *((F.col(c) - F.col(f"m_{c}")).alias(c) for c in columns))  # one row


def _gram(frame: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    row = frame.agg(*(F.sum(F.col(a) * F.col(b)) for a in left for b in right)).first()
    return np.array(row, float).reshape(len(left), len(right))


def _times(frame: DataFrame, columns: list[str], matrix: np.ndarray, names: list[str]) -> DataFrame:
    return frame.select("i", *(sum((float(matrix[k, c]) * F.col(x) for k, x in enumerate(columns)), F.lit(0.0)).alias(n) for c, n in enumerate(names)))


def classical_plane(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """i, x, y: the two leading principal coordinates of the dissimilarities d of all pairs (i, j, d, each once).

    The doubly centred squares are never written: a product with them is a sum along the pairs, then centred. Subspace iteration with
    Gram matrices of ``COLUMNS`` squared numbers; the directions of the largest eigenvalues, none below zero, are taken.
    """
    both = both_orders(pairs)
    squares = both.select("i", "j", (F.col("d") * F.col("d")).alias("q"))
    names = [f"c{k}" for k in range(COLUMNS)]
    product = [f"b{k}" for k in range(COLUMNS)]
    start = both.select("i").distinct().select("i", *((F.pmod(F.xxhash64("i", F.lit(k)), F.lit(10007)) / 10007.0).alias(c) for k, c in enumerate(names)))
    state = materialise(_centred(start, names), "subspace")

    def multiplied(frame: DataFrame) -> DataFrame:
        at = squares.join(frame.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*((-0.5 * F.sum(F.col("q") * F.col(c))).alias(p) for c, p in zip(names, product, strict=True)))
        return materialise(_centred(at, product), "subspace")

    for _ in range(rounds):
        made = multiplied(state)
        values, vectors = np.linalg.eigh(_gram(made, product, product))
        scale = np.where(values > values.max() * 1e-14, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0) if values.max() > 0 else np.zeros(COLUMNS)
        state = materialise(_times(made, product, vectors * scale, names), "subspace")
    both_of = state.join(multiplied(state), "i")
    inner = _gram(both_of, names, product)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(values)[::-1][:2]
    return _times(state, names, vectors[:, order] * np.sqrt(np.maximum(values[order], 0)), ["x", "y"])


def monotone(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted least-squares fit of y that never falls: neighbours that do are pooled."""
    means, sizes, lengths = [], [], []
    for v, w in zip(y.tolist(), weights.tolist(), strict=True):
        mean, size, length = v, w, 1
        while means and means[-1] >= mean:
            m, s = means.pop(), sizes.pop()
            mean, size, length = (mean * size + m * s) / (size + s), size + s, length + lengths.pop()
        means.append(mean)
        sizes.append(size)
        lengths.append(length)
    return np.repeat(means, lengths)


def kruskal_plane(pairs: DataFrame, rounds: int = 30, least_gain: float = 1e-4, digits: int = DIGITS) -> tuple[DataFrame, list[float]]:
    """(i, x, y), the stress of each round: a plane whose distances rise with the dissimilarities d of all pairs (i, j, d, each once), from the classical one.

    In a round the plane's distances are averaged by dissimilarity, to ``digits``, and fitted by pooled monotone regression; the plane then moves by the
    majorising step towards the fitted distances, so the stress never rises. It ends after ``rounds`` or when a round gains less than ``least_gain``.
    """
    plane = materialise(classical_plane(pairs), "plane")
    both = both_orders(pairs.withColumn("d", F.round("d", digits)))
    n = plane.count()
    history: list[float] = []
    for _ in range(rounds):
        joined = both.join(plane, "i").join(plane.select(F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v")), "j")
        apart = materialise(joined.withColumn("far", F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)), "apart")
        found = apart.groupBy("d").agg(F.avg("far").alias("far"), F.sum(F.col("far") * F.col("far")).alias("squares"), F.count("*").alias("n")).toArrow().sort_by("d")
        d, far, squares, count = (found.column(c).to_numpy() for c in ("d", "far", "squares", "n"))
        fitted = monotone(far, count)
        norm = np.sqrt(n * (n - 1) / max((count * fitted**2).sum(), 1e-300))  # the fitted distances keep one size
        fitted = fitted * norm
        stress = float(np.sqrt(max((squares - 2 * fitted * far * count + fitted**2 * count).sum(), 0) / max((fitted**2 * count).sum(), 1e-300)))
        if history and history[-1] - stress < least_gain:
            break
        history.append(stress)
        wanted = plane.sparkSession.createDataFrame(list(zip(d.tolist(), fitted.tolist(), strict=True)), "d double, fit double")
        pull = F.when(F.col("far") > 1e-12, F.col("fit") / F.col("far")).otherwise(0.0)
        moved = apart.join(F.broadcast(wanted), "d").groupBy("i").agg(*((F.sum(pull * (F.col(a) - F.col(b))) / n).alias(a) for a, b in (("x", "u"), ("y", "v"))))
        plane = materialise(moved, "plane")
    return plane, history
