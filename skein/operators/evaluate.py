"""Folds, AUC, ROC points and comparisons of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scratch import materialise
from skein.functions.stats import fold_number, rank_average, shuffled, upper_tail


def folds(members: DataFrame, k: int = 10, seed: str = "fold") -> DataFrame:
    """name, node, fold of every member: shuffled by a seeded hash, then cut into k bins of equal width."""
    of = Window.partitionBy("name")
    i = F.row_number().over(of.orderBy(shuffled(seed, F.col("name"), F.col("node")), "node"))
    return members.select("name", "node", i.alias("i"), F.count("*").over(of).alias("n")).select("name", "node", fold_number(F.col("i"), F.col("n"), k).alias("fold"))


def auc(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """n_pos, n_neg and the AUC of each group, ties counted half: from the ranks of the positives. Null if a class is absent."""
    ranked = scored.withColumn("_r", rank_average(score, by)).withColumn("_y", F.coalesce(F.col(label).cast("int"), F.lit(0)))
    pos = F.sum("_y")
    neg = F.count("*") - pos
    u = F.sum(F.col("_r") * F.col("_y")) - pos * (pos + 1) / 2.0
    return ranked.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), u / (pos * neg)).alias("auc"))


#: Lists that scores of one run and bin are dealt to where they come as rows.
LISTS = 64


def score_bin(score: np.ndarray) -> np.ndarray:
    """Bins of whole numbers above zero: an eighth of what lies between two powers of two, rising with the number."""
    part, exponent = np.frexp(score.astype(np.float64))
    return exponent * 8 + np.floor((part - 0.5) * 16).astype(np.int64)


def score_bin_column(score: Column) -> Column:
    """The same of a column."""
    exponent = F.length(F.bin(score))
    return (exponent * 8 + F.floor((score / F.pow(F.lit(2.0), exponent) - 0.5) * 16)).cast("int")


def auc_of_lists(lists: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """As ``auc``, from lists of whole scores above zero; all other rows are counted, they tie behind.

    lists: ``by``, bin (``score_bin`` of the scores), pos, neg; totals: ``by``, n_pos, n_neg of all rows, listed or not. Within a bin negatives are
    counts of their distinct scores, between bins sums say how many lie below.
    """
    grouped = [*by, "bin"]

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {c: (np.empty(0, np.int64), np.empty(0, np.int64)) for c in ("pos", "neg")}
        for batch in batches:
            for c, (held, n) in sides.items():
                fresh = batch.column(c).flatten().to_numpy(zero_copy_only=False)
                values, at = np.unique(np.concatenate([held, fresh]), return_inverse=True)
                sides[c] = values, np.bincount(at, np.concatenate([n, np.ones(len(fresh), np.int64)]), len(values)).astype(np.int64)
        (pos, p), (neg, q) = sides["pos"], sides["neg"]
        below = np.concatenate([[0], np.cumsum(q)])
        won = int((p * (below[np.searchsorted(neg, pos)] + below[np.searchsorted(neg, pos, "right")])).sum())  # a tie counts one, a win two
        out = {c: pa.array([k.as_py()], k.type) for c, k in zip(grouped, key, strict=True)} | {"_won": [won], "_p": [int(p.sum())], "_q": [int(q.sum())]}
        yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in grouped)
    at = materialise(lists.groupBy(*grouped).applyInArrow(work, fields + ", _won long, _p long, _q long"), "won")
    lower = F.coalesce(F.sum("_q").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bin
    per = at.withColumn("_won", F.col("_won") / 2.0 + F.col("_p") * lower).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("_won", "_p", "_q")))
    joined = totals.join(per, by, "left").na.fill(0, ["_won", "_p", "_q"])
    zero = F.col("n_neg") - F.col("_q")  # negatives that aren't listed
    u = F.col("_won") + F.col("_p") * zero + (F.col("n_pos") - F.col("_p")) * zero / 2.0
    return joined.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def roc(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """threshold, tpr, fpr of each group at every distinct score. The rate of a class that the group lacks is null."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    at = scored.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    upto = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = Window.partitionBy(*by)
    rate = lambda c: F.try_divide(F.sum(c).over(upto), F.sum(c).over(of))
    return at.select(*by, "threshold", rate("p").alias("tpr"), rate("q").alias("fpr"))


def delong(scored: DataFrame, by: list[str], first: str, second: str, label: str = "label") -> DataFrame:
    """auc1, auc2, z, p of the difference of two scores' AUCs on the same rows, by placement values. Null if a class is absent."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    of = Window.partitionBy(*by)
    base = scored.withColumn("_y", y).withColumn("_m", F.sum("_y").over(of)).withColumn("_n", F.count("*").over(of) - F.sum("_y").over(of))
    for k, s in ((1, first), (2, second)):
        base = base.withColumn(f"_all{k}", rank_average(s, by)).withColumn(f"_own{k}", rank_average(s, [*by, "_y"]))
        other = F.when(F.col("_y") == 1, F.col("_n")).otherwise(F.col("_m"))
        share = F.try_divide(F.col(f"_all{k}") - F.col(f"_own{k}"), other)
        base = base.withColumn(f"_v{k}", F.when(F.col("_y") == 1, share).otherwise(1 - share))
    per = base.groupBy(*by, "_y").agg(F.count("*").alias("c"), F.avg("_v1").alias("a1"), F.avg("_v2").alias("a2"), F.var_samp("_v1").alias("s11"), F.var_samp("_v2").alias("s22"), F.covar_samp("_v1", "_v2").alias("s12"))
    var = F.sum((F.col("s11") + F.col("s22") - 2 * F.col("s12")) / F.col("c"))
    pick = lambda c: F.max(F.when(F.col("_y") == 1, F.col(c)))
    out = per.groupBy(*by).agg(pick("a1").alias("auc1"), pick("a2").alias("auc2"), var.alias("_var"))
    z = F.when(F.col("_var") > 0, (F.col("auc1") - F.col("auc2")) / F.sqrt("_var"))
    return out.withColumn("z", z).withColumn("p", 2 * upper_tail(F.abs("z"))).drop("_var")
