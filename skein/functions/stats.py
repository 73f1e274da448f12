"""Statistics as column expressions and small frame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_average(value: str, by: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank whose ties share their mean. Nulls rank last. Without ``by`` all rows meet in one task: for summaries only."""
    c = F.col(value)
    order = Window.partitionBy(*by).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def adjusted(frame: DataFrame, p: str, name: str = "adjusted", by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg values over the non-null ``p`` of all rows, or of each ``by``."""
    m = F.count(p).over(Window.partitionBy(*by))
    ranked = frame.withColumn("_m", m).withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())))
    ranked = ranked.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_rn")))
    falling = Window.partitionBy(*by).orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(falling)))).drop("_m", "_rn", "_q")


def cut_right(x: Column, breaks: Sequence[float], labels: Sequence[str], lowest: bool = False) -> Column:
    """Label of the interval (break, next break] that holds x, null outside; ``lowest`` closes the first one."""
    out = None
    for lo, hi, label in zip(breaks, breaks[1:], labels, strict=False):
        inside = (x > lo) & (x <= hi)
        if lowest and lo == breaks[0]:
            inside = (x >= lo) & (x <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


#: Coefficients of the rational form of the complementary error function (relative error below 1.2e-7), fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + t * series
    tail = t * F.exp(-x * x + series) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def upper_tail_sql(z: str) -> str:
    """The same in SQL."""
    x = f"(abs({z}) / {2**0.5!r})"
    t = f"(1 / (1 + {x} / 2))"
    series = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = f"({c!r} + {t} * {series})"
    tail = f"({t} * exp(-{x} * {x} + {series}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


def fold_number(i: Column, n: Column, k: int) -> Column:
    """Fold 1..k of the i-th of n shuffled members: bins of equal width over 1..n, closed on the right."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(((i - 1) * k + n - 2) / (n - 1)))).cast("int")


def shuffled(*parts: Column | str) -> Column:
    """A key whose order is a reproducible shuffle: the MD5 of the parts."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))
