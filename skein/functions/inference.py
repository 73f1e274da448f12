"""Tails of distributions as column expressions, and tests on ranks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.stats import adjusted, rank_average, upper_tail

#: Terms of the continued fraction; halvings of an interval.
TERMS = 120
HALVINGS = 45
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0: Stirling's series, seven steps up, where it is exact to 1e-12."""
    y = x + 7
    low = sum((F.log(x + k) for k in range(1, 7)), F.log(x))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - low


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    safe = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))

    def go(state: Column, term: Column) -> Column:
        d = 1 / safe(1 + term * state["d"])
        c = safe(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def two(state: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return go(go(state, even), odd)

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, two, lambda s: s["h"])


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0, 0 below x = 0 and 1 above x = 1."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    turn = x > (a + 1) / (a + b + 2)
    p, q, at = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b), F.when(turn, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.log(at) + q * F.log(1 - at)) / p
    part = front * _fraction(p, q, at)
    return F.when(x.isNull() | a.isNull() | b.isNull(), None).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(turn, 1 - part).otherwise(part))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's distribution."""
    return F.when(t.isNull() | (df <= 0), None).otherwise(beta_cdf(df / (df + t * t), df / 2, F.lit(0.5)))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    return F.when(f <= 0, 1.0).otherwise(beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2))


def beta_quantile(p: Column, a: Column, b: Column) -> Column:
    """x at which the beta distribution reaches p, by halving."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = beta_cdf(mid, a, b) < p
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, half, lambda s: (s["lo"] + s["hi"]) / 2)


def binomial_interval(x: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The exact (Clopper-Pearson) interval of a share of x in n."""
    x, n, tail = x.cast("double"), n.cast("double"), (1 - level) / 2
    low = F.when(x <= 0, 0.0).otherwise(beta_quantile(F.lit(tail), F.greatest(x, F.lit(1.0)), n - x + 1))
    high = F.when(x >= n, 1.0).otherwise(beta_quantile(F.lit(1 - tail), x + 1, F.greatest(n - x, F.lit(1.0))))
    return low, high


def chi_square_upper(x: Column, df: Column) -> Column:
    """P(X > x) for a whole number of degrees of freedom: a finite sum, from the exponential for even and the normal tail for odd numbers."""
    half = x.cast("double") / 2
    even = F.pmod(df, F.lit(2)) == 0
    steps = F.when(even, df / 2 - 1).otherwise((df - 1) / 2).cast("int")
    # the first term, and each next one from the one before
    start = F.struct(F.when(even, F.exp(-half)).otherwise(F.sqrt(half) * F.exp(-half) / (math.sqrt(math.pi) / 2)).alias("term"), F.when(even, F.exp(-half)).otherwise(F.lit(0.0)).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = F.when(even, s["term"] * half / k).otherwise(F.when(k == 1, s["term"]).otherwise(s["term"] * half / (k - 0.5)))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, start, add, lambda s: s["sum"])
    return F.when(x.isNull() | df.isNull(), None).when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.when(even, total).otherwise(2 * upper_tail(F.sqrt(x.cast("double"))) + total)))


def correlation_tests(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by``, n, pearson, p_pearson, spearman, p_spearman over the rows that have both values; p of no correlation by Student's t, two-sided; null below three rows."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumns({"_x": rank_average(x, by), "_y": rank_average(y, by)})
    found = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_x", "_y").alias("spearman"))
    df = F.col("n") - 2
    p = lambda r: F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(r * F.sqrt(df / (1 - r * r)), df))
    return found.select(*by, "n", "pearson", F.when(df > 0, p(F.col("pearson"))).alias("p_pearson"), "spearman", F.when(df > 0, p(F.col("spearman"))).alias("p_spearman"))


@lru_cache(maxsize=256)
def _rank_sum_ways(m: int, n: int) -> np.ndarray:
    """The probability of each value of the rank-sum statistic, 0 to m * n, by adding one member at a time."""
    ways = np.zeros((m + 1, m * n + m + n + 1))
    ways[0, 0] = 1
    for rank in range(1, m + n + 1):  # each rank goes to the first group or not
        for k in range(min(rank, m), 0, -1):
            shift = rank - k  # what this rank adds beyond the least sum
            ways[k, shift:] += ways[k - 1, : ways.shape[1] - shift]
    row = ways[m, : m * n + 1]
    return row / row.sum()


@lru_cache(maxsize=256)
def _signed_rank_ways(n: int) -> np.ndarray:
    """The probability of each value of the signed-rank statistic."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank].copy()
    return ways / ways.sum()


def _two_sided(ways: np.ndarray, value: float) -> float:
    at = int(round(value))
    return float(min(1.0, 2 * min(ways[: at + 1].sum(), ways[at:].sum())))


@F.pandas_udf(T.DoubleType())
def exact_rank_sum(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of the rank-sum statistic without ties."""
    return pd.Series([_two_sided(_rank_sum_ways(int(a), int(b)), x) for x, a, b in zip(u, m, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def exact_signed_rank(v: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of the signed-rank statistic without ties and zeros."""
    return pd.Series([_two_sided(_signed_rank_ways(int(k)), x) for x, k in zip(v, n, strict=True)])


#: Groups below this size have exact p where there are no ties.
EXACT_BELOW = 50


def _normal(gap: Column, variance: Column) -> Column:
    """Two-sided p with half a step of continuity."""
    return F.when(variance > 0, F.least(F.lit(1.0), 2 * upper_tail(F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.sqrt(variance)))).otherwise(F.lit(None))


def _with_exact(exact_udf, small: Column, arguments: list[Column], normal: Column) -> Column:
    """The exact p where ``small`` holds; other rows hand the smallest case to the function, whose work so stays bounded."""
    given = [F.when(small, a).otherwise(F.lit(1.0)) for a in arguments]
    return F.when(small, exact_udf(*given)).otherwise(normal)


def rank_sum_tests(rows: DataFrame, by: list[str], group: str, value: str, exact_below: int = EXACT_BELOW) -> DataFrame:
    """``by``, n1, n2, u, p of the two groups that the boolean ``group`` makes (n1, u: where it holds), unpaired. Null values and groups are left out."""
    held = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("_r", rank_average(value, by))
    ties = held.groupBy(*by, value).agg(F.count("*").alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_ties"))
    sums = held.groupBy(*by).agg(F.count_if(group).alias("n1"), F.count_if(~F.col(group)).alias("n2"), F.sum(F.when(F.col(group), F.col("_r"))).alias("_s"))
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("_s") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1)))
    normal = F.when((n1 > 0) & (n2 > 0), _normal(u - n1 * n2 / 2, variance))
    some = (n1 > 0) & (n2 > 0) & (F.col("_ties") == 0) & (n1 < exact_below) & (n2 < exact_below)
    p = _with_exact(exact_rank_sum, some, [u, n1, n2], normal) if exact_below else normal
    return sums.join(ties, by).select(*by, "n1", "n2", u.alias("u"), p.alias("p"))


def signed_rank_tests(pairs: DataFrame, by: list[str], first: str, second: str, exact_below: int = EXACT_BELOW) -> DataFrame:
    """``by``, n (pairs that differ), v (sum of the ranks where the first is larger), p of paired values. Pairs with a null are left out."""
    gap = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("_d", F.col(first) - F.col(second)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = gap.withColumn("_r", rank_average("_a", by))
    ties = gap.groupBy(*by, "_a").agg(F.count("*").alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_ties"))
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("v"))
    n = F.col("n")
    normal = _normal(F.col("v") - n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    p = _with_exact(exact_signed_rank, (F.col("_ties") == 0) & (n < exact_below), [F.col("v"), n], normal) if exact_below else normal
    return sums.join(ties, by).select(*by, "n", "v", p.alias("p"))


def complete_blocks(rows: DataFrame, by: list[str], subject: str, condition: str, value: str) -> DataFrame:
    """The rows of subjects that have a value under every condition of their ``by``."""
    held = rows.where(F.col(value).isNotNull())
    conditions = held.select(*by, condition).distinct().groupBy(*by).agg(F.count("*").alias("_k"))
    return held.join(conditions, by).withColumn("_own", F.count("*").over(Window.partitionBy(*by, subject))).where("_own = _k").drop("_own")  # a row a condition


def friedman_tests(rows: DataFrame, by: list[str], subject: str, condition: str, value: str) -> DataFrame:
    """``by``, n, k, q, p, w: Friedman's test of repeated measures, corrected for ties, and Kendall's concordance. One row a subject and condition; incomplete subjects are left out."""
    ranked = complete_blocks(rows, by, subject, condition, value).withColumn("_r", rank_average(value, [*by, subject]))
    per = ranked.groupBy(*by, condition).agg(F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_q"), F.count("*").alias("n"), F.first("_k").alias("k"))
    n, k = F.max("n"), F.max("k")
    all_of = per.groupBy(*by).agg(n.alias("n"), k.alias("k"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum("_q").alias("_qq"))
    n, k = F.col("n"), F.col("k")
    mean = n * n * k * (k + 1) * (k + 1) / 4
    spread = F.col("_qq") - n * k * (k + 1) * (k + 1) / 4
    q = F.when(spread > 0, (k - 1) * (F.col("_ss") - mean) / spread)
    return all_of.select(*by, "n", "k", q.alias("q"), chi_square_upper(q, k - 1).alias("p"), (q / (n * (k - 1))).alias("w"))


def paired_comparisons(rows: DataFrame, by: list[str], subject: str, condition: str, value: str, exact_below: int = EXACT_BELOW) -> DataFrame:
    """``by``, first, second, n, v, p, adjusted: signed-rank tests of all pairs of conditions over the complete subjects, Benjamini-Hochberg within ``by``."""
    held = complete_blocks(rows, by, subject, condition, value).drop("_k")
    one = held.select(*by, subject, F.col(condition).alias("first"), F.col(value).alias("_one"))
    two = held.select(*by, subject, F.col(condition).alias("second"), F.col(value).alias("_two"))
    pairs = one.join(two, [*by, subject]).where("first < second")  # conditions are few
    return adjusted(signed_rank_tests(pairs, [*by, "first", "second"], "_one", "_two", exact_below), "p", by=by)
