"""Tails against tabled values, exact rank tests against enumeration."""

import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import inference


def test_tails_equal_tables(spark):
    c = lambda x: F.lit(float(x))
    one = spark.range(1).coalesce(1)
    want = {
        "t": (inference.t_two_sided(c(2.228139), F.lit(10)), 0.05), "t1": (inference.t_two_sided(c(-12.7062), F.lit(1)), 0.05), "t30": (inference.t_two_sided(c(2.75), F.lit(30)), 0.01),
        "f": (inference.f_upper(c(4.102821), F.lit(2), F.lit(10)), 0.05), "f2": (inference.f_upper(c(2.866081), F.lit(4), F.lit(20)), 0.05),
        "x2": (inference.chi_square_upper(c(5.991465), F.lit(2)), 0.05), "x3": (inference.chi_square_upper(c(7.814728), F.lit(3)), 0.05), "x1": (inference.chi_square_upper(c(3.841459), F.lit(1)), 0.05), "x8": (inference.chi_square_upper(c(20.090235), F.lit(8)), 0.01), "x7": (inference.chi_square_upper(c(18.475307), F.lit(7)), 0.01),
        "b": (inference.beta_cdf(c(0.5), c(2), c(3)), 0.6875), "b0": (inference.beta_cdf(c(0), c(2), c(3)), 0), "b1": (inference.beta_cdf(c(1), c(2), c(3)), 1),
    }
    low, high = inference.binomial_interval(F.lit(7), F.lit(20))
    none, some = inference.binomial_interval(F.lit(0), F.lit(20))
    want |= {"low": (low, 0.153909), "high": (high, 0.592189), "none": (none, 0), "some": (some, 0.168433)}
    row = one.select(*(v.alias(k) for k, (v, _) in want.items())).first()
    assert {k: row[k] for k in want} == {k: pytest.approx(v, abs=2e-6) for k, (_, v) in want.items()}
    assert one.select(inference.t_two_sided(F.lit(None).cast("double"), F.lit(3)), inference.chi_square_upper(F.lit(None).cast("double"), F.lit(3))).first() == (None, None)


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_exact_rank_tests_equal_enumeration(spark):
    rng = random.Random(4)
    rows = [("g", k < 4, v) for k, v in enumerate(rng.sample(range(100), 9))] + [("tied", k < 3, float(k % 3)) for k in range(8)] + [("alone", True, 1.0), ("g", None, 3.0), ("g", True, None)]
    frame = spark.createDataFrame([(g, k, None if v is None else float(v)) for g, k, v in rows], "g string, first boolean, v double").coalesce(2)
    got = {r.g: r for r in inference.rank_sum_tests(frame, ["g"], "first", "v").collect()}
    values = [v for g, k, v in rows if g == "g" and k is not None and v is not None]
    r = ranks(values)
    u = r[:4].sum() - 10
    every = np.array([r[list(c)].sum() - 10 for c in combinations(range(9), 4)])
    assert got["g"].u == u and got["g"].p == pytest.approx(min(1, 2 * min((every <= u).mean(), (every >= u).mean())))
    assert got["alone"].p is None and 0 < got["tied"].p <= 1
    pairs = [("g", float(a), float(b)) for a, b in zip(rng.sample(range(50), 8), rng.sample(range(100, 190), 8), strict=True)]
    pairs = [(g, a, b - 120) for g, a, b in pairs] + [("g", 1.0, 1.0), ("g", None, 2.0)]
    got = inference.signed_rank_tests(spark.createDataFrame(pairs, "g string, a double, b double").coalesce(1), ["g"], "a", "b").first()
    d = np.array([a - b for _, a, b in pairs if a is not None and a != b])
    if len(set(abs(d))) == len(d):
        r = ranks(abs(d))
        every = np.array([(np.array(s) * r).sum() for s in product((0, 1), repeat=len(d))])
        v = r[d > 0].sum()
        assert (got.n, got.v) == (len(d), v) and got.p == pytest.approx(min(1, 2 * min((every <= v).mean(), (every >= v).mean())))


def test_friedman_equals_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 9, (12, 4)).astype(float)
    rows = [("one", s, f"c{k}", float(y[s, k])) for s in range(12) for k in range(4)] + [("one", 99, "c0", 4.0)]
    got = inference.friedman_tests(spark.createDataFrame(rows, "g string, s long, c string, y double"), ["g"], "s", "c", "y").first()
    r = np.array([ranks(row) for row in y])
    q = 3 * (((r.sum(0) - 12 * 2.5) ** 2).sum()) / ((r**2).sum() - 12 * 4 * 25 / 4)
    assert (got.n, got.k) == (12, 4) and got.q == pytest.approx(q) and got.w == pytest.approx(q / 36)
    pairs = inference.paired_comparisons(spark.createDataFrame(rows, "g string, s long, c string, y double"), ["g"], "s", "c", "y").collect()
    assert len(pairs) == 6 and all(x.adjusted >= x.p for x in pairs)
