"""Hand-computed graphs and numpy references."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import stats
from skein.operators import build, components, evaluate, ontology, paths, propagate, topology


def edges(spark, rows):
    return spark.createDataFrame([("L", a, b) for a, b in rows], "layer string, a long, b long")


def nodes(spark, rows):
    return spark.createDataFrame([("L", n) for n in rows], "layer string, node long")


def test_canonical_and_node_universes(spark):
    dirty = spark.createDataFrame([(2, 1), (1, 2), (1, 2), (3, 3), (4, None)], "a long, b long")
    assert [tuple(r) for r in build.canonical(dirty).collect()] == [(1, 2)]
    # a node with only a loop is an isolate of the graph view
    assert {r.node for r in build.graph_nodes(dirty).collect()} == {1, 2, 3, 4}


def test_components_of_a_path_without_its_middle(spark):
    el = edges(spark, [(1, 2), (2, 3), (3, 4)])
    members = spark.createDataFrame([("s", 1), ("s", 2), ("s", 4)], "name string, node long")
    run = spark.createDataFrame([("s", 1), ("s", 2), ("s", 4)], "run string, node long")
    links = build.induced(el, members).select(F.col("name").alias("run"), "a", "b")
    assert [tuple(r) for r in components.largest(run, links).collect()] == [("s", 3, 2)]


def test_topology_of_a_triangle_with_a_tail(spark):
    el = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])
    t = topology.transitivity(el).first()
    assert t.triangles == 1 and t.transitivity == pytest.approx(3 / 5)
    assert topology.local_clustering(el).first().clustering == pytest.approx((1 + 1 + 1 / 3) / 3)
    star = edges(spark, [(0, k) for k in range(1, 5)])
    assert topology.assortativity(star).first().assortativity == -1 or math.isnan(topology.assortativity(star).first().assortativity)


def test_average_ranks_and_adjusted_p(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 3.0), (4, None)], "k int, x double")
    got = {r.k: r.r for r in df.select("k", stats.rank_average("x", descending=True).alias("r")).collect()}
    assert (got[1], got[2], got[3]) == (1.5, 1.5, 3.0)
    p = [0.01, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = [r.adjusted for r in stats.adjusted(df, "p").orderBy("k").collect()]
    assert got[:4] == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5]) and got[4] is None


def test_normal_tail(spark):
    zs = [-3.0, -1.0, 0.0, 0.5, 2.0, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.upper_tail(F.col("z")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=2e-7)


def test_folds_have_equal_width(spark):
    members = spark.createDataFrame([("s", k) for k in range(15)], "name string, node long")
    sizes = [r["count"] for r in evaluate.folds(members, 10).groupBy("fold").count().orderBy("fold").collect()]
    want = [0] * 10
    for i in range(1, 16):
        want[max(1, math.ceil((i - 1) * 10 / 14)) - 1] += 1
    assert sizes == [w for w in want if w]


def test_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1e-4,), (0.05,), (1.0,)], "x double")
    got = [r[0] for r in df.select(stats.cut_right(F.col("x"), [0, 1e-4, 0.05, 1], ["a", "b", "c"])).collect()]
    assert got == [None, "a", "b", "c"]


def dense_walk(layers, n, weights, seeds, steps, r=0.7):
    count = len(layers)
    p = np.array([[min(1, weights[i] / weights[j]) / count if i != j else 0 for j in range(count)] for i in range(count)])
    for j in range(count):
        p[j, j] = 1 - p[:, j].sum()
    big = np.zeros((count * n, count * n))
    for i in range(count):
        for j in range(count):
            if i == j:
                m = np.zeros((n, n))
                for a, b in layers[i]:
                    m[a, b] = m[b, a] = 1
                d = m.sum(0)
                m = m / np.where(d > 0, d, 1)
            else:
                m = np.eye(n)
            big[i * n : (i + 1) * n, j * n : (j + 1) * n] = p[i, j] * m
    s = big.sum(0)
    big = big / np.where(s > 0, s, 1)
    p0 = np.zeros(count * n)
    for i in range(count):
        for k, w in seeds.items():
            p0[i * n + k] = w / (count * sum(seeds.values()))
    x = p0.copy()
    for _ in range(steps):
        x = (1 - r) * big @ x + r * p0
    return x


def test_walk_equals_the_explicit_matrix(spark):
    layers = [[(0, 1), (1, 2), (2, 3)], [(1, 3), (0, 3)], [(2, 4)]]
    el = spark.createDataFrame([(f"L{i}", a, b) for i, es in enumerate(layers) for a, b in es], "layer string, a long, b long")
    weights = spark.createDataFrame([("L0", 2.0), ("L1", 1.0), ("L2", 3.0)], "layer string, w double")
    seeds = spark.createDataFrame([("r", 0, 1.0), ("r", 2, 2.0), ("r", 99, 5.0)], "run string, node long, weight double")
    got = propagate.restart_walk(el, build.graph_nodes(el), weights, seeds, steps=7)
    want = dense_walk(layers, 5, [2.0, 1.0, 3.0], {0: 1.0, 2: 2.0}, 7)
    for r in got.collect():
        assert r.p == pytest.approx(want[int(r.layer[1]) * 5 + r.node], abs=1e-12)
    assert sum(r.p for r in got.collect()) == pytest.approx(want.sum())


def test_auc_and_delong(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 60)
    a, b = rng.normal(y, 1).round(1), rng.normal(y * 0.5, 1).round(1)
    df = spark.createDataFrame([("g", float(p), float(q), int(t)) for p, q, t in zip(a, b, y)], "g string, a double, b double, label int")
    brute = lambda s: np.mean([(p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]])
    assert evaluate.auc(df, ["g"], "a").first().auc == pytest.approx(brute(a))
    v10 = {k: np.array([np.mean([(p > q) + 0.5 * (p == q) for q in s[y == 0]]) for p in s[y == 1]]) for k, s in (("a", a), ("b", b))}
    v01 = {k: np.array([np.mean([(p > q) + 0.5 * (p == q) for p in s[y == 1]]) for q in s[y == 0]]) for k, s in (("a", a), ("b", b))}
    var = np.var(v10["a"] - v10["b"], ddof=1) / len(v10["a"]) + np.var(v01["a"] - v01["b"], ddof=1) / len(v01["a"])
    r = evaluate.delong(df, ["g"], "a", "b").first()
    assert r.auc1 - r.auc2 == pytest.approx(brute(a) - brute(b)) and r.z == pytest.approx((brute(a) - brute(b)) / math.sqrt(var))


def test_hypergeometric_tail():
    from math import comb

    for x, m, n, k in ((0, 3, 10, 4), (1, 5, 20, 6), (4, 4, 9, 5)):
        want = sum(comb(m, i) * comb(n - m, k - i) for i in range(x + 1, min(k, m) + 1) if k - i <= n - m) / comb(n, k)
        assert topology.hypergeometric_tail(x, m, n, k) == pytest.approx(want)


def test_distances_on_a_path(spark):
    el = edges(spark, [(1, 2), (2, 3), (3, 4)])
    got = {(r.src, r.node): r.d for r in paths.distances(el, spark.createDataFrame([("L", 1)], "layer string, src long"), 5).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3}


def test_closure_and_groups(spark):
    isa = spark.createDataFrame([("b", "root"), ("c", "b"), ("d", "c"), ("e", "root")], "child string, parent string")
    assert {tuple(r) for r in ontology.closure(isa).where("ancestor = 'b'").collect()} == {("c", "b"), ("d", "b")}
    genes = spark.createDataFrame([("b", "g0"), ("c", "g1"), ("d", "g1"), ("e", "g2")], "term string, gene string")
    # a group's own genes don't count, and a group without descendants has none
    assert {tuple(r) for r in ontology.group_genes(isa, genes, "root").collect()} == {("b", "g1")}


def test_loess_follows_a_parabola():
    x = np.arange(40.0)
    assert topology.loess(x, x**2, np.array([10.5, 20.2]), 0.2) == pytest.approx([10.5**2, 20.2**2])


def test_backbone_keeps_what_is_significant_both_ways(spark):
    w = [(i, j, 100.0 if {i, j} == {0, 1} else 1.0) for i in range(12) for j in range(12) if i != j]
    kept = build.backbone(build.disparity(spark.createDataFrame(w, "i long, j long, w double")))
    assert [(r.i, r.j) for r in kept.collect()] == [(0, 1)]
