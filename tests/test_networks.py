"""Network operators against brute force on small graphs, files, the command line and tables that are computed once."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import __main__ as cli
from skein.functions import draws
from skein.functions.scratch import cached
from skein.operators import build, components, ontology, paths, propagate, search, topology
from skein.plans import network, registry
from skein.sources import files

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    pairs = {(layer, *sorted(rng.sample(range(60), 2))) for layer in "xy" for _ in range(75)}
    return sorted(pairs), spark.createDataFrame(sorted(pairs), "layer string, a long, b long")


def steps_from(pairs, layer, start):
    near = {}
    for k, a, b in pairs:
        if k == layer:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen, front = {start: 0}, [start]
    while front:
        front = [n for f in front for n in near.get(f, ()) if n not in seen and not seen.update({n: seen[f] + 1})]
    return seen


def test_components_equal_search(spark, graph):
    pairs, edges = graph
    nodes = build.graph_nodes(edges, by=("layer",)).withColumnRenamed("layer", "run")
    got = components.labels(nodes, edges.withColumnRenamed("layer", "run")).collect()
    assert all(r.label == min(steps_from(pairs, r.run, r.node)) for r in got) and len(got) == len({(k, n) for k, a, b in pairs for n in (a, b)})
    chain = spark.createDataFrame([("r", k, k + 1) for k in range(50)], "run string, a long, b long")
    assert {r.label for r in components.labels(spark.range(51).select(F.lit("r").alias("run"), F.col("id").alias("node")), chain).collect()} == {0}


def test_nearest_members_equal_search(spark, graph):
    pairs, edges = graph
    rng = random.Random(4)
    sets = [(name, n) for name in ("p", "q", "r") for n in rng.sample(range(60), 8)]
    members = spark.createDataFrame(sets, "name string, node long")
    nodes = build.graph_nodes(edges, by=("layer",))
    inside = nodes.join(members, "node").select("name", "layer", "node").cache()
    held = {(r.name, r.layer, r.node) for r in inside.collect()}
    near, to_sets = search.closest(edges, inside)
    own, first = {}, {}
    for name, layer, node in held:
        far = steps_from(pairs, layer, node)
        for other in ("p", "q", "r"):
            found = [far[m] for n, k, m in held if n == other and k == layer and m in far and (n != name or m != node)]
            if found:
                (own if other == name else first)[name, other, layer, node] = min(found)
    assert {(r.name, r.name, r.layer, r.node): r.near for r in near.collect()} == own
    want = {}
    for (name, other, layer, _), d in first.items():
        want.setdefault((*sorted((name, other)), layer), []).append(d)
    got = {(r.name1, r.name2, r.layer): r.closest for r in paths.between(to_sets, inside).collect()}
    assert got == {k: pytest.approx(np.mean(v)) for k, v in want.items()}
    scored = paths.closest_significance(edges, nodes, members, trials=4).collect()
    mean = {}
    for (name, _, layer, _), d in own.items():
        mean.setdefault((name, layer), []).append(d)
    assert {(r.name, r.layer): r.closest for r in scored} == {k: pytest.approx(np.mean(v)) for k, v in mean.items()}
    assert all(r.fold == pytest.approx(r["mean"] / r.closest) and (r.z is None or 0 <= r.p <= 1) for r in scored)


def test_rewiring_keeps_degrees(spark, graph):
    pairs, edges = graph
    got = [tuple(r) for r in topology.rewired(edges, 6, bucket=20).collect()]
    degree = lambda rows: Counter((k, n) for k, a, b in rows for n in (a, b))
    assert degree(got) == degree(pairs) and len(set(got)) == len(got) == len(pairs) and all(a < b for _, a, b in got)
    assert len(set(got) & set(pairs)) < 0.7 * len(pairs)


def test_walk_comes_to_rest(spark, graph):
    _, edges = graph
    nodes = build.graph_nodes(edges)
    weights = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "layer string, w double")
    seeds = spark.createDataFrame([("one", 3, 1.0), ("two", 5, 1.0), ("two", 9, 2.0)], "run string, node long, weight double").join(nodes, "node", "left_semi")
    of = lambda steps: {(r.run, r.layer, r.node): r.p for r in propagate.restart_walk(edges, nodes, weights, seeds, steps).collect()}
    rest, many = of(None), of(30)
    assert all(rest[k] == pytest.approx(many.get(k, 0), abs=1e-6) for k in rest)
    assert sum(v for (run, _, _), v in rest.items() if run == "two") == pytest.approx(1, abs=1e-6)
    judged = spark.createDataFrame([(0.5, 0.5, None), (0.19, 0.2, 0.5), (0.5, None, None), (0.4, 0.5, 0.6001)], "now double, before double, first double")
    assert [r[0] for r in judged.coalesce(1).select(propagate.at_rest(F.col("now"), F.col("before"), F.col("first"))).collect()] == [True, False, False, True]


def test_runs_rest_one_by_one(spark, graph):
    """Each run stops at its own step, in whatever company it walks."""
    _, edges = graph
    nodes = build.graph_nodes(edges)
    weights = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "layer string, w double")
    seeds = nodes.where("node < 20").select(F.concat(F.lit("r"), "node").alias("run"), "node", F.lit(1.0).alias("weight")).cache()
    together = {(r.run, r.layer, r.node): r.p for r in propagate.restart_walk(edges, nodes, weights, seeds, None).collect()}
    alone = {(r.run, r.layer, r.node): r.p for r in propagate.restart_walk(edges, nodes, weights, seeds.where("run = 'r3'"), None).collect()}
    assert alone == {k: pytest.approx(v, abs=1e-15) for k, v in together.items() if k[0] == "r3"}


@pytest.mark.parametrize("scaling", [None, "both"])
def test_matrix_walk_equals_numpy(spark, scaling):
    rng = np.random.default_rng(6)
    m = rng.random((9, 9)) * (rng.random((9, 9)) < 0.6)
    np.fill_diagonal(m, 0.1)
    if scaling is None:
        m /= 2 * m.sum()
    w = m.sum(0)
    scaled = {None: m, "columns": m / w, "both": m / np.sqrt(np.outer(w, w))}[scaling]
    entries = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(9) if m[i, j]], "i long, j long, w double")
    seeds = spark.createDataFrame([("a", 2, 1.0), ("b", 4, 3.0), ("b", 5, 1.0)], "run string, node long, weight double")
    p0 = {"a": np.eye(9)[2], "b": (3 * np.eye(9)[4] + np.eye(9)[5]) / 4}
    for r in propagate.matrix_walk(entries, seeds, 3, 0.8, scaling).collect():
        p = p0[r.run]
        for _ in range(3):
            p = 0.2 * scaled @ p + 0.8 * p0[r.run]
        assert r.p == pytest.approx(p[r.node], abs=1e-12)


def test_ten_folds_equal_numpy(spark):
    """AUC of the library's default walk from dense matrices, for the first layer moves of the queries."""
    edges = [(r.layer, r.a, r.b) for r in network.tables.edges(spark, DATA).collect()]
    nodes = sorted({n for _, a, b in edges for n in (a, b)})
    at, names = {n: k for k, n in enumerate(nodes)}, [k for k, _ in network.WEIGHTS]
    n, layers = len(nodes), len(names)
    adjacency = np.zeros((layers, n, n))
    for layer, a, b in edges:
        adjacency[names.index(layer), at[a], at[b]] = adjacency[names.index(layer), at[b], at[a]] = 1
    w = [x for _, x in network.WEIGHTS]
    move = np.array([[min(1, w[i] / w[j]) / layers for j in range(layers)] for i in range(layers)])
    np.fill_diagonal(move, 0)
    own = 1 - move.sum(0)
    full = np.zeros((layers * n, layers * n))
    for j in range(layers):
        k = adjacency[j].sum(0)
        norm = 1 / ((1 - own[j]) + np.where(k > 0, own[j], 0))
        for i in range(layers):
            full[i * n : (i + 1) * n, j * n : (j + 1) * n] = adjacency[j] / np.maximum(k, 1) * own[j] * norm if i == j else np.diag(move[i, j] * norm)
    folds = {(r.name, r.node): r.fold for r in network.evaluate.folds(network.tables.sets(spark, DATA)).collect()}
    got = {(r.name, r.fold): (r.n_pos, r.n_neg, r.auc) for r in registry.QUERIES["rw09_ten_folds"](spark, DATA).collect()}
    assert len(got) > 150
    for (name, fold), (n_pos, n_neg, auc) in list(got.items())[::7]:
        seeds = [at[m] for (s, m), f in folds.items() if s == name and f != fold and m in at]
        held = [at[m] for (s, m), f in folds.items() if s == name and f == fold and m in at]
        p0 = np.zeros(layers * n)
        for j in range(layers):
            p0[[j * n + s for s in seeds]] = 1 / (layers * len(seeds))
        p = p0
        for _ in range(20):
            p = 0.3 * full @ p + 0.7 * p0
        score = np.round(p.reshape(layers, n).mean(0), 12)
        other = [score[k] for k in range(n) if k not in seeds and k not in held]
        won = sum((score[h] > np.array(other)).sum() + (score[h] == np.array(other)).sum() / 2 for h in held)
        assert (n_pos, n_neg) == (len(held), len(other))
        assert (auc is None) if not held else auc == pytest.approx(won / len(held) / len(other), abs=2e-3)


def test_tails():
    for n, p in ((10, 0.3), (40, 0.9), (7, 0.5)):
        for x in range(-1, n + 2):
            assert topology.binomial_tail(x, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(x, 0), n + 1)), abs=1e-12)
    assert 0 < topology.binomial_tail(500_500, 1_000_000, 0.5) < 0.5


def test_nodes_that_a_layer_lacks(spark, graph):
    _, edges = graph
    counts = topology.connectivity_counts(edges, build.graph_nodes(edges, by=("layer",)), spark.createDataFrame([(3,), (5,)], "node long"))
    got = topology.connectivity(counts, spark.createDataFrame([("x", 999), ("x", 3)], "layer string, node long")).collect()
    assert [(r.x, r.k, r.p) for r in got if r.node == 999] == [(0, 0, 1.0)] and len(got) == 2


def test_all_pairs_of_vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 8))
    got = {(r.i, r.j): r.w for r in build.cosine_pairs(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "node long, embedding array<double>"), block=9).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    w = unit @ unit.T
    assert got == {(i, j): pytest.approx(w[i, j]) for i in range(50) for j in range(50) if i != j and w[i, j] > 0}


def test_backbone_without_all_pairs(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 6)) + 0.5 * rng.normal(size=(1, 6))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "node long, embedding array<double>")
    plain = build.backbone(build.disparity(build.drop_weakest(build.cosine_pairs(vectors).cache())), 0.2).collect()
    kept, counts = build.vector_backbone(vectors, 0.2, block=13)
    assert {(r.i, r.j): r.w for r in kept.collect()} == {(r.i, r.j): pytest.approx(r.w) for r in plain} and plain
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    w = (unit @ unit.T)[np.triu_indices(60, 1)]
    floor = np.ceil(w[w > 0].min() * 100) / 100
    assert {r.bin: r.n for r in counts.collect()} == Counter(np.floor(w[w > floor] / 0.05).astype(int).tolist())


def test_contracted_components_equal_labels(spark):
    rng = random.Random(5)
    pairs = [("chain", k, k + 1) for k in range(40)] + [("star", 0, k) for k in range(1, 30)] + [("loop", 7, 7)] + [("r%d" % (k % 3), rng.randrange(60), rng.randrange(60)) for k in range(110)]
    links = spark.createDataFrame(pairs, "run string, a long, b long")
    nodes = links.select("run", links.a.alias("node")).union(links.select("run", "b")).distinct()
    by_label = components.labels(nodes, links).groupBy("run", "label").count().groupBy("run").agg({"count": "max"}).collect()
    assert {(r.run, r.lcc) for r in components.largest(nodes, links).collect()} == {tuple(r) for r in by_label}
    assert components.linked_largest(links.where("run = 'loop'")).collect() == []


def test_random_sets_meet_the_edges_once_a_trial(spark, graph):
    _, edges = graph
    nodes = build.graph_nodes(edges, by=("layer",))
    wanted = nodes.groupBy("layer").count().selectExpr("layer", "explode(sequence(2L, count)) as n")
    drawn = draws.drawn_ranks(nodes, wanted, 2, "t").cache()
    held = {}
    for r in draws.drawn_sets(nodes, wanted, 2, "t").collect():
        held.setdefault((r.layer, r.n, r.trial), set()).add(r.node)
    links = [tuple(r) for r in edges.select("layer", "a", "b").collect()]
    want = Counter((*k, a, b) for k, v in held.items() for layer, a, b in links if layer == k[0] and a in v and b in v)
    assert Counter(tuple(r) for r in components.drawn_links(edges, drawn, wanted).collect()) == want and want
    sizes = wanted.groupBy("layer").agg({"n": "max"}).collect()
    assert drawn.count() == 2 * sum(r[1] for r in sizes)  # a row a node and trial, whatever the sizes


def test_pairs_of_genes_move_lists_and_no_terms(spark):
    isa = spark.createDataFrame([("s1", "n1"), ("s2", "n1"), ("s3", "n2"), ("s3", "n1"), ("n1", "r"), ("n2", "r"), ("n1", "q")], "child string, parent string")
    genes = spark.createDataFrame([("s1", 1), ("s2", 1), ("s2", 2), ("n1", 2), ("s3", 3), ("r", 4)], "term string, gene long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (4, 5), (5, 6)], "a long, b long")
    above = {"s1": {"n1", "r", "q"}, "s2": {"n1", "r", "q"}, "s3": {"n1", "n2", "r", "q"}, "n1": {"r", "q"}, "r": set()}
    own = {1: {"s1", "s2"}, 2: {"s2", "n1"}, 3: {"s3"}, 4: {"r"}}
    want = {}
    for a, b in ((1, 2), (1, 3), (2, 3), (1, 4), (4, 5), (5, 6)):
        x, y = own.get(a, set()), own.get(b, set())
        nodes = set().union(x, y, *(above[t] for t in x | y))
        for c, p in {(r.child, r.parent) for r in isa.collect() if r.child in nodes}:
            want[a, b, c, p] = "both" if c in x & y else "first" if c in x else "second" if c in y else "none"
    assert {(r.a, r.b, r.child, r.parent): r.label for r in ontology.pair_subgraphs(isa, genes, pairs).collect()} == want
    found = ontology.pair_subgraph_counts(isa, genes, pairs)
    got = {(r.a, r.b): (r.n, r.both_n, r.first_n, r.second_n, r.parents) for r in found.collect()}
    of = lambda a, b: {k: v for k, v in want.items() if k[:2] == (a, b)}
    assert got == {p: (len(of(*p)), *(list(of(*p).values()).count(k) for k in ("both", "first", "second")), len({k[3] for k in of(*p)})) for p in {k[:2] for k in want}}
    for plan in (found, registry.QUERIES["ot10_pair_overlap"](spark, DATA)):  # nothing after the pairs makes a row for each term
        assert not any(x in plan._jdf.queryExecution().optimizedPlan().toString() for x in ("Generate", "Aggregate"))


def test_block_products_deal_no_pairs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(70, 6))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "node long, embedding array<double>")
    plan = build.cosine_pairs(vectors, block=9)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "RoundRobinPartitioning" not in plan.split("== Physical Plan ==")[1]
    want = {(r.i, r.j): (r.w, r.p) for r in build.disparity(build.drop_weakest(build.cosine_pairs(vectors).cache())).collect()}
    assert {(r.i, r.j): r.w for r in build.strong_pairs(vectors, block=9).collect()} == {k: pytest.approx(w) for k, (w, _) in want.items()} and want
    assert {(r.i, r.j): r.p for r in build.vector_disparity(vectors, block=9).collect()} == {k: pytest.approx(p) for k, (_, p) in want.items()}


def test_backbone_is_not_written_and_vectors_keep_their_numbers(spark, monkeypatch):
    written = {}

    def put(df, name, write=build.materialise):
        written[name] = df.schema
        return write(df, name)

    monkeypatch.setattr(build, "materialise", put)
    m = np.random.default_rng(5).normal(size=(700, 3)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "node long, embedding array<float>")
    kept, _ = build.vector_backbone(vectors, 0.2, block=4)
    assert kept.count() and "backbone" not in written
    assert written["blocks"]["rows"].dataType.simpleString() == "array<array<float>>"
    # 175 blocks: each part of one side meets each of the other, so the number of tasks says how often a side is read
    assert kept.rdd.getNumPartitions() <= 7**2


def test_principal_plane_equals_numpy(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    m = np.array([rows[k] for k in sorted(rows)])
    axes = np.linalg.eigh(np.cov(m.T))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    got = {r.vec_id: (r.x, r.y) for r in registry.QUERIES["gr34_principal_plane"](spark, DATA).collect()}
    assert np.allclose([got[k] for k in sorted(rows)], m @ axes, atol=1e-6)


def test_computed_once_then_loaded(spark, tmp_path):
    calls = []
    name = f"test-{random.random()}"
    source = str(tmp_path / "in")
    spark.range(5).coalesce(1).write.parquet(source)
    get = lambda parameters=None: cached(spark, name, lambda: calls.append(1) or spark.read.parquet(source), [source], parameters)
    assert get().count() == get().count() == 5 and calls == [1]
    spark.range(7).coalesce(1).write.mode("overwrite").parquet(source)
    assert get().count() == 7 and calls == [1, 1] and get().count() == 7
    assert get("other").count() == 7 and calls == [1, 1, 1]
    with pytest.raises(ZeroDivisionError):
        cached(spark, f"{name}-fails", lambda: 1 / 0)
    assert cached(spark, f"{name}-fails", lambda: spark.range(3)).count() == 3


def test_database_reads_are_split_and_filtered(spark):
    """The database that comes with the engine, in memory."""
    where = {"url": "jdbc:derby:memory:skein;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).select("id", (F.col("id") * 2).alias("twice")).coalesce(1).write.format("jdbc").options(dbtable="numbers", **where).save()
    found = files.read_jdbc(spark, "numbers", ("id", 0, 100, 4), **where)
    some = found.where("id > 90").select("id")
    assert found.rdd.getNumPartitions() == 4 and sorted(r[0] for r in some.collect()) == list(range(91, 100))
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,90)" in plan.replace("ID", "id") and "twice" not in plan.lower().split("readschema")[-1]
    assert files.read_jdbc(spark, "numbers", **where).count() == 100


def test_expression_matrix(spark, tmp_path):
    (tmp_path / "m.gct").write_text("#1.2\n2\t2\nName\tDescription\theart\tliver\nE1\tgA\t1.5\t0\nE2\tgB\t2\t7\n")
    got = {(r.gene, r["sample"], r.value) for r in files.read_gct(spark, str(tmp_path / "m.gct")).collect()}
    assert got == {("gA", "heart", 1.5), ("gA", "liver", 0.0), ("gB", "heart", 2.0), ("gB", "liver", 7.0)}
    (tmp_path / "n.gct").write_text("#1.2\n1\t1\nName\tDescription\tlung\nE9\tgA\tx\nE9\tgB\t4\nshort\n")
    (tmp_path / "o.gct").write_text("#1.2\n0\t1\nName\tDescription\tlung\n")
    many = {(r.file[-5:], r.gene, r["sample"], r.value) for r in files.read_gct(spark, str(tmp_path)).collect()}
    assert many == {("m.gct", *row) for row in got} | {("n.gct", "gA", "lung", None), ("n.gct", "gB", "lung", 4.0)}


def test_command_line(spark, tmp_path):
    rng = random.Random(8)
    for layer in ("one", "two"):
        (tmp_path / "graphs").mkdir(exist_ok=True)
        lines = [f"g{a}\tg{b}" for a, b in (rng.sample(range(80), 2) for _ in range(200))]
        (tmp_path / "graphs" / f"{layer}.tsv").write_text("A\tB\n# no edge\n" + "\n".join(lines) + "\n")
    (tmp_path / "sets.tsv").write_text("name\tgene\nset a\t" + ";".join(f"g{k}" for k in range(15)) + "\nset b\t" + ";".join(f"g{k}" for k in range(10, 30)) + "\nsmall\tg1;g2\n")
    cli.main([str(tmp_path / "graphs"), str(tmp_path / "sets.tsv"), str(tmp_path / "out"), "_x", "--min", "10", "--trials", "5", "--pairs", "--distances"])
    read = lambda name: spark.read.csv(str(tmp_path / "out" / f"{name}_x"), sep="\t", header=True).collect()
    assert {(r.name, r.layer) for r in read("localisation")} == {(n, k) for n in ("set a", "set b") for k in ("one", "two")}
    assert len(read("pairs")) == 2 and len(read("distances")) == 4
