"""Steps that do a bounded part of the work in a task each, against the plain way."""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import build, evaluate, parts, propagate, topology
from skein.sources import files


def test_layers_of_edge_lists_come_from_short_names(spark, tmp_path):
    for at in ("layer=A/part-0.csv", "layer=B c/part-1.csv", "deep/one.tsv", "deep/two.txt", "three", "x.csv.tsv"):
        (tmp_path / at).parent.mkdir(exist_ok=True)
        (tmp_path / at).write_text("A\tB\n1\t2\n# none\n 3 \t\n")
    found = files.read_edge_lists(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, "1", "2") for k in ("A", "B%20c", "one", "two", "three", "x.csv"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(input_file_name()" not in plan  # a pattern over the whole path took longer than all else


def test_walks_of_parts_need_no_joins(spark, monkeypatch):
    """Two components, walked in a task each, or the larger one by joins: the same scores and the same lists."""
    rows = [("x", k, k + 1) for k in range(1, 5)] + [("y", 1, 5)] + [("x", 20, k) for k in range(21, 30)] + [("y", k, k + 1) for k in range(20, 28)]
    edges = spark.createDataFrame(rows, "layer string, a long, b long")
    nodes = build.graph_nodes(edges)
    weights = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "layer string, w double")
    seeds = spark.createDataFrame([("one", 3, 1.0), ("one", 22, 1.0), ("two", 5, 2.0), ("two", 20, 1.0)], "run string, node long, weight double")
    held = spark.createDataFrame([("one", 4), ("one", 28), ("two", 2)], "run string, node long")

    def scores():
        return {(r.run, r.layer, r.node): r.p for r in propagate.restart_walk(edges, nodes, weights, seeds, 2).collect()}

    def lists():
        found = defaultdict(lambda: ([], []))
        for r in propagate.retrieved(edges, nodes, weights, seeds, held, 2).collect():
            found[r.run, r.bin][0].extend(r.pos)
            found[r.run, r.bin][1].extend(r.neg)
        return {k: tuple(map(sorted, v)) for k, v in found.items()}

    with monkeypatch.context() as m:
        m.setattr(propagate, "walk", None)
        alone, listed = scores(), lists()
    monkeypatch.setattr(parts, "MOST_LINKS", 8)
    assert scores() == {k: pytest.approx(v, abs=1e-12) for k, v in alone.items()}
    assert lists() == listed and sum(len(p) for p, _ in listed.values()) == 2


def test_auc_of_lists_equals_auc_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("r", int(s), int(y)) for s, y in zip(rng.integers(0, 40, 300) ** 3, rng.random(300) < 0.2, strict=True)]
    frame = spark.createDataFrame(rows, "run string, score long, label int")
    some = lambda c: F.collect_list(F.when(c, F.col("score")))
    lists = frame.where("score > 0").withColumn("bin", evaluate.score_bin_column(F.col("score"))).groupBy("run", "bin", (F.col("score") % 2).alias("k")).agg(some(F.col("label") == 1).alias("pos"), some(F.col("label") == 0).alias("neg"))
    assert {(r.score, r.bin) for r in frame.where("score > 0").select("score", evaluate.score_bin_column(F.col("score")).alias("bin")).collect()} == {(s, int(evaluate.score_bin(np.array([s]))[0])) for _, s, _ in rows if s}
    want = evaluate.auc(frame.withColumn("score", F.col("score").cast("double")), ["run"]).collect()[0]
    totals = frame.groupBy("run").agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg"))
    got = evaluate.auc_of_lists(lists, totals, ["run"]).collect()[0]
    assert (got.n_pos, got.n_neg, got.auc) == (want.n_pos, want.n_neg, pytest.approx(want.auc))


def test_triangles_are_counted_without_their_nodes(spark):
    rows = [("x", 1, 2), ("x", 2, 3), ("x", 1, 3), ("x", 3, 4), ("y", 1, 2), ("y", 2, 3)]
    found = topology.transitivity(spark.createDataFrame(rows, "layer string, a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == [("x", 1, 0.6), ("y", 0, 0.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(u" not in plan  # three rows for each triangle


def test_runs_of_one_component_are_walked_by_many_tasks(spark):
    edges = spark.createDataFrame([("x", k, k + 1) for k in range(30)], "layer string, a long, b long")
    split = parts.cut(edges)
    starts = spark.createDataFrame([(k, 3 * k, 1.0) for k in range(8)], "g long, node long, p0 double")
    starts = starts.select(*propagate._row(propagate.START, "node", run="g", p="p0")).withColumn("until", F.lit(1))
    near = propagate._lists(parts.inside(split, edges.select(*propagate._row(0, "a", "b")), "a"), "part", "layer")

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = propagate._Part(batches, np.ones((1, 1)))
        yield pa.RecordBatch.from_pydict({"runs": [len(part.runs)], "nodes": [len(part.nodes)]})

    found = propagate._dealt(near, split, starts).applyInArrow(work, "runs long, nodes long").collect()
    assert len(found) == 4 and {(r.runs, r.nodes) for r in found} == {(2, 31)}  # four cores
    assert near.count() == 1  # a part's links are a few rows
