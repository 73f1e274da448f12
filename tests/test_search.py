"""Bit-parallel search, distances of pairs and sets, and numbering and bottom-k draws, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import draws, stats
from skein.operators import build, parts, paths, search
from test_networks import steps_from


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    pairs = sorted({(layer, *sorted(rng.sample(range(70), 2))) for layer in "xy" for _ in range(80)} | {("x", 200 + k, 201 + k) for k in range(11)})
    edges = spark.createDataFrame(pairs, "layer string, a long, b long")
    names = [(f"s{k}", n) for k in range(4) for n in sorted(rng.sample(range(70), 5 + 3 * k))] + [("one", 3), ("chain", 200), ("chain", 211), ("chain", 205)]
    members = spark.createDataFrame(names, "name string, node long")
    nodes = build.graph_nodes(edges, by=("layer",)).cache()
    inside = nodes.join(members, "node").select("name", "layer", "node").cache()
    far = {(k, n): steps_from(pairs, k, n) for k, n in {(k, n) for k, a, b in pairs for n in (a, b)}}
    held = {}
    for r in inside.collect():
        held.setdefault((r.layer, r.name), set()).add(r.node)
    return edges, nodes, members, inside, far, held


def test_closest_equals_search(spark, graph):
    edges, _, _, inside, far, held = graph
    near, to_sets = search.closest(edges, inside)
    want = {}
    for (layer, name), nodes in held.items():
        for n in nodes:
            found = [far[layer, n][m] for m in nodes - {n} if m in far[layer, n]]
            if found:
                want[name, layer, n] = min(found)
    assert {(r.name, r.layer, r.node): r.near for r in near.collect()} == want and want["chain", "x", 200] == 5
    every = {(k, n) for (k, _), nodes in held.items() for n in nodes}
    want = {}
    for (layer, name), nodes in held.items():
        for k, n in every:
            found = [far[layer, n][m] for m in nodes if k == layer and m in far[layer, n]]
            if found:
                want[layer, name, n] = min(found)
    assert {(r.layer, r.name, r.node): r.d for r in to_sets.collect()} == want


def test_more_sets_than_a_block_holds(spark, graph):
    edges, nodes, _, _, far, _ = graph
    inside = nodes.join(spark.range(90).select(F.concat(F.lit("d"), "id").alias("name"), "id"), F.pmod(F.xxhash64("name", "node"), F.lit(9)) < 2).select("name", "layer", "node").cache()
    held = {}
    for r in inside.collect():
        held.setdefault((r.name, r.layer), set()).add(r.node)
    want = {(*g, n): min(x) for g, ns in held.items() for n in ns if (x := [far[g[1], n][m] for m in ns - {n} if m in far[g[1], n]])}
    assert {(r.name, r.layer, r.node): r.near for r in search.closest(edges, inside)[0].collect()} == want


def test_index_answers_pairs_and_sets(spark, graph):
    edges, nodes, members, inside, far, held = graph
    index = search.distance_index(edges)
    pairs = [(k, a, b) for k, a in list(far)[:40] for b in range(0, 212, 3)]
    got = {(r.layer, r.a, r.b): r.d for r in search.pair_distances(index, spark.createDataFrame(pairs, "layer string, a long, b long")).collect()}
    assert got == {(k, a, b): far[k, a][b] for k, a, b in pairs if b in far[k, a]}
    assert {(r.layer, r.d): r.n for r in search.level_counts(index).collect()} == Counter((k, d) for (k, _), to in far.items() for d in to.values())
    whole = {r.layer: (r["mean"], r.sd) for r in search.all_pairs(index).collect()}
    for layer in "xy":
        d = [v for (k, a), to in far.items() for b, v in to.items() if k == layer and a < b]
        assert whole[layer] == (pytest.approx(np.mean(d)), pytest.approx(np.std(d, ddof=1)))
    within = {(r.name, r.layer): (r.closest, r.shortest) for r in search.within_distances(search.within_levels(index, inside)).collect()}
    for (layer, name), ns in held.items():
        rows = [[far[layer, n][m] for m in ns - {n} if m in far[layer, n]] for n in ns]
        every = [min(r) for r in rows if r]
        assert within.get((name, layer)) == ((pytest.approx(np.mean(every)), pytest.approx(np.mean(sum(rows, [])))) if every else None)
    scored = search.between_significance(index, nodes, members, trials=3).collect()
    seen = {}
    for (layer, one), first in held.items():
        for (k, two), second in held.items():
            if k == layer and one < two:
                steps = [[far[layer, a][b] for b in second if b in far[layer, a]] for a in first]
                back = [[far[layer, b][a] for a in first if a in far[layer, b]] for b in second]
                near = [min(r) for r in steps + back if r]
                if near:
                    seen[layer, one, two] = (pytest.approx(np.mean(near)), pytest.approx(np.mean(sum(steps, []))))
    assert {(r.layer, r.name1, r.name2): (r.closest, r.shortest) for r in scored} == seen
    assert all(r.z_shortest == pytest.approx((r.shortest - whole[r.layer][0]) / whole[r.layer][1]) for r in scored)
    old = {(r.name, r.layer): r.closest for r in paths.closest_significance(edges, nodes, members, trials=4).collect()}
    new = {(r.name, r.layer): r for r in search.within_significance(index, nodes, members, trials=4).collect()}
    assert {k: r.closest for k, r in new.items()} == {k: pytest.approx(v) for k, v in old.items()}
    assert all(r.fold_shortest == pytest.approx(whole[r.layer][0] / r.shortest) for r in new.values())


def test_smallest_and_numbers(spark, monkeypatch):
    monkeypatch.setattr(draws, "BUCKET_ROWS", 50)
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string").cast("binary")).alias("key"), (5 + 300 * (F.col("id") % 3)).alias("k")).repartition(7).cache()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.key)):
        if len(mine := want.setdefault(r.g, [])) < r.k:
            mine.append(r.id)
    got = draws.smallest(rows, ["g"], "key", ["id"], F.col("k")).collect()
    assert {g: [r.id for r in sorted(got, key=lambda r: r.r) if r.g == g] for g in range(3)} == want
    assert len(draws.smallest(rows, ["g"], "key", ["id"], 5000).collect()) == 3000
    numbers = draws.numbered_within(rows, ["g"], "id").collect()
    assert all(sorted(r.position for r in numbers if r.g == g) == list(range(1000)) for g in range(3))


def test_smallest_deals_by_bin_not_by_group(spark):
    rows = spark.range(4000).selectExpr("'g' as g", "id", "md5(cast(id as string)) as key")
    found = draws.smallest(rows, ["g"], "key", ["id"], 1500)
    assert not re.search(r"hashpartitioning\(g#\d+, \d+\)", found._jdf.queryExecution().executedPlan().toString())
    order = sorted((r.key, r.id) for r in rows.collect())[:1500]
    assert sorted((r.r, r.id) for r in found.collect()) == [(k, i) for k, (_, i) in enumerate(order, 1)]


def test_average_ranks_of_large_groups(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 5 = 0, 'a', 'b') as g", "case when id % 3 = 0 then 0.0 else round(rand(4), 2) end as v").cache()
    for descending in (False, True):
        want = {r.id: r.k for r in rows.withColumn("k", stats.rank_average("v", ["g"], descending)).collect()}
        found = draws.average_ranks(rows, ["g"], "v", "k", descending)
        assert {r.id: r.k for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # rows meet no window of their whole group


def test_index_of_parts_equals_that_of_joins(spark, graph, monkeypatch):
    edges, nodes, members, inside, far, _ = graph
    pairs = spark.createDataFrame([(k, a, b) for k, a in list(far)[::5] for b in range(0, 212, 3)], "layer string, a long, b long")
    found = []
    for most in (1000, 20):  # all in parts, the small component alone
        monkeypatch.setattr(parts, "MOST_LINKS", most)
        index = search.distance_index(edges)
        assert (index.levels is None, index.parts.some) == (most == 1000, True)
        found.append([sorted(map(tuple, x.collect()), key=repr) for x in (search.pair_distances(index, pairs), search.level_counts(index), search.within_levels(index, inside))])
        found[-1].append({(r.layer, r.name1, r.name2): tuple(round(v, 9) for v in r if isinstance(v, float)) for r in search.between_significance(index, nodes, members, trials=2).collect()})
    assert found[0] == found[1] and all(found[0])


def test_closest_in_parts_equals_that_of_joins(spark, graph, monkeypatch):
    edges, _, _, inside, _, _ = graph
    near, to_sets = (x.cache() for x in search.closest(edges, inside))
    found = search.set_distances(edges, inside)  # all in parts
    own = {(r.name1, r.layer): r.steps / r.n for r in found.where("name1 = name2").collect()}
    assert own == {(r.name, r.layer): r["avg(near)"] for r in near.groupBy("name", "layer").avg("near").collect()}
    assert {tuple(r)[:3]: round(r.closest, 9) for r in paths.between_sets(found).collect()} == {tuple(r)[:3]: round(r.closest, 9) for r in paths.between(to_sets, inside).collect()}
    monkeypatch.setattr(parts, "MOST_LINKS", 20)  # the chain is a part, the rest goes by joins
    assert sorted(map(tuple, search.member_distances(edges, inside).collect())) == sorted(map(tuple, near.collect()))
