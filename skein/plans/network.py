"""Queries of similarity backbones, paths, walks, evaluation and prioritisation (survey rows GR22-34, RW)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import draws, stats
from skein.functions.scratch import materialise
from skein.operators import build, evaluate, parts, paths, propagate, search
from skein.plans.base import query
from skein.plans.graph import FOLDS, SEEDS_OF_FOLDS, fold_seeds
from skein.sources import tables
from skein.sources.tables import EDGES_SQL

WITH = f"WITH {EDGES_SQL}"

SIM_SQL = """
WITH e AS (SELECT vec_id, embedding FROM embeddings),
sim AS (SELECT x.vec_id AS i, y.vec_id AS j, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS w FROM e x JOIN e y ON x.vec_id <> y.vec_id),
pos AS (SELECT * FROM sim WHERE w > 0),
cut AS (SELECT * FROM pos WHERE w > (SELECT ceil(min(w) * 100) / 100 FROM pos)),
bb AS (SELECT i, j, w, pow(1 - w / sum(w) OVER (PARTITION BY j), count(*) OVER (PARTITION BY j) - 1) AS p FROM cut)
"""


def _vectors(spark, d):
    return tables.table(spark, d, "embeddings", F.col("vec_id").alias("node"), "embedding")


@query("gr22_drop_weakest", SIM_SQL + "SELECT i, j, round(w, 6) AS w FROM cut")
def gr22(spark, d):
    """Similarities over the smallest one rounded up to hundredths."""
    return build.strong_pairs(_vectors(spark, d)).select("i", "j", F.round("w", 6).alias("w"))


@query("gr23_disparity", SIM_SQL + "SELECT i, j, round(p, 6) AS p FROM bb")
def gr23(spark, d):
    return build.vector_disparity(_vectors(spark, d)).select("i", "j", F.round("p", 6).alias("p"))


@query("gr24_backbone", SIM_SQL + "SELECT x.i, x.j, round(x.w, 6) AS w FROM bb x JOIN bb y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j AND x.p < 0.05 AND y.p < 0.05")
def gr24(spark, d):
    """The pairs that are significant from both ends; no others leave the block products."""
    return build.vector_backbone(_vectors(spark, d))[0].select("i", "j", F.round("w", 6).alias("w"))


@query(
    "gr25_score_histogram",
    SIM_SQL + "SELECT CAST(floor(w * 20) AS BIGINT) AS bin, CAST(count(*) // 2 AS BIGINT) AS before, CAST(count(CASE WHEN k THEN 1 END) // 2 AS BIGINT) AS after FROM (SELECT c.w, x.p < 0.05 AND y.p < 0.05 AS k FROM cut c JOIN bb x ON x.i = c.i AND x.j = c.j JOIN bb y ON y.i = c.j AND y.j = c.i) GROUP BY ALL",
)
def gr25(spark, d):
    """Pairs by twentieths of the similarity, before and after the backbone."""
    kept, before = build.vector_backbone(_vectors(spark, d))
    after = kept.groupBy(F.floor(F.col("w") * 20).alias("bin")).agg(F.count("*").alias("after"))
    return before.withColumnRenamed("n", "before").join(after, "bin", "left").fillna(0, ["after"]).select("bin", "before", "after")


#: Steps that the SQL of distances goes; the engine goes on until nothing changes, which is before that at the checked scales, as a test says.
LEVELS = 6
#: The nodes that reach a node in so many steps, as a string of a bit a node.
REACH_SQL = """,
num AS (SELECT layer, node, CAST(row_number() OVER (PARTITION BY layer ORDER BY node) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY layer) AS INTEGER) AS c FROM nodes),
r0 AS MATERIALIZED (SELECT layer, node, set_bit(bitstring('0', c), i, 1) AS b FROM num),
""" + ",\n".join(
    f"r{k} AS MATERIALIZED (SELECT layer, node, bit_or(b) AS b FROM (SELECT * FROM r{k - 1} UNION ALL SELECT l.layer, l.dst, r.b FROM r{k - 1} r JOIN two_way l ON l.layer = r.layer AND l.src = r.node) GROUP BY layer, node)"
    for k in range(1, LEVELS + 1)
) + ",\nreach AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(LEVELS + 1)) + ")"
#: The two nearest members of every set at every node, level by level; the engine goes on until nothing changes, which is before LEVELS at the checked scale.
NEAR_SQL = """,
inside AS (SELECT s.name, n.layer, n.node FROM nodes n JOIN sets s USING (node)),
n0 AS (SELECT layer, name, node, node AS src, 0 AS d FROM inside),
""" + ",\n".join(
    f"""n{k} AS (SELECT layer, name, node, src, min(d) AS d FROM (
  SELECT * FROM n{k - 1} UNION ALL SELECT s.layer, s.name, l.dst, s.src, s.d + 1 FROM n{k - 1} s JOIN two_way l ON l.layer = s.layer AND l.src = s.node) GROUP BY layer, name, node, src
  QUALIFY row_number() OVER (PARTITION BY layer, name, node ORDER BY min(d), src) <= 2)"""
    for k in range(1, LEVELS + 1)
) + f""",
near AS (SELECT x.name, x.layer, x.node, min(n.d) AS near FROM n{LEVELS} n JOIN inside x USING (layer, name, node) WHERE n.src <> n.node GROUP BY ALL),
win AS (SELECT name, layer, avg(near) AS closest FROM near GROUP BY ALL),
btw AS (SELECT least(n.name, x.name) AS name1, greatest(n.name, x.name) AS name2, layer, avg(n.d) AS closest
  FROM (SELECT layer, name, node, min(d) AS d FROM n{LEVELS} GROUP BY ALL) n JOIN inside x USING (layer, node) WHERE n.name <> x.name GROUP BY ALL)
"""


def _layers(spark, d, sets=None):
    edges = materialise(tables.edges(spark, d), "edges")
    chosen = tables.sets(spark, d) if sets is None else sets
    return edges, materialise(build.graph_nodes(edges, by=("layer",)).join(chosen, "node").select("name", "layer", "node"), "inside")


HIST_SQL = """,
upto AS (SELECT layer, k, sum(bit_count(b)) AS n FROM reach GROUP BY ALL),
hist AS (SELECT layer, k AS d, n - coalesce(lag(n) OVER (PARTITION BY layer ORDER BY k), 0) AS n FROM upto),
whole AS (SELECT layer, sum(d * n) / sum(n) AS ms, sqrt((sum(d * d * n) / 2.0 - (sum(d * n) / 2.0) * (sum(d * n) / 2.0) / (sum(n) / 2.0)) / (sum(n) / 2.0 - 1)) AS ss FROM hist WHERE d > 0 GROUP BY ALL)
"""


@query("gr30_distances", WITH + REACH_SQL + HIST_SQL + "SELECT layer, CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS n FROM hist WHERE n > 0")
def gr30(spark, d):
    """How many ordered pairs of nodes are at each distance, all nodes of all layers, at any distance."""
    return search.level_counts(search.distance_index(materialise(tables.edges(spark, d), "edges")))


@query(
    "gr30_pair_distances",
    WITH + REACH_SQL + ", pairs AS (SELECT x.layer, e.a, e.b FROM (SELECT DISTINCT a, b FROM edges) e JOIN nodes x ON x.node = e.a)"
    " SELECT p.layer, p.a, p.b, CAST(min(r.k) AS BIGINT) AS d FROM pairs p JOIN num n ON n.layer = p.layer AND n.node = p.a JOIN reach r ON r.layer = p.layer AND r.node = p.b WHERE get_bit(r.b, n.i) = 1 GROUP BY ALL",
)
def gr30_pairs(spark, d):
    """The distance in every layer of the ends of every edge of any layer, looked up in the index of all distances."""
    edges = materialise(tables.edges(spark, d), "edges")
    pairs = edges.select("a", "b").distinct().join(build.graph_nodes(edges, by=("layer",)).withColumnRenamed("node", "a"), "a").select("layer", "a", "b")
    return search.pair_distances(search.distance_index(edges), pairs)


@query("gr32_within_distance", WITH + NEAR_SQL + "SELECT name, layer, round(closest, 6) AS closest FROM win")
def gr32(spark, d):
    """Mean steps from the members of every set to their nearest other member, at any distance."""
    found = search.set_distances(*_layers(spark, d), pairs=False)
    return found.select(F.col("name1").alias("name"), "layer", F.round(F.col("steps") / F.col("n"), 6).alias("closest"))


#: Random sets of each size: as many as the reference draws.
NEAR_TRIALS = 1000


def _draw_sql(seed: str, side: str) -> str:
    """The members of random sets of every size of a layer, as groups named by side, size and trial."""
    return f"""SELECT '{side}|' || w.n || '|' || x.trial AS g, x.layer, x.node FROM (
  SELECT layer, trial, node, row_number() OVER (PARTITION BY layer, trial ORDER BY md5('{seed}|' || layer || '|' || trial || '|' || node), node) AS r FROM nodes, range(1, {NEAR_TRIALS + 1}) t(trial)) x
  JOIN (SELECT DISTINCT layer, n FROM sizes) w ON w.layer = x.layer AND x.r <= w.n"""


SETS_SQL = """,
inside2 AS (SELECT DISTINCT s.name, n.layer, n.node FROM nodes n JOIN sets s USING (node)),
sizes AS (SELECT name, layer, count(*) AS n FROM inside2 GROUP BY ALL),
"""
MASK_SQL = """,
mask AS MATERIALIZED (SELECT g, layer, bit_or(set_bit(bitstring('0', c), i, 1)) AS m FROM grp JOIN num USING (layer, node) GROUP BY ALL)"""
WITHIN_SQL = SETS_SQL + f"grp AS (SELECT 'own|' || name AS g, layer, node FROM inside2 UNION ALL {_draw_sql('near', 'draw')})" + MASK_SQL + """,
seen AS (SELECT g, layer, node, k, bit_count(r.b & m.m) AS c FROM grp JOIN mask m USING (g, layer) JOIN reach r USING (layer, node)),
member AS (SELECT g, layer, node, min(CASE WHEN c > 1 THEN k END) AS near, sum(k * fresh) AS steps, sum(fresh) AS n
  FROM (SELECT *, CASE WHEN k > 0 THEN c - lag(c) OVER (PARTITION BY g, layer, node ORDER BY k) END AS fresh FROM seen) GROUP BY ALL HAVING max(c) > 1),
grouped AS (SELECT g, layer, avg(near) AS closest, sum(steps) / sum(n) AS shortest FROM member GROUP BY ALL),
nullc AS (SELECT layer, CAST(split_part(g, '|', 2) AS BIGINT) AS n, avg(closest) AS mc, stddev_samp(closest) AS sc FROM grouped WHERE g LIKE 'draw|%' GROUP BY ALL),
scored AS (SELECT s.name, s.layer, s.n, g.closest, g.shortest, mc, sc, CASE WHEN sc > 0 THEN (g.closest - mc) / sc END AS zc, ms, ss, CASE WHEN ss > 0 THEN (g.shortest - ms) / ss END AS zs
  FROM sizes s JOIN grouped g ON g.g = 'own|' || s.name AND g.layer = s.layer LEFT JOIN nullc n ON n.layer = s.layer AND n.n = s.n JOIN whole w ON w.layer = s.layer)
"""
BETWEEN_SQL = SETS_SQL + f"grp AS (SELECT 'own|' || name AS g, layer, node FROM inside2 UNION ALL {_draw_sql('first', 'a')} UNION ALL {_draw_sql('second', 'b')})" + MASK_SQL + """,
pairs AS (SELECT x.layer, x.name AS name1, y.name AS name2, x.n AS n1, y.n AS n2 FROM sizes x JOIN sizes y ON x.layer = y.layer AND x.name < y.name),
asked AS (
  SELECT layer, 'own|' || name1 AS g1, 'own|' || name2 AS g2 FROM pairs UNION ALL SELECT layer, 'own|' || name2, 'own|' || name1 FROM pairs
  UNION ALL SELECT DISTINCT layer, 'a|' || n1 || '|' || trial, 'b|' || n2 || '|' || trial FROM pairs, range(1, """ + str(NEAR_TRIALS + 1) + """) t(trial)
),
seen AS (SELECT a.layer, a.g1, a.g2, x.node, r.k, bit_count(r.b & m.m) AS c FROM asked a JOIN grp x ON x.g = a.g2 AND x.layer = a.layer JOIN mask m ON m.g = a.g1 AND m.layer = a.layer JOIN reach r ON r.layer = a.layer AND r.node = x.node),
member AS (SELECT layer, g1, g2, node, min(CASE WHEN c > 0 THEN k END) AS near, sum(k * fresh) AS steps, sum(fresh) AS n
  FROM (SELECT *, c - coalesce(lag(c) OVER (PARTITION BY layer, g1, g2, node ORDER BY k), 0) AS fresh FROM seen) GROUP BY ALL HAVING max(c) > 0),
turned AS (SELECT layer, g1, g2, near, steps, n FROM member WHERE g1 LIKE 'own|%' AND g1 < g2 UNION ALL SELECT layer, g2, g1, near, 0, 0 FROM member WHERE g1 LIKE 'own|%' AND g1 > g2),
own AS (SELECT layer, substr(g1, 5) AS name1, substr(g2, 5) AS name2, avg(near) AS closest, sum(steps) / sum(n) AS shortest FROM turned GROUP BY ALL),
drawn AS (SELECT layer, g1, g2, avg(near) AS m FROM member WHERE g1 LIKE 'a|%' GROUP BY ALL),
nullc AS (SELECT layer, CAST(split_part(g1, '|', 2) AS BIGINT) AS n1, CAST(split_part(g2, '|', 2) AS BIGINT) AS n2, avg(m) AS mc, stddev_samp(m) AS sc FROM drawn GROUP BY ALL),
scored AS (SELECT o.*, mc, sc, CASE WHEN sc > 0 THEN (closest - mc) / sc END AS zc, ms, ss, CASE WHEN ss > 0 THEN (shortest - ms) / ss END AS zs
  FROM own o JOIN pairs p USING (layer, name1, name2) LEFT JOIN nullc n ON n.layer = o.layer AND n.n1 = p.n1 AND n.n2 = p.n2 JOIN whole w ON w.layer = o.layer)
"""
_COLUMNS = ("mean_closest", "sd_closest", "z_closest", "fold_closest", "mean_shortest", "sd_shortest", "z_shortest", "fold_shortest")
_SCORES_SQL = "round(closest, 6) AS closest, round(shortest, 6) AS shortest, " + ", ".join(
    f"round({m}, 6) AS mean_{c}, round({s}, 6) AS sd_{c}, round({z}, 5) AS z_{c}, round({m} / nullif({c}, 0), 6) AS fold_{c}, CASE WHEN {z} IS NOT NULL THEN round(1 - ({stats.upper_tail_sql(z)}), 5) END AS p_{c}"
    for c, m, s, z in (("closest", "mc", "sc", "zc"), ("shortest", "ms", "ss", "zs"))
)


def _rounded(found, *keys):
    digits = {**dict.fromkeys(("closest", "shortest", *_COLUMNS), 6), "z_closest": 5, "z_shortest": 5, "p_closest": 5, "p_shortest": 5}
    return found.select(*keys, *(F.round(c, n).alias(c) for c, n in digits.items()))


@query("gr32_distance_significance", WITH + REACH_SQL + HIST_SQL + WITHIN_SQL + f"SELECT name, layer, n, {_SCORES_SQL} FROM scored")
def gr32_significance(spark, d):
    """Both distances inside every set: to the nearest other member, against a thousand random sets of each size, and of all pairs, against all pairs of the layer."""
    edges = materialise(tables.edges(spark, d), "edges")
    found = search.within_significance(search.distance_index(edges), materialise(build.graph_nodes(edges, by=("layer",)), "nodes"), tables.sets(spark, d), trials=NEAR_TRIALS)
    return _rounded(found, "name", "layer", "n")


@query("gr32_between_significance", WITH + REACH_SQL + HIST_SQL + BETWEEN_SQL + f"SELECT layer, name1, name2, {_SCORES_SQL} FROM scored")
def gr32_between(spark, d):
    """Both distances between all pairs of sets, against a thousand pairs of random sets of the two sizes and against all pairs of the layer."""
    edges = materialise(tables.edges(spark, d), "edges")
    found = search.between_significance(search.distance_index(edges), materialise(build.graph_nodes(edges, by=("layer",)), "nodes"), tables.sets(spark, d), trials=NEAR_TRIALS)
    return _rounded(found, "layer", "name1", "name2")


@query("gr33_separation", WITH + NEAR_SQL + "SELECT name1, name2, b.layer, round(b.closest - (x.closest + y.closest) / 2, 6) AS s FROM btw b JOIN win x ON x.name = name1 AND x.layer = b.layer JOIN win y ON y.name = name2 AND y.layer = b.layer")
def gr33(spark, d):
    """Separation of all pairs of sets in every layer: one search for all sets, a few bits a set."""
    edges, inside = _layers(spark, d)
    found = search.set_distances(edges, inside)
    own = found.where("name1 = name2").select(F.col("name1").alias("name"), "layer", (F.col("steps") / F.col("n")).alias("closest"))
    return paths.separation(own, paths.between_sets(found)).select("name1", "name2", "layer", F.round("s", 6).alias("s"))


STEPS = 4
WEIGHTS = (("A", 2.0), ("N", 3.0), ("R", 1.5))
WALK_SQL = """,
wts(layer, w) AS (VALUES ('A', 2.0::DOUBLE), ('N', 3.0::DOUBLE), ('R', 1.5::DOUBLE)),
off AS (SELECT x.layer AS lj, y.layer AS li, least(1.0, y.w / x.w) / 3 AS p FROM wts x JOIN wts y ON x.layer <> y.layer),
own AS (SELECT lj AS layer, 1 - sum(p) AS own FROM off GROUP BY ALL),
uni AS (SELECT DISTINCT node FROM nodes),
nrm AS (SELECT o.layer, u.node, d.k, o.own, 1 / ((1 - o.own) + CASE WHEN d.k IS NOT NULL THEN o.own ELSE 0 END) AS norm FROM uni u CROSS JOIN own o LEFT JOIN deg d ON d.layer = o.layer AND d.node = u.node),
seeds AS (SELECT name AS run, node FROM sets JOIN uni USING (node)),
p0 AS (SELECT s.run, w.layer, s.node, 1.0::DOUBLE / (3 * t.c) AS p FROM seeds s CROSS JOIN wts w JOIN (SELECT run, count(*) AS c FROM seeds GROUP BY ALL) t USING (run)),
""" + ",\n".join(
    f"""w{k} AS (SELECT run, layer, node, sum(y) AS p FROM (
  SELECT s.run, e.layer, e.dst AS node, 0.3 * s.p * n.own * n.norm / n.k AS y FROM {'p0' if k == 1 else f'w{k - 1}'} s JOIN two_way e ON e.layer = s.layer AND e.src = s.node JOIN nrm n ON n.layer = s.layer AND n.node = s.node
  UNION ALL SELECT s.run, o.li, s.node, 0.3 * s.p * n.norm * o.p FROM {'p0' if k == 1 else f'w{k - 1}'} s JOIN nrm n ON n.layer = s.layer AND n.node = s.node JOIN off o ON o.lj = s.layer
  UNION ALL SELECT run, layer, node, 0.7 * p FROM p0) GROUP BY ALL)"""
    for k in range(1, STEPS + 1)
)


def _walk_from(spark, d, sets=None):
    edges = materialise(tables.edges(spark, d), "edges")
    nodes = materialise(build.graph_nodes(edges), "nodes")
    weights = spark.createDataFrame(list(WEIGHTS), "layer string, w double")
    seeds = (tables.sets(spark, d) if sets is None else sets).select(F.col("name").alias("run"), "node", F.lit(1.0).alias("weight"))
    return edges, nodes, weights, materialise(seeds.join(nodes, "node", "left_semi"), "seeds")


def _walk(spark, d, sets=None, steps=STEPS):
    edges, nodes, weights, seeds = _walk_from(spark, d, sets)
    return propagate.restart_walk(edges, nodes, weights, seeds, steps), seeds, weights, nodes


@query("rw03_layer_moves", WITH + WALK_SQL + "SELECT lj, li, round(p, 9) AS p FROM off UNION ALL SELECT layer, layer, round(own, 9) FROM own")
def rw03(spark, d):
    layers = tables.table(spark, d, "lineitem", "l_returnflag").distinct().select(F.col("l_returnflag").alias("layer"))
    weights = layers.join(spark.createDataFrame(list(WEIGHTS), "layer string, w double"), "layer")
    return propagate.layer_moves(weights).select("lj", "li", F.round("p", 9).alias("p"))


@query("rw06_restart_walk", WITH + WALK_SQL + f"SELECT run, layer, node, round(p, 10) AS p FROM w{STEPS}")
def rw06(spark, d):
    """Four steps of the walk from every set; the library's default is twenty."""
    return _walk(spark, d)[0].select("run", "layer", "node", F.round("p", 10).alias("p"))


@query("rw06_walk_at_rest")
def rw06_rest(spark, d):
    """The walk from one set until it comes to rest; held against many steps in the tests."""
    scores = _walk(spark, d, tables.sets(spark, d).where("name = 'Brand#11'"), None)[0]
    return scores.select("run", "layer", "node", F.round("p", 9).alias("p"))


@query(
    "rw08_rank_aggregation",
    WITH + WALK_SQL + f""",
got AS (SELECT DISTINCT run, node FROM w{STEPS} ANTI JOIN seeds USING (run, node)),
cell AS (SELECT g.run, w.layer, g.node, coalesce(s.p, 0) AS p, round(coalesce(s.p, 0), 10) AS q FROM got g CROSS JOIN wts w LEFT JOIN w{STEPS} s ON s.run = g.run AND s.layer = w.layer AND s.node = g.node),
rk AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY q DESC) + (count(*) OVER (PARTITION BY run, q) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY run, layer ORDER BY q DESC) + (count(*) OVER (PARTITION BY run, layer, q) - 1) / 2.0 AS re FROM cell),
per AS (SELECT run, node, round(sum(p) / 3, 10) AS avg, round(CASE WHEN count(CASE WHEN p > 0 THEN 1 END) = 3 THEN exp(sum(CASE WHEN p > 0 THEN ln(p) END) / 3) ELSE 0 END, 10) AS geom,
  round(exp(avg(ln(ra))), 6) AS ga, round(exp(avg(ln(re))), 6) AS ge FROM rk GROUP BY run, node)
SELECT run, node, avg, geom""" + "".join(f", rank() OVER (PARTITION BY run ORDER BY {c}{way}) + (count(*) OVER (PARTITION BY run, {c}) - 1) / 2.0 AS {n}" for c, way, n in (("avg", " DESC", "rank_avg"), ("geom", " DESC", "rank_geom"), ("ga", "", "rank_all"), ("ge", "", "rank_each"))) + " FROM per",
)
def rw08(spark, d):
    """Mean scores over the layers and the four rankings of the nodes that are no seeds, from every set."""
    scores, seeds, weights, _ = _walk(spark, d)
    return propagate.four_ranks(scores, weights, seeds)


@query(
    "rw09_cross_validation",
    WITH.replace("sets AS (SELECT p_brand AS name, p_partkey AS node FROM part)", SEEDS_OF_FOLDS) + WALK_SQL + f""",
runs AS (SELECT DISTINCT run FROM seeds),
sc AS (SELECT run, node, round(sum(p) / 3, 12) AS s FROM w{STEPS} GROUP BY ALL),
cand AS (SELECT r.run, u.node, coalesce(s, 0) AS s FROM runs r CROSS JOIN uni u LEFT JOIN sc USING (run, node) ANTI JOIN seeds x ON x.run = r.run AND x.node = u.node),
lab AS (SELECT c.*, CAST(f.node IS NOT NULL AS INTEGER) AS y FROM cand c LEFT JOIN ffl f ON f.name || '/' || f.fold = c.run AND f.node = c.node),
rk AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY s) + (count(*) OVER (PARTITION BY run, s) - 1) / 2.0 AS k FROM lab)
SELECT split_part(run, '/', 1) AS name, CAST(split_part(run, '/', 2) AS INTEGER) AS fold, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
  round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM rk GROUP BY run""",
)
def rw09(spark, d):
    """Retrieval of held-out members: every set and fold walks from the other members in one batch, and the AUC of what is no seed follows.

    Three folds and four steps; the library's defaults are ten and twenty.
    """
    return _retrieval(spark, d, FOLDS, STEPS)


def _retrieval(spark, d, folds, steps):
    """name, fold, n_pos, n_neg, auc of every set and fold: what isn't reached has no row, it is counted."""
    members = materialise(evaluate.folds(tables.sets(spark, d), folds), "folds")
    edges, nodes, weights, seeds = _walk_from(spark, d, fold_seeds(spark, d, folds))
    run = F.concat_ws("/", "name", F.col("fold").cast("string")).alias("run")
    held = materialise(members.join(nodes, "node", "left_semi").select(run, "node"), "held-out")
    found = propagate.retrieved(edges, nodes, weights, seeds, held, steps)
    every = nodes.agg(F.count("*").alias("every"))
    totals = seeds.groupBy("run").agg(F.count("*").alias("seeds")).join(held.groupBy("run").agg(F.count("*").alias("n_pos")), "run", "left").crossJoin(F.broadcast(every))  # one row
    totals = totals.na.fill(0, ["n_pos"]).select("run", "n_pos", (F.col("every") - F.col("seeds") - F.col("n_pos")).alias("n_neg"))
    part = F.split("run", "/")
    return evaluate.auc_of_lists(found, totals, ["run"]).select(part[0].alias("name"), part[1].cast("int").alias("fold"), "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("rw09_ten_folds")
def rw09_ten(spark, d):
    """The same with ten folds and twenty steps, the library's defaults; held against numpy in the tests."""
    return _retrieval(spark, d, 10, 20)


@query(
    "rw06b_scaled_walk",
    WITH + ", sums AS (SELECT layer, src AS node, sum(1.0) AS total FROM two_way GROUP BY ALL), moves AS (SELECT 'columns' AS scaling, t.layer, t.src, t.dst, 1.0 / s.total AS w FROM two_way t JOIN sums s ON s.layer = t.layer AND s.node = t.src"
    " UNION ALL SELECT 'both', t.layer, t.src, t.dst, 1.0 / sqrt(s.total) / sqrt(u.total) FROM two_way t JOIN sums s ON s.layer = t.layer AND s.node = t.src JOIN sums u ON u.layer = t.layer AND u.node = t.dst),"
    " p0 AS (SELECT name AS run, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY name) AS p FROM sets JOIN nodes USING (node) WHERE layer = 'N'), s0 AS (SELECT x.scaling, run, node, p FROM p0, (VALUES ('columns'), ('both')) x(scaling)), "
    + ", ".join(
        f"s{k} AS (SELECT scaling, run, node, sum(y) AS p FROM (SELECT s.scaling, s.run, m.dst AS node, 0.2 * s.p * m.w AS y FROM s{k - 1} s JOIN moves m ON m.scaling = s.scaling AND m.layer = 'N' AND m.src = s.node UNION ALL SELECT scaling, run, node, 0.8 * p FROM s0) GROUP BY ALL)"
        for k in range(1, STEPS + 1)
    )
    + f" SELECT scaling, run, node, round(p, 10) AS p FROM s{STEPS}",
)
def rw06b(spark, d):
    """Four steps of the walk from every set in one layer, with moves scaled by columns and by both ends."""
    edges = materialise(tables.edges(spark, d).where("layer = 'N'"), "edges")
    entries = build.both_ways(edges).select(F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("w"))
    seeds = materialise(tables.sets(spark, d).join(build.graph_nodes(edges), "node", "left_semi").select(F.col("name").alias("run"), "node", F.lit(1.0).alias("weight")), "seeds")
    split = parts.cut(edges)  # the same for both
    one, two = (propagate.matrix_walk(entries, seeds, STEPS, scaling=x, split=split).select(F.lit(x).alias("scaling"), "run", "node", F.round("p", 10).alias("p")) for x in ("columns", "both"))
    return one.unionByName(two)


FOLD_SQL = """,
sh AS (SELECT name, node, row_number() OVER (PARTITION BY name ORDER BY md5('fold|' || name || '|' || node), node) AS i, count(*) OVER (PARTITION BY name) AS n FROM sets),
fl AS (SELECT name, node, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((i - 1) * 10 + n - 2) // (n - 1)) END AS INTEGER) AS fold FROM sh)
"""


@query("rw10_folds", WITH + FOLD_SQL + "SELECT name, node, fold FROM fl")
def rw10(spark, d):
    return evaluate.folds(tables.sets(spark, d))


LABEL = "substr(md5('case|' || p_partkey), 1, 1) = '0'"
LABELLED_SQL = f"WITH r AS (SELECT p_brand AS grp, CAST(p_size AS DOUBLE) AS score, p_retailprice AS other, CAST({LABEL} AS INTEGER) AS y FROM part)"


def _labelled(spark, d):
    part = tables.table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    y = (F.substring(F.md5(F.concat(F.lit("case|"), F.col("p_partkey").cast("string")).cast("binary")), 1, 1) == "0").cast("int")
    return part.select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("score"), F.col("p_retailprice").alias("other"), y.alias("label"))


@query(
    "rw14_auc",
    LABELLED_SQL + ", k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rk FROM r)"
    " SELECT grp, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM k GROUP BY grp",
)
def rw14(spark, d):
    return evaluate.auc(_labelled(spark, d), ["grp"]).withColumn("auc", F.round("auc", 6))


@query(
    "rw15_auc_summary",
    LABELLED_SQL + ", k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rk FROM r),"
    " u AS (SELECT (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM k GROUP BY grp)"
    " SELECT round(avg(auc), 6) AS mean, round(median(auc), 6) AS median, round(quantile_cont(auc, 0.25), 6) AS q25, round(quantile_cont(auc, 0.75), 6) AS q75 FROM u",
)
def rw15(spark, d):
    found = evaluate.auc(_labelled(spark, d), ["grp"])
    return found.agg(*(F.round(f, 6).alias(n) for n, f in (("mean", F.avg("auc")), ("median", F.percentile("auc", 0.5)), ("q25", F.percentile("auc", 0.25)), ("q75", F.percentile("auc", 0.75)))))


@query(
    "rw16_roc",
    LABELLED_SQL + ", t AS (SELECT grp, score AS threshold, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY ALL)"
    " SELECT grp, threshold, round(sum(p) OVER w / sum(p) OVER (PARTITION BY grp), 9) AS tpr, round(sum(q) OVER w / sum(q) OVER (PARTITION BY grp), 9) AS fpr FROM t WINDOW w AS (PARTITION BY grp ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def rw16(spark, d):
    return evaluate.roc(_labelled(spark, d), ["grp"]).select("grp", "threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def _placement_sql(score: str, k: int) -> str:
    """The placement of each row among the other class by one score."""
    rank = lambda by: f"rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0"
    return f"({rank('grp')} - ({rank('grp, y')})) / nullif(CASE WHEN y = 1 THEN count(*) FILTER (y = 0) OVER (PARTITION BY grp) ELSE count(*) FILTER (y = 1) OVER (PARTITION BY grp) END, 0) AS share{k}"


@query(
    "rw17_delong",
    LABELLED_SQL + f", s AS (SELECT grp, y, {_placement_sql('score', 1)}, {_placement_sql('other', 2)} FROM r), v AS (SELECT grp, y, CASE WHEN y = 1 THEN share1 ELSE 1 - share1 END AS v1, CASE WHEN y = 1 THEN share2 ELSE 1 - share2 END AS v2 FROM s),"
    " p AS (SELECT grp, y, count(*) AS c, avg(v1) AS a1, avg(v2) AS a2, var_samp(v1) + var_samp(v2) - 2 * covar_samp(v1, v2) AS s FROM v GROUP BY ALL),"
    " g AS (SELECT grp, max(a1) FILTER (y = 1) AS auc1, max(a2) FILTER (y = 1) AS auc2, sum(s / c) AS v FROM p GROUP BY ALL), z AS (SELECT *, CASE WHEN v > 0 THEN (auc1 - auc2) / sqrt(v) END AS z FROM g)"
    f" SELECT grp, round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round(z, 5) AS z, CASE WHEN z IS NOT NULL THEN round(2 * ({stats.upper_tail_sql('abs(z)')}), 5) END AS p FROM z",
)
def rw17(spark, d):
    """DeLong comparison of two scores' AUCs in every brand."""
    found = evaluate.delong(_labelled(spark, d), ["grp"], "score", "other")
    return found.select("grp", *(F.round(c, n).alias(c) for c, n in (("auc1", 6), ("auc2", 6), ("z", 5), ("p", 5))))


@query("rw19_edge_subsample", WITH + "SELECT s.seed, e.layer, e.a, e.b FROM range(1, 4) s(seed), (SELECT *, 1 FROM edges) e QUALIFY row_number() OVER (PARTITION BY s.seed, e.layer ORDER BY md5(s.seed || '|' || e.layer || '|' || e.a || '|' || e.b), e.a, e.b) <= 100")
def rw19(spark, d):
    """Three seeded samples of a hundred edges a layer."""
    seeds = spark.range(1, 4).select(F.col("id").alias("seed"))
    keyed = materialise(tables.edges(spark, d).select("layer", "a", "b"), "edges").crossJoin(F.broadcast(seeds))
    keyed = keyed.withColumn("key", stats.shuffled(F.col("seed"), F.col("layer"), F.col("a"), F.col("b")))
    return draws.smallest(keyed, ["seed", "layer"], "key", ["a", "b"], 100).drop("r", "key")


@query(
    "rw20_patient_seeds",
    "SELECT o_custkey AS patient, l_partkey AS node, count(DISTINCT l_suppkey) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
)
def rw20(spark, d):
    """Seeds of every patient (customer), weighted by the number of terms (suppliers) that hit the node (part)."""
    o, li = tables.table(spark, d, "orders", "o_orderkey", "o_custkey"), tables.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("patient"), F.col("l_partkey").alias("node")).agg(F.count_distinct("l_suppkey").alias("weight"))


@query(
    "rw21_patient_candidates",
    "WITH c AS (SELECT DISTINCT o_custkey AS patient, l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT c.patient, c.node, p_retailprice AS score FROM c LEFT JOIN part ON p_partkey = c.node)"
    " SELECT patient, node, score, rank() OVER (PARTITION BY patient ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY patient, score) - 1) / 2.0 AS network_rank, count(*) OVER (PARTITION BY patient) AS total FROM s",
)
def rw21(spark, d):
    """Candidates of every patient ranked by score, with their number; each candidate once."""
    o, li = tables.table(spark, d, "orders", "o_orderkey", "o_custkey"), tables.table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    c = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("patient"), F.col("l_partkey").alias("node")).distinct()
    s = c.join(tables.table(spark, d, "part", "p_partkey", "p_retailprice").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score")), "node", "left")
    return s.select("patient", "node", "score", stats.rank_average("score", ["patient"], True).alias("network_rank"), F.count("*").over(Window.partitionBy("patient")).alias("total"))


@query("rw24_holdout", "SELECT c_custkey AS patient FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = c_custkey AND p_brand = 'Brand#3')")
def rw24(spark, d):
    """Patients with no candidate in a panel (one brand)."""
    panel = tables.table(spark, d, "part", "p_partkey", "p_brand").where("p_brand = 'Brand#3'")
    hit = tables.table(spark, d, "lineitem", "l_orderkey", "l_partkey").join(panel, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    of = tables.table(spark, d, "orders", "o_orderkey", "o_custkey").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return tables.table(spark, d, "customer", "c_custkey").join(of, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("patient"))
