"""Queries of the graph operators (survey rows GR)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import stats
from skein.functions.scratch import materialise
from skein.operators import build, components, evaluate, topology
from skein.plans.base import query
from skein.sources import tables
from skein.sources.tables import EDGES_SQL

WITH = f"WITH {EDGES_SQL}"
RECURSIVE = f"WITH RECURSIVE {EDGES_SQL}"


@query("gr01_canonical_edges", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def gr01(spark, d):
    return build.canonical(tables.table(spark, d, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("gr02_graph_nodes", "SELECT l_partkey AS node FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def gr02(spark, d):
    return build.graph_nodes(tables.table(spark, d, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("gr03_induced_subgraph", WITH + "SELECT s.name, e.layer, e.a, e.b FROM edges e JOIN sets s ON s.node = e.a JOIN sets t ON t.node = e.b AND t.name = s.name")
def gr03(spark, d):
    return build.induced(tables.edges(spark, d), tables.sets(spark, d))


LCC_SQL = """,
inside AS (SELECT s.name, n.layer, n.node FROM nodes n JOIN sets s USING (node)),
links AS (SELECT s.name, e.layer, e.a, e.b FROM edges e JOIN sets s ON s.node = e.a JOIN sets t ON t.node = e.b AND t.name = s.name),
both_links AS (SELECT name, layer, a AS src, b AS dst FROM links UNION ALL SELECT name, layer, b, a FROM links),
reach AS (
  SELECT name, layer, node, node AS label FROM inside
  UNION SELECT r.name, r.layer, l.dst, r.label FROM reach r JOIN both_links l ON l.name = r.name AND l.layer = r.layer AND l.src = r.node
),
labels AS (SELECT name, layer, node, min(label) AS label FROM reach GROUP BY ALL),
comps AS (SELECT name, layer, label, count(*) AS size FROM labels GROUP BY ALL),
lcc AS (SELECT name, layer, CAST(sum(size) AS BIGINT) AS n_in_graph, max(size) AS lcc FROM comps GROUP BY ALL)
"""


def layer_nodes(edges):
    return build.graph_nodes(edges, by=("layer",))


def _modules(spark, d, edges):
    """name, layer, n_in_graph, lcc of every set."""
    sets = tables.sets(spark, d)
    run = F.concat_ws("|", "name", "layer").alias("run")
    found = components.largest(layer_nodes(edges).join(sets, "node").select(run, "node"), materialise(build.induced(edges, sets).select(run, "a", "b"), "modules"))
    part = F.split("run", r"\|")
    return found.select(part[0].alias("name"), part[1].alias("layer"), F.col("n").alias("n_in_graph"), "lcc")


@query("gr04_module_lcc", RECURSIVE + LCC_SQL + "SELECT * FROM lcc")
def gr04(spark, d):
    return _modules(spark, d, materialise(tables.edges(spark, d), "edges"))


#: Random sets of each size: as many as the reference draws, and the few of the queries that only take the result further.
TRIALS = 1000
FEW_TRIALS = 8


def _significance(spark, d, trials=TRIALS, sets=None, edges=None):
    edges = materialise(tables.edges(spark, d), "edges") if edges is None else edges
    return components.significance(edges, layer_nodes(edges), tables.sets(spark, d) if sets is None else sets, trials)


NULL_SQL = """,
sizes AS (SELECT layer, name, count(*) AS n_in_graph FROM inside GROUP BY ALL),
wanted AS (SELECT DISTINCT layer, n_in_graph AS size FROM sizes WHERE n_in_graph >= 10),
drawn AS (
  SELECT layer, trial, node, row_number() OVER (PARTITION BY layer, trial ORDER BY md5('lcc|' || layer || '|' || trial || '|' || node), node) AS r
  FROM nodes, range(1, 9) t(trial)
),
random AS (SELECT d.layer, w.size, d.trial, d.node FROM drawn d JOIN wanted w ON w.layer = d.layer AND d.r <= w.size),
rlinks AS (
  SELECT x.layer, x.size, x.trial, e.src, e.dst FROM two_way e
  JOIN random x ON x.layer = e.layer AND x.node = e.src JOIN random y ON y.layer = e.layer AND y.node = e.dst AND y.size = x.size AND y.trial = x.trial
),
rreach AS (
  SELECT layer, size, trial, node, node AS label FROM random
  UNION SELECT r.layer, r.size, r.trial, l.dst, r.label FROM rreach r
  JOIN rlinks l ON l.layer = r.layer AND l.size = r.size AND l.trial = r.trial AND l.src = r.node
),
rlabels AS (SELECT layer, size, trial, node, min(label) AS label FROM rreach GROUP BY ALL),
rlcc AS (SELECT layer, size, trial, max(c) AS lcc FROM (SELECT layer, size, trial, label, count(*) AS c FROM rlabels GROUP BY ALL) GROUP BY ALL),
nulls AS (SELECT layer, size, avg(lcc) AS mean, stddev_samp(lcc) AS sd FROM rlcc GROUP BY ALL),
scored AS (
  SELECT s.name, s.layer, s.n_in_graph, CASE WHEN s.n_in_graph >= 10 THEN l.lcc END AS lcc, mean, sd, CASE WHEN sd > 0 THEN (l.lcc - mean) / sd END AS z
  FROM sizes s JOIN lcc l USING (name, layer) LEFT JOIN nulls n ON n.layer = s.layer AND n.size = s.n_in_graph
)
"""
#: The same with as many random sets as the reference draws.
WHOLE_NULL_SQL = NULL_SQL.replace(f"range(1, {FEW_TRIALS + 1})", f"range(1, {TRIALS + 1})")


@query("gr05_lcc_significance", RECURSIVE + LCC_SQL + WHOLE_NULL_SQL + "SELECT name, layer, n_in_graph, lcc, round(mean, 6) AS mean, round(sd, 6) AS sd, round(z, 6) AS z FROM scored")
def gr05(spark, d):
    found = _significance(spark, d)
    return found.select("name", "layer", "n_in_graph", "lcc", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "z")))


CLASSES = ("****", "***", "**", "*", "none")
BREAKS = (0.0, 1e-4, 1e-3, 1e-2, 0.05, 1.0)
BH_SQL = f""",
pv AS (SELECT *, {stats.upper_tail_sql("z")} AS p0 FROM scored WHERE z IS NOT NULL UNION ALL SELECT *, NULL FROM scored WHERE z IS NULL),
rn AS (SELECT *, count(p0) OVER () AS cnt, row_number() OVER (ORDER BY p0 NULLS LAST) AS rn FROM pv),
bh AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN least(1.0, min(p0 * cnt / rn) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS adj FROM rn),
cls AS (
  SELECT *, CASE WHEN adj > 0 AND adj <= 1e-4 THEN '****' WHEN adj > 1e-4 AND adj <= 1e-3 THEN '***' WHEN adj > 1e-3 AND adj <= 1e-2 THEN '**'
    WHEN adj > 1e-2 AND adj <= 0.05 THEN '*' WHEN adj > 0.05 AND adj <= 1 THEN 'none' END AS signif FROM bh WHERE n_in_graph >= 10 AND lcc >= 5
)
"""


def classified(found, min_n=10, min_lcc=5):
    """p, adjusted p over all rows, class and -log10 of sets large enough, with rows kept whose set and layer are ever significant."""
    found = stats.adjusted(found.withColumn("p", stats.upper_tail(F.col("z"))), "p")
    found = found.where((F.col("n_in_graph") >= min_n) & (F.col("lcc") >= min_lcc)).withColumn("signif", stats.cut_right(F.col("adjusted"), BREAKS, CLASSES))
    found = materialise(found.withColumn("minus_log", F.when(F.col("adjusted") > 0, -F.log10("adjusted"))), "classified")
    hits = found.where("signif <> 'none'")
    return found.join(hits.select("name").distinct(), "name", "left_semi").join(hits.select("layer").distinct(), "layer", "left_semi")


@query(
    "gr09_process_result",
    RECURSIVE + LCC_SQL + WHOLE_NULL_SQL + BH_SQL
    + "SELECT name, layer, lcc, signif, round(adj, 8) AS adjusted, round(-log10(adj), 4) AS minus_log FROM cls "
    "WHERE name IN (SELECT name FROM cls WHERE signif <> 'none') AND layer IN (SELECT layer FROM cls WHERE signif <> 'none')",
)
def gr09(spark, d):
    return classified(_significance(spark, d)).select("name", "layer", "lcc", "signif", F.round("adjusted", 8).alias("adjusted"), F.round("minus_log", 4).alias("minus_log"))


@query(
    "ui02_significant_layers",
    RECURSIVE + LCC_SQL + WHOLE_NULL_SQL + BH_SQL
    + "SELECT name, layer, n_in_graph, lcc, signif, round(z, 6) AS z, row_number() OVER (PARTITION BY name ORDER BY round(z, 6) DESC, layer) AS place FROM cls WHERE signif <> 'none'",
)
def ui02(spark, d):
    """The layers in which a set is significant, those of the largest z first."""
    found = classified(_significance(spark, d)).where("signif <> 'none'").withColumn("z", F.round("z", 6))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("z"), "layer")).cast("long")  # a row a layer
    return found.select("name", "layer", "n_in_graph", "lcc", "signif", "z", place.alias("place"))


@query(
    "rw13_significant_scenarios",
    RECURSIVE + LCC_SQL + NULL_SQL + BH_SQL
    + ", s AS (SELECT name, layer, z FROM cls WHERE signif <> 'none') SELECT 'weighted' AS scenario, name, layer, round(z, 6) AS w FROM s UNION ALL SELECT 'unweighted', name, layer, 1.0 FROM s"
    " UNION ALL SELECT 'best', name, max_by(layer, round(z, 6)), 1.0 FROM s GROUP BY name",
)
def rw13_significant(spark, d):
    """Layers and weights of the scenarios that follow from significance: all significant layers by z, unweighted, and the best one alone."""
    s = materialise(classified(_significance(spark, d, FEW_TRIALS)).where("signif <> 'none'").select("name", "layer", F.round("z", 6).alias("w")), "significant")
    one = s.groupBy("name").agg(F.max_by("layer", "w").alias("layer"))
    pick = lambda frame, scenario, w: frame.select(F.lit(scenario).alias("scenario"), "name", "layer", w.alias("w"))
    return pick(s, "weighted", F.col("w")).unionByName(pick(s, "unweighted", F.lit(1.0))).unionByName(pick(one, "best", F.lit(1.0)))


#: Layers that the custom scenarios leave out, together.
EXCLUDED = {"without A": ["A"], "without N and R": ["N", "R"], "without any": ["A", "N", "R"], "whole": []}


@query(
    "rw13_custom_lists",
    RECURSIVE + LCC_SQL + WHOLE_NULL_SQL + BH_SQL
    + ", x(scenario, gone) AS (VALUES " + ", ".join(f"('{k}', {v or '[]::VARCHAR[]'})" for k, v in EXCLUDED.items()) + ") SELECT scenario, name, layer, round(z, 6) AS w FROM cls, x WHERE signif <> 'none' AND NOT list_contains(gone, layer)",
)
def rw13_custom(spark, d):
    """Each set's significant layers by z but for those that a scenario's list leaves out; a scenario that leaves none to a set has no row for it."""
    s = materialise(classified(_significance(spark, d)).where("signif <> 'none'").select("name", "layer", F.round("z", 6).alias("w")), "significant")
    lists = spark.createDataFrame([(k, v) for k, v in EXCLUDED.items()], "scenario string, gone array<string>")
    return s.join(F.broadcast(lists), ~F.array_contains("gone", F.col("layer"))).select("scenario", "name", "layer", "w")  # the lists are a parameter


FOLDS = 3
SEEDS_OF_FOLDS = f"""fsh AS (SELECT p_brand AS name, p_partkey AS node, row_number() OVER (PARTITION BY p_brand ORDER BY md5('fold|' || p_brand || '|' || p_partkey), p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
ffl AS (SELECT name, node, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((i - 1) * {FOLDS} + n - 2) // (n - 1)) END AS INTEGER) AS fold FROM fsh),
sets AS (SELECT name || '/' || t.fold AS name, node FROM ffl, range(1, {FOLDS + 1}) t(fold) WHERE ffl.fold <> t.fold)"""


def fold_seeds(spark, d, folds=FOLDS):
    """name (set/fold), node: the members of every set that are not in the fold."""
    found = materialise(evaluate.folds(tables.sets(spark, d), folds), "folds")
    runs = spark.range(1, folds + 1).select(F.col("id").cast("int").alias("run"))
    return found.join(F.broadcast(runs), F.col("fold") != F.col("run")).select(F.concat_ws("/", "name", F.col("run").cast("string")).alias("name"), "node")


@query(
    "rw12_fold_layers",
    RECURSIVE.replace("sets AS (SELECT p_brand AS name, p_partkey AS node FROM part)", SEEDS_OF_FOLDS) + LCC_SQL + NULL_SQL + f""",
pv AS (SELECT *, split_part(name, '/', 2) AS fold, {stats.upper_tail_sql("z")} AS p0 FROM scored WHERE z IS NOT NULL UNION ALL SELECT *, split_part(name, '/', 2), NULL FROM scored WHERE z IS NULL),
rn AS (SELECT *, count(p0) OVER (PARTITION BY fold) AS cnt, row_number() OVER (PARTITION BY fold ORDER BY p0 NULLS LAST) AS rn FROM pv),
bh AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN least(1.0, min(p0 * cnt / rn) OVER (PARTITION BY fold ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS adj FROM rn)
SELECT split_part(name, '/', 1) AS name, CAST(fold AS INTEGER) AS fold, layer, lcc, round(z, 6) AS z, round(adj, 8) AS adjusted, adj < 0.05 AS significant FROM bh""",
)
def rw12(spark, d):
    """Significance of every layer for every set from the seeds of each fold alone, p adjusted within the fold."""
    found = _significance(spark, d, FEW_TRIALS, sets=materialise(fold_seeds(spark, d), "fold-seeds"))
    part = F.split("name", "/")
    found = found.withColumn("fold", part[1].cast("int")).withColumn("name", part[0]).withColumn("p", stats.upper_tail(F.col("z")))
    found = stats.adjusted(found, "p", by=["fold"])  # a row a set and layer
    return found.select("name", "fold", "layer", "lcc", F.round("z", 6).alias("z"), F.round("adjusted", 8).alias("adjusted"), (F.col("adjusted") < 0.05).alias("significant"))


@query("gr07_reference_curve")
def gr07(spark, d):
    """Mean and deviation of the largest component of random sets at the 116 sizes, smoothed; two draws a size, the library's default is 1000."""
    edges = materialise(tables.edges(spark, d), "edges")
    return topology.reference_curve(edges, layer_nodes(edges), draws=2)


@query(
    "gr08_reference_z",
    RECURSIVE + LCC_SQL + NULL_SQL + "SELECT l.name, l.layer, l.lcc, round((l.lcc - n.mean) / nullif(n.sd, 0), 6) AS z FROM lcc l LEFT JOIN nulls n ON n.layer = l.layer AND n.size = l.n_in_graph",
)
def gr08(spark, d):
    """z of every set from the stored random statistics of its size; null where the size has none."""
    edges = materialise(tables.edges(spark, d), "edges")
    scored = materialise(_significance(spark, d, FEW_TRIALS, edges=edges), "scored")
    curve = scored.select("layer", "n_in_graph", "mean", "sd").where("mean is not null").distinct()
    own = _modules(spark, d, edges)
    return own.join(curve, ["layer", "n_in_graph"], "left").select("name", "layer", "lcc", F.round(F.when(F.col("sd") > 0, (F.col("lcc") - F.col("mean")) / F.col("sd")), 6).alias("z"))


@query("gr06_rewired_null")
def gr06(spark, d):
    """Observed largest components against degree-preserving rewirings, three a layer, ten rounds of swaps; the library's defaults are 1000 and 20."""
    edges = materialise(tables.edges(spark, d), "edges")
    return topology.rewired_significance(edges, tables.sets(spark, d), trials=3, rounds=10)


@query(
    "gr10_connectivity",
    WITH + ", seeds AS (SELECT node FROM sets WHERE name = 'Brand#11'), hit AS (SELECT b.layer, b.src AS node, count(*) AS x FROM two_way b JOIN seeds s ON s.node = b.dst GROUP BY ALL),"
    " pop AS (SELECT layer, count(*) AS n FROM nodes GROUP BY ALL), succ AS (SELECT n.layer, count(*) AS m FROM nodes n JOIN seeds USING (node) GROUP BY ALL)"
    " SELECT d.layer, d.node, coalesce(x, 0) AS x, d.k, p.n AS population, coalesce(s.m, 0) AS successes FROM deg d LEFT JOIN hit h ON h.layer = d.layer AND h.node = d.node JOIN pop p ON p.layer = d.layer LEFT JOIN succ s ON s.layer = d.layer",
)
def gr10(spark, d):
    """Links of every node to the seeds, with what the hypergeometric tail needs; see ``topology.connectivity`` for the tail itself."""
    seeds = tables.sets(spark, d).where("name = 'Brand#11'").select("node")
    edges = materialise(tables.edges(spark, d), "edges")
    return topology.connectivity_counts(edges, layer_nodes(edges), seeds)


_CHOOSE = lambda a, b: f"lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - ({b}) + 1)"


@query(
    "gr10_connectivity_tail",
    WITH + ", seeds AS (SELECT node FROM sets WHERE name = 'Brand#11'), hit AS (SELECT b.layer, b.src AS node, count(*) AS x FROM two_way b JOIN seeds s ON s.node = b.dst GROUP BY ALL),"
    " pop AS (SELECT layer, count(*) AS n FROM nodes GROUP BY ALL), succ AS (SELECT n.layer, count(*) AS m FROM nodes n JOIN seeds USING (node) GROUP BY ALL),"
    " c AS (SELECT d.layer, d.node, coalesce(x, 0) AS x, d.k, p.n, coalesce(s.m, 0) AS m FROM deg d LEFT JOIN hit h ON h.layer = d.layer AND h.node = d.node JOIN pop p ON p.layer = d.layer LEFT JOIN succ s ON s.layer = d.layer),"
    f" t AS (SELECT *, least(1.0, coalesce(list_sum(list_transform(range(greatest(x + 1, k - (n - m)), least(k, m) + 1), lambda i: exp({_CHOOSE('m', 'i')} + {_CHOOSE('n - m', 'k - i')} - ({_CHOOSE('n', 'k')})))), 0.0)) AS p FROM c)"
    " SELECT l.layer, p_partkey AS node, coalesce(x, 0) AS x, coalesce(k, 0) AS k, round(coalesce(p, 1.0), 8) AS p FROM part CROSS JOIN (SELECT DISTINCT l_returnflag AS layer FROM lineitem) l LEFT JOIN t ON t.layer = l.layer AND t.node = p_partkey",
)
def gr10_tail(spark, d):
    """The tails of all parts in every layer; a part that a layer lacks has 0, 0, 1."""
    layers = tables.table(spark, d, "lineitem", F.col("l_returnflag").alias("layer")).distinct()
    every = tables.table(spark, d, "part", F.col("p_partkey").alias("node")).crossJoin(F.broadcast(layers))  # few layers
    return topology.connectivity(gr10(spark, d), every).withColumn("p", F.round("p", 8))


@query("gr11_degree", WITH + "SELECT layer, node, k FROM deg")
def gr11(spark, d):
    return build.degrees(tables.edges(spark, d))


@query(
    "gr12_density",
    WITH + "SELECT layer, v, e, round(2.0 * e / (v * (v - 1)), 9) AS density FROM (SELECT layer, count(*) AS e FROM edges GROUP BY ALL) JOIN (SELECT layer, count(*) AS v FROM nodes GROUP BY ALL) USING (layer)",
)
def gr12(spark, d):
    edges = materialise(tables.edges(spark, d), "edges")
    return topology.density(edges, layer_nodes(edges))


TRIANGLES_SQL = """,
tri AS (
  SELECT x.layer, x.a AS u, x.b AS v, y.b AS w FROM edges x JOIN edges y ON y.layer = x.layer AND y.a = x.b
  JOIN edges z ON z.layer = x.layer AND z.a = x.a AND z.b = y.b
),
tv AS (SELECT layer, node, count(*) AS t FROM (SELECT layer, u AS node FROM tri UNION ALL SELECT layer, v FROM tri UNION ALL SELECT layer, w FROM tri) GROUP BY ALL)
"""


@query(
    "gr13_transitivity",
    WITH + TRIANGLES_SQL + "SELECT d.layer, CAST(coalesce(sum(t), 0) / 3 AS BIGINT) AS triangles, round(coalesce(sum(t), 0) / sum(k * (k - 1) / 2.0), 9) AS transitivity FROM deg d LEFT JOIN tv ON tv.layer = d.layer AND tv.node = d.node GROUP BY d.layer",
)
def gr13(spark, d):
    return topology.transitivity(materialise(tables.edges(spark, d), "edges"))


@query(
    "gr14_local_clustering",
    WITH + TRIANGLES_SQL + "SELECT d.layer, round(avg(coalesce(t, 0) / (k * (k - 1) / 2.0)), 9) AS clustering FROM deg d LEFT JOIN tv ON tv.layer = d.layer AND tv.node = d.node WHERE k >= 2 GROUP BY d.layer",
)
def gr14(spark, d):
    return topology.local_clustering(materialise(tables.edges(spark, d), "edges"))


@query(
    "gr15_assortativity",
    WITH + "SELECT b.layer, round(corr(x.k, y.k), 6) AS assortativity FROM two_way b JOIN deg x ON x.layer = b.layer AND x.node = b.src JOIN deg y ON y.layer = b.layer AND y.node = b.dst GROUP BY b.layer",
)
def gr15(spark, d):
    return topology.assortativity(materialise(tables.edges(spark, d), "edges"))


@query(
    "gr16_nominal_assortativity",
    WITH + """, kind AS (SELECT p_partkey AS node, p_size > 25 AS t FROM part),
mix AS (SELECT b.layer, x.t AS i, y.t AS j, count(*) AS c FROM two_way b JOIN kind x ON x.node = b.src JOIN kind y ON y.node = b.dst GROUP BY ALL),
share AS (SELECT layer, i, j, c / sum(c) OVER (PARTITION BY layer) AS e FROM mix),
mar AS (SELECT layer, i, sum(e) AS a, sum(CASE WHEN i = j THEN e ELSE 0 END) AS own FROM share GROUP BY ALL)
SELECT layer, round((sum(own) - sum(a * a)) / (1 - sum(a * a)), 6) AS assortativity FROM mar GROUP BY layer""",
)
def gr16(spark, d):
    kinds = tables.table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("kind"))
    return topology.nominal_assortativity(materialise(tables.edges(spark, d), "edges"), kinds)


KNN_SQL = """,
knn AS (SELECT b.layer, b.src AS node, avg(y.k) AS knn FROM two_way b JOIN deg y ON y.layer = b.layer AND y.node = b.dst GROUP BY ALL),
hist AS (SELECT layer, k, count(*) AS c FROM deg GROUP BY ALL),
mean AS (SELECT layer, sum(k * c) / sum(c) AS mk, sum(c) AS n FROM hist GROUP BY ALL),
q AS (SELECT layer, k - 1 AS j, k * (c / n) / mk AS qk, mk FROM hist JOIN mean USING (layer)),
mq AS (SELECT layer, sum(j * qk) AS mu, sum((mk - j) * (mk - j) * qk) AS var FROM q GROUP BY ALL),
ec AS (SELECT layer, count(*) AS e FROM edges GROUP BY ALL)
"""


@query("gr17_local_assortativity", WITH + KNN_SQL + "SELECT d.layer, d.node, d.k, round(knn, 6) AS knn, round(d.k * (d.k - 1) * (knn - 1 - mu) / (2 * e * var), 9) AS local_r FROM deg d JOIN knn USING (layer, node) JOIN mq USING (layer) JOIN ec USING (layer)")
def gr17(spark, d):
    return topology.local_assortativity(materialise(tables.edges(spark, d), "edges"))


RANK_SQL = "rank() OVER (PARTITION BY layer ORDER BY {x}) + (count(*) OVER (PARTITION BY layer, {x}) - 1) / 2.0"


@query(
    "gr18_social_bias",
    WITH + f", pop AS (SELECT l_partkey AS node, count(*) AS cited FROM lineitem GROUP BY ALL), r AS (SELECT layer, {RANK_SQL.format(x='k')} AS rk, {RANK_SQL.format(x='cited')} AS rc FROM deg JOIN pop USING (node)) SELECT layer, round(corr(rk, rc), 6) AS bias FROM r GROUP BY layer",
)
def gr18(spark, d):
    """Spearman correlation of a node's degree and popularity in each layer."""
    cited = tables.table(spark, d, "lineitem", "l_partkey").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("cited"))
    two_way = build.degrees(tables.edges(spark, d)).join(cited, "node")
    ranked = two_way.select("layer", stats.rank_average("k", ["layer"]).alias("rk"), stats.rank_average("cited", ["layer"]).alias("rc"))
    return ranked.groupBy("layer").agg(F.round(F.corr("rk", "rc"), 6).alias("bias"))


@query(
    "gr19_power_law",
    WITH + """, h AS (SELECT layer, k, count(*) AS c FROM deg GROUP BY ALL),
p AS (SELECT layer, k, c / sum(c) OVER (PARTITION BY layer) AS pdf, sum(c) OVER (PARTITION BY layer ORDER BY k DESC) / sum(c) OVER (PARTITION BY layer) AS ccdf FROM h)
SELECT layer, round(-regr_slope(log10(pdf), log10(k)), 6) AS alpha_pdf, round(regr_r2(log10(pdf), log10(k)), 6) AS r2_pdf,
  round(-regr_slope(log10(ccdf), log10(k)), 6) AS alpha_ccdf, round(regr_r2(log10(ccdf), log10(k)), 6) AS r2_ccdf FROM p GROUP BY layer""",
)
def gr19(spark, d):
    return topology.power_law(tables.edges(spark, d))


OVERLAP_SQL = """,
ec AS (SELECT layer, count(*) AS e FROM edges GROUP BY ALL),
inter AS (SELECT x.layer AS v1, y.layer AS v2, count(*) AS n FROM edges x JOIN edges y ON x.a = y.a AND x.b = y.b AND x.layer < y.layer GROUP BY ALL),
sim AS (
  SELECT p.layer AS v1, q.layer AS v2, coalesce(n, 0) AS shared, coalesce(n, 0) / (p.e + q.e - coalesce(n, 0)) AS jaccard, coalesce(n, 0) / least(p.e, q.e) AS overlap
  FROM ec p JOIN ec q ON p.layer < q.layer LEFT JOIN inter i ON i.v1 = p.layer AND i.v2 = q.layer
)
"""


@query("gr20_layer_similarity", WITH + OVERLAP_SQL + "SELECT v1, v2, shared, round(jaccard, 9) AS jaccard, round(overlap, 9) AS overlap FROM sim")
def gr20(spark, d):
    found = topology.layer_similarity(materialise(tables.edges(spark, d), "edges"))
    return found.select("v1", "v2", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("overlap", 9).alias("overlap"))


PERMS = 10
SIM_CLASSES = ("****", "***", "**", "*", "ns")
SIM_BREAKS = (0.0, 1e-5, 1e-4, 1e-3, 0.05, 1.0)


@query(
    "gr21_overlap_permutation",
    WITH + f"""{OVERLAP_SQL},
nat AS (SELECT layer, node, row_number() OVER (PARTITION BY layer ORDER BY node) AS r FROM nodes),
shf AS (SELECT layer, perm, node, row_number() OVER (PARTITION BY layer, perm ORDER BY md5('perm|' || layer || '|' || perm || '|' || node), node) AS r FROM nodes, range(1, {PERMS + 1}) t(perm)),
relab AS (SELECT n.layer, s.perm, n.node, s.node AS to_node FROM nat n JOIN shf s ON s.layer = n.layer AND s.r = n.r),
pe AS (SELECT e.layer, x.perm, least(x.to_node, y.to_node) AS a, greatest(x.to_node, y.to_node) AS b FROM edges e JOIN relab x ON x.layer = e.layer AND x.node = e.a JOIN relab y ON y.layer = e.layer AND y.node = e.b AND y.perm = x.perm),
pi AS (SELECT x.layer AS v1, y.layer AS v2, x.perm AS p1, y.perm AS p2, count(*) AS n FROM pe x JOIN pe y ON x.a = y.a AND x.b = y.b AND x.layer < y.layer GROUP BY ALL),
po AS (SELECT s.v1, s.v2, p1, p2, coalesce(n, 0) / least(ex.e, ey.e) AS o FROM sim s CROSS JOIN range(1, {PERMS + 1}) t(p1) CROSS JOIN range(1, {PERMS + 1}) u(p2) JOIN ec ex ON ex.layer = s.v1 JOIN ec ey ON ey.layer = s.v2
  LEFT JOIN pi USING (v1, v2, p1, p2)),
st AS (SELECT v1, v2, avg(o) AS mean, stddev_samp(o) AS sd FROM po GROUP BY ALL),
zs AS (SELECT v1, v2, round(overlap, 9) AS overlap, round(mean, 9) AS mean, round(sd, 9) AS sd, round((overlap - mean) / nullif(sd, 0), 4) AS z FROM sim JOIN st USING (v1, v2)),
zp AS (SELECT *, {stats.upper_tail_sql("z")} AS p0 FROM zs WHERE z IS NOT NULL UNION ALL SELECT *, NULL FROM zs WHERE z IS NULL),
zr AS (SELECT *, count(p0) OVER () AS cnt, row_number() OVER (ORDER BY p0 NULLS LAST) AS rn FROM zp),
zb AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN least(1.0, min(p0 * cnt / rn) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS adj FROM zr)
SELECT v1, v2, overlap, mean, sd, z, round(p0, 8) AS p, round(adj, 8) AS adjusted, round(log2(overlap / nullif(mean, 0)), 4) AS log_ratio,
  CASE WHEN adj >= 0 AND adj <= 1e-5 THEN '****' WHEN adj > 1e-5 AND adj <= 1e-4 THEN '***' WHEN adj > 1e-4 AND adj <= 1e-3 THEN '**' WHEN adj > 1e-3 AND adj <= 0.05 THEN '*' WHEN adj > 0.05 THEN 'ns' END AS signif FROM zb""",
)
def gr21(spark, d):
    edges = materialise(tables.edges(spark, d), "edges")
    found = topology.overlap_significance(edges, layer_nodes(edges), PERMS)
    found = stats.adjusted(found.withColumn("p", stats.upper_tail(F.col("z"))), "p")  # one row a pair of layers
    signif = stats.cut_right(F.col("adjusted"), SIM_BREAKS, SIM_CLASSES, lowest=True)
    ratio = F.round(F.log2(F.col("overlap") / F.nullif("mean", F.lit(0.0))), 4)
    return found.withColumn("signif", signif).select("v1", "v2", "overlap", "mean", "sd", "z", F.round("p", 8).alias("p"), F.round("adjusted", 8).alias("adjusted"), ratio.alias("log_ratio"), "signif")


@query(
    "gr26_co_membership_threshold",
    WITH.replace("m AS (SELECT", "m0 AS (SELECT", 1).replace("edges AS (", "m AS (SELECT layer, grp, node FROM (SELECT *, count(*) OVER (PARTITION BY layer, grp) AS size FROM m0) WHERE size BETWEEN 2 AND 300),\nedges AS (", 1)
    + "SELECT t.threshold, e.layer, count(*) AS edges FROM edges e, range(0, 4) t(threshold) WHERE e.n > t.threshold GROUP BY ALL",
)
def gr26(spark, d):
    """Edges left by layer as the threshold on shared groups rises, of groups of 2 to 300 members."""
    edges = tables.edges(spark, d, build.MAX_GROUP)
    kept = edges.select("layer", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.col("n").cast("int") - 1))).alias("threshold"))
    return kept.groupBy(F.col("threshold").cast("long").alias("threshold"), "layer").agg(F.count("*").alias("edges"))


@query(
    "gr27_multiplicity",
    WITH + ", mu AS (SELECT a, b, count(*) AS layers FROM edges GROUP BY ALL) SELECT layers, (x.p_size <= 10)::INT + (y.p_size <= 10)::INT AS score, count(*) AS n FROM mu JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b GROUP BY ALL",
)
def gr27(spark, d):
    """Edges by number of layers and by how many of their ends are essential (small parts)."""
    small = tables.table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), (F.col("p_size") <= 10).cast("int").alias("s"))
    found = build.multiplicity(tables.edges(spark, d))
    found = found.join(small.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(small.withColumnsRenamed({"node": "b", "s": "y"}), "b")
    return found.groupBy("layers", (F.col("x") + F.col("y")).alias("score")).agg(F.count("*").alias("n"))


@query("gr28_specific_and_core", WITH + ", mu AS (SELECT a, b, count(*) AS c FROM edges GROUP BY ALL) SELECT layer, a, b, c > 1 AS core FROM edges JOIN mu USING (a, b)")
def gr28(spark, d):
    """Every edge with whether it is specific to one layer or of the core."""
    edges = tables.edges(spark, d)
    return edges.select("layer", "a", "b", (F.count("*").over(Window.partitionBy("a", "b")) > 1).alias("core"))


@query("gr29_edge_key", WITH + "SELECT layer, least(a::VARCHAR, b::VARCHAR) || '-' || greatest(a::VARCHAR, b::VARCHAR) AS key FROM edges")
def gr29(spark, d):
    """Ends in the order of their strings."""
    return tables.edges(spark, d).select("layer", build.edge_key(F.col("a"), F.col("b")).alias("key"))


@query(
    "gr35_merged_layers",
    WITH + "SELECT a, b, string_agg(layer, ';' ORDER BY layer) AS layers FROM edges WHERE a IN (SELECT node FROM sets WHERE name = 'Brand#12') AND b IN (SELECT node FROM sets WHERE name = 'Brand#12') GROUP BY ALL",
)
def gr35(spark, d):
    """One set's module merged over layers, edges tagged with theirs."""
    one = tables.sets(spark, d).where("name = 'Brand#12'")
    return build.induced(tables.edges(spark, d), one).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("layer")), ";").alias("layers"))
