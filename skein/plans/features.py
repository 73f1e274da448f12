"""Queries of scenarios, features, enrichment and streams (survey rows RW13-RW23, OT2-OT16, GR34)."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import inference, stats
from skein.functions.scratch import materialise
from skein.operators import build, ontology, scaling, topology
from skein.plans.base import query
from skein.sources import tables
from skein.sources.tables import EDGES_SQL
from skein.streaming.windows import windowed_counts

T = tables.table
WITH = f"WITH {EDGES_SQL}"


@query("rw02_transition", WITH + "SELECT b.layer, b.src, b.dst, round(1.0 / k, 9) AS p FROM two_way b JOIN deg d ON d.layer = b.layer AND d.node = b.src")
def rw02(spark, d):
    """Column-stochastic transition of every layer."""
    edges = materialise(tables.edges(spark, d), "edges")
    return build.both_ways(edges).join(build.degrees(edges).withColumnRenamed("node", "src"), ["layer", "src"]).select("layer", "src", "dst", F.round(1.0 / F.col("k"), 9).alias("p"))


@query(
    "rw13_scenarios",
    "WITH l AS (SELECT DISTINCT l_returnflag AS layer FROM lineitem) SELECT 'all' AS scenario, layer FROM l UNION ALL SELECT 'only ' || layer, layer FROM l UNION ALL SELECT 'without ' || x.layer, y.layer FROM l x JOIN l y ON x.layer <> y.layer",
)
def rw13(spark, d):
    """Layers of every scenario: all, each alone, all but one."""
    layers = materialise(T(spark, d, "lineitem", F.col("l_returnflag").alias("layer")).distinct(), "layers")
    other = layers.select(F.col("layer").alias("gone"))
    without = layers.join(other, F.col("layer") != F.col("gone")).select(F.concat(F.lit("without "), "gone").alias("scenario"), "layer")
    return layers.select(F.lit("all").alias("scenario"), "layer").unionAll(layers.select(F.concat(F.lit("only "), "layer"), "layer")).unionAll(without)


@query(
    "rw18_rank_sums",
    "WITH r AS (SELECT p_brand, p_size > 25 AS large, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS k FROM part) SELECT p_brand, large, count(*) AS n, round(sum(k) - count(*) * (count(*) + 1) / 2.0, 6) AS u FROM r GROUP BY ALL",
)
def rw18(spark, d):
    """Rank-sum statistics of two groups in every brand."""
    r = T(spark, d, "part", "p_brand", "p_size", "p_retailprice").select("p_brand", (F.col("p_size") > 25).alias("large"), stats.rank_average("p_retailprice", ["p_brand"]).alias("k"))
    return r.groupBy("p_brand", "large").agg(F.count("*").alias("n"), F.round(F.sum("k") - F.count("*") * (F.count("*") + 1) / 2.0, 6).alias("u"))


@query(
    "rw22_feature_baselines",
    "WITH c AS (SELECT DISTINCT o_custkey AS patient, l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey), f AS (SELECT l_partkey AS node, count(*) AS popular FROM lineitem GROUP BY ALL)"
    " SELECT patient, node, rank() OVER (PARTITION BY patient ORDER BY popular DESC) + (count(*) OVER (PARTITION BY patient, popular) - 1) / 2.0 AS by_popularity, rank() OVER (PARTITION BY patient ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY patient, p_size) - 1) / 2.0 AS by_size FROM c JOIN f USING (node) JOIN part ON p_partkey = node",
)
def rw22(spark, d):
    """Candidates of every patient ranked by plain features."""
    o, li = T(spark, d, "orders", "o_orderkey", "o_custkey"), T(spark, d, "lineitem", "l_orderkey", "l_partkey")
    c = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("patient"), F.col("l_partkey").alias("node")).distinct()
    f = li.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("popular"))
    full = c.join(f, "node").join(T(spark, d, "part", F.col("p_partkey").alias("node"), "p_size"), "node")
    return full.select("patient", "node", stats.rank_average("popular", ["patient"], True).alias("by_popularity"), stats.rank_average("p_size", ["patient"], True).alias("by_size"))


@query("ot02_part_of", "SELECT 's' || s_suppkey AS term, 'n' || s_nationkey AS whole FROM supplier UNION SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def ot02(spark, d):
    """Wholes one and two levels up."""
    s, n = T(spark, d, "supplier", "s_suppkey", "s_nationkey"), T(spark, d, "nation", "n_nationkey", "n_regionkey")
    one = s.select(F.concat(F.lit("s"), "s_suppkey").alias("term"), F.concat(F.lit("n"), "s_nationkey").alias("whole"))
    two = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("term"), F.concat(F.lit("r"), "n_regionkey").alias("whole"))
    return one.union(two).distinct()


@query("ot06_earliest_level", "SELECT l_partkey AS gene, min(CAST(left(o_orderpriority, 1) AS INTEGER)) AS level FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def ot06(spark, d):
    """Earliest ordinal of every node over its groups."""
    o = T(spark, d, "orders", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return T(spark, d, "lineitem", "l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("gene")).agg(F.min("level").alias("level"))


@query(
    "ot07_term_counts",
    "WITH m AS (SELECT DISTINCT l_suppkey AS term, l_partkey AS gene FROM lineitem), ic AS (SELECT term, -ln(count(*) / (SELECT count(DISTINCT gene) FROM m)) AS ic FROM m GROUP BY term), q AS (SELECT quantile_cont(ic, 0.75) AS q FROM ic) SELECT gene, count(*) AS terms, count(CASE WHEN round(ic, 9) >= round(q, 9) THEN 1 END) AS informative FROM m JOIN ic USING (term), q GROUP BY gene",
)
def ot07(spark, d):
    """Terms of every node, and how many of them are in the upper quarter of information."""
    m = materialise(T(spark, d, "lineitem", F.col("l_suppkey").alias("term"), F.col("l_partkey").alias("gene")).distinct(), "terms")
    total = m.agg(F.count_distinct("gene").alias("total"))
    ic = m.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("term", (-F.log(F.col("n") / F.col("total"))).alias("ic"))  # one row
    cut = ic.agg(F.percentile("ic", 0.75).alias("q"))
    marked = ic.crossJoin(F.broadcast(cut)).select("term", (F.round("ic", 9) >= F.round("q", 9)).alias("high"))
    return m.join(marked, "term").groupBy("gene").agg(F.count("*").alias("terms"), F.count_if("high").alias("informative"))


@query(
    "ot10_pair_overlap",
    "WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS g FROM lineitem), n AS (SELECT g, count(*) AS n FROM m GROUP BY ALL), e AS (SELECT DISTINCT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey AND x.l_returnflag = y.l_returnflag)"
    ", i AS (SELECT a, b, count(*) AS both_n FROM e JOIN m x ON x.g = a JOIN m y ON y.g = b AND y.s = x.s GROUP BY ALL) SELECT a, b, coalesce(both_n, 0) AS shared, p.n - coalesce(both_n, 0) AS only1, q.n - coalesce(both_n, 0) AS only2, round(coalesce(both_n, 0) / (p.n + q.n - coalesce(both_n, 0)), 9) AS fraction FROM e JOIN n p ON p.g = a JOIN n q ON q.g = b LEFT JOIN i USING (a, b)",
)
def ot10(spark, d):
    """Terms that both ends of an edge share, and that one has alone, along the edges of all layers."""
    m = T(spark, d, "lineitem", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("g")).distinct()
    lists = materialise(m.groupBy("g").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("terms")), "term-lists")
    full = materialise(tables.pairs(spark, d), "pairs")
    for end, n, terms in (("a", "p", "x"), ("b", "q", "y")):  # a pair moves the list of one end, and no row a term
        full = full.join(lists.select(F.col("g").alias(end), F.col("n").alias(n), F.col("terms").alias(terms)), end)
    full = full.withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
    fraction = F.round(F.col("i") / (F.col("p") + F.col("q") - F.col("i")), 9).alias("fraction")
    return full.select("a", "b", F.col("i").alias("shared"), (F.col("p") - F.col("i")).alias("only1"), (F.col("q") - F.col("i")).alias("only2"), fraction)


@query(
    "ot13_enrichment_counts",
    WITH + ", mu AS (SELECT a, b, count(*) AS layers FROM edges GROUP BY ALL), k AS (SELECT layers, (x.p_size <= 10 AND y.p_size <= 10) AS hit FROM mu JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b)"
    " SELECT layers, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits, round(count(*) * (SELECT avg(CAST(hit AS INTEGER)) FROM k), 6) AS expected FROM k GROUP BY layers",
)
def ot13(spark, d):
    """Essential edges by multiplicity against what the overall share leads to expect; tails as in ``topology.hypergeometric_tail``."""
    small = T(spark, d, "part", F.col("p_partkey").alias("node"), (F.col("p_size") <= 10).alias("s"))
    mu = build.multiplicity(tables.edges(spark, d))
    k = mu.join(small.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(small.withColumnsRenamed({"node": "b", "s": "y"}), "b").groupBy("layers").agg(F.count("*").alias("n"), F.count_if(F.col("x") & F.col("y")).alias("hits"))
    every = Window.partitionBy()  # one row a multiplicity
    return k.select("layers", "n", "hits", F.round(F.col("n") * F.sum("hits").over(every) / F.sum("n").over(every), 6).alias("expected"))


@query(
    "ot13_enrichment_tails",
    WITH + ", mu AS (SELECT a, b, count(*) AS layers FROM edges GROUP BY ALL), k AS (SELECT layers, (x.p_size <= 10 AND y.p_size <= 10) AS hit FROM mu JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b),"
    " c AS (SELECT layers, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS x, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k WHERE hit) AS hits FROM k GROUP BY layers)"
    " SELECT layers, n, x AS hits, round(list_sum(list_transform(range(x, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(hits / total) + (n - i) * ln(1 - hits / total)))), 6) AS p_binomial,"
    " round(coalesce(list_sum(list_transform(range(greatest(x + 1, n - (total - hits)), least(n, hits) + 1), lambda i: exp(lgamma(hits + 1) - lgamma(i + 1) - lgamma(hits - i + 1) + lgamma(total - hits + 1) - lgamma(n - i + 1) - lgamma(total - hits - n + i + 1)"
    " - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)))), 0), 6) AS p_hypergeometric FROM c",
)
def ot13_tails(spark, d):
    """Whether edges of each multiplicity are essential more often than all edges: binomial P(X >= hits) and hypergeometric P(X > hits)."""
    small = T(spark, d, "part", F.col("p_partkey").alias("node"), (F.col("p_size") <= 10).alias("s"))
    mu = build.multiplicity(tables.edges(spark, d))
    k = mu.join(small.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(small.withColumnsRenamed({"node": "b", "s": "y"}), "b").groupBy("layers").agg(F.count("*").alias("n"), F.count_if(F.col("x") & F.col("y")).alias("hits"))
    every = Window.partitionBy()  # one row a multiplicity
    k = k.select("layers", "n", "hits", F.sum("n").over(every).alias("total"), F.sum("hits").over(every).alias("all_hits"))

    @F.pandas_udf("double")
    def binomial(x: pd.Series, n: pd.Series, m: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([topology.binomial_tail(a, b, c / t) for a, b, c, t in zip(x, n, m, total, strict=True)])

    @F.pandas_udf("double")
    def hypergeometric(x: pd.Series, n: pd.Series, m: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([topology.hypergeometric_tail(a, c, t, b) for a, b, c, t in zip(x, n, m, total, strict=True)])

    of = ("hits", "n", "all_hits", "total")
    return k.select("layers", "n", "hits", F.round(binomial(*of), 6).alias("p_binomial"), F.round(hypergeometric(*of), 6).alias("p_hypergeometric"))


@query(
    "ot09_set_similarity",
    WITH + ", s AS (SELECT e.layer, least(x.name, y.name) AS name1, greatest(x.name, y.name) AS name2, e.n FROM edges e JOIN sets x ON x.node = e.a JOIN sets y ON y.node = e.b WHERE x.name <> y.name)"
    " SELECT name1, name2, layer, round(avg(n), 6) AS similarity FROM s GROUP BY ALL UNION ALL SELECT 'random', 'random', layer, round(avg(n), 6) FROM edges GROUP BY layer",
)
def ot09(spark, d):
    """Mean similarity of the members of two sets in each of several tables, whichever of them is first in a row, and of all rows of the table."""
    return ontology.set_similarity(materialise(tables.edges(spark, d), "edges").select("layer", "a", "b", "n"), tables.sets(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("ot15_stage_counts", WITH + "SELECT layer, count(*) AS edges, count(CASE WHEN n > 1 THEN 1 END) AS over_one, count(CASE WHEN a < 1000 AND b < 1000 THEN 1 END) AS low FROM edges GROUP BY ALL")
def ot15(spark, d):
    """Edges of every layer after each filter."""
    return tables.edges(spark, d).groupBy("layer").agg(F.count("*").alias("edges"), F.count_if(F.col("n") > 1).alias("over_one"), F.count_if((F.col("a") < 1000) & (F.col("b") < 1000)).alias("low"))


@query(
    "ot16_three_ranks",
    "WITH f AS (SELECT p_partkey AS gene, p_brand, p_size AS x, p_retailprice AS y, count(*) AS z FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) SELECT gene, " + ", ".join(f"rank() OVER (PARTITION BY p_brand ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY p_brand, {c}) - 1) / 2.0 AS r{c}" for c in "xyz") + " FROM f",
)
def ot16(spark, d):
    """Descending ranks of three features of the nodes that have all three, within each set."""
    z = T(spark, d, "lineitem", "l_partkey").groupBy(F.col("l_partkey").alias("gene")).agg(F.count("*").alias("z"))
    f = T(spark, d, "part", F.col("p_partkey").alias("gene"), "p_brand", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")).join(z, "gene").dropna("any")
    return f.select("gene", *(stats.rank_average(c, ["p_brand"], True).alias(f"r{c}") for c in "xyz"))


@query("gr34_principal_plane")
def gr34(spark, d):
    """First two principal components of the node vectors, each with the sign that makes its largest loading positive."""
    v = T(spark, d, "embeddings", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).select("vec_id", array_to_vector("e").alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="xy").fit(v)
    axes = model.pc.toArray()  # as many rows as a vector has entries
    signs = [1.0 if axes[abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    xy = model.transform(v).select("vec_id", vector_to_array("xy").alias("xy"))
    return xy.select("vec_id", *((F.col("xy")[k] * signs[k]).alias("xy"[k]) for k in range(2)))


@query("st01_event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st01(spark, d):
    """Daily counts of events by type, as a stream over the table's files."""
    return windowed_counts(spark, d, "events.parquet").withColumn("total", F.round("total", 4))


def _t_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by Student's distribution, as the finite sums of a whole number of degrees of freedom."""
    v, angle = f"({n} - 2)", f"atan(abs({r}) / sqrt(1 - {r} * {r}))"
    term = lambda up, half: f"exp(2 * k * ln(cos({angle})) + {up})"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {v} // 2), lambda k: {term('lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)', 0)}))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), lambda k: {term('lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)', 1)})), 0))"
    return f"CASE WHEN {v} > 0 THEN CASE WHEN abs({r}) >= 1 THEN 0.0 WHEN {v} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END END"


@query(
    "a12_correlation_tests",
    "WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS rp FROM part),"
    " c AS (SELECT p_brand, count(*) AS n, corr(p_size, p_retailprice) AS a, corr(rs, rp) AS b FROM r GROUP BY ALL)"
    f" SELECT p_brand, n, round(a, 6) AS pearson, round({_t_sql('a', 'n')}, 6) AS p_pearson, round(b, 6) AS spearman, round({_t_sql('b', 'n')}, 6) AS p_spearman FROM c",
)
def a12_tests(spark, d):
    """Correlations of size and price in every brand, with the tests of none."""
    found = inference.correlation_tests(T(spark, d, "part", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")
    return found.select("p_brand", "n", *(F.round(c, 6).alias(c) for c in ("pearson", "p_pearson", "spearman", "p_spearman")))


def _normal_sql(gap: str, variance: str) -> str:
    tail = stats.upper_tail_sql(f"(greatest(abs({gap}) - 0.5, 0) / sqrt({variance}))")
    return f"CASE WHEN {variance} > 0 THEN least(1.0, 2 * ({tail})) END"


@query(
    "rw18_rank_sum_tests",
    "WITH r AS (SELECT p_brand, p_size > 25 AS large, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS k FROM part),"
    " t AS (SELECT p_brand, sum(t * t * t - t) AS ties FROM (SELECT p_brand, p_retailprice, count(*) AS t FROM part GROUP BY ALL) GROUP BY ALL),"
    " s AS (SELECT p_brand, count(*) FILTER (large) AS n1, count(*) FILTER (NOT large) AS n2, sum(k) FILTER (large) AS s FROM r GROUP BY ALL),"
    " u AS (SELECT p_brand, n1, n2, s - n1 * (n1 + 1) / 2.0 AS u, n1 * n2 / 2.0 AS mean, n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0))) AS v FROM s JOIN t USING (p_brand))"
    f" SELECT p_brand, n1, n2, round(u, 6) AS u, CASE WHEN n1 > 0 AND n2 > 0 THEN round({_normal_sql('(u - mean)', 'v')}, 6) END AS p FROM u",
)
def rw18_rank_sum_tests(spark, d):
    """The same with p from the normal form, corrected for ties; the library's default takes exact distributions below fifty, which tests hold against enumeration."""
    rows = T(spark, d, "part", "p_brand", "p_size", "p_retailprice").select("p_brand", (F.col("p_size") > 25).alias("large"), "p_retailprice")
    found = inference.rank_sum_tests(rows, ["p_brand"], "large", "p_retailprice", exact_below=0)
    return found.select("p_brand", "n1", "n2", F.round("u", 6).alias("u"), F.round("p", 6).alias("p"))


BLOCKS_SQL = (
    "WITH v AS (SELECT l_suppkey AS s, l_returnflag AS c, round(avg(l_quantity), 4) AS y FROM lineitem GROUP BY ALL), k AS (SELECT count(DISTINCT c) AS k FROM v),"
    " b AS (SELECT * FROM v, k QUALIFY count(*) OVER (PARTITION BY s) = k),"
    " r AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY y) + (count(*) OVER (PARTITION BY s, y) - 1) / 2.0 AS r FROM b)"
)


def _blocks(spark, d):
    """s, c, y: mean quantity of every supplier under every flag."""
    lines = T(spark, d, "lineitem", F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("c"), "l_quantity")
    return materialise(lines.groupBy("s", "c").agg(F.round(F.avg("l_quantity"), 4).alias("y")).withColumn("all", F.lit("all")), "blocks")


@query(
    "rw18_friedman",
    BLOCKS_SQL + ", p AS (SELECT c, sum(r) AS s, sum(r * r) AS q, count(*) AS n, max(k) AS k FROM r GROUP BY ALL), a AS (SELECT max(n) AS n, max(k) AS k, sum(s * s) AS ss, sum(q) AS qq FROM p),"
    " f AS (SELECT n, k, (k - 1) * (ss - n * n * k * (k + 1) * (k + 1) / 4.0) / (qq - n * k * (k + 1) * (k + 1) / 4.0) AS q FROM a)"
    " SELECT n, k, round(q, 6) AS q, round(exp(-q / 2), 6) AS p, round(q / (n * (k - 1)), 6) AS w FROM f",
)
def rw18_friedman(spark, d):
    """Repeated measures of suppliers under the three flags; with three conditions the tail is an exponential, which the SQL takes."""
    found = inference.friedman_tests(_blocks(spark, d), ["all"], "s", "c", "y")
    return found.select("n", "k", *(F.round(x, 6).alias(x) for x in ("q", "p", "w")))


@query(
    "rw18_paired_comparisons",
    BLOCKS_SQL + ", d AS (SELECT x.c AS first, z.c AS second, x.y - z.y AS d FROM b x JOIN b z USING (s) WHERE x.c < z.c AND x.y <> z.y),"
    " g AS (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY abs(d)) + (count(*) OVER (PARTITION BY first, second, abs(d)) - 1) / 2.0 AS r FROM d),"
    " t AS (SELECT first, second, sum(t * t * t - t) AS ties FROM (SELECT first, second, abs(d), count(*) AS t FROM d GROUP BY ALL) GROUP BY ALL),"
    " w AS (SELECT first, second, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS v FROM g GROUP BY ALL),"
    f" p AS (SELECT first, second, n, v, {_normal_sql('(v - n * (n + 1) / 4.0)', '(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)')} AS p FROM w JOIN t USING (first, second)),"
    " o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)"
    " SELECT first, second, n, round(v, 6) AS v, round(p, 6) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM o",
)
def rw18_paired(spark, d):
    """Signed ranks of all pairs of flags over the suppliers that have them all, adjusted together."""
    found = inference.paired_comparisons(_blocks(spark, d), ["all"], "s", "c", "y", exact_below=0)
    return found.select("first", "second", "n", *(F.round(x, 6).alias(x) for x in ("v", "p", "adjusted")))


def _brand_distances(spark, d):
    """i, j, d: one less the overlap of every two brands' orders."""
    parts = T(spark, d, "part", "p_partkey", F.col("p_brand").alias("name"))
    members = T(spark, d, "lineitem", "l_partkey", F.col("l_orderkey").alias("node")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("name", "node").distinct()
    names = members.select("name").distinct()
    every = names.select(F.col("name").alias("i")).join(names.select(F.col("name").alias("j")), F.col("i") < F.col("j"))  # brands are few
    found = ontology.set_overlaps(materialise(members, "members")).select(F.col("name1").alias("i"), F.col("name2").alias("j"), "overlap")
    return materialise(every.join(found, ["i", "j"], "left").select("i", "j", (1 - F.coalesce("overlap", F.lit(0.0))).alias("d")), "brand-distances")


@query("gr34_classical_plane")
def gr34_classical(spark, d):
    """Brands in the plane by classical scaling of one less the overlap of their orders; held against numpy in the tests."""
    return scaling.classical_plane(_brand_distances(spark, d)).select("i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("gr34_kruskal_plane")
def gr34_kruskal(spark, d):
    """The same by Kruskal's non-metric scaling."""
    return scaling.kruskal_plane(_brand_distances(spark, d))[0].select("i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
