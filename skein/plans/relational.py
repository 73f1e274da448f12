"""Queries of the relational operators (survey rows PF, J, A, W, S, SO, RS) and of sources and ontology (IO, OT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import draws, stats
from skein.functions.scratch import materialise
from skein.operators import ontology
from skein.operators.build import canonical
from skein.plans.base import query
from skein.sources import files, tables

T = tables.table


# --- projections, filters, predicates


@query("pf01_select", "SELECT p_partkey, p_brand FROM part")
def pf01(spark, d):
    part = T(spark, d, "part")
    return part.select(*(c for c in part.columns if c in ("p_partkey", "p_brand")))


@query("pf03_derived", "SELECT s_suppkey AS key, round(s_acctbal / 1000, 6) AS thousands, s_acctbal < 0 AS negative FROM supplier")
def pf03(spark, d):
    s = T(spark, d, "supplier", "s_suppkey", "s_acctbal").withColumnRenamed("s_suppkey", "key")
    return s.withColumns({"thousands": F.round(F.col("s_acctbal") / 1000, 6), "negative": F.col("s_acctbal") < 0}).drop("s_acctbal")


@query("pf04_filter", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT p_brand = 'Brand#1' OR p_retailprice > 1900")
def pf04(spark, d):
    return T(spark, d, "part", "p_partkey", "p_size", "p_brand", "p_retailprice").where("p_size BETWEEN 10 AND 20 AND NOT p_brand = 'Brand#1' OR p_retailprice > 1900").select("p_partkey")


@query("pf05_in_table", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def pf05(spark, d):
    nations = T(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_regionkey = 1")
    large = T(spark, d, "lineitem", "l_suppkey", "l_quantity").where("l_quantity > 49")
    s = T(spark, d, "supplier", "s_suppkey", "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return s.join(large, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@query("pf06_regex", "SELECT p_partkey, regexp_matches(p_type, 'E.*L$') AS hit, starts_with(p_name, 'a') AS a, length(p_name) AS n FROM part")
def pf06(spark, d):
    return T(spark, d, "part", "p_partkey", "p_type", "p_name").select("p_partkey", F.col("p_type").rlike("E.*L$").alias("hit"), F.col("p_name").startswith("a").alias("a"), F.length("p_name").alias("n"))


@query("pf07_nulls", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'none') AS status, nullif(o_orderstatus, 'O') IS NULL AS missing FROM orders")
def pf07(spark, d):
    o = T(spark, d, "orders", "o_orderkey", "o_orderstatus").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return o.select("o_orderkey", F.coalesce("s", F.lit("none")).alias("status"), F.col("s").isNull().alias("missing"))


@query("pf08_complete_rows", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND nullif(c_nationkey, 3) IS NOT NULL")
def pf08(spark, d):
    c = T(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return c.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("a"), F.nullif("c_nationkey", F.lit(3)).alias("b")).dropna("any", subset=["a", "b"]).select("c_custkey")


@query("pf09_distinct_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def pf09(spark, d):
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return T(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("r", first).where("r = 1").drop("r")


@query("pf12_recode", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE o_orderpriority END AS priority FROM orders")
def pf12(spark, d):
    names = F.create_map(F.lit("1"), F.lit("urgent"), F.lit("2"), F.lit("high"))
    return T(spark, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.coalesce(names[F.substring("o_orderpriority", 1, 1)], "o_orderpriority").alias("priority"))


# --- joins


@query("j01_inner", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def j01(spark, d):
    c = T(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey").join(T(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return T(spark, d, "orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("j02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def j02(spark, d):
    o = T(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_totalprice > 300000")
    return T(spark, d, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j03_full", "SELECT coalesce(c, s) AS nation, customers, suppliers FROM (SELECT c_nationkey AS c, count(*) AS customers FROM customer WHERE c_nationkey < 15 GROUP BY ALL) FULL JOIN (SELECT s_nationkey AS s, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY ALL) ON c = s")
def j03(spark, d):
    c = T(spark, d, "customer", "c_nationkey").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = T(spark, d, "supplier", "s_nationkey").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "outer")


@query("j04_right", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def j04(spark, d):
    s = T(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 5000")
    return s.join(T(spark, d, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


#: Slices of one side of a group whose pairs are wanted.
SLICES = 16


@query("j05_stats_of_both", "WITH st AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey) SELECT x, y, s.n AS nx, t.n AS ny FROM p LEFT JOIN st s ON s.k = x LEFT JOIN st t ON t.k = y")
def j05(spark, d):
    """Pairs within one nation and segment with the orders of both sides.

    The orders join the customers, not their pairs, and one side of a group is dealt in slices that each meet the whole other side, so a group's pairs come from many tasks.
    """
    c = T(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    st = T(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = materialise(c.join(st, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_nationkey", "c_mktsegment", "c_custkey", "n"), "customers")
    keys, parts = ["c_nationkey", "c_mktsegment", "slice"], 4 * spark.sparkContext.defaultParallelism
    x = c.withColumn("slice", F.pmod(F.xxhash64("c_custkey"), F.lit(SLICES))).select(*keys, F.col("c_custkey").alias("x"), F.col("n").alias("nx")).repartition(parts, *keys)
    y = c.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select("c_nationkey", "c_mktsegment", F.col("slice").cast("long").alias("slice"), F.col("c_custkey").alias("y"), F.col("n").alias("ny")).repartition(parts, *keys)
    return x.join(y, keys).where("x < y").select("x", "y", "nx", "ny")


@query("j06_grid", "SELECT r_name, s AS segment, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) LEFT JOIN (SELECT n_regionkey AS rk, c_mktsegment AS sg, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) ON rk = r_regionkey AND sg = s")
def j06(spark, d):
    """Every region and segment with its customers, zero where there are none: a grid of two small dimensions."""
    c = T(spark, d, "customer", "c_nationkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")
    n = c.join(T(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "segment").agg(F.count("*").alias("n"))
    grid = T(spark, d, "region", "r_regionkey", "r_name").crossJoin(c.select("segment").distinct())
    return grid.join(n, ["r_regionkey", "segment"], "left").select("r_name", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@query("j09_either_orientation", "SELECT l_partkey AS x, l_suppkey AS y FROM lineitem WHERE l_partkey < 50 AND l_suppkey BETWEEN 50 AND 90 UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey < 50 AND l_partkey BETWEEN 50 AND 90")
def j09(spark, d):
    """Links between two id sets in either orientation, duplicates kept."""
    li = T(spark, d, "lineitem", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return li.where("x < 50 AND y BETWEEN 50 AND 90").unionAll(li.where("y < 50 AND x BETWEEN 50 AND 90"))


# --- aggregations and windows


@query("a01_quartiles", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.75), 6) AS q75 FROM part GROUP BY p_brand")
def a01(spark, d):
    q = lambda p: F.percentile("p_retailprice", p)
    cols = (("mean", F.avg("p_retailprice")), ("median", q(0.5)), ("q25", q(0.25)), ("q75", q(0.75)))
    return T(spark, d, "part", "p_brand", "p_retailprice").groupBy("p_brand").agg(*(F.round(f, 6).alias(n) for n, f in cols))


@query("a03_moments", "SELECT l_returnflag, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(stddev_samp(l_quantity), 6) AS sd, count(DISTINCT l_partkey) AS parts, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS cheap FROM lineitem GROUP BY ALL")
def a03(spark, d):
    g = T(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_partkey", "l_discount").groupBy("l_returnflag")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"))


@query("a07_joined_strings", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY ALL")
def a07(spark, d):
    return T(spark, d, "nation", "n_regionkey", "n_name").groupBy("n_regionkey").agg(F.concat_ws(";", F.array_sort(F.collect_list("n_name"))).alias("names"))


@query("a08_share_of_total", "WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 9) AS share, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 6) AS percent FROM g")
def a08(spark, d):
    g = T(spark, d, "orders", "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.select("o_orderstatus", "o_orderpriority", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 9).alias("share"), F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("a11_ordered_minimum", "SELECT o_custkey, min(o_orderpriority) AS first, min_by(o_orderkey, o_orderpriority || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS at FROM orders GROUP BY ALL")
def a11(spark, d):
    """Earliest level of an ordered factor for each customer, and the first order that has it."""
    return T(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("first"), F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("at"))


@query("a12_correlations", "WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS rp FROM part) SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS pearson, round(corr(rs, rp), 6) AS spearman FROM r GROUP BY ALL")
def a12(spark, d):
    p = T(spark, d, "part", "p_brand", "p_size", "p_retailprice").withColumns({"rs": stats.rank_average("p_size", ["p_brand"]), "rp": stats.rank_average("p_retailprice", ["p_brand"])})
    return p.groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("pearson"), F.round(F.corr("rs", "rp"), 6).alias("spearman"))


@query("a13_binned_counts", "SELECT bin, count(p_partkey) AS n FROM (VALUES ('(0,10]', 0, 10), ('(10,20]', 10, 20), ('(20,50]', 20, 50), ('(50,100]', 50, 100)) b(bin, lo, hi) LEFT JOIN part ON p_size > lo AND p_size <= hi GROUP BY ALL")
def a13(spark, d):
    """Parts by size class, classes without parts too."""
    labels = ["(0,10]", "(10,20]", "(20,50]", "(50,100]"]
    n = T(spark, d, "part", "p_size").select(stats.cut_right(F.col("p_size"), [0, 10, 20, 50, 100], labels).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("a14_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL")
def a14(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return T(spark, d, "lineitem", "l_returnflag", y, x).groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("a16_total_row", "SELECT s_nationkey AS nation, round(avg(s_acctbal), 6) AS mean FROM supplier GROUP BY ALL UNION ALL SELECT -1, round(avg(s_acctbal), 6) FROM supplier")
def a16(spark, d):
    s = T(spark, d, "supplier", "s_nationkey", "s_acctbal")
    mean = F.round(F.avg("s_acctbal"), 6).alias("mean")
    return s.groupBy(F.col("s_nationkey").alias("nation")).agg(mean).unionByName(s.agg(mean).select(F.lit(-1).alias("nation"), "mean"))


@query("w01_average_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r FROM part")
def w01(spark, d):
    return T(spark, d, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", stats.rank_average("p_size", ["p_brand"], True).alias("r"))


@query("w02_hashed_ties", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, md5('tie|' || p_partkey), p_partkey) AS r FROM part")
def w02(spark, d):
    order = Window.partitionBy("p_brand").orderBy("p_size", stats.shuffled("tie", F.col("p_partkey")), "p_partkey")
    return T(spark, d, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", F.row_number().over(order).alias("r"))


@query("w05_running_total", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def w05(spark, d):
    of = Window.partitionBy("o_custkey")
    return T(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(of.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("total"), F.count("*").over(of).alias("n"))


@query("w06_group_maximum", "SELECT p_brand, p_partkey FROM part QUALIFY p_size = max(p_size) OVER (PARTITION BY p_brand)")
def w06(spark, d):
    return T(spark, d, "part", "p_brand", "p_partkey", "p_size").withColumn("m", F.max("p_size").over(Window.partitionBy("p_brand"))).where("p_size = m").select("p_brand", "p_partkey")


@query("w08_adjusted_p", "WITH p AS (SELECT p_brand, p_partkey, p_retailprice / 3000 AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS rn FROM p) SELECT p_partkey, round(least(1.0, min(p * m / rn) OVER (PARTITION BY p_brand ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM r")
def w08(spark, d):
    p = T(spark, d, "part", "p_brand", "p_partkey", "p_retailprice").select("p_brand", "p_partkey", (F.col("p_retailprice") / 3000).alias("p"))
    return stats.adjusted(p, "p", by=["p_brand"]).select("p_partkey", F.round("adjusted", 9).alias("adjusted"))


# --- sort, top-k, sampling, sets, reshaping


@query("s02_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def s02(spark, d):
    """The twenty largest orders: the limit is the feature."""
    return T(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("s03_rank_bins", "WITH r AS (SELECT rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part) SELECT CASE WHEN r <= 5 THEN '(0,5]' WHEN r <= 10 THEN '(5,10]' WHEN r <= 20 THEN '(10,20]' ELSE '(20,Inf]' END AS bin, count(*) AS n FROM r GROUP BY ALL")
def s03(spark, d):
    r = F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))
    bins = stats.cut_right(F.col("r"), [0, 5, 10, 20, float("inf")], ["(0,5]", "(5,10]", "(10,20]", "(20,Inf]"])
    return T(spark, d, "part", "p_brand", "p_retailprice").select(r.alias("r")).select(bins.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("s04_sample", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('7|' || p_partkey), p_partkey) <= 5")
def s04(spark, d):
    """Five parts a brand by a seeded hash: a sampling operator."""
    keyed = T(spark, d, "part", "p_brand", "p_partkey").withColumn("key", stats.shuffled("7", F.col("p_partkey")))
    return draws.smallest(keyed, ["p_brand"], "key", ["p_partkey"], 5).drop("r", "key")


@query("s05_permutation", "WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part), b AS (SELECT p_brand, p_partkey AS moved, row_number() OVER (PARTITION BY p_brand ORDER BY md5('p|' || p_partkey), p_partkey) AS r FROM part) SELECT p_partkey, moved FROM a JOIN b USING (p_brand, r)")
def s05(spark, d):
    p, of = T(spark, d, "part", "p_brand", "p_partkey"), Window.partitionBy("p_brand")
    a = p.withColumn("r", F.row_number().over(of.orderBy("p_partkey")))
    b = p.select("p_brand", F.col("p_partkey").alias("moved"), F.row_number().over(of.orderBy(stats.shuffled("p", F.col("p_partkey")), "p_partkey")).alias("r"))
    return a.join(b, ["p_brand", "r"]).select("p_partkey", "moved")


@query("so02_set_operations", "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def so02(spark, d):
    c, s = T(spark, d, "customer", F.col("c_nationkey").alias("k")), T(spark, d, "supplier", F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "both": c.intersect(s), "first": c.subtract(s)}
    out = None
    for op, df in parts.items():
        tagged = df.select(F.lit(op).alias("op"), "k")
        out = tagged if out is None else out.unionByName(tagged)
    return out


GRAPH_SETS_SQL = "WITH x AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R')"


@query("so03_graph_union", GRAPH_SETS_SQL + " SELECT a, b FROM x UNION SELECT a, b FROM y")
def so03(spark, d):
    x, y = _two(spark, d)
    return x.unionByName(y).distinct()


@query("so04_graph_difference", GRAPH_SETS_SQL + " SELECT a, b FROM x EXCEPT SELECT a, b FROM y")
def so04(spark, d):
    x, y = _two(spark, d)
    return x.join(y, ["a", "b"], "left_anti")


@query("so05_graph_intersection", GRAPH_SETS_SQL + " SELECT a, b FROM x INTERSECT SELECT a, b FROM y")
def so05(spark, d):
    x, y = _two(spark, d)
    return x.join(y, ["a", "b"], "left_semi")


def _two(spark, d):
    li = T(spark, d, "lineitem", "l_returnflag", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return (li.where(F.col("l_returnflag") == f).select("a", "b").distinct() for f in "AR")


@query("rs01_unpivot", "SELECT p_partkey, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def rs01(spark, d):
    p = T(spark, d, "part", "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "feature", "value")


@query("rs02_pivot", "SELECT l_suppkey, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS a, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS r FROM lineitem GROUP BY ALL")
def rs02(spark, d):
    wide = T(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)
    return wide.select("l_suppkey", *(F.col(c).alias(c.lower()) for c in "ANR"))


@query("rs03_separate_rows", "SELECT p_brand AS name, p_partkey AS node FROM part")
def rs03(spark, d):
    """Sets joined to one string each, and taken apart again."""
    one = T(spark, d, "part", "p_brand", "p_partkey").groupBy(F.col("p_brand").alias("name")).agg(F.concat_ws(";", F.array_sort(F.collect_list("p_partkey")).cast("array<string>")).alias("genes"))
    return one.select("name", F.explode(F.split("genes", ";")).alias("node")).select("name", F.col("node").cast("long").alias("node"))


# --- sources and sinks over the given tables


@query("io01_edge_list_files", "SELECT DISTINCT l_returnflag AS layer, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def io01(spark, d):
    """Edge lists written as one folder of files a layer and read back as layers."""
    at = files.fresh(spark, "edge-lists")
    li = T(spark, d, "lineitem", "l_returnflag", F.col("l_partkey").alias("A"), F.col("l_suppkey").alias("B"))
    files.write_edge_lists(li.withColumnRenamed("l_returnflag", "layer"), at)
    found = files.read_edge_lists(spark, at)
    return canonical(found.select("layer", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), by=("layer",))


@query("io02_membership_file", "SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY ALL HAVING count(*) BETWEEN 5 AND 80)")
def io02(spark, d):
    """Named sets written to a file, read back, those of 5 to 80 members kept."""
    at = files.fresh(spark, "sets")
    one = T(spark, d, "part", "p_brand", "p_partkey").groupBy(F.col("p_brand").alias("name")).agg(F.concat_ws(";", F.collect_list(F.col("p_partkey").cast("string"))).alias("gene"))
    files.write_table(one, at)
    return files.read_memberships(spark, at, 5, 80)


@query("io05_gmt_file", "SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS gene FROM part")
def io05(spark, d):
    """Ragged lines of name, address and members, read back long."""
    at = files.fresh(spark, "gmt")
    line = F.concat_ws("\t", F.col("p_brand"), F.lit("http://example.org/"), F.concat_ws("\t", F.collect_list(F.col("p_partkey").cast("string"))))
    T(spark, d, "part", "p_brand", "p_partkey").groupBy("p_brand").agg(line.alias("value")).select("value").write.text(at)
    return files.read_gmt(spark, at).select("name", F.explode("genes").alias("gene"))


@query(
    "io04_expression_matrices",
    "WITH c AS (SELECT l_returnflag AS file, CAST(l_suppkey AS VARCHAR) AS gene, CAST(l_linenumber AS VARCHAR) AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),"
    " s AS (SELECT DISTINCT file, sample FROM c), g AS (SELECT DISTINCT file, gene FROM c)"
    " SELECT file, gene, sample, round(CAST(coalesce(value, 0) AS DOUBLE), 2) AS value FROM s JOIN g USING (file) LEFT JOIN c USING (file, gene, sample)",
)
def io04(spark, d):
    """Quantities of every supplier by line number, written as a matrix a flag, each with its own samples, and all read back together."""
    at = files.fresh(spark, "matrices")
    li = T(spark, d, "lineitem", F.col("l_returnflag").alias("file"), F.col("l_suppkey").cast("string").alias("gene"), F.col("l_linenumber").cast("string").alias("sample"), "l_quantity")
    cells = materialise(li.groupBy("file", "gene", "sample").agg(F.sum("l_quantity").alias("v")), "cells")
    samples = cells.groupBy("file").agg(F.array_sort(F.collect_set("sample")).alias("samples"))  # a matrix has a column a sample
    held = cells.groupBy("file", "gene").agg(F.map_from_entries(F.collect_list(F.struct("sample", "v"))).alias("held"))
    value = F.transform("samples", lambda s: F.coalesce(F.col("held")[s], F.lit(0)).cast("string"))
    rows = held.join(samples, "file").select("file", F.lit(3).alias("i"), F.concat_ws("\t", F.concat(F.lit("E"), "gene"), "gene", value).alias("value"))
    dims = held.groupBy("file").agg(F.count("*").alias("n")).join(samples, "file")
    heads = dims.select("file", F.posexplode(F.array(F.lit("#1.2"), F.concat_ws("\t", F.col("n").cast("string"), F.size("samples").cast("string")), F.concat_ws("\t", F.lit("Name"), F.lit("Description"), "samples"))).alias("i", "value"))
    # one file a matrix, as the format asks for
    heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "i").select("file", "value").write.partitionBy("file").text(at)
    found = files.read_gct(spark, at)
    return found.select(F.regexp_extract("file", r"file=([^/]+)/", 1).alias("file"), "gene", "sample", F.round("value", 2).alias("value"))


@query("io03_typed_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io03(spark, d):
    """A table written as text and read with its types."""
    at = files.fresh(spark, "typed")
    files.write_table(T(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), at)
    return files.read_table(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("io06_line_lists", "SELECT p_brand AS category, p_name AS label FROM part WHERE trim(p_name) <> ''")
def io06(spark, d):
    """Lists of one label a line, a folder of files for each category."""
    at = files.fresh(spark, "lines")
    T(spark, d, "part", F.col("p_brand").alias("category"), F.trim("p_name").alias("value")).write.partitionBy("category").text(at)
    return files.read_lines(spark, at)


# --- ontology: regions, nations and their customers as terms

ISA_SQL = """
WITH RECURSIVE isa AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
),
genes AS (SELECT DISTINCT 's' || l_suppkey AS term, l_partkey AS gene FROM lineitem),
clo AS (SELECT child AS descendant, parent AS ancestor FROM isa UNION SELECT c.descendant, i.parent FROM clo c JOIN isa i ON i.child = c.ancestor)
"""


def _isa(spark, d):
    n = T(spark, d, "nation", F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = T(spark, d, "region", F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    s = T(spark, d, "supplier", F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return n.unionByName(r).unionByName(s)


def _genes(spark, d):
    return T(spark, d, "lineitem", F.concat(F.lit("s"), "l_suppkey").alias("term"), F.col("l_partkey").alias("gene")).distinct()


@query("ot01_closure", ISA_SQL + "SELECT descendant, ancestor FROM clo")
def ot01(spark, d):
    return ontology.closure(materialise(_isa(spark, d), "isa"))


@query("ot04_group_genes", ISA_SQL + "SELECT c.ancestor AS grp, count(DISTINCT gene) AS genes FROM clo c JOIN isa i ON i.child = c.ancestor AND i.parent = 'world' JOIN genes g ON g.term = c.descendant GROUP BY ALL")
def ot04(spark, d):
    found = ontology.group_genes(materialise(_isa(spark, d), "isa"), _genes(spark, d), "world")
    return found.groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("genes"))


@query("ot05_root_labels", ISA_SQL + "SELECT s_suppkey, string_agg(r_name, ';' ORDER BY r_name) AS roots FROM supplier JOIN clo ON descendant = 's' || s_suppkey JOIN region ON ancestor = 'r' || r_regionkey GROUP BY ALL")
def ot05(spark, d):
    roots = T(spark, d, "region", F.concat(F.lit("r"), "r_regionkey").alias("ancestor"), "r_name")
    found = ontology.closure(materialise(_isa(spark, d), "isa")).where(F.col("descendant").startswith("s")).join(roots, "ancestor")
    return found.groupBy(F.substring("descendant", 2, 20).cast("long").alias("s_suppkey")).agg(F.concat_ws(";", F.array_sort(F.collect_list("r_name"))).alias("roots"))


@query("ot08_information_content", ISA_SQL + ", up AS (SELECT term, gene FROM genes UNION SELECT c.ancestor, g.gene FROM clo c JOIN genes g ON g.term = c.descendant) SELECT term, round(-ln(count(*) / (SELECT count(DISTINCT gene) FROM genes)), 6) + 0.0 AS ic FROM up GROUP BY term")
def ot08(spark, d):
    found = ontology.information_content(materialise(_isa(spark, d), "isa"), materialise(_genes(spark, d), "genes"))
    return found.select("term", (F.round("ic", 6) + 0.0).alias("ic"))


@query("ot12_set_overlap", "WITH m AS (SELECT DISTINCT p_brand AS name, l_suppkey AS node FROM part JOIN lineitem ON l_partkey = p_partkey), z AS (SELECT name, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT x.name AS name1, y.name AS name2, count(*) AS shared FROM m x JOIN m y ON x.node = y.node AND x.name < y.name GROUP BY ALL) SELECT name1, name2, shared, round(shared / (a.n + b.n - shared), 9) AS jaccard, round(shared / least(a.n, b.n), 9) AS overlap FROM s JOIN z a ON a.name = name1 JOIN z b ON b.name = name2")
def ot12(spark, d):
    """Overlap of the suppliers of all pairs of brands; a node is in few sets, so the self-join makes at most their square a node."""
    return ontology.set_overlaps(_supplied(spark, d)).select("name1", "name2", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("overlap", 9).alias("overlap"))


def _supplied(spark, d):
    """name, node: the suppliers of each brand."""
    part = T(spark, d, "part", F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    return materialise(T(spark, d, "lineitem", "l_partkey", F.col("l_suppkey").alias("node")).join(part, "l_partkey").select("name", "node").distinct(), "supplied")


@query("ot14_first_mapping", "SELECT l_orderkey, l_partkey AS mapped FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS LAST, l_partkey NULLS LAST) = 1")
def ot14(spark, d):
    """First match of an id mapping with several matches: the least line number, of lines with the same one the least part; nulls come last."""
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber").asc_nulls_last(), F.col("l_partkey").asc_nulls_last()))
    return T(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").withColumn("r", first).where("r = 1").select("l_orderkey", F.col("l_partkey").alias("mapped"))


@query("ot11_feature_table", "SELECT p_partkey AS gene, p_size AS size, coalesce(o.n, 0) AS orders, coalesce(s.n, 0) AS suppliers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) o ON o.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL) s ON s.l_partkey = p_partkey")
def ot11(spark, d):
    counts = T(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.count("*").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))
    p = T(spark, d, "part", F.col("p_partkey").alias("gene"), F.col("p_size").alias("size"))
    return p.join(counts, F.col("gene") == F.col("l_partkey"), "left").select("gene", "size", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


