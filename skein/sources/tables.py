"""The supplied tables in the roles of the network model.

Parts are the nodes, return flags the layers; two parts bought in one order under one flag are linked, with the
number of such orders as weight. Brands are the named sets. Customers are patients and the parts they buy their
candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.build import co_member_pairs, co_membership


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, grp, node: parts by order and flag, distinct."""
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_orderkey", "l_partkey")
    return lines.select(F.col("l_returnflag").alias("layer"), F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("node")).distinct()


def edges(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """layer, a, b, n with a < b, of groups of up to ``most`` members."""
    return co_membership(memberships(spark, sf_dir), most=most)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: the distinct ends of ``edges`` in any layer."""
    return co_member_pairs(memberships(spark, sf_dir))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, node: parts by brand."""
    return table(spark, sf_dir, "part", "p_brand", "p_partkey").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("node"))


#: SQL of ``memberships`` and ``edges`` as common table expressions, and of ``sets`` and the nodes of each layer.
EDGES_SQL = """
m AS (SELECT DISTINCT l_returnflag AS layer, l_orderkey AS grp, l_partkey AS node FROM lineitem),
edges AS (
  SELECT x.layer, x.node AS a, y.node AS b, count(*) AS n
  FROM m x JOIN m y ON x.layer = y.layer AND x.grp = y.grp AND x.node < y.node GROUP BY ALL
),
sets AS (SELECT p_brand AS name, p_partkey AS node FROM part),
nodes AS (SELECT layer, a AS node FROM edges UNION SELECT layer, b FROM edges),
two_way AS (SELECT layer, a AS src, b AS dst FROM edges UNION ALL SELECT layer, b, a FROM edges),
deg AS (SELECT layer, src AS node, count(*) AS k FROM two_way GROUP BY ALL)
"""
