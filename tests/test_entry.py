"""The contract of ``__spark_entry__`` and every library query against its SQL at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql.functions import spark_partition_id

import __spark_entry__ as entry_point
from skein.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(found):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in found), key=repr)


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(duck.sql(f"select {pick} from ({registry.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_first_mapping_leaves_no_ties_to_chance(spark, tmp_path):
    lines = [(1, 9, 1), (1, 3, 1), (1, 1, 2), (2, 5, None), (2, 8, 4), (3, 7, 2), (3, 6, 2)]
    for k, order in enumerate((lines, lines[::-1])):
        at = tmp_path / str(k)
        spark.createDataFrame(order, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(str(at / "lineitem.parquet"))
        got = {tuple(r) for r in registry.QUERIES["ot14_first_mapping"](spark, str(at)).collect()}
        sql = registry.ORACLES["ot14_first_mapping"].replace("FROM lineitem", f"FROM read_parquet('{at}/lineitem.parquet/*.parquet')")
        assert got == set(duckdb.sql(sql).fetchall()) == {(1, 3), (2, 8), (3, 6)}


def test_pairs_of_one_group_come_from_many_tasks(spark, tmp_path):
    spark.range(200).selectExpr("id as c_custkey", "1 as c_nationkey", "'m' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(300).selectExpr("id % 100 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    found = registry.QUERIES["j05_stats_of_both"](spark, str(tmp_path)).withColumn("task", spark_partition_id()).collect()
    assert {(r.x, r.y): (r.nx, r.ny) for r in found} == {(x, y): (3 if x < 100 else None, 3 if y < 100 else None) for y in range(200) for x in range(y)}
    assert max(Counter(r.task for r in found).values()) < len(found) / 2
