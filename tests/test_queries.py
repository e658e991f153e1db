"""Every query that has SQL gives DuckDB's rows; the others run and give rows."""

import os

import duckdb
import pytest

import __spark_entry__
from strata.queries import QUERIES


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, oracle, name):
    df = __spark_entry__.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = oracle.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_partition_filters_reach_the_scan(spark, data):
    plan = __spark_entry__.queries()["partition_prune_sql"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_p_event_type" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan
