"""Queries against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from seriesloom.plans import extras, suite

SF = "/root/testdata/sf0.001"
ORACLES = suite.ORACLES | extras.ORACLES
#: Queries that pair, place or order series, on larger tables as well.
ORDERED = ["derivative", "integral", "integralByInterval", "keepLastValue", "divideSeriesLists", "diffSeriesLists", "areaBetween", "reduceSeries", "weightedAverage", "mapSeries", "sortByTotal", "asPercent", "pearsonClosest", "ifft", "group", "timeLagSeriesLists"]


@pytest.fixture(scope="module")
def tiny(spark):
    """Partitions as small as they get, so that branches of a plan are cut differently."""
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.shuffle.partitions": "16",
    }
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def same_rows(spark, name, sf):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = (suite.QUERIES | extras.QUERIES)[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(tiny, name):
    same_rows(tiny, name, SF)


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.01")), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ORDERED)
def test_same_rows_of_larger_tables(tiny, name):
    same_rows(tiny, name, SF.replace("0.001", "0.01"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_scans_are_pruned(spark):
    df = extras.QUERIES["scan_orders"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    assert pushed and all("GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p and "EqualTo(o_orderstatus,F)" in p for p in pushed)
    assert not re.search(r"ReadSchema: struct<[^>]*o_custkey", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 720


def test_every_oracle_has_a_query():
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())
    assert len(suite.QUERIES) == 140
