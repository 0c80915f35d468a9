"""The driver's relational tables as series.

``events.<type>.u<user % 5>.value`` (hourly), ``ev10.<type>.u<user % 5>.value`` (ten minutes),
``orders.<status>.<priority digit>.total`` and ``lineitem.<flag>.<status>.{qty,price}`` (daily),
``offset.consumer`` and ``offset.producer`` (hourly running counts of views and clicks).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.store import RawTable, RunningTable, Store

#: 2024-01-01 and 2024-01-31, UTC.
JANUARY, FEBRUARY = 1704067200, 1706659200
HOUR, DAY = 3600, 86400


def _user() -> Column:
    return F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))


def events_table(spark: SparkSession, sf_dir: str, step: int = HOUR, prefix: str = "events") -> RawTable:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return RawTable(prefix, rows, ("event_type", _user()), "ts", {"value": "value"}, step)


def orders_table(spark: SparkSession, sf_dir: str) -> RawTable:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return RawTable("orders", rows, ("o_orderstatus", F.substring("o_orderpriority", 1, 1)), "o_orderdate", {"total": "o_totalprice"}, DAY)


def lineitem_table(spark: SparkSession, sf_dir: str) -> RawTable:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return RawTable("lineitem", rows, ("l_returnflag", "l_linestatus"), "l_shipdate", {"qty": "l_quantity", "price": "l_extendedprice"}, DAY)


def offsets_table(spark: SparkSession, sf_dir: str) -> RunningTable:
    """Running counts, so that the consumer (clicks) follows the producer (views)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type").isin("view", "click")).withColumn("one", F.lit(1.0))
    counts = RawTable("count", rows, ("event_type",), "ts", {"n": "one"}, HOUR)
    return RunningTable(counts, "offset", {"count.view.n": "offset.producer", "count.click.n": "offset.consumer"})


def store(spark: SparkSession, sf_dir: str) -> Store:
    tables = [events_table(spark, sf_dir), events_table(spark, sf_dir, 600, "ev10"), orders_table(spark, sf_dir), lineitem_table(spark, sf_dir), offsets_table(spark, sf_dir)]
    return Store(spark, tables)
