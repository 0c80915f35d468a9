"""Queries beyond single functions: scans, merging, catalog, sinks, mixed steps, pipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans.compiler import Engine
from seriesloom.plans.suite import CLICK, EVENTS_NAME, HOUR, Query, events, grid, over
from seriesloom.sources import bridge, catalog, replicas, sinks
from seriesloom.sources.bridge import DAY, FEBRUARY, JANUARY

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _points(spark: SparkSession, sf_dir: str, target: str, start: int = JANUARY, stop: int = FEBRUARY) -> DataFrame:
    found = Engine(bridge.store(spark, sf_dir)).points(target, start, stop)
    return found.select("name", F.col("ts").cast("long").alias("ts"), (F.round("v", 6) + 0.0).alias("v"))


@query(over("SELECT name, ts, round(v, 6) + 0.0 AS v FROM s", ""))
def scan_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hourly event series."""
    return _points(spark, sf_dir, "events.*.*.value")


_ORDERS = "'orders.' || o_orderstatus || '.' || substr(o_orderpriority, 1, 1) || '.total'"


@query(f"SELECT name, ts, round(v, 6) + 0.0 AS v FROM ({grid('orders', _ORDERS, 'o_orderdate', 'o_totalprice', DAY, 804556800, 836092800)}) WHERE name LIKE 'orders.F.%'")
def scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of daily order totals; the range prunes the scan."""
    return _points(spark, sf_dir, "orders.F.*.total", 804556800, 836092800)


#: Ten years from 1995-01-01, UTC, which hold all dates of the tables.
DAYS = 3650
FIRST, LAST = 788918400, 788918400 + DAYS * DAY


@query("WITH t AS (SELECT 'lineitem.' || l_returnflag || '.' || l_linestatus || '.qty' AS name, l_quantity AS q, CAST(floor(epoch(l_shipdate) / 86400) * 86400 AS BIGINT) AS ts FROM lineitem) "
       f"SELECT 'total' AS name, CAST({FIRST} + i * 86400 AS BIGINT) AS ts, round(sum(q), 6) + 0.0 AS v FROM (SELECT unnest(range({DAYS})) AS i) LEFT JOIN t ON ts = {FIRST} + i * 86400 GROUP BY i")
def pipe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe over daily quantities of the whole table."""
    return _points(spark, sf_dir, "lineitem.*.*.qty|sumSeries()|alias('total')", FIRST, LAST)


_CLICKS = "event_type = 'click'"
_MIXED = (
    f"WITH a AS ({events('click')}), b AS (SELECT name, i // 6 AS i, avg(v) AS v FROM ({grid('events', EVENTS_NAME.replace('events.', 'ev10.'), 'ts', 'value', 600, where=_CLICKS)}) GROUP BY 1, 2), "
    "u AS (SELECT i, v FROM a UNION ALL SELECT i, v FROM b) "
    f"SELECT 'mixed' AS name, CAST({JANUARY} + i * 3600 AS BIGINT) AS ts, round(sum(v), 6) + 0.0 AS v FROM u GROUP BY i"
)


@query(_MIXED)
def mixed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly and ten-minute series summed at the least common multiple of their steps."""
    return _points(spark, sf_dir, "alias(sumSeries(events.click.*.value,ev10.click.*.value),'mixed')")


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of the hourly slots: each drops some and shifts others, by plain arithmetic."""
    one = bridge.events_table(spark, sf_dir).points.filter((F.col("ts") >= JANUARY) & (F.col("ts") < FEBRUARY))
    slot = F.col("ts") / F.lit(HOUR)
    copies = one.select("name", "ts", "v", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("replica"))
    key = F.pmod(slot.cast("long") * 7 + F.col("replica") * 3, F.lit(10))
    value = F.when(key == 0, F.lit(None)).when(key == 1, F.col("v") + 1).otherwise(F.col("v"))
    return copies.select("replica", "name", F.lit(HOUR).alias("step"), "ts", value.alias("v"))


_COPIES = (
    f"WITH p AS (SELECT {EVENTS_NAME} AS name, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts, sum(value) AS v FROM events GROUP BY 1, 2), "
    f"r AS (SELECT replica, name, ts, CASE (ts // 3600 * 7 + replica * 3) % 10 WHEN 0 THEN NULL WHEN 1 THEN v + 1 ELSE v END AS v FROM p, (SELECT unnest(range(3)) AS replica) WHERE ts >= {JANUARY} AND ts < {FEBRUARY}), "
    "f AS (SELECT name, ts, arg_min(v, replica) FILTER (v IS NOT NULL) AS v, count(v) AS n, count(DISTINCT v) AS d FROM r GROUP BY 1, 2), "
    "w AS (SELECT name, ts, v AS m FROM (SELECT name, ts, v, count(*) AS k, sum(count(*)) OVER (PARTITION BY name, ts) AS n FROM r WHERE v IS NOT NULL GROUP BY 1, 2, 3) WHERE k * 2 > n) "
)


@query(_COPIES + "SELECT name, ts, round(v, 6) + 0.0 AS v FROM f")
def merge_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas healed in order."""
    return replicas.merge(_replicas(spark, sf_dir)).points.select("name", "ts", (F.round("v", 6) + 0.0).alias("v"))


@query(_COPIES + "SELECT name, ts, round(coalesce(m, v), 6) + 0.0 AS v FROM f LEFT JOIN w USING (name, ts)")
def merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas that meet as whole series, by vote; slots that no replica has are left out."""
    rows = _replicas(spark, sf_dir)
    place = ((F.col("ts") - JANUARY) / HOUR).cast("int")
    held = rows.groupBy("replica", "name", "step").agg(F.map_from_entries(F.collect_list(F.struct(place, "v"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit((FEBRUARY - JANUARY) // HOUR - 1)), lambda i: F.try_element_at("m", i))
    merged = replicas.merge_series(held.select("replica", "name", F.lit(JANUARY).cast("long").alias("start"), "step", values.alias("values")), "majority")
    points = merged.select("name", F.posexplode("values").alias("i", "v")).select("name", (F.lit(JANUARY) + F.col("i") * HOUR).cast("long").alias("ts"), (F.round("v", 6) + 0.0).alias("v"))
    return rows.select("name", F.col("ts").cast("long").alias("ts")).distinct().join(points, ["name", "ts"])


@query(_COPIES + "SELECT name, ts, round(coalesce(m, v), 6) + 0.0 AS v FROM f LEFT JOIN w USING (name, ts)")
def merge_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas by vote."""
    return replicas.merge(_replicas(spark, sf_dir), "majority").points.select("name", "ts", (F.round("v", 6) + 0.0).alias("v"))


@query(_COPIES + "SELECT name, count(*) AS points, count(*) FILTER (d > 1) AS mismatches FROM f GROUP BY name")
def merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often replicas differ."""
    return replicas.merge(_replicas(spark, sf_dir), "check").stats.drop("fixed")


@query(f"SELECT DISTINCT 'events.' || event_type AS path, false AS is_leaf FROM events")
def find_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the tree."""
    return catalog.find(bridge.store(spark, sf_dir), "events.*")


@query(f"SELECT DISTINCT {EVENTS_NAME} AS path FROM events WHERE event_type IN ('click', 'view') UNION SELECT DISTINCT 'events.' || event_type FROM events WHERE event_type = 'error'")
def expand_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two finds."""
    return catalog.expand(bridge.store(spark, sf_dir), ["events.{click,view}.*.value", "events.err*"])


@query(f"SELECT name, CAST(3600 AS BIGINT) AS step, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT DISTINCT {EVENTS_NAME} AS name, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts FROM events) WHERE name LIKE 'events.click.%' GROUP BY name")
def info_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of some series."""
    return catalog.info(bridge.store(spark, sf_dir), CLICK)


@query(None)
def function_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All functions."""
    return catalog.functions(bridge.store(spark, sf_dir))


@query(over(f"SELECT name, CAST({JANUARY} + (i // 8) * 28800 AS BIGINT) AS ts, round(max(v), 6) + 0.0 AS v FROM s GROUP BY name, i // 8"))
def max_data_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 90 points for each series, by their largest value."""
    found = sinks.reduced_to(Engine(bridge.store(spark, sf_dir)).evaluate(f"consolidateBy({CLICK},'max')", JANUARY, FEBRUARY), 90)
    rows = found.select("name", "start", "step", F.posexplode("values").alias("i", "v"))
    return rows.select("name", (F.col("start") + F.col("i") * F.col("step")).alias("ts"), (F.round("v", 6) + 0.0).alias("v"))


_COUNTS = grid("events", "CASE event_type WHEN 'view' THEN 'offset.producer' ELSE 'offset.consumer' END", "ts", "1", HOUR, where="event_type IN ('view', 'click')")
_RUNNING = f"WITH s AS (SELECT ord, name, i, ts, CASE WHEN v IS NOT NULL THEN CAST(CAST(sum(v) OVER (PARTITION BY name ORDER BY i) AS BIGINT) AS VARCHAR) END AS v FROM ({_COUNTS})) "


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(bridge.store(spark, sf_dir)).render("offset.*", JANUARY, FEBRUARY)


@query(_RUNNING + "SELECT ord, '{\"target\":\"' || name || '\",\"datapoints\":[' || string_agg('[' || coalesce(v, 'null') || ',' || ts || ']', ',' ORDER BY i) || ']}' AS json FROM s GROUP BY ord, name")
def encode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts as JSON, a row for each series."""
    return sinks.json_rows(_offsets(spark, sf_dir))


@query(_RUNNING + "SELECT ord, CAST(i AS INTEGER) AS i, '\"' || name || '\",' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') || ',' || coalesce(v, '') AS csv FROM s")
def encode_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts as CSV, a row for each slot."""
    return sinks.csv_rows(_offsets(spark, sf_dir))


@query(_RUNNING + f"SELECT ord, name || ',{JANUARY},{FEBRUARY},3600|' || string_agg(coalesce(v, 'None'), ',' ORDER BY i) AS raw FROM s GROUP BY ord, name")
def encode_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts as raw text."""
    return sinks.raw_rows(_offsets(spark, sf_dir))


@query("SELECT DISTINCT 'events.' || event_type AS id, '{\"allowChildren\":1,\"context\":{},\"expandable\":1,\"id\":\"events.' || event_type || '\",\"leaf\":0,\"text\":\"' || event_type || '\"}' AS json FROM events")
def find_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the tree, as tree browsers read it."""
    return sinks.find_json(catalog.find(bridge.store(spark, sf_dir), "events.*"), "events.*")


@query("SELECT DISTINCT 'events.' || event_type || '.' AS path, '{\"path\":\"events.' || event_type || '.\",\"name\":\"\",\"is_leaf\":\"0\"}' AS json FROM events WHERE event_type LIKE 'c%'")
def complete_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an unfinished path may go on."""
    return sinks.completer_json(catalog.complete(bridge.store(spark, sf_dir), "events/c"))


@query(f"SELECT name, '{{\"name\":\"' || name || '\",\"aggregationMethod\":\"\",\"maxRetention\":' || CAST(max(ts) - min(ts) + 3600 AS BIGINT) || ',\"xFilesFactor\":0.0,\"retentions\":[{{\"secondsPerPoint\":3600,\"numberOfPoints\":' || count(*) || '}}]}}' AS json FROM (SELECT DISTINCT {EVENTS_NAME} AS name, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts FROM events) GROUP BY name")
def info_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of all event series, as JSON."""
    return sinks.info_json(catalog.info(bridge.store(spark, sf_dir), "events.*.*.value"))


def _drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies that drift by 4 in 1000, and in every third slot by 1 in 10."""
    one = bridge.events_table(spark, sf_dir).points
    copies = one.select("name", "ts", "v", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("replica"))
    drift = F.when(F.pmod(F.col("ts") / HOUR, F.lit(3)).cast("int") == 0, 0.1).otherwise(0.004)
    return copies.select("replica", "name", F.lit(HOUR).alias("step"), "ts", (F.col("v") * (1 + F.col("replica") * drift)).alias("v"))


@query(
    f"WITH p AS (SELECT {EVENTS_NAME} AS name, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts, sum(value) AS v FROM events GROUP BY 1, 2), "
    "d AS (SELECT *, CASE WHEN ts // 3600 % 3 = 0 THEN 0.1 ELSE 0.004 END AS x FROM p) "
    "SELECT name, count(*) AS points, count(*) FILTER (abs(v - v * (1 + 2 * x)) > abs(v * (1 + 2 * x)) * 0.01) AS mismatches FROM d GROUP BY name"
)
def merge_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often replicas differ by more than 1 in 100."""
    return replicas.merge(_drifting(spark, sf_dir), "check", 0.01).stats.drop("fixed")


@query(over("SELECT name, ts, round(v, 6) + 0.0 AS v FROM s"))
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range told as text."""
    found = Engine(bridge.store(spark, sf_dir)).points(CLICK, "20240101", "midnight_01/31/2024")
    return found.select("name", F.col("ts").cast("long").alias("ts"), (F.round("v", 6) + 0.0).alias("v"))


@query(None)
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(Engine(bridge.store(spark, sf_dir)).evaluate(CLICK, JANUARY, FEBRUARY))


@query(None)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_rows(Engine(bridge.store(spark, sf_dir)).evaluate(CLICK, JANUARY, FEBRUARY))


@query(None)
def sink_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.raw_rows(Engine(bridge.store(spark, sf_dir)).evaluate(CLICK, JANUARY, FEBRUARY))
