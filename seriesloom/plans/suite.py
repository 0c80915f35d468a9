"""One query for each function, over the driver's tables, with DuckDB SQL that gives the same rows.

Values are rounded to six decimals. Queries whose point is the order of series give place and name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans.compiler import Engine
from seriesloom.sources import bridge
from seriesloom.sources.bridge import FEBRUARY, HOUR, JANUARY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLICK, ALL, VIEW = "events.click.*.value", "events.*.*.value", "events.view.*.value"
SLOTS = (FEBRUARY - JANUARY) // HOUR


def grid(table: str, name: str, time: str, value: str, step: int, start: int = JANUARY, stop: int = FEBRUARY, where: str = "true") -> str:
    """A relation (ord, name, i, ts, v) with a row for every slot of every series."""
    slot = f"CAST(floor(epoch({time}) / {step}) * {step} AS BIGINT)"
    rows = f"SELECT {name} AS name, {slot} AS ts, sum({value}) AS v FROM {table} WHERE {where} GROUP BY 1, 2"
    return (
        f"SELECT n.ord, n.name, g.i, {start} + g.i * {step} AS ts, r.v FROM "
        f"(SELECT name, row_number() OVER (ORDER BY name) - 1 AS ord FROM (SELECT DISTINCT name FROM ({rows}) WHERE ts >= {start} AND ts < {stop})) n "
        f"CROSS JOIN (SELECT unnest(range({(stop - start) // step})) AS i) g "
        f"LEFT JOIN ({rows}) r ON r.name = n.name AND r.ts = {start} + g.i * {step}"
    )


EVENTS_NAME = "'events.' || event_type || '.u' || (user_id % 5) || '.value'"


def events(kind: str = "click", step: int = HOUR, start: int = JANUARY, stop: int = FEBRUARY) -> str:
    return grid("events", EVENTS_NAME, "ts", "value", step, start, stop, f"event_type = '{kind}'" if kind else "true")


def over(body: str, kind: str = "click", more: str = "") -> str:
    return f"WITH s AS ({events(kind)}){more} {body}"


def shown(body: str, kind: str = "click", more: str = "") -> str:
    """``body`` yields name, ts, v."""
    return over(f"SELECT name, ts, round(v, 6) + 0.0 AS v FROM ({body})", kind, more)


def points(key: str, target: str | list[str], sql: str | None, start: int = JANUARY, stop: int = FEBRUARY, off: float = 0.0) -> None:
    """off: what is added before rounding, where values halfway between two roundings occur."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(bridge.store(spark, sf_dir)).points(target, start, stop)
        return found.select("name", F.col("ts").cast("long").alias("ts"), (F.round(F.col("v") + off, 6) + 0.0).alias("v"))

    QUERIES[key] = query
    if sql:
        ORACLES[key] = sql


def places(key: str, target: str, sql: str | None) -> None:
    """Place and name of each series."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(bridge.store(spark, sf_dir)).render(target, JANUARY, FEBRUARY).select(F.col("ord").alias("place"), "name")

    QUERIES[key] = query
    if sql:
        ORACLES[key] = sql


def elementwise(key: str, args: str, value: str, head: str | None = None, tail: str = "") -> None:
    points(key, f"{key}({CLICK}{args})", shown(f"SELECT '{head or key}(' || name || '{tail})' AS name, ts, {value} AS v FROM s"))


def _elementwise() -> None:
    w = "OVER (PARTITION BY name)"
    elementwise("absolute", "", "abs(v)")
    elementwise("scale", ",2.5", "v * 2.5", tail=",2.5")
    elementwise("scaleToSeconds", ",60", "v * 60 / 3600", tail=",60")
    elementwise("offset", ",10", "v + 10", tail=",10")
    elementwise("offsetToZero", "", f"v - min(v) {w}")
    elementwise("invert", "", "1 / nullif(v, 0)")
    elementwise("pow", ",0.5", "pow(v, 0.5)", tail=",0.5")
    elementwise("squareRoot", "", "sqrt(v)")
    for key in ("logarithm", "log"):
        elementwise(key, ",2", "CASE WHEN v > 0 THEN ln(v) / ln(2) END", "logarithm", ",2")
    for key in ("isNotNull", "isNonNull"):
        elementwise(key, "", "CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END", "isNonNull")
    elementwise("transformNull", ",-1", "coalesce(v, -1)", tail=",-1")
    elementwise("removeBelowValue", ",20", "CASE WHEN v >= 20 THEN v END", tail=", 20")
    elementwise("removeAboveValue", ",20", "CASE WHEN v <= 20 THEN v END", tail=", 20")
    elementwise("removeBelowPercentile", ",30", f"CASE WHEN v >= quantile_cont(v, 0.3) {w} THEN v END", tail=", 30")
    elementwise("removeAbovePercentile", ",30", f"CASE WHEN v <= quantile_cont(v, 0.3) {w} THEN v END", tail=", 30")
    elementwise("nPercentile", ",95", f"quantile_cont(v, 0.95) {w}", tail=",95")
    for key in ("lowPass", "lpf"):
        elementwise(key, ",40", f"CASE WHEN i < floor({SLOTS} * 0.2) OR i >= floor({SLOTS} * 0.8) THEN v END", "lowPass", ",40")
    elementwise("linearRegression", "", f"regr_intercept(v, i) {w} + regr_slope(v, i) {w} * i")
    figures = "avg(coalesce(v, 0)) AS a, max(coalesce(v, 0)) AS m, max(v) AS mx, min(v) AS mn, arg_max(v, i) FILTER (v IS NOT NULL) AS cur"
    places("legendValue", f"legendValue({CLICK},'avg','max')", over(f"SELECT ord AS place, name || printf(' (avg: %.6f) (max: %.6f)', a, m) AS name FROM (SELECT ord, name, {figures} FROM s GROUP BY ord, name)"))
    places("cactiStyle", f"cactiStyle({CLICK})", over(f"SELECT ord AS place, name || printf(' Current: %.0f Max: %.0f Min: %.0f', cur, mx, mn) AS name FROM (SELECT ord, name, {figures} FROM s GROUP BY ord, name)"))


def _aggregates() -> None:
    def reduced(key: str, name: str, value: str, target: str = CLICK) -> None:
        raw = target
        points(key, f"{key}({target})", shown(f"SELECT '{name}({raw})' AS name, ts, {value} AS v FROM s GROUP BY ts"))

    for key in ("sum", "sumSeries"):
        reduced(key, "sumSeries", "sum(v)")
    for key in ("avg", "average", "averageSeries"):
        reduced(key, "averageSeries", "avg(v)")
    for key in ("min", "minSeries"):
        reduced(key, key, "min(v)")
    for key in ("max", "maxSeries"):
        reduced(key, key, "max(v)")
    for key in ("median", "medianSeries"):
        reduced(key, "medianSeries", "quantile_cont(v, 0.5)")
    for key in ("stddev", "stddevSeries"):
        reduced(key, "stddevSeries", "stddev_pop(v)")
    for key in ("diff", "diffSeries"):
        reduced(key, "diffSeries", "max(CASE WHEN ord = 0 THEN v END) - coalesce(sum(CASE WHEN ord > 0 THEN v END), 0)")
    reduced("multiplySeries", "multiplySeries", "CASE WHEN count(v) = count(*) THEN product(v) END")
    reduced("countSeries", "countSeries", "CAST(count(*) AS DOUBLE)")
    reduced("rangeOfSeries", "rangeOfSeries", "CASE WHEN count(v) >= 2 THEN max(v) - min(v) END")
    nth = "list_sort(list(v) FILTER (v IS NOT NULL))[CAST(ceil((count(v) - 1) * 0.6) AS INTEGER) + 1]"
    points("percentileOfSeries", f"percentileOfSeries({CLICK},60)", shown(f"SELECT 'percentileOfSeries({CLICK},60)' AS name, ts, {nth} AS v FROM s GROUP BY ts"))
    key = "'events.' || split_part(name, '.', 3) || '.value'"
    for kind, value in (("sum", "sum(v)"), ("average", "avg(v)"), ("multiply", "product(v)")):
        f = f"{kind}SeriesWithWildcards"
        body = f"SELECT '{f}(' || {key} || ')' AS name, ts, {value} AS v FROM s GROUP BY 1, 2"
        if kind == "multiply":
            points(f, f"{f}(scale({VIEW},0.01),2)", shown(f"SELECT '{f}(scale(events.view.value,0.01))' AS name, ts, product(v * 0.01) AS v FROM s GROUP BY ts", "view"))
        else:
            points(f, f"{f}({ALL},1)", shown(body, ""))
    two = f", w AS ({events('view')})"
    points(
        "weightedAverage", f"weightedAverage({CLICK},{VIEW},2)",
        shown(
            "SELECT 'weightedAverage(' || (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM s) || ', ' || (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM w) || ', 2)' AS name, "
            "ts, p / nullif(q, 0) AS v FROM (SELECT s.ts, sum(s.v * w.v) AS p FROM s JOIN w ON s.i = w.i AND split_part(s.name, '.', 3) = split_part(w.name, '.', 3) GROUP BY s.ts) JOIN (SELECT ts, sum(v) AS q FROM w GROUP BY ts) USING (ts)",
            more=two,
        ),
    )
    points("asPercent", f"asPercent({CLICK})", shown(f"SELECT 'asPercent(' || name || ',sumSeries({CLICK}))' AS name, ts, v / nullif(sum(v) OVER (PARTITION BY ts), 0) * 100 AS v FROM s"))


def _groups() -> None:
    for key, target in (("groupByNode", f"groupByNode({ALL},1,'sumSeries')"), ("groupByNodes", f"groupByNodes({ALL},'sumSeries',1)")):
        points(key, target, shown("SELECT split_part(name, '.', 2) AS name, ts, sum(v) AS v FROM s GROUP BY 1, 2", ""))
    points("applyByNode", "applyByNode(events.*.u1.value,1,'sumSeries(%.*.value)','%.sum')", shown("SELECT 'events.' || split_part(name, '.', 2) || '.sum' AS name, ts, sum(v) AS v FROM s GROUP BY 1, 2", ""))
    for key in ("mapSeries", "map"):
        places(key, f"{key}({ALL},2)", over("SELECT row_number() OVER (ORDER BY split_part(name, '.', 3), ord) - 1 AS place, name FROM (SELECT DISTINCT ord, name FROM s)", ""))
    for key in ("reduceSeries", "reduce"):
        sql = shown("SELECT 'events.reduce.asPercent.' || substr(a.name, 14) AS name, a.ts, a.v / nullif(b.v, 0) * 100 AS v FROM (SELECT * FROM s WHERE name LIKE 'events.click.%') a JOIN (SELECT * FROM s WHERE name LIKE 'events.view.%') b ON a.i = b.i AND split_part(a.name, '.', 3) = split_part(b.name, '.', 3)", "")
        points(key, f"{key}({ALL},'asPercent',1,'click','view')", sql)
    both = f", w AS ({events('view')})"
    places("group", f"group({VIEW},{CLICK})", over("SELECT ord AS place, name FROM (SELECT DISTINCT ord, name FROM w) UNION ALL SELECT ord + (SELECT count(DISTINCT name) FROM w), name FROM (SELECT DISTINCT ord, name FROM s)", more=both))
    points("fallbackSeries", f"fallbackSeries(events.nothing.*.value,{CLICK})", shown("SELECT name, ts, v FROM s"))


def _pairs() -> None:
    both = f", w AS ({events('view')})"
    named = "'{}(' || s.name || ',' || w.name || ')'"
    join = "FROM s JOIN w ON s.i = w.i AND s.ord = w.ord"
    points("divideSeries", f"divideSeries({CLICK},events.view.u0.value)", shown(f"SELECT {named.format('divideSeries')} AS name, s.ts, s.v / nullif(w.v, 0) AS v FROM s JOIN w ON s.i = w.i AND w.name = 'events.view.u0.value'", more=both))
    for kind, value in (("divide", "s.v / nullif(w.v, 0)"), ("diff", "s.v - w.v"), ("multiply", "s.v * w.v")):
        points(f"{kind}SeriesLists", f"{kind}SeriesLists({CLICK},{VIEW})", shown(f"SELECT {named.format(kind + 'Series')} AS name, s.ts, {value} AS v {join}", more=both))
    points("powSeriesLists", f"powSeriesLists(scale({CLICK},0.01),scale({VIEW},0.01))", shown("SELECT 'powSeries(scale(' || s.name || ',0.01),scale(' || w.name || ',0.01))' AS name, s.ts, pow(s.v * 0.01, w.v * 0.01) AS v " + join, more=both))
    counts = grid("events", "CASE event_type WHEN 'view' THEN 'p' ELSE 'c' END", "ts", "1", HOUR, where="event_type IN ('view', 'click')")
    lag = (
        f"WITH r AS (SELECT name, i, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER (PARTITION BY name ORDER BY i) AS DOUBLE) END AS v, ts FROM ({counts})), "
        "c AS (SELECT * FROM r WHERE name = 'c'), p AS (SELECT * FROM r WHERE name = 'p'), "
        f"a AS (SELECT c.ts, c.i, c.v, least(c.i, coalesce((SELECT min(p.i) FROM p WHERE p.v > c.v), {SLOTS}) - 1) AS j FROM c) "
        "SELECT 'timeLagSeries(offset.consumer,offset.producer)' AS name, a.ts, CAST(CASE WHEN a.v IS NOT NULL AND p.v IS NOT NULL THEN (a.i - a.j) * 3600 END AS DOUBLE) AS v FROM a LEFT JOIN p ON p.i = a.j"
    )
    points("timeLagSeries", "timeLagSeries(offset.consumer,offset.producer)", lag)
    points("timeLagSeriesLists", "timeLagSeriesLists(offset.consumer,offset.producer)", lag)
    frame = "OVER (ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    x, y = "CASE WHEN b IS NOT NULL THEN a END", "CASE WHEN a IS NOT NULL THEN b END"
    sums = ", ".join(f"sum({e}) {frame} AS {k}" for k, e in (("sx", x), ("sy", y), ("sxy", "a * b"), ("sxx", f"({x}) * a"), ("syy", f"({y}) * b"))) + f", count(a * b) {frame} AS n"
    points(
        "pearson", "pearson(events.click.u0.value,events.view.u0.value,24)",
        over(
            "SELECT 'pearson(events.click.u0.value,events.view.u0.value,24)' AS name, ts, round(CASE WHEN i >= 23 AND (n * sxx - sx * sx) > 1e-6 AND (n * syy - sy * sy) > 1e-6 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 6) + 0.0 AS v "
            f"FROM (SELECT i, ts, {sums} FROM (SELECT s.i, s.ts, s.v AS a, w.v AS b FROM s JOIN w ON s.i = w.i WHERE s.name = 'events.click.u0.value' AND w.name = 'events.view.u0.value'))",
            more=both,
        ),
    )
    places("pearsonClosest", f"pearsonClosest(events.click.u0.value,{ALL},4,direction='abs')", over("SELECT row_number() OVER (ORDER BY round(abs(k), 12) DESC, ord) - 1 AS place, name FROM (SELECT b.ord, b.name, corr(b.v, a.v) AS k FROM s b JOIN s a ON a.i = b.i AND a.name = 'events.click.u0.value' GROUP BY 1, 2) WHERE k IS NOT NULL AND NOT isnan(k) QUALIFY place < 4", ""))
    # Values of both windows, each with the shares of both that are no larger; then the series of the p value.
    near = "SELECT w.i, a.v, {} AS y FROM (SELECT DISTINCT i FROM s WHERE i >= 48) w JOIN x{} a ON a.i > w.i - 48 AND a.i <= w.i"
    values = f"x0 AS (SELECT i, v FROM s WHERE name = 'events.click.u0.value' AND v IS NOT NULL), x1 AS (SELECT i, v FROM w WHERE name = 'events.view.u0.value' AND v IS NOT NULL), u AS ({near.format(0, 0)} UNION ALL {near.format(1, 1)}), "
    shares = "c AS (SELECT i, v, count(*) FILTER (y = 0) OVER (PARTITION BY i ORDER BY v RANGE UNBOUNDED PRECEDING) AS a, count(*) FILTER (y = 1) OVER (PARTITION BY i ORDER BY v RANGE UNBOUNDED PRECEDING) AS b, count(*) FILTER (y = 0) OVER (PARTITION BY i) AS m, count(*) FILTER (y = 1) OVER (PARTITION BY i) AS n FROM u), "
    gaps = "d AS (SELECT i, max(abs(a / m - b / n)) AS d, sqrt(any_value(m) * any_value(n) / (any_value(m) + any_value(n))) AS e FROM c WHERE m > 0 AND n > 0 GROUP BY i), z AS (SELECT i, (e + 0.12 + 0.11 / e) * d AS z FROM d), "
    chance = "p AS (SELECT i, CASE WHEN z < 1e-9 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * pow(k * z, 2)))), 0), 1) END AS p FROM z) "
    smirnov = f"SELECT 'kolmogorovSmirnovTest2(events.click.u0.value,events.view.u0.value,48)' AS name, s.ts, round(p, 6) + 0.0 AS v FROM s LEFT JOIN p ON p.i = s.i WHERE s.name = 'events.click.u0.value'"
    for key in ("kolmogorovSmirnovTest2", "ksTest2"):
        points(key, f"{key}(events.click.u0.value,events.view.u0.value,48)", over(smirnov, more=f"{both}, {values}{shares}{gaps}{chance}"))


def _windows() -> None:
    w = "PARTITION BY name ORDER BY i"
    before = f"OVER ({w} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
    for key, value in (("movingAverage", "avg(v)"), ("movingMin", "min(v)"), ("movingMax", "max(v)")):
        elementwise(key, ",10", f"CASE WHEN i >= 10 THEN {value} {before} END", tail=",10")
    elementwise("movingSum", ",10", f"CASE WHEN i >= 10 THEN coalesce(sum(v) {before}, 0) END", tail=",10")
    elementwise("movingMedian", ",10", f"CASE WHEN i >= 9 THEN quantile_cont(v, 0.5) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END", tail=",10")
    recent = f"OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    elementwise("stdev", ",10", f"CASE WHEN NOT (i >= 9 AND count(v) {recent} < 9) THEN coalesce(stddev_pop(v) {recent}, 0) END", tail=",10")
    elementwise("derivative", "", f"v - last_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    elementwise("nonNegativeDerivative", "", f"CASE WHEN v >= lag(v) OVER ({w}) THEN v - lag(v) OVER ({w}) END")
    elementwise("perSecond", "", f"CASE WHEN v >= lag(v) OVER ({w}) THEN (v - lag(v) OVER ({w})) / 3600 END")
    elementwise("integral", "", f"CASE WHEN v IS NOT NULL THEN sum(v) OVER ({w}) END")
    elementwise("integralByInterval", ",'1d'", "CASE WHEN v IS NOT NULL THEN sum(v) OVER (PARTITION BY name, i // 24 ORDER BY i) END", tail=",''1d''")
    elementwise("delay", ",3", f"lag(v, 3) OVER ({w})", tail=",3")
    elementwise("changed", "", f"CASE WHEN coalesce(v, 0) <> lag(coalesce(v, 0)) OVER ({w}) THEN 1.0 ELSE 0.0 END")
    gap = f"i - max(CASE WHEN v IS NOT NULL THEN i END) OVER ({w})"
    elementwise("keepLastValue", ",2", f"CASE WHEN {gap} <= 2 THEN last_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END", tail=",2")
    points("hitcount", f"hitcount({CLICK},'6h')", shown(f"SELECT 'hitcount(' || name || ',''6h'')' AS name, {JANUARY} + (i // 6) * 21600 AS ts, CASE WHEN count(v) > 0 THEN sum(v) * 3600 WHEN i // 6 = 0 THEN 0.0 END AS v FROM s GROUP BY name, i // 6"))
    points("summarize", f"summarize({CLICK},'1d','avg')", shown(f"SELECT 'summarize(' || name || ',''1d'',''avg'')' AS name, {JANUARY} + (i // 24) * 86400 AS ts, avg(v) AS v FROM s GROUP BY name, i // 24"))
    steps = f"k AS (SELECT *, row_number() OVER ({w}) AS n FROM s WHERE v IS NOT NULL)"
    held = "h AS (SELECT name, n, i, v AS h FROM k WHERE n = 1 UNION ALL SELECT k.name, k.n, k.i, 0.3::DOUBLE * k.v + 0.7::DOUBLE * h.h FROM h JOIN k ON k.name = h.name AND k.n = h.n + 1)"
    smoothed = shown("SELECT 'ewma(' || s.name || ',0.3)' AS name, ts, h AS v FROM s LEFT JOIN h ON h.name = s.name AND h.i = s.i", more=f", {steps}, {held}").replace("WITH s", "WITH RECURSIVE s", 1)
    for key in ("ewma", "exponentialWeightedMovingAverage"):
        points(key, f"{key}({CLICK},0.3)", smoothed)


def _filters() -> None:
    def kept(key: str, args: str, having: str) -> None:
        places(key, f"{key}({ALL}{args})", over(f"SELECT row_number() OVER (ORDER BY ord) - 1 AS place, name FROM (SELECT ord, name FROM s GROUP BY ord, name HAVING {having})", ""))

    current = "arg_max(v, i) FILTER (v IS NOT NULL)"
    kept("averageAbove", ",60", "avg(v) >= 60")
    kept("averageBelow", ",60", "avg(v) <= 60")
    kept("currentAbove", ",50", f"{current} >= 50")
    kept("currentBelow", ",50", f"{current} <= 50")
    kept("maximumAbove", ",380", "max(v) > 380")
    kept("maximumBelow", ",380", "max(v) <= 380")
    kept("minimumAbove", ",0.3", "min(v) > 0.3")
    kept("minimumBelow", ",0.3", "min(v) <= 0.3")
    kept("filterSeries", ",'max','>=',250", "max(v) >= 250")
    kept("grep", ",'u[12]'", "regexp_matches(name, 'u[12]')")
    kept("exclude", ",'u[12]'", "NOT regexp_matches(name, 'u[12]')")
    kept("removeEmptySeries", "", "count(v) > 0")
    kept("removeZeroSeries", "", "count(nullif(v, 0)) > 0")


def _sorts() -> None:
    def sorted_(key: str, args: str, order: str, n: int = 1000, having: str = "true") -> None:
        places(key, f"{key}({ALL}{args})", over(f"SELECT row_number() OVER (ORDER BY {order}, ord) - 1 AS place, name FROM (SELECT ord, name, avg(v) AS a, max(v) AS m, var_pop(v) AS d, arg_max(v, i) FILTER (v IS NOT NULL) AS c, max(coalesce(v, 0)) AS mz, min(coalesce(v, 0)) AS nz, sum(v) AS t FROM s GROUP BY ord, name) WHERE {having} QUALIFY place < {n}", ""))

    sorted_("highestAverage", ",5", "a DESC", 5)
    sorted_("highestCurrent", ",5", "c DESC", 5)
    sorted_("highestMax", ",5", "m DESC", 5)
    sorted_("lowestAverage", ",5", "a", 5)
    sorted_("lowestCurrent", ",5", "c", 5)
    sorted_("mostDeviant", ",5", "d DESC", 5)
    sorted_("limit", ",7", "0", 7)
    sorted_("sortByMaxima", "", "mz DESC")
    sorted_("sortByMinima", "", "CASE WHEN nz = 0 THEN 1e308 ELSE 1 / nz END DESC")
    sorted_("sortByTotal", "", "t DESC")
    sorted_("sortByName", "", "name")
    pool = ", q AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM s WHERE v IS NOT NULL), e AS (SELECT l[CAST(floor(0.25 * n) AS INTEGER) + 1] AS q1, l[CAST(floor(0.75 * n) AS INTEGER) + 1] AS q3 FROM q)"
    for key, test in (("tukeyAbove", "v >= q3 + 1.5 * (q3 - q1)"), ("tukeyBelow", "v <= q1 - 0.125 * (q3 - q1)")):
        basis = 1.5 if key == "tukeyAbove" else 0.125
        places(key, f"{key}({ALL},{basis},5)", over(f"SELECT row_number() OVER (ORDER BY k DESC, ord) - 1 AS place, name FROM (SELECT ord, name, count(*) AS k FROM s, e WHERE {test} GROUP BY ord, name) QUALIFY place < 5", "", pool))


def _names() -> None:
    def renamed(key: str, args: str, name: str) -> None:
        places(key, f"{key}({CLICK}{args})", over(f"SELECT ord AS place, {name} AS name FROM (SELECT DISTINCT ord, name FROM s)"))

    renamed("alias", ",'clicks'", "'clicks'")
    renamed("aliasByMetric", "", "'value'")
    renamed("aliasByNode", ",1,-2", "split_part(name, '.', 2) || '.' || split_part(name, '.', 3)")
    places("aliasSub", f"aliasSub({CLICK},'u(\\d)','user-\\1')", over("SELECT ord AS place, regexp_replace(name, 'u(\\d)', 'user-\\1', 'g') AS name FROM (SELECT DISTINCT ord, name FROM s)"))
    renamed("substr", ",1,3", "split_part(name, '.', 2) || '.' || split_part(name, '.', 3)")


def _shifts() -> None:
    unchanged = shown("SELECT name, ts, v FROM s")
    points("consolidateBy", f"consolidateBy({CLICK},'max')", unchanged)
    points("cumulative", f"cumulative({CLICK})", unchanged)
    start, stop = JANUARY + 7 * 86400, JANUARY + 9 * 86400

    def earlier(by: int) -> str:
        return f"SELECT 'timeShift(' || name || ',{{}}' || '{-by}' || '{{}})' AS name, ts + {by} AS ts, v FROM ({events('click', HOUR, start - by, stop - by)})"

    points("timeShift", f"timeShift({CLICK},'1d')", f"SELECT name, ts, round(v, 6) + 0.0 AS v FROM ({earlier(86400).format(chr(39) * 2, chr(39) * 2)})", start, stop)
    stacked = " UNION ALL ".join(earlier(k * 86400).format("", "") for k in range(3)).replace("'-0'", "'0'")
    points("timeStack", f"timeStack({CLICK},'1d',0,3)", f"SELECT name, ts, round(v, 6) + 0.0 AS v FROM ({stacked})", start, stop)
    points("constantLine", "constantLine(42.5)", f"SELECT '42.5' AS name, CAST({start} + i * 86400 AS BIGINT) AS ts, CAST(42.5 AS DOUBLE) AS v FROM (SELECT unnest(range(3)) AS i)", start, stop)
    for key in ("timeFunction", "time"):
        points(key, f"{key}('clock',3600)", f"SELECT 'clock' AS name, CAST({start} + i * 3600 AS BIGINT) AS ts, CAST({start} + i * 3600 AS DOUBLE) AS v FROM (SELECT unnest(range(48)) AS i)", start, stop)
    for key in ("randomWalk", "randomWalkFunction"):
        points(key, f"{key}('walk')", None, start, start + 3600)
    for key, args in (("color", ",'blue'"), ("stacked", ""), ("alpha", ",0.5"), ("lineWidth", ",2")):
        points(key, f"{key}({CLICK}{args})", unchanged)
    for key in ("dashed", "drawAsInfinite", "secondYAxis"):
        elementwise(key, "", "v")
    between = f"SELECT 'areaBetween(events.click.{{u0,u1}}.value)' AS name, a.ts, a.v FROM s a WHERE a.name = 'events.click.u0.value' UNION ALL SELECT 'areaBetween(events.click.{{u0,u1}}.value)', a.ts, b.v - a.v FROM s a JOIN s b ON a.i = b.i WHERE a.name = 'events.click.u0.value' AND b.name = 'events.click.u1.value'"
    points("areaBetween", "areaBetween(events.click.{u0,u1}.value)", shown(between.replace("{{", "{").replace("}}", "}")))
    points("threshold", "threshold(7.5,'limit','red')", f"SELECT 'limit' AS name, CAST({start} + i * {stop - start} AS BIGINT) AS ts, CAST(7.5 AS DOUBLE) AS v FROM (SELECT unnest(range(2)) AS i)", start, stop)


def smoothing(value: str) -> str:
    """A recursive relation h (name, i, ts, v, p, d): triple exponential smoothing with a season of 24
    slots over s. ss and ds hold the last season's figures and deviations, f what comes next."""
    usual, spread = "CASE WHEN len(ss) = 24 THEN ss[1] ELSE 0.0 END", "CASE WHEN len(ds) = 24 THEN ds[1] ELSE 0.0 END"
    coming = "CASE len(ss) WHEN 24 THEN ss[2] WHEN 23 THEN ss[1] ELSE 0.0 END"
    last = "CASE WHEN len({0}) = 24 THEN list_slice({0}, 2, 24) ELSE {0} END"
    read = f"SELECT h.name, s.i, s.ts, CAST({value} AS DOUBLE) AS v, h.l AS was, h.t, h.f, h.ss, h.ds FROM h JOIN s ON s.name = h.name AND s.i = h.i + 1"
    told = f"SELECT *, CASE WHEN v IS NULL THEN f WHEN i = 0 THEN v ELSE f END AS p, coalesce(was, v) AS b, {usual} AS u, {spread} AS x, {coming} AS y FROM ({read})"
    level = f"SELECT *, 0.1::DOUBLE * (v - u) + (1 - 0.1::DOUBLE) * (b + t) AS l FROM ({told})"
    slope = f"SELECT *, CASE WHEN v IS NULL THEN 0.0 ELSE 0.0035::DOUBLE * (l - b) + (1 - 0.0035::DOUBLE) * t END AS t2, CASE WHEN v IS NULL THEN 0.0 ELSE 0.1::DOUBLE * (v - l) + (1 - 0.1::DOUBLE) * u END AS s2, CASE WHEN v IS NULL THEN 0.0 ELSE 0.1::DOUBLE * abs(v - coalesce(p, 0.0)) + (1 - 0.1::DOUBLE) * x END AS d FROM ({level})"
    start = "SELECT DISTINCT name, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS f, CAST([] AS DOUBLE[]) AS ss, CAST([] AS DOUBLE[]) AS ds FROM s"
    return f"h AS ({start} UNION ALL SELECT name, i, ts, v, p, d, l, t2, CASE WHEN v IS NOT NULL THEN l + t2 + y END, list_append({last.format('ss')}, s2), list_append({last.format('ds')}, d) FROM ({slope}))"


def _numeric() -> None:
    waves = ", ".join(f"sum(coalesce(b.v, 0) * {f}(2 * pi() * ((a.i * b.i) % {SLOTS}) / {SLOTS})) AS {k}" for f, k in (("cos", "x"), ("sin", "y")))
    points("fft", f"fft({CLICK},'abs')", shown(f"SELECT 'fft(' || name || ',''abs'')' AS name, ts, sqrt(x * x + y * y) AS v FROM (SELECT a.name, a.ts, {waves} FROM s a JOIN s b ON a.name = b.name GROUP BY a.name, a.ts)"))
    points("ifft", f"ifft(fft({CLICK},'abs'),fft({CLICK},'phase'))", shown("SELECT 'ifft(fft(' || name || ',''abs''), fft(' || name || ',''phase''))' AS name, ts, abs(coalesce(v, 0)) AS v FROM s"))
    # Least squares by polynomials that are orthogonal over the slots with a value.
    fitted = (
        f"b AS (SELECT name, i / {SLOTS - 1} AS x, v FROM s WHERE v IS NOT NULL), "
        "c1 AS (SELECT name, avg(x) AS m, avg(v) AS k0, avg(x * x) AS s20, avg(x * x * x) AS s30 FROM b GROUP BY name), "
        "q1 AS (SELECT b.*, x - m AS p1, s20, s30 FROM b JOIN c1 USING (name)), "
        "c2 AS (SELECT name, sum(p1 * p1) AS n1, sum(x * x * p1) / sum(p1 * p1) AS s21, sum(x * x * x * p1) / sum(p1 * p1) AS s31, sum(v * p1) / sum(p1 * p1) AS k1 FROM q1 GROUP BY name), "
        "q2 AS (SELECT q1.*, s31, x * x - s20 - s21 * p1 AS p2 FROM q1 JOIN c2 USING (name)), "
        "c3 AS (SELECT name, sum(x * x * x * p2) / sum(p2 * p2) AS s32, sum(v * p2) / sum(p2 * p2) AS k2 FROM q2 GROUP BY name), "
        "q3 AS (SELECT q2.*, x * x * x - s30 - s31 * p1 - s32 * p2 AS p3 FROM q2 JOIN c3 USING (name)), "
        "c4 AS (SELECT name, sum(v * p3) / sum(p3 * p3) AS k3 FROM q3 GROUP BY name), "
        f"g AS (SELECT *, i / {SLOTS - 1} AS x, i / {SLOTS - 1} - m AS p1 FROM c1 JOIN c2 USING (name) JOIN c3 USING (name) JOIN c4 USING (name), (SELECT unnest(range({SLOTS + 24})) AS i)), "
        "h AS (SELECT *, x * x - s20 - s21 * p1 AS p2 FROM g) "
    )
    curve = f"SELECT 'polyfit(' || name || ',3,''1d'')' AS name, CAST({JANUARY} + i * 3600 AS BIGINT) AS ts, round(k0 + k1 * p1 + k2 * p2 + k3 * (x * x * x - s30 - s31 * p1 - s32 * p2), 6) + 0.0 AS v FROM h"
    points("polyfit", f"polyfit({CLICK},3,'1d')", over(curve, more=f", {fitted}"))
    start = JANUARY + 8 * 86400
    predicted = "SELECT 'holtWinters{}(' || name || ')' AS name, ts, {} AS v FROM {} WHERE ts >= " + str(start)
    bands = " UNION ALL ".join(predicted.format(f"Confidence{side}", f"p {sign} 3 * d", "h") for side, sign in (("Lower", "-"), ("Upper", "+")))
    outside = "CASE WHEN p IS NULL OR v IS NULL THEN 0.0 WHEN v > p + 3 * d THEN v - (p + 3 * d) WHEN v < p - 3 * d THEN v - (p - 3 * d) ELSE 0.0 END"
    for key, body, value in (
        ("holtWintersForecast", predicted.format("Forecast", "p", "h"), "coalesce(s.v, 0.0)"),
        ("holtWintersConfidenceBands", bands, "s.v"),
        ("holtWintersAberration", predicted.format("Aberration", outside, "(SELECT h.name, h.ts, h.p, h.d, s.v FROM h JOIN s ON s.name = h.name AND s.i = h.i)"), "coalesce(s.v, 0.0)"),
    ):
        sql = f"WITH RECURSIVE s AS ({events('click', HOUR, start - 7 * 86400, FEBRUARY)}), {smoothing(value)} SELECT name, ts, round(v + 1e-9, 6) + 0.0 AS v FROM ({body})"
        points(key, f"{key}({CLICK})", sql, start, FEBRUARY, 1e-9)


for _add in (_elementwise, _aggregates, _groups, _pairs, _windows, _filters, _sorts, _names, _shifts, _numeric):
    _add()
