"""Series as rows: the algebra that functions are made of.

A series is a row ``ord, name, start, stop, step, values, agg, graph``: values are regularly sampled
from ``start`` (epoch seconds) every ``step`` seconds, a null element is an absent point, ``agg`` is
the consolidation function and ``graph`` a map of drawing hints. Functions of one series are narrow
array expressions; functions across series go through points (``id, i, v``), so that Spark's
partial aggregation does the work before the shuffle.

``ord`` is made from data alone, never from how rows lie in partitions: ``key`` holds what the list is
ordered by, part after part, and ``id`` names the series within its list. Branches of a plan agree on
the id; only it is joined on. Places 0, 1, ... are counted where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORD = "struct<key:array<struct<n:double,s:string>>,id:string>"
SCHEMA = f"ord {ORD}, name string, start long, stop long, step long, values array<double>, agg string, graph map<string,string>"
COLUMNS = ["ord", "name", "start", "stop", "step", "values", "agg", "graph"]


@dataclass(frozen=True)
class SeriesList:
    """An ordered list of series. steps: the sample steps that can occur, known when planning."""

    df: DataFrame
    steps: frozenset[int]

    def having(self, df: DataFrame, steps: frozenset[int] | None = None) -> SeriesList:
        return replace(self, df=df.select(COLUMNS), steps=self.steps if steps is None else steps)

    def with_(self, **columns: Column) -> SeriesList:
        return self.having(put(self.df, columns))

    def named(self, name: Column) -> SeriesList:
        return self.with_(name=name)

    def map(self, f: Callable[[Column], Column]) -> SeriesList:
        """f of each element, absent ones included."""
        return self.with_(values=F.transform("values", f))

    def filter(self, condition: Column) -> SeriesList:
        return self.having(self.df.filter(condition))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns set, values first: a lambda over values would else see the new start or step."""
    first = {k: c for k, c in columns.items() if k == "values"}
    rest = {k: c for k, c in columns.items() if k != "values"}
    return (df.withColumns(first) if first else df).withColumns(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(present(values), F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    """Null if nothing is present."""
    return let(present(values), lambda p: F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), F.size(p).cast("double")))


def last(values: Column) -> Column:
    return let(present(values), lambda p: F.get(p, F.size(p) - 1))


def variance(values: Column) -> Column:
    return let(present(values), lambda p: let(mean(p), lambda m: F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(p).cast("double"))))


def percentile(values: Column, n: float, interpolate: bool) -> Column:
    """Of the present values; without interpolation the value at or above the place."""
    if not 0 <= n <= 100:
        return F.lit(None).cast("double")

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(n) / 100.0
        if not interpolate:
            return F.get(s, F.ceil(place).cast("int"))
        low = F.floor(place).cast("int")
        return F.get(s, low) + (place - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low))

    return let(F.sort_array(present(values)), at)


def aggregated(values: Column, agg: Column) -> Column:
    """A window of values by the consolidation function that a column names (mean by default)."""
    p = present(values)
    return (
        F.when(agg == "sum", F.when(F.size(p) > 0, total(values)))
        .when(agg == "max", F.array_max(values))
        .when(agg == "min", F.array_min(values))
        .when(agg == "first", F.get(p, F.lit(0)))
        .when(agg == "last", last(values))
        .otherwise(mean(values))
    )


def chunked(values: Column, k: Column) -> Column:
    """The array cut into arrays of k elements; the last may be shorter."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / k).cast("int")), lambda j: F.slice(values, (j * k).cast("int") + 1, k.cast("int")))).otherwise(F.array().cast("array<array<double>>"))


def consolidated(s: SeriesList, k: Column, step: Column) -> SeriesList:
    """Each k values as one, by index from the series' start; ``stop`` stays."""
    values = F.when(k > 1, F.transform(chunked(F.col("values"), k), lambda w: aggregated(w, F.col("agg")))).otherwise(F.col("values"))
    return s.having(put(s.df, {"values": values, "step": step}))


def normalized(s: SeriesList) -> SeriesList:
    """All series of a list at the least common multiple of their steps; ends cut to whole buckets."""
    if len(s.steps) <= 1:
        return s
    step = lcm(*s.steps)
    out = consolidated(s, F.lit(step) / F.col("step"), F.lit(step).cast("long"))
    size = F.floor((F.col("stop") - F.col("start")) / F.lit(step)).cast("int")
    return out.having(put(out.df, {"values": F.slice("values", 1, F.least(size, F.size("values"))), "stop": F.col("stop") - (F.col("stop") - F.col("start")) % step}), frozenset({step}))


def points(df: DataFrame, *keep: str) -> DataFrame:
    """The columns kept with i and v of each slot. (An outer generator, because the optimiser would
    evaluate an inner one's array twice: once to see that it is not empty.)"""
    return df.select(*keep, F.posexplode_outer("values").alias("i", "v")).filter(F.col("i").isNotNull())


def folded(points_: DataFrame, key: str, value: str = "v") -> DataFrame:
    """key and values: points gathered to arrays in order of i."""
    return points_.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col(value).alias("v")))), lambda p: p["v"]).alias("values"))


def reduced(s: SeriesList, reducer: Column, key: Column | None, name: Callable[[Column], Column]) -> SeriesList:
    """One series for each key (or one for all): ``reducer`` is an aggregate over a slot of the
    columns v, id (of the series), first (id of the group's first series) and n (its number of
    series). Groups keep the order of their first series."""
    s = normalized(s)
    df = s.df.withColumn("key", F.lit("") if key is None else key)
    head = df.groupBy("key").agg(
        F.min("ord").alias("ord"), F.min_by("start", "ord").alias("start"), F.min_by("stop", "ord").alias("stop"), F.min_by("step", "ord").alias("step"),
        F.min_by("agg", "ord").alias("agg"), F.count("*").alias("n"),
    )
    groups = head.select("key", F.col("ord.id").alias("first"), "n")
    slots = points(df.withColumn("id", F.col("ord.id")), "key", "id").join(F.broadcast(groups) if key is None else groups, "key")
    values = folded(slots.groupBy("key", "i").agg(reducer.alias("v")), "key")
    order = F.struct(F.col("ord.key").alias("key"), F.concat(F.lit("of/"), F.coalesce("key", F.lit(""))).alias("id"))
    out = head.join(values, "key").withColumn("ord", order).withColumn("name", name(F.col("key"))).withColumn("graph", F.lit(None).cast("map<string,string>"))
    return s.having(out)


def combined(both: DataFrame, f: Callable[[Column, Column], Column], name: Column) -> DataFrame:
    """Rows with a series and, as b_name, b_values, ..., another, slot by slot; absent where one is.
    Steps must agree (see ``aligned``)."""
    values = F.zip_with("values", "b_values", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), f(x, y)))
    return both.withColumns({"values": values, "name": name, "start": F.least("start", "b_start"), "stop": F.greatest("stop", "b_stop")})


def others(df: DataFrame, *on: str) -> DataFrame:
    """The columns of a series as b_name, b_values, ... beside those to join on."""
    return df.select(*on, *[F.col(c).alias(f"b_{c}") for c in PLAIN])


def with_one(a: DataFrame, b: SeriesList, what: str) -> DataFrame:
    """Each series of a with the only series of b."""
    return a.crossJoin(F.broadcast(one(b, what))).select(*COLUMNS, *[F.col(f"b.{c}").alias(f"b_{c}") for c in PLAIN])


def aligned(a: SeriesList, b: SeriesList) -> tuple[SeriesList, SeriesList]:
    """Two lists at one step; partial last buckets stay."""
    steps = a.steps | b.steps
    if len(steps) <= 1:
        return a, b
    step = lcm(*steps)
    ratio = F.lit(step) / F.col("step")
    one = frozenset({step})
    x, y = (consolidated(s, ratio, F.lit(step).cast("long")) for s in (a, b))
    return x.having(x.df, one), y.having(y.df, one)


def by_numpy(s: SeriesList, f: Callable[[np.ndarray, dict], np.ndarray], more: DataFrame | None = None) -> SeriesList:
    """f of the values of each series (NaN where absent) and its row (start, step and what ``more``
    has, b_values as values) gives its new values. Series go through numpy in Arrow batches; columns
    but the values stay Arrow's."""
    df = s.df if more is None else more
    extra = [c for c in df.columns if c not in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            told = {c: floats(column[c]) if c == "b_values" else column[c].to_pylist() for c in ("start", "step", *extra)}
            made = [f(v, {c: x[k] for c, x in told.items()}) for k, v in enumerate(floats(column["values"]))]
            flat = np.concatenate([np.zeros(0), *made])
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([values if c == "values" else column[c] for c in COLUMNS], names=COLUMNS)

    return s.having(df.select(*COLUMNS, *extra).mapInArrow(run, SCHEMA))


def floats(lists: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, NaN for null elements."""
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.split(flat, offsets[1:-1] - offsets[0]) if len(lists) else []


def by_number(value: Column, descending: bool = False) -> Column:
    """A part of an order: numbers, null last."""
    n = value.cast("double")
    return F.struct(F.coalesce(-n if descending else n, F.lit(float("inf"))).alias("n"), F.lit(None).cast("string").alias("s"))


def by_text(value: Column) -> Column:
    """A part of an order: strings."""
    return F.struct(F.lit(0.0).alias("n"), value.alias("s"))


def order(parts: list[Column], id_: Column) -> Column:
    return F.struct(F.array(*parts).alias("key"), id_.alias("id"))


def reordered(df: DataFrame, *parts: Column) -> DataFrame:
    """The order given, then that which was."""
    return df.withColumn("ord", F.struct(F.concat(F.array(*parts), F.col("ord.key"), F.array(by_text(F.col("ord.id")))).alias("key"), F.col("ord.id").alias("id")))


def under(k: int) -> Column:
    """The order in list k of several, one after the other."""
    return F.struct(F.concat(F.array(by_number(F.lit(k))), F.col("ord.key")).alias("key"), F.concat(F.lit(f"{k}/"), F.col("ord.id")).alias("id"))


def behind(first: Column, k: Column | int = 0) -> Column:
    """The order at the place of another series, the k-th there."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.struct(F.concat(first["key"], F.array(by_text(first["id"]), by_number(k))).alias("key"), F.concat(first["id"], F.lit("/"), k.cast("string")).alias("id"))


def positions(df: DataFrame) -> DataFrame:
    """id and position (0, 1, ...). Orders and ids, but no values, meet in one task."""
    return df.select(F.col("ord.id").alias("id"), "ord").withColumn("position", F.row_number().over(Window.orderBy("ord")).cast("long") - 1).drop("ord")


def placed(df: DataFrame) -> DataFrame:
    """The rows with their position."""
    return df.withColumn("id", F.col("ord.id")).join(positions(df), "id").drop("id")


def first(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a list."""
    return df.orderBy("ord").limit(n)


def last_of_each(df: DataFrame) -> DataFrame:
    """The last series of each key."""
    return df.groupBy("key").agg(F.max_by(F.struct(*df.columns), "ord").alias("row")).select("row.*")


#: Columns of a series that can be compared, and so sorted in an array.
PLAIN = [c for c in COLUMNS if c != "graph"]


def one(s: SeriesList, what: str) -> DataFrame:
    """A row with the struct ``b`` of the list's only series, or none if it has none; more are an error."""
    held = s.df.limit(2).agg(F.collect_list(F.struct(*PLAIN)).alias("b"))
    many = F.raise_error(F.lit(f"{what} takes a single series here, not a list"))
    return held.select(F.when(F.size("b") > 1, many).otherwise(F.get("b", F.lit(0))).alias("b")).filter(F.col("b").isNotNull())


def first_two(s: SeriesList) -> DataFrame:
    """A row with the list's first series and, as b_name, b_values, ..., the second; none if it has
    fewer than two."""
    held = s.df.select(*PLAIN).orderBy("ord").limit(2).agg(F.sort_array(F.collect_list(F.struct(*PLAIN))).alias("p")).filter(F.size("p") == 2)
    a, b = (F.get("p", F.lit(k)) for k in (0, 1))
    return held.select(*[a[c].alias(c) for c in PLAIN], F.lit(None).cast("map<string,string>").alias("graph"), *[b[c].alias(f"b_{c}") for c in PLAIN])


def counted(df: DataFrame) -> DataFrame:
    """The rows with their number in ``_count``, by one aggregate of one row."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("_count"))))
