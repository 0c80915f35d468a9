"""Functions over groups of series, and functions that take functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError, parse
from seriesloom.operators.aggregate import NAMES, REDUCERS
from seriesloom.operators.naming import metric
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context, concatenated
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import FUNCTIONS, function


def node_key(places: list[int]) -> Column:
    parts = F.split(metric(F.col("name")), "[.]")
    return F.array_join(F.array(*[F.get(parts, F.lit(k)) for k in places]), ".")


@function("groupByNode", "groupByNodes", args="seriesList, nodeNum, callback='average' (groupByNodes: callback, *nodes)", group="Combine")
def group_by_node(c: Context, e: Expr) -> SeriesList:
    """Groups by nodes of the name, and one series for each group by a function of lists. Functions
    that reduce a list become one aggregate; for others the groups' keys are read and each group is
    planned by itself, its first series named after the key."""
    if e.target == "groupByNode":
        places, callback = [e.integer(1)], e.string(2, "average", name="callback")
    else:
        callback, places = e.string(1), e.integers(2)
    if any(k < 0 for k in places):
        raise ParseError("nodes count from 0")
    s = c.series(e.args[0])
    if callback in NAMES:
        return frame.reduced(s, REDUCERS[NAMES[callback][0]](), node_key(places), lambda k: k)
    if callback not in FUNCTIONS:
        raise ParseError(f"unknown function {callback}")
    keyed = s.df.withColumn("key", node_key(places))
    keys = [r["key"] for r in keyed.groupBy("key").agg(F.min("ord").alias("ord")).orderBy("ord").collect()]
    out = []
    for key in keys:
        inner = _Fixed(c, s.having(keyed.filter(F.col("key") == key)))
        found = FUNCTIONS[callback].build(inner, Expr("func", target=callback, args=[Expr("name", target="group")], raw="group"))
        head = found.df.agg(F.min("ord")["id"].alias("first"))
        named = found.df.crossJoin(F.broadcast(head)).withColumn("name", F.when(F.col("ord.id") == F.col("first"), F.lit(key)).otherwise(F.col("name")))
        out.append(found.having(named))
    return concatenated(out) if out else c.empty()


class _Fixed(Context):
    """A context in which every name stands for one list."""

    def __init__(self, c: Context, s: SeriesList):
        super().__init__(c.store, c.start, c.stop)
        object.__setattr__(self, "fixed", s)

    def series(self, e: Expr) -> SeriesList:
        return self.fixed if e.kind == "name" else super().series(e)


@function("applyByNode", args="seriesList, nodeNum, templateFunction, newName=None", group="Combine")
def apply_by_node(c: Context, e: Expr) -> SeriesList:
    """For each series the template with % replaced by its first nodes, evaluated anew. The names
    are read when planning; each gives a part of the plan."""
    place, template, new = e.integer(1), e.string(2), e.string(3, "", name="newName")
    df = c.series(e.args[0]).df
    rows = df.select("ord", F.array_join(F.slice(F.split("name", "[.]"), 1, place + 1), ".").alias("prefix")).orderBy("ord").collect()
    out = []
    for row in rows:
        found = c.series(parse(template.replace("%", row["prefix"])))
        out.append(found.named(F.lit(new.replace("%", row["prefix"]))) if new else found)
    return concatenated(out) if out else c.empty()


@function("mapSeries", "map", args="seriesList, *mapNodes", group="Combine")
def map_series(c: Context, e: Expr) -> SeriesList:
    """The same series, those with equal nodes next to each other."""
    s = c.series(e.args[0])
    df = s.df.withColumn("key", node_key(e.integers(1)))
    first = df.groupBy("key").agg(F.min("ord").alias("first"))
    together = F.struct(F.concat(F.col("first.key"), F.array(frame.by_text(F.col("first.id"))), F.col("ord.key"), F.array(frame.by_text(F.col("ord.id")))).alias("key"), F.col("ord.id").alias("id"))
    return s.having(df.join(first, "key").withColumn("ord", together))


@function("reduceSeries", "reduce", args="seriesLists, reduceFunction, reduceNode, *reduceMatchers", group="Combine")
def reduce_series(c: Context, e: Expr) -> SeriesList:
    """Groups of series that differ at one node: the function of those that have the matchers' values
    there, in their order, named with the node replaced. Groups without a value of each are skipped."""
    name, place, wanted = e.string(1), e.integer(2), [a.text for a in e.args[3:]]
    if name not in FUNCTIONS:
        raise ParseError(f"unknown function {name}")
    s = c.series(e.args[0])
    parts = F.split(F.col("name"), "[.]")
    key = F.array_join(F.transform(parts, lambda x, i: F.when(i == place, F.lit(f"reduce.{name}")).otherwise(x)), ".")
    df = s.df.withColumns({"key": key, "node": F.get(parts, F.lit(place))})
    whole = df.filter(F.col("node").isin(wanted)).groupBy("key").agg(F.min("ord").alias("first"), F.count_distinct("node").alias("n")).filter(F.col("n") == len(wanted))
    lists = {}
    for w in wanted:
        own = frame.last_of_each(df.filter(F.col("node") == w))
        lists[w] = s.having(own.join(whole, "key").withColumns({"name": F.col("key"), "ord": F.struct(F.col("first.key").alias("key"), F.col("key").alias("id"))}))
    build = PAIRWISE.get(name)
    if build is None or len(wanted) != 2:
        kind = NAMES.get(name)
        if kind is None:
            raise ParseError(f"{name} cannot reduce {len(wanted)} series")
        # Members of a group in the matchers' order, next to each other.
        members = [lists[w].with_(ord=frame.behind(F.col("ord"), k)) for k, w in enumerate(wanted)]
        members = SeriesList(reduce(DataFrame.unionByName, [m.df for m in members]), frozenset().union(*(m.steps for m in members)))
        return frame.reduced(members, REDUCERS[kind[0]](), F.col("name"), lambda k: k)
    return build(lists[wanted[0]], lists[wanted[1]]).named(F.col("name"))


#: Functions of two series that reduceSeries joins by group; filled by the pairs module.
PAIRWISE: dict = {}


@function("group", args="*seriesLists", group="Combine")
def group(c: Context, e: Expr) -> SeriesList:
    """The lists one after the other."""
    return c.all(e.args)


@function("fallbackSeries", args="seriesList, fallback", group="Special")
def fallback(c: Context, e: Expr) -> SeriesList:
    """The first list if it has series, else the second."""
    a, b = c.series(e.args[0]), c.series(e.args[1])
    other = frame_without(b, a)
    return concatenated([a, other])


def frame_without(b: SeriesList, a: SeriesList) -> SeriesList:
    """b, or nothing if a has rows."""
    flag = a.df.limit(1).select(F.lit(1).alias("_one"))
    return b.having(b.df.withColumn("_one", F.lit(1)).join(F.broadcast(flag), "_one", "left_anti"))
