"""Functions from many series to one, slot by slot. Absent values are skipped unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function



def slot_percentile(n: float, interpolate: bool) -> Column:
    if not 0 <= n <= 100:
        return F.max(F.lit(None).cast("double"))
    if interpolate:
        return F.percentile(F.col("v"), F.lit(n / 100.0))
    return frame.let(F.sort_array(F.collect_list(F.col("v"))), lambda s: F.get(s, F.ceil((F.size(s) - 1) * F.lit(n) / 100.0).cast("int")))


def strict_product() -> Column:
    return F.when(F.count(F.col("v")) == F.first("n"), F.product(F.col("v")))


#: Aggregates by the function that callbacks and wildcards name.
REDUCERS = {
    "sum": lambda: F.sum(F.col("v")),
    "average": lambda: F.avg(F.col("v")),
    "min": lambda: F.min(F.col("v")),
    "max": lambda: F.max(F.col("v")),
    "median": lambda: slot_percentile(50, True),
    "stddev": lambda: F.stddev_pop(F.col("v")),
    "diff": lambda: F.when(F.count(F.when(F.col("id") == F.col("first"), F.col("v"))) > 0, F.sum(F.when(F.col("id") == F.col("first"), F.col("v")).otherwise(-F.col("v")))),
    "multiply": strict_product,
    "range": lambda: F.when(F.count(F.col("v")) >= 2, F.max(F.col("v")) - F.min(F.col("v"))),
    "count": lambda: F.first("n").cast("double"),
}
#: Names of functions that reduce a list, with the kind of reduction and the name of the result.
NAMES = {
    "sum": ("sum", "sumSeries"), "sumSeries": ("sum", "sumSeries"),
    "avg": ("average", "averageSeries"), "average": ("average", "averageSeries"), "averageSeries": ("average", "averageSeries"),
    "min": ("min", "min"), "minSeries": ("min", "minSeries"), "max": ("max", "max"), "maxSeries": ("max", "maxSeries"),
    "median": ("median", "medianSeries"), "medianSeries": ("median", "medianSeries"),
    "stddev": ("stddev", "stddevSeries"), "stddevSeries": ("stddev", "stddevSeries"),
    "diff": ("diff", "diffSeries"), "diffSeries": ("diff", "diffSeries"),
    "multiplySeries": ("multiply", "multiplySeries"),
    "rangeOfSeries": ("range", "rangeOfSeries"),
    "countSeries": ("count", "countSeries"),
}


@function(*NAMES, args="*seriesLists", group="Combine")
def reduce_list(c: Context, e: Expr) -> SeriesList:
    """One value for each slot of all series. multiplySeries is absent where any series is,
    diffSeries where the first is, rangeOfSeries where fewer than two have a value."""
    kind, name = NAMES[e.target]
    return frame.reduced(c.all(e.args), REDUCERS[kind](), None, lambda _: F.lit(f"{name}({e.raw})"))


@function("percentileOfSeries", args="seriesList, n, interpolate=False", group="Combine")
def percentile_of_series(c: Context, e: Expr) -> SeriesList:
    """A percentile over the values of each slot."""
    n = e.number(1, name="n")
    return frame.reduced(c.series(e.args[0]), slot_percentile(n, e.boolean(2, name="interpolate")), None, lambda _: F.lit(f"percentileOfSeries({e.raw})"))


@function("sumSeriesWithWildcards", "averageSeriesWithWildcards", "multiplySeriesWithWildcards", args="seriesList, *position", group="Combine")
def with_wildcards(c: Context, e: Expr) -> SeriesList:
    """Groups by the name without some nodes and reduces each group; absent values are skipped."""
    gone = [F.lit(k) for k in e.integers(1)]
    key = F.array_join(F.filter(F.split("name", "[.]"), lambda x, i: ~F.array_contains(F.array(*gone), i) if gone else F.lit(True)), ".")
    reducer = {"sum": F.sum(F.col("v")), "average": F.avg(F.col("v")), "multiply": F.product(F.col("v"))}[e.target.removesuffix("SeriesWithWildcards")]
    return frame.reduced(c.series(e.args[0]), reducer, key, lambda k: F.concat(F.lit(f"{e.target}("), k, F.lit(")")))
