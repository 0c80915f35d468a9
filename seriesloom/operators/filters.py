"""Functions that keep or drop whole series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function

SUMMARIES = {"average": frame.mean, "current": frame.last, "maximum": F.array_max, "minimum": F.array_min}


@function("averageAbove", "averageBelow", "currentAbove", "currentBelow", "maximumAbove", "maximumBelow", "minimumAbove", "minimumBelow", args="seriesList, n", group="Filter Series")
def by_summary(c: Context, e: Expr) -> SeriesList:
    """Series whose average, last, largest or smallest value is above or below n. Above includes n
    for average and current, below always; series without values go."""
    n, kind = e.number(1, name="n"), e.target[:7]
    figure = SUMMARIES[kind](F.col("values"))
    if e.target.endswith("Below"):
        return c.series(e.args[0]).filter(figure <= n)
    return c.series(e.args[0]).filter(figure >= n if kind in ("average", "current") else figure > n)


@function("filterSeries", args="seriesList, func, operator, threshold", group="Filter Series")
def filter_series(c: Context, e: Expr) -> SeriesList:
    """Series whose figure compares as told with a threshold; ``last`` is the last slot."""
    figures = {"max": F.array_max(F.col("values")), "min": F.array_min(F.col("values")), "sum": frame.total(F.col("values")), "average": frame.mean(F.col("values")), "last": F.get(F.col("values"), F.size(F.col("values")) - 1)}
    kind, operator, n = e.string(1, name="func"), e.string(2, name="operator"), e.number(3, name="threshold")
    if kind not in figures:
        raise ParseError(f"unknown figure {kind}")
    x = figures[kind]
    tests: dict[str, Column] = {"=": x == n, "!=": x != n, ">": x > n, ">=": x >= n, "<": x < n, "<=": x <= n}
    if operator not in tests:
        raise ParseError(f"unknown operator {operator}")
    return c.series(e.args[0]).filter(tests[operator])


@function("grep", args="seriesList, pattern", group="Filter Series")
def grep(c: Context, e: Expr) -> SeriesList:
    """Series whose name a regular expression finds."""
    return c.series(e.args[0]).filter(F.col("name").rlike(e.string(1)))


@function("exclude", args="seriesList, pattern", group="Filter Series")
def exclude(c: Context, e: Expr) -> SeriesList:
    """Series whose name a regular expression does not find."""
    return c.series(e.args[0]).filter(~F.col("name").rlike(e.string(1)))


@function("removeEmptySeries", "removeZeroSeries", args="seriesList, xFilesFactor=None", group="Filter Series")
def remove_empty(c: Context, e: Expr) -> SeriesList:
    """Series with a value; removeZeroSeries wants one that is not zero. The factor is ignored."""
    zero = e.target == "removeZeroSeries"
    return c.series(e.args[0]).filter(F.exists(F.col("values"), lambda v: v.isNotNull() & (v != 0) if zero else v.isNotNull()))
