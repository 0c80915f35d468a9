"""Functions that order lists and take the first series; ties keep the list's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList, by_number, by_text, first, reordered
from seriesloom.plans.registry import function



def top(s: SeriesList, n: int, *parts: Column) -> SeriesList:
    """The first n in an order; a distributed top-n."""
    return s.having(first(reordered(s.df, *parts), n))


@function("highestAverage", "highestCurrent", "highestMax", args="seriesList, n=1", group="Filter Series")
def highest(c: Context, e: Expr) -> SeriesList:
    """The n series with the largest figure, largest first. Series without values don't count; a
    list of fewer than n series stays as it is."""
    n = e.integer(1, 1, name="n")
    figure = {"highestAverage": frame.mean, "highestCurrent": frame.last, "highestMax": F.array_max}[e.target](F.col("values"))
    return _best(c.series(e.args[0]), n, figure, True)


def _best(s: SeriesList, n: int, figure: Column, highest: bool) -> SeriesList:
    df = frame.counted(s.df).withColumn("_figure", figure)
    few = F.col("_count") < n
    kept = df.filter(few | F.col("_figure").isNotNull()) if highest else df
    return s.having(first(reordered(kept, by_number(F.when(~few, F.col("_figure")), highest)), n))


@function("lowestAverage", "lowestCurrent", args="seriesList, n=1", group="Filter Series")
def lowest(c: Context, e: Expr) -> SeriesList:
    """The n series with the smallest figure, smallest first."""
    n = e.integer(1, 1, name="n")
    figure = frame.mean(F.col("values")) if e.target == "lowestAverage" else frame.last(F.col("values"))
    return _best(c.series(e.args[0]), n, figure, False)


@function("mostDeviant", args="seriesList, n", group="Filter Series")
def most_deviant(c: Context, e: Expr) -> SeriesList:
    """The n series with the largest variance; the arguments may be swapped."""
    swapped = e.args[0].kind == "const"
    n = e.integer(0 if swapped else 1)
    s = c.series(e.args[1 if swapped else 0])
    return top(s.filter(F.exists(F.col("values"), lambda v: v.isNotNull())), n, by_number(frame.variance(F.col("values")), True))


@function("limit", args="seriesList, n", group="Filter Series")
def limit(c: Context, e: Expr) -> SeriesList:
    """The first n series."""
    s = c.series(e.args[0])
    return s.having(first(s.df, e.integer(1, name="n")))


@function("sortByMaxima", "sortByMinima", "sortByTotal", args="seriesList", group="Sorting")
def sort_by(c: Context, e: Expr) -> SeriesList:
    """Descending by the largest value, by 1 / the smallest, or by the sum; absent points are 0."""
    zeroed = F.transform(F.col("values"), lambda v: F.coalesce(v, F.lit(0.0)))
    low = F.array_min(zeroed)
    figure = {"sortByMaxima": F.array_max(zeroed), "sortByMinima": F.when(low == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), low)), "sortByTotal": frame.total(zeroed)}[e.target]
    s = c.series(e.args[0])
    return s.having(reordered(s.df, by_number(figure, True)))


@function("sortByName", args="seriesList, natural=False", group="Sorting")
def sort_by_name(c: Context, e: Expr) -> SeriesList:
    """By name; in natural order numbers count by their value."""
    s = c.series(e.args[0])
    key = F.col("name")
    if e.boolean(1, name="natural"):
        runs = F.regexp_extract_all("name", F.lit(r"(\d+|\D+)"), F.lit(1))
        key = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 10, "0")).otherwise(x)), "")
    return s.having(reordered(s.df, by_text(key)))


@function("tukeyAbove", "tukeyBelow", args="seriesList, basis, n, interval=0", group="Filter Series")
def tukey(c: Context, e: Expr) -> SeriesList:
    """The n series with the most points beyond the quartiles of all points of the list by ``basis``
    times their distance. A positive interval looks at the last points, a negative one at all others."""
    basis, n = e.number(1), e.integer(2)
    if basis <= 0 or n < 1:
        raise ParseError("basis and n must be positive")
    s = c.series(e.args[0])
    size = F.size(F.col("values"))
    points = F.lit(0)
    if len(e.args) > 3:
        points = F.lit(e.integer(3)) if e.args[3].kind == "const" else (F.lit(e.interval(3, 1)) / F.col("step")).cast("int")
    start = F.when((points > 0) & (points < size), size - points).otherwise(0)
    stop = F.when((points < 0) & (-points < size), size + points).otherwise(size)
    df = s.df.withColumn("_seen", frame.present(F.slice(F.col("values"), (start + 1).cast("int"), (stop - start).cast("int"))))
    pooled = df.select(F.explode("_seen").alias("v"))
    count = pooled.count()  # this and the two quartiles are all that the plan needs
    if not count:
        return s.filter(F.lit(False))
    # The value at a place, from 0: the first whose share of values up to it reaches (place + 1/2) / count.
    shares = [(int(q * count) + 0.5) / count for q in (0.25, 0.75)]
    low, high = pooled.agg(*[F.expr(f"percentile_disc({x!r}D) WITHIN GROUP (ORDER BY v)") for x in shares]).first()
    above = e.target == "tukeyAbove"
    edge = high + basis * (high - low) if above else low - basis * (high - low)
    beyond = F.size(F.filter("_seen", lambda v: v >= edge if above else v <= edge))
    marked = df.withColumn("_beyond", beyond).filter("_beyond > 0")
    return s.having(first(reordered(marked, by_number(F.col("_beyond"), True)), n))
