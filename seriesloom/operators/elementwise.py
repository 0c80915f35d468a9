"""Functions of each value. All are narrow array expressions; absent stays absent unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError, number_text
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function



def wrapped(head: str, tail: str = "") -> Column:
    return F.concat(F.lit(f"{head}("), F.col("name"), F.lit(f"{tail})"))


@function("absolute", args="seriesList", group="Transform")
def absolute(c: Context, e: Expr) -> SeriesList:
    """The absolute value."""
    return c.series(e.args[0]).map(F.abs).named(wrapped("absolute"))


@function("scale", args="seriesList, factor", group="Transform")
def scale(c: Context, e: Expr) -> SeriesList:
    """Times a factor."""
    n = e.number(1, name="factor")
    return c.series(e.args[0]).map(lambda v: v * n).named(wrapped("scale", f",{number_text(n)}"))


@function("scaleToSeconds", args="seriesList, seconds", group="Transform")
def scale_to_seconds(c: Context, e: Expr) -> SeriesList:
    """The value per so many seconds."""
    n = e.number(1, name="seconds")
    return c.series(e.args[0]).map(lambda v: v * n / F.col("step").cast("double")).named(wrapped("scaleToSeconds", f",{int(n)}"))


@function("offset", args="seriesList, factor", group="Transform")
def offset(c: Context, e: Expr) -> SeriesList:
    """Plus a number."""
    n = e.number(1, name="factor")
    return c.series(e.args[0]).map(lambda v: v + n).named(wrapped("offset", f",{number_text(n)}"))


@function("offsetToZero", args="seriesList", group="Transform")
def offset_to_zero(c: Context, e: Expr) -> SeriesList:
    """Less the smallest value of the series."""
    values = frame.let(F.array_min(F.col("values")), lambda low: F.transform(F.col("values"), lambda v: v - low))
    return c.series(e.args[0]).with_(values=values, name=wrapped("offsetToZero"))


@function("invert", args="seriesList", group="Transform")
def invert(c: Context, e: Expr) -> SeriesList:
    """One divided by the value; absent for zero."""
    return c.series(e.args[0]).map(lambda v: F.try_divide(F.lit(1.0), v)).named(wrapped("invert"))


@function("pow", args="seriesList, factor", group="Transform")
def power(c: Context, e: Expr) -> SeriesList:
    """To a power."""
    n = e.number(1, name="factor")
    return c.series(e.args[0]).map(lambda v: F.pow(v, F.lit(n))).named(wrapped("pow", f",{number_text(n)}"))


@function("squareRoot", args="seriesList", group="Transform")
def square_root(c: Context, e: Expr) -> SeriesList:
    """The square root; NaN below zero."""
    return c.series(e.args[0]).map(F.sqrt).named(wrapped("squareRoot"))


@function("logarithm", "log", args="seriesList, base=10", group="Transform")
def logarithm(c: Context, e: Expr) -> SeriesList:
    """The logarithm; absent where there is none."""
    base = e.integer(1, 10, name="base")
    given = e.has(1, "base")
    return c.series(e.args[0]).map(lambda v: F.ln(v) / F.ln(F.lit(float(base)))).named(wrapped("logarithm", f",{base}" if given else ""))


@function("isNotNull", "isNonNull", args="seriesList", group="Transform")
def is_not_null(c: Context, e: Expr) -> SeriesList:
    """1 for a value, 0 for an absent point."""
    return c.series(e.args[0]).map(lambda v: F.when(v.isNotNull(), 1.0).otherwise(0.0)).named(wrapped("isNonNull"))


@function("transformNull", args="seriesList, default=0", group="Transform")
def transform_null(c: Context, e: Expr) -> SeriesList:
    """A default for absent points."""
    n = e.number(1, 0.0, name="default")
    given = e.has(1, "default")
    return c.series(e.args[0]).map(lambda v: F.coalesce(v, F.lit(n))).named(wrapped("transformNull", f",{number_text(n)}" if given else ""))


@function("removeBelowValue", "removeAboveValue", "removeBelowPercentile", "removeAbovePercentile", args="seriesList, n", group="Filter Data")
def remove(c: Context, e: Expr) -> SeriesList:
    """Values beyond a threshold, or beyond a percentile of the series, become absent."""
    n = e.number(1, name="n")
    limit = frame.percentile(F.col("values"), n, True) if e.target.endswith("Percentile") else F.lit(n)
    above = "Above" in e.target

    def cut(at: Column) -> Column:
        return F.transform(F.col("values"), lambda v: F.when(v <= at if above else v >= at, v))

    return c.series(e.args[0]).with_(values=frame.let(limit, cut), name=wrapped(e.target, f", {number_text(n)}"))


@function("nPercentile", args="seriesList, n", group="Calculate")
def n_percentile(c: Context, e: Expr) -> SeriesList:
    """A line at the series' percentile."""
    n = e.number(1, name="n")
    values = frame.let(frame.percentile(F.col("values"), n, True), lambda p: F.transform(F.col("values"), lambda v: p))
    return c.series(e.args[0]).with_(values=values, name=wrapped("nPercentile", f",{number_text(n)}"))


@function("lowPass", "lpf", args="seriesList, cutPercent", group="Transform")
def low_pass(c: Context, e: Expr) -> SeriesList:
    """Keeps the outer places of a transformed series, which hold its low frequencies."""
    n = e.number(1)
    low = F.floor(F.size(F.col("values")) * F.lit(n / 200.0)).cast("int")
    high = F.floor(F.size(F.col("values")) * F.lit(1 - n / 200.0)).cast("int")
    values = F.transform(F.col("values"), lambda v, i: F.when((i < low) | (i >= high), v))
    return c.series(e.args[0]).with_(values=values, name=wrapped("lowPass", f",{number_text(n)}"))


@function("linearRegression", args="seriesList, startSourceAt=None, endSourceAt=None", group="Calculate")
def linear_regression(c: Context, e: Expr) -> SeriesList:
    """The least-squares line over the slots with a value. The source range only shows in the name."""
    held = F.filter(F.transform(F.col("values"), lambda v, i: F.struct(v.alias("v"), i.cast("double").alias("i"))), lambda p: p["v"].isNotNull())

    def line(p: Column) -> Column:
        n = F.size(p).cast("double")
        sums = F.aggregate(
            p,
            F.array(*[F.lit(0.0)] * 4),
            lambda a, x: F.array(F.get(a, F.lit(0)) + x["i"], F.get(a, F.lit(1)) + x["v"], F.get(a, F.lit(2)) + x["i"] * x["i"], F.get(a, F.lit(3)) + x["i"] * x["v"]),
        )

        def fitted(s: Column) -> Column:
            si, sv, sii, siv = (F.get(s, F.lit(k)) for k in range(4))
            slope = F.try_divide(n * siv - si * sv, n * sii - si * si)
            return F.transform(F.col("values"), lambda v, i: (sv - slope * si) / n + slope * i)

        return F.when(n >= 2, frame.let(sums, fitted)).otherwise(F.transform(F.col("values"), lambda v: F.lit(None).cast("double")))

    tail = "".join(f",'{a.text}'" for a in e.args[1:])
    return c.series(e.args[0]).with_(values=frame.let(held, line), name=wrapped("linearRegression", tail))


@function("legendValue", args="seriesList, *valueTypes", group="Alias")
def legend_value(c: Context, e: Expr) -> SeriesList:
    """Adds figures of the series to its name; absent points count as 0."""
    kinds = [a.text for a in e.args[1:]]
    system = kinds.pop() if kinds and kinds[-1] in ("si", "binary") else ""
    zeroed = F.transform(F.col("values"), lambda v: F.coalesce(v, F.lit(0.0)))
    figures = {"avg": frame.mean(zeroed), "average": frame.mean(zeroed), "total": frame.total(zeroed), "sum": frame.total(zeroed), "min": F.array_min(zeroed), "max": F.array_max(zeroed), "last": F.get(zeroed, F.size(zeroed) - 1)}
    parts: list[Column] = []
    for kind in kinds:
        if kind not in figures:
            raise ParseError(f"unknown figure {kind}")
        parts.append(F.concat(F.lit(f" ({kind}: "), unit_text(figures[kind], system) if system else F.format_string("%f", figures[kind]), F.lit(")")))
    return c.series(e.args[0]).named(F.concat(F.col("name"), *parts))


def unit_text(value: Column, system: str) -> Column:
    """A number with the largest prefix of a system of units that leaves it at 1 or more."""
    base, names = (1024.0, ["", "Ki", "Mi", "Gi", "Ti", "Pi"]) if system == "binary" else (1000.0, ["", "k", "M", "G", "T", "P"])
    out = F.format_string("%.2f", value)
    for k in range(1, len(names)):
        out = F.when(F.abs(value) >= base**k, F.format_string(f"%.2f{names[k]}", value / base**k)).otherwise(out)
    return out


@function("cactiStyle", args="seriesList, system=None, units=None", group="Special")
def cacti_style(c: Context, e: Expr) -> SeriesList:
    """Adds the current, largest and smallest value to the name."""
    system, unit = e.string(1, "", name="system"), e.string(2, "", name="units")

    def text(value: Column) -> Column:
        shown = unit_text(value, system) if system else F.format_string("%.0f", value)
        return F.coalesce(F.concat(shown, F.lit(f" {unit}" if unit else "")), F.lit("NaN"))

    return c.series(e.args[0]).named(F.concat(F.col("name"), F.lit(" Current: "), text(frame.last(F.col("values"))), F.lit(" Max: "), text(F.array_max(F.col("values"))), F.lit(" Min: "), text(F.array_min(F.col("values")))))
