"""Functions that move time, make series, or attach hints."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError, number_text
from seriesloom.operators.elementwise import wrapped
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context, concatenated
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function

KINDS = {"max": "max", "min": "min", "sum": "sum", "average": "average", "avg": "average", "first": "first", "last": "last"}


@function("consolidateBy", args="seriesList, consolidationFunc", group="Special")
def consolidate_by(c: Context, e: Expr) -> SeriesList:
    """Which figure stands for several points when there are too many; unknown names mean average."""
    return c.series(e.args[0]).with_(agg=F.lit(KINDS.get(e.string(1), "average")))


@function("cumulative", args="seriesList", group="Special")
def cumulative(c: Context, e: Expr) -> SeriesList:
    """consolidateBy sum."""
    return c.series(e.args[0]).with_(agg=F.lit("sum"))


def _shifted(c: Context, arg: Expr, by: int) -> SeriesList:
    s = c.shifted(by).series(arg)
    return s.with_(start=F.col("start") - by, stop=F.col("stop") - by)


@function("timeShift", args="seriesList, timeShift, resetEnd=True, alignDST=False", group="Transform")
def time_shift(c: Context, e: Expr) -> SeriesList:
    """The past (or, with a sign, the future) at the times asked for. Further arguments are ignored."""
    by = e.interval(1, -1)
    return _shifted(c, e.args[0], by).named(wrapped("timeShift", f",'{by}'"))


@function("timeStack", args="seriesList, timeShiftUnit='1d', timeShiftStart=0, timeShiftEnd=7", group="Transform")
def time_stack(c: Context, e: Expr) -> SeriesList:
    """Several shifts by multiples of a unit."""
    unit, start, stop = e.interval(1, -1), e.integer(2), e.integer(3)
    found = [_shifted(c, e.args[0], k * unit).named(wrapped("timeShift", f",{k * unit}")) for k in range(start, stop)]
    return concatenated(found) if found else c.empty()


def made(c: Context, name: str, start: int, stop: int, step: int, values: list[float]) -> SeriesList:
    return SeriesList(c.spark.createDataFrame([(([], name), name, start, stop, step, values, None, None)], frame.SCHEMA), frozenset({step}))


@function("constantLine", args="value", group="Special")
def constant_line(c: Context, e: Expr) -> SeriesList:
    """A line of three points over the range."""
    n, step = e.number(0), (c.stop - c.start) // 2
    return made(c, number_text(n), c.start, c.stop, step, [n] * 3)


@function("timeFunction", "time", args="name, step=60", group="Transform")
def time_function(c: Context, e: Expr) -> SeriesList:
    """The time itself."""
    step = e.integer(1, 60, name="step")
    if step <= 0:
        raise ParseError("step can't be less than 0")
    s = made(c, e.args[0].text or e.args[0].target, c.start, c.stop, step, [])
    return s.with_(values=F.transform(F.sequence(F.lit(c.start), F.lit(c.stop - 1), F.lit(step)), lambda t: t.cast("double")))


@function("randomWalk", "randomWalkFunction", args="name, step=60", group="Transform")
def random_walk(c: Context, e: Expr) -> SeriesList:
    """A walk of steps between -1/2 and 1/2 every second, the same for the same name and range. The
    step is ignored."""
    name = e.args[0].text or e.args[0].target
    seed = random.Random(f"{name}/{c.start}/{c.stop}").randrange(1 << 31)
    points = c.spark.range(c.start, c.stop).select(F.lit(0).alias("one"), (F.col("id") - c.start).cast("int").alias("i"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / (1 << 30) - 0.5).alias("d"))
    from pyspark.sql import Window

    walk = points.withColumn("v", F.sum("d").over(Window.partitionBy("one").orderBy("i")) - F.col("d"))
    s = made(c, name, c.start, c.stop, 1, [])
    return s.having(s.df.drop("values").crossJoin(F.broadcast(frame.folded(walk, "one"))))


def hinted(s: SeriesList, **hints: str) -> SeriesList:
    added = F.create_map(*[F.lit(x) for k, v in hints.items() for x in (k, v)])
    # A hint given twice takes the later value.
    held = F.map_filter(F.coalesce("graph", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(list(hints)))
    return s.with_(graph=F.map_concat(held, added))


@function("color", "stacked", "alpha", "dashed", "drawAsInfinite", "secondYAxis", "lineWidth", args="seriesList, value", group="Graph")
def hint(c: Context, e: Expr) -> SeriesList:
    """A drawing hint in the column ``graph``; values stay."""
    s = c.series(e.args[0])
    if e.target == "color":
        return hinted(s, color=e.string(1))
    if e.target == "stacked":
        return hinted(s, stacked="true", stack_name=e.string(1, "__DEFAULT__"))
    if e.target in ("alpha", "lineWidth"):
        return hinted(s, **{{"alpha": "alpha", "lineWidth": "line_width"}[e.target]: number_text(e.number(1))})
    if e.target == "dashed":
        n = e.number(1, 5.0)
        return hinted(s, dashed=number_text(n)).named(wrapped("dashed", f",{number_text(n)}" if e.has(1) else ""))
    key = {"drawAsInfinite": "draw_as_infinite", "secondYAxis": "second_y_axis"}[e.target]
    return hinted(s, **{key: "true"}).named(wrapped(e.target))


@function("areaBetween", args="seriesList", group="Graph")
def area_between(c: Context, e: Expr) -> SeriesList:
    """The lower of two series, not drawn, and the distance to the upper one, stacked on it."""
    s = frame.normalized(c.series(e.args[0]))
    two = frame.first_two(s)
    name = F.lit(f"areaBetween({e.raw})")
    gap = s.having(frame.combined(two, lambda x, y: y - x, name))
    lower = s.having(two.withColumn("name", name))
    stack = {"stacked": "true", "stack_name": "__areaBetween"}
    return concatenated([hinted(lower, invisible="true", **stack), hinted(gap, **stack)])


@function("threshold", args="value, label=None, color=None", group="Graph")
def threshold(c: Context, e: Expr) -> SeriesList:
    """A line of two points, with a label and a colour."""
    n = e.number(0)
    s = made(c, e.string(1, number_text(n), name="label"), c.start, c.stop, c.stop - c.start, [n, n])
    color = e.string(2, "", name="color")
    return hinted(s, color=color) if color else s
