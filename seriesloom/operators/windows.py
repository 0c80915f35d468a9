"""Functions over neighbouring slots. Those that look at a slot or two are array expressions; running
and moving figures go over each series' array in numpy, in time that grows with the array alone."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError, number_text
from seriesloom.operators.elementwise import wrapped
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function

#: Seconds from the start of year 1 to the epoch: multiples of a bucket count from there.
YEAR_ONE = 62135596800


def last_present(v: np.ndarray) -> np.ndarray:
    """For each slot the place of the last one up to it that has a value, or -1."""
    return np.maximum.accumulate(np.where(np.isnan(v), -1, np.arange(len(v)))) if len(v) else np.zeros(0, np.int64)


def _window(c: Context, e: Expr) -> tuple[SeriesList, int, bool, str]:
    """The series (fetched a window earlier if that is an interval), the window's size in slots or in
    seconds, whether it is in seconds, and the argument as it shows in names."""
    arg = e.args[1] if len(e.args) > 1 else None
    if arg is None or arg.kind not in ("const", "string"):
        raise ParseError(f"{e.target} needs a window")
    if arg.kind == "const":
        return c.series(e.args[0]), int(arg.value), False, str(int(arg.value))
    span = e.interval(1, 1)
    return c.shifted(-span, 0).series(e.args[0]), span, True, f'"{arg.text}"'


def _moved(c: Context, e: Expr, figure: Callable[[np.ndarray, int], np.ndarray], own: bool) -> SeriesList:
    """``figure`` of each whole window, that ends before a slot or (own) with it; absent before the
    first. Windows told as an interval give the slots before the range, which are dropped."""
    s, given, seconds, text = _window(c, e)

    def move(v: np.ndarray, row: dict) -> np.ndarray:
        size = given // row["step"] if seconds else given
        out = np.full(len(v), np.nan)
        if 0 < size <= len(v):
            found = figure(v, size)
            first = size - 1 if own else size
            out[first:] = found if own else found[:-1]
        return out[size:] if seconds else out

    return frame.by_numpy(s, move).with_(name=wrapped(e.target, f",{text}"), start=F.lit(c.start).cast("long"), stop=F.lit(c.stop).cast("long"))


def window_sums(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the values of all windows, by prefix sums."""
    there = ~np.isnan(v)
    count = np.concatenate([[0], np.cumsum(there)])
    if np.isfinite(v[there]).all():
        run = np.concatenate([[0.0], np.cumsum(np.where(there, v, 0.0))])
        return run[size:] - run[:-size], count[size:] - count[:-size]
    return by_windows(v, size, lambda w: np.nansum(w, 1)), count[size:] - count[:-size]


def by_windows(v: np.ndarray, size: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f of blocks of windows, a row each."""
    rows = np.lib.stride_tricks.sliding_window_view(v, size)
    block = max(1, (1 << 20) // size)
    return np.concatenate([f(rows[at : at + block]) for at in range(0, len(rows), block)])


def _mean(v: np.ndarray, size: int) -> np.ndarray:
    sums, count = window_sums(v, size)
    return np.where(count > 0, sums / np.maximum(count, 1), np.nan)


def _median(w: np.ndarray) -> np.ndarray:
    """The medians of rows, NaN where there is nothing."""
    ordered, n = np.sort(w, 1), (~np.isnan(w)).sum(1)  # NaN sorts last
    low, high = (np.take_along_axis(ordered, np.maximum(k, 0)[:, None], 1)[:, 0] for k in ((n - 1) // 2, n // 2))
    return np.where(n > 0, (low + high) / 2, np.nan)


@function("movingAverage", "movingMin", "movingMax", "movingSum", args="seriesList, windowSize, xFilesFactor=None", group="Calculate")
def moving(c: Context, e: Expr) -> SeriesList:
    """A figure of the slots before each; the slot itself is not among them. Absent until there are
    as many; a sum of nothing is 0. The factor is ignored."""
    figures = {
        "movingAverage": _mean, "movingSum": lambda v, n: window_sums(v, n)[0],
        "movingMin": lambda v, n: by_windows(v, n, lambda w: np.fmin.reduce(w, 1)), "movingMax": lambda v, n: by_windows(v, n, lambda w: np.fmax.reduce(w, 1)),
    }
    return _moved(c, e, figures[e.target], False)


@function("movingMedian", args="seriesList, windowSize, xFilesFactor=None", group="Calculate")
def moving_median(c: Context, e: Expr) -> SeriesList:
    """The median of so many slots up to and with each."""
    return _moved(c, e, lambda v, n: by_windows(v, n, _median), True)


@function("stdev", args="seriesList, points, windowTolerance=0.1", group="Calculate")
def stdev(c: Context, e: Expr) -> SeriesList:
    """The population deviation of so many slots up to and with each; absent where too few have values."""
    n, tolerance = e.integer(1, name="points"), e.number(2, 0.1, name="windowTolerance")
    least = int((1 - tolerance) * n)

    def of(v: Column, i: Column) -> Column:
        window = F.slice(F.col("values"), F.greatest(i - n + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(n)))
        return frame.let(frame.present(window), lambda p: F.when(~((i >= least) & (F.size(p) < least)), F.coalesce(F.sqrt(frame.variance(p)), F.lit(0.0))))

    return c.series(e.args[0]).with_(values=F.transform(F.col("values"), of), name=wrapped("stdev", f",{n}"))


@function("derivative", args="seriesList", group="Transform")
def derivative(c: Context, e: Expr) -> SeriesList:
    """The change since the last value."""

    def change(v: np.ndarray, _: dict) -> np.ndarray:
        before = np.concatenate([[-1], last_present(v)[:-1]])[: len(v)].astype(np.int64)
        return np.where(before >= 0, v - v[np.maximum(before, 0)], np.nan)

    return frame.by_numpy(c.series(e.args[0]), change).named(wrapped("derivative"))


def _rate(c: Context, e: Expr, per: Column | None) -> SeriesList:
    given = {k: e.number(n, name=k) for n, k in ((1, "maxValue"), (2, "minValue")) if e.has(n, k)}
    high, low = given.get("maxValue"), given.get("minValue")
    if high is not None and low is None:
        low = 0.0
    if high is not None and high <= low:
        raise ParseError("maxValue must exceed minValue")
    tail = f",{number_text(high)}" if high is not None else ""
    if "minValue" in given:
        tail += f",{number_text(low)}" if high is not None else f",minValue={number_text(low)}"

    def change(v: Column, i: Column) -> Column:
        was = F.get(F.col("values"), i - 1)
        out = F.when(v >= was, v - was)
        if high is not None:
            out = out.when((was <= high) & (v >= low), (high - was) + (v - low) + 1)
        elif low is not None:
            out = out.when(v >= low, v - low)
        return F.when(i > 0, out / per if per is not None else out)

    return c.series(e.args[0]).with_(values=F.transform(F.col("values"), change), name=wrapped(e.target, tail))


@function("nonNegativeDerivative", args="seriesList, maxValue=None, minValue=None", group="Transform")
def non_negative_derivative(c: Context, e: Expr) -> SeriesList:
    """The growth since the slot before; a fall is absent, or a counter's wrap if its bounds are told."""
    return _rate(c, e, None)


@function("perSecond", args="seriesList, maxValue=None, minValue=None", group="Transform")
def per_second(c: Context, e: Expr) -> SeriesList:
    """The growth for each second."""
    return _rate(c, e, F.col("step").cast("double"))


@function("integral", args="seriesList", group="Transform")
def integral(c: Context, e: Expr) -> SeriesList:
    """The sum so far."""
    return frame.by_numpy(c.series(e.args[0]), lambda v, _: _so_far(v)).named(wrapped("integral"))


def _so_far(v: np.ndarray) -> np.ndarray:
    absent = np.isnan(v)
    return np.where(absent, np.nan, np.cumsum(np.where(absent, 0.0, v)))


@function("integralByInterval", args="seriesList, intervalString", group="Transform")
def integral_by_interval(c: Context, e: Expr) -> SeriesList:
    """The sum so far in each interval from the request's start."""
    size = e.interval(1, 1)
    begin = c.start

    def sums(v: np.ndarray, row: dict) -> np.ndarray:
        bucket = (row["start"] + np.arange(len(v)) * row["step"] - begin) // size
        parts = np.split(v, np.flatnonzero(np.diff(bucket)) + 1)
        return np.concatenate([_so_far(p) for p in parts])

    return frame.by_numpy(c.series(e.args[0]), sums).named(wrapped("integralByInterval", f",'{e.string(1)}'"))


@function("delay", args="seriesList, steps", group="Transform")
def delay(c: Context, e: Expr) -> SeriesList:
    """Later by so many slots."""
    n = e.integer(1, name="steps")
    return c.series(e.args[0]).with_(values=F.transform(F.col("values"), lambda v, i: F.when(i >= n, F.get(F.col("values"), i - n))), name=wrapped("delay", f",{n}"))


@function("changed", args="seriesList", group="Special")
def changed(c: Context, e: Expr) -> SeriesList:
    """1 where the value differs from that before, else 0; absent points count as 0."""
    zeroed = F.transform(F.col("values"), lambda v: F.coalesce(v, F.lit(0.0)))
    values = frame.let(zeroed, lambda z: F.transform(z, lambda v, i: F.when((i > 0) & (v != F.get(z, i - 1)), 1.0).otherwise(0.0)))
    return c.series(e.args[0]).with_(values=values, name=wrapped("changed"))


@function("keepLastValue", args="seriesList, limit=inf", group="Transform")
def keep_last_value(c: Context, e: Expr) -> SeriesList:
    """Fills a gap with the value before it, for so many slots at most."""
    given = e.has(1, "limit")
    limit = e.integer(1, -1, name="limit") if given else -1

    def keep(v: np.ndarray, _: dict) -> np.ndarray:
        last = last_present(v)
        near = (last >= 0) & (np.arange(len(v)) - last <= limit if limit >= 0 else True)
        return np.where(near, v[np.maximum(last, 0)], np.nan)

    return frame.by_numpy(c.series(e.args[0]), keep).named(wrapped("keepLastValue", f",{limit}" if given else ""))


def bucket_values(values: Column, start: Column, step: Column, grid: Column, stop: Column, size: int, f) -> Column:
    """One value for each bucket of [grid, stop): ``f(window, bucket)`` of the slots in it."""
    count = F.greatest(F.ceil((stop - grid) / F.lit(size)), F.lit(0)).cast("int")

    def of(b: Column) -> Column:
        low = F.greatest(F.ceil((grid + b * size - start) / step), F.lit(0))
        high = F.least(F.ceil((grid + (b + 1) * size - start) / step), F.ceil((stop - start) / step), F.size(values))
        return f(F.slice(values, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), b, high > low)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), of)).otherwise(F.array().cast("array<double>"))


def _grid(s: SeriesList):
    """The series with the first one's start and stop as g_start and g_stop."""
    first = s.df.agg(F.min_by("start", "ord").alias("g_start"), F.min_by("stop", "ord").alias("g_stop"))
    return s.df.crossJoin(F.broadcast(first))


@function("hitcount", args="seriesList, intervalString, alignToInterval=False", group="Transform")
def hitcount(c: Context, e: Expr) -> SeriesList:
    """The sum of values times seconds in each bucket, on the first series' grid. A bucket without
    values is absent, except the first, which is 0."""
    size, align = e.interval(1, 1), e.boolean(2, name="alignToInterval")
    s = c.series(e.args[0])
    grid = F.col("g_start")
    if align:
        unit = next((u for u in (86400, 3600, 60) if size >= u), 1)
        grid = grid - F.pmod(grid, F.lit(unit))
    tail = f",'{e.string(1)}'" + (f",{str(align).lower()}" if e.has(2, "alignToInterval") else "")
    step = F.col("step").cast("double")

    def sum_(w: Column, b: Column, any_: Column) -> Column:
        held = F.exists(w, lambda v: v.isNotNull())
        return F.when(held, frame.total(w) * step).when(b == 0, 0.0)

    df = frame.put(_grid(s), {"values": bucket_values(F.col("values"), F.col("start"), F.col("step"), grid, F.col("g_stop"), size, sum_), "name": wrapped("hitcount", tail), "start": grid, "stop": F.col("g_stop"), "step": F.lit(size).cast("long")})
    return s.having(df, frozenset({size}))


@function("summarize", args="seriesList, intervalString, func='sum', alignToFrom=False", group="Transform")
def summarize(c: Context, e: Expr) -> SeriesList:
    """A figure for each bucket; buckets are aligned to multiples of their size since year 1, or to
    the series' start. Series with longer steps stay as they are."""
    size, func, align = e.interval(1, 1), e.string(2, "sum", name="func"), e.boolean(3, name="alignToFrom")
    percent = re.fullmatch(r"p(\d\d?)", func)
    figures = {
        "sum": frame.total, "total": frame.total, "avg": frame.mean, "average": frame.mean, "max": F.array_max, "min": F.array_min, "last": frame.last,
        "count": lambda w: F.size(frame.present(w)).cast("double"), "median": lambda w: frame.percentile(w, 50, True),
    }
    if func not in figures and not percent:
        raise ParseError(f"unsupported aggregation function: {func}")
    figure = figures.get(func) or (lambda w: frame.percentile(w, float(percent[1]), True))
    s = c.series(e.args[0])
    start, stop = F.col("g_start"), F.col("g_stop")
    if not align:
        start = start - F.pmod(start + YEAR_ONE, F.lit(size))
        over = F.pmod(stop + YEAR_ONE, F.lit(size))
        stop = F.when(over == 0, stop).otherwise(stop - over + size)
    shown_align, shown_func = e.has(3, "alignToFrom"), e.has(2, "func")
    tail = f",'{e.string(1)}'" + (f",'{func}'" if shown_func or shown_align else "") + (f",{str(align).lower()}" if shown_align else "")
    values = bucket_values(F.col("values"), F.col("start"), F.col("step"), start, stop, size, lambda w, b, any_: F.when(F.exists(w, lambda v: v.isNotNull()), figure(w)))
    coarse = F.col("step") > size
    keep = lambda new, old: F.when(coarse, F.col(old)).otherwise(new)
    df = frame.put(_grid(s), {"values": keep(values, "values"), "name": wrapped("summarize", tail), "start": keep(start, "start"), "stop": keep(stop, "stop"), "step": keep(F.lit(size).cast("long"), "step")})
    return s.having(df, frozenset(max(x, size) for x in s.steps))
