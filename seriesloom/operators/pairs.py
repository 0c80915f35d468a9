"""Functions that pair series by place, by nodes, or with one other series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError
from seriesloom.operators.grouping import PAIRWISE, node_key
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function

OPERATIONS = {"divide": lambda x, y: F.try_divide(x, y), "diff": lambda x, y: x - y, "multiply": lambda x, y: x * y, "pow": lambda x, y: F.pow(x, y)}


def pair_name(head: str) -> Column:
    return F.concat(F.lit(f"{head}("), F.col("name"), F.lit(","), F.col("b_name"), F.lit(")"))


def by_one(a: SeriesList, b: SeriesList, f, name: Column, what: str) -> SeriesList:
    """Each series of a with the single series of b."""
    a, b = frame.aligned(a, b)
    return a.having(frame.combined(frame.with_one(a.df, b, what), f, name))


def by_place(a: SeriesList, b: SeriesList, f, name: Column, order: str = "ord") -> SeriesList:
    """The first with the first, the second with the second, ..."""
    a, b = frame.aligned(a, b)
    x, y = (frame.placed(s.df if order == "ord" else frame.reordered(s.df, frame.by_text(F.col("name")))) for s in (a, b))
    return a.having(frame.combined(x.join(frame.others(y, "position"), "position"), f, name))


def in_group(operation: str):
    def build(a: SeriesList, b: SeriesList) -> SeriesList:
        a, b = frame.aligned(a, b)
        other = frame.others(b.df.withColumn("key", F.col("name")), "key")
        return a.having(frame.combined(a.df.withColumn("key", F.col("name")).join(other, "key"), OPERATIONS[operation], F.col("name")))

    return build


PAIRWISE |= {"divideSeries": in_group("divide"), "diffSeries": in_group("diff"), "powSeriesLists": in_group("pow")}
PAIRWISE["asPercent"] = lambda a, b: in_group("divide")(a, b).map(lambda v: v * 100)


@function("divideSeries", args="dividendSeriesList, divisorSeries", group="Combine")
def divide_series(c: Context, e: Expr) -> SeriesList:
    """Each series by one other, or the first of two by the second; absent where that is zero."""
    if len(e.args) > 1:
        return by_one(c.series(e.args[0]), c.series(e.args[1]), OPERATIONS["divide"], pair_name("divideSeries"), "divideSeries")
    s = frame.normalized(c.series(e.args[0]))
    return s.having(frame.combined(frame.first_two(s), OPERATIONS["divide"], F.lit(f"divideSeries({e.raw})")))


@function("divideSeriesLists", "diffSeriesLists", "multiplySeriesLists", "powSeriesLists", args="firstSeriesList, secondSeriesList", group="Combine")
def lists(c: Context, e: Expr) -> SeriesList:
    """Two lists of equal length, place by place."""
    kind = e.target.removesuffix("SeriesLists")
    return by_place(c.series(e.args[0]), c.series(e.args[1]), OPERATIONS[kind], pair_name(f"{kind}Series"))


@function("asPercent", args="seriesList, total=None, *nodes", group="Calculate")
def as_percent(c: Context, e: Expr) -> SeriesList:
    """Percent of a total: of the list's sum, a number, one series, a list of equal length paired by
    name, or the total with equal nodes. With nodes, keys without a partner give absent series, and a
    key with several totals takes the sum of the whole first list; this is kept on purpose."""
    s = c.series(e.args[0])
    percent = lambda x, y: F.try_divide(x, y) * 100
    if len(e.args) == 1:
        text = f"sumSeries({e.args[0].target})"
        both = frame.normalized(s)
        whole = frame.reduced(both, F.sum(F.col("v")), None, lambda _: F.lit(text))
        return by_one(both, whole, percent, F.concat(F.lit("asPercent("), F.col("name"), F.lit(f",{text})")), "asPercent")
    total = e.args[1]
    if len(e.args) == 2 and total.kind == "const":
        n = total.value
        return s.map(lambda v: F.try_divide(v, F.lit(n)) * 100).named(F.concat(F.lit("asPercent("), F.col("name"), F.lit(f",{n:.2f})")))
    t = c.series(total)
    if len(e.args) == 2:
        if t.df.limit(2).count() == 1:
            text = total.target if total.kind == "name" else str(total)
            return by_one(s, t, percent, F.concat(F.lit("asPercent("), F.col("name"), F.lit(f",{text})")), "asPercent")
        return by_place(s, t, percent, pair_name("asPercent"), "name")
    key = node_key(e.integers(2))
    a, b = frame.aligned(s, t)
    x, y = a.df.withColumn("key", key), b.df.withColumn("key", key)
    own = y.groupBy("key").agg(F.count("*").alias("n"), *[F.first(k).alias(f"b_{k}") for k in ("name", "values", "start", "stop", "step")])
    text = f"sumSeries({total.target})"
    whole = frame.reduced(a, F.sum(F.col("v")), None, lambda _: F.lit(text)).df
    one = whole.select(*[F.col(k).alias(f"w_{k}") for k in ("name", "values", "start", "stop")])
    own = own.crossJoin(F.broadcast(one)).select("key", "b_step", *[F.when(F.col("n") == 1, F.col(f"b_{k}")).otherwise(F.col(f"w_{k}")).alias(f"b_{k}") for k in ("name", "values", "start", "stop")])
    both = x.join(own, "key", "full_outer")
    missing = F.lit("MISSING")
    values = F.when(F.col("values").isNull() | F.col("b_values").isNull(), F.transform(F.coalesce("values", "b_values"), lambda v: F.lit(None).cast("double"))).otherwise(
        F.zip_with("values", "b_values", percent)
    )
    out = both.withColumns({
        "values": values,
        "name": F.concat(F.lit("asPercent("), F.coalesce(F.col("name"), missing), F.lit(","), F.coalesce(F.col("b_name"), missing), F.lit(")")),
        "start": F.least("start", "b_start"), "stop": F.greatest("stop", "b_stop"), "step": F.coalesce("step", "b_step"),
    })
    lone = frame.order([], F.concat(F.lit("missing/"), "key"))
    return s.having(frame.reordered(out.withColumn("ord", F.coalesce("ord", lone)), frame.by_text(F.col("key"))))


@function("weightedAverage", args="seriesListAvg, seriesListWeight, *nodes", group="Combine")
def weighted_average(c: Context, e: Expr) -> SeriesList:
    """The sum of values times weights, matched by nodes, over the sum of all weights."""
    a, b = frame.aligned(c.series(e.args[0]), c.series(e.args[1]))
    key = node_key(e.integers(2))

    def latest(s: SeriesList):
        return frame.last_of_each(s.df.withColumn("key", key))

    products = a.having(frame.combined(latest(a).join(frame.others(latest(b), "key"), "key"), OPERATIONS["multiply"], F.col("name")))
    top, bottom = (frame.reduced(s, F.sum(F.col("v")), None, lambda _: F.lit("")) for s in (products, b))
    names = [F.array_join(F.sort_array(F.collect_set("name")), ",") for _ in (a, b)]
    one, other = (s.df.agg(n.alias(k)) for s, n, k in zip((a, b), names, ("_a", "_b"), strict=True))
    tail = ",".join(map(str, e.integers(2)))
    found = by_one(top, bottom, OPERATIONS["divide"], F.col("name"), "weightedAverage")
    named = found.df.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(other))
    return found.having(named.withColumn("name", F.concat(F.lit("weightedAverage("), "_a", F.lit(", "), "_b", F.lit(f", {tail})"))))


def zipped(a: SeriesList, b: SeriesList, f, name: Column, place: bool, what: str) -> SeriesList:
    """Pairs of whole series (by place, or each of a with the only one of b) given to numpy:
    f(values, row) to values; the row has b_values, b_start and b_step."""
    if place:
        both = frame.placed(a.df).join(frame.others(frame.placed(b.df), "position"), "position")
    else:
        both = frame.with_one(a.df, b, what)
    return in_numpy(a, both, f, name)


def in_numpy(a: SeriesList, both: DataFrame, f, name: Column) -> SeriesList:
    return frame.by_numpy(a, f, both.withColumn("name", name).select(*frame.COLUMNS, "b_values", "b_start", "b_step"))


def time_lag(v: np.ndarray, row: dict) -> np.ndarray:
    """Seconds since the producer had the consumer's value: its last slot, up to the consumer's own,
    reached through values no larger. The search starts over when the consumer's value falls."""
    w = row["b_values"]
    zero_v, zero_w = np.nan_to_num(v), np.nan_to_num(w)
    out = np.full(len(v), np.nan)
    at = -1
    for i in range(len(v)):
        if i and zero_v[i - 1] > zero_v[i]:
            at = -1
        if np.isnan(v[i]):
            continue
        while at < i and at + 1 < len(w) and zero_w[at + 1] <= v[i]:
            at += 1
        if at >= 0 and not np.isnan(w[at]):
            out[i] = row["start"] + i * row["step"] - row["b_start"] - at * row["b_step"]
    return out


@function("timeLagSeries", "timeLagSeriesLists", args="consumeMaxOffsetSeries, produceMaxOffsetSeries", group="Combine")
def time_lag_series(c: Context, e: Expr) -> SeriesList:
    """How long ago a producer's offset was what a consumer's is now."""
    a = c.series(e.args[0])
    if len(e.args) == 1:
        return in_numpy(a, frame.first_two(a), time_lag, F.lit(f"timeLagSeries({e.raw})"))
    return zipped(a, c.series(e.args[1]), time_lag, pair_name("timeLagSeries"), e.target.endswith("Lists"), e.target)


@function("pearson", args="seriesList, seriesList, windowSize", group="Calculate")
def pearson(c: Context, e: Expr) -> SeriesList:
    """The correlation of two series over the last so many slots; slots where one is absent are left
    out, and a window without variance is absent."""
    size = e.integer(2)

    def f(v: np.ndarray, row: dict) -> np.ndarray:
        w = row["b_values"]
        n = min(len(v), len(w))
        both = ~np.isnan(v[:n]) & ~np.isnan(w[:n])
        out = np.full(len(v), np.nan)
        for i in range(size - 1, n):
            m = both[i - size + 1 : i + 1]
            out[i] = correlation(v[i - size + 1 : i + 1][m], w[i - size + 1 : i + 1][m])
        return out

    name = F.concat(F.lit("pearson("), F.col("name"), F.lit(","), F.col("b_name"), F.lit(f",{size})"))
    found = zipped(c.series(e.args[0]), c.series(e.args[1]), f, name, False, e.target)
    return found.with_(start=F.lit(c.start).cast("long"), stop=F.lit(c.stop).cast("long"))


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 1:
        return np.nan
    dx, dy = x - x.mean(), y - y.mean()
    scale = np.sqrt((dx * dx).sum() * (dy * dy).sum())
    return (dx * dy).sum() / scale if scale > 0 else np.nan


@function("pearsonClosest", args="seriesList, seriesList, n, direction", group="Calculate")
def pearson_closest(c: Context, e: Expr) -> SeriesList:
    """The n series of the second list that correlate the most with the first list's only one, by
    direction: abs, pos or neg."""
    n, direction = e.integer(2), e.string(3, "abs", name="direction")
    if direction not in ("abs", "pos", "neg"):
        raise ParseError("direction is abs, pos or neg")
    s = c.series(e.args[1])
    one = frame.one(c.series(e.args[0]), "pearsonClosest").select(F.col("b.values").alias("r"))
    df = s.df.crossJoin(F.broadcast(one)).filter(F.size("r") == F.size("values"))
    pairs = F.filter(F.arrays_zip(F.col("values").alias("x"), F.col("r").alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def score(p: Column) -> Column:
        k = F.size(p).cast("double")

        def of(m: Column) -> Column:
            mx, my = m["mx"], m["my"]
            add = lambda g: F.aggregate(p, F.lit(0.0), lambda a, z: a + g(z))
            xy, xx, yy = add(lambda z: (z["x"] - mx) * (z["y"] - my)), add(lambda z: (z["x"] - mx) * (z["x"] - mx)), add(lambda z: (z["y"] - my) * (z["y"] - my))
            return F.try_divide(xy, F.sqrt(xx * yy))

        means = F.struct(F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, z: a + z["x"]), k).alias("mx"), F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, z: a + z["y"]), k).alias("my"))
        return frame.let(means, of)

    scored = df.withColumn("_score", frame.let(pairs, score)).filter(F.col("_score").isNotNull())
    if direction != "abs":
        scored = scored.filter(F.col("_score") >= 0 if direction == "pos" else F.col("_score") <= 0)
    return s.having(frame.first(frame.reordered(scored, frame.by_number(F.round(F.abs("_score"), 12), True)), n))


def smirnov_p(x: np.ndarray, y: np.ndarray) -> float:
    """The p value of the two-sample Kolmogorov-Smirnov test, by the asymptotic series."""
    x, y = np.sort(x[~np.isnan(x)]), np.sort(y[~np.isnan(y)])
    if not len(x) or not len(y):
        return np.nan
    at = np.concatenate([x, y])
    d = np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max()
    n = np.sqrt(len(x) * len(y) / (len(x) + len(y)))
    z = (n + 0.12 + 0.11 / n) * d
    if z < 1e-9:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * (k * z) ** 2)).sum(), 0, 1))


@function("kolmogorovSmirnovTest2", "ksTest2", args="seriesList, seriesList, windowSize", group="Calculate")
def ks_test(c: Context, e: Expr) -> SeriesList:
    """The p value that the last so many values of two series are of one distribution."""
    size = e.integer(2)

    def f(v: np.ndarray, row: dict) -> np.ndarray:
        w = row["b_values"]
        return np.array([smirnov_p(v[i - size + 1 : i + 1], w[i - size + 1 : i + 1]) if i >= size else np.nan for i in range(len(v))])

    name = F.concat(F.lit("kolmogorovSmirnovTest2("), F.col("name"), F.lit(","), F.col("b_name"), F.lit(f",{size})"))
    found = zipped(c.series(e.args[0]), c.series(e.args[1]), f, name, False, e.target)
    return found.with_(start=F.lit(c.start).cast("long"), stop=F.lit(c.stop).cast("long"))
