"""Merging of replicas: the same series from several backends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.plans.frame import let

MODES = ("normal", "check", "majority")


@dataclass(frozen=True)
class Merged:
    """points: name, ts, v; stats: name, points, mismatches, fixed."""

    points: DataFrame
    stats: DataFrame


def _decided(values: Column, mode: str, epsilon: float) -> Column:
    """v, mismatch and fixed of a slot from the array of its values, in the order of replicas."""
    near = lambda a, b: (a == b) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * epsilon)

    def of(held: Column) -> Column:
        first, size = F.get(held, F.lit(0)), F.size(held)
        if mode == "normal":
            return F.struct(first.alias("v"), F.lit(False).alias("mismatch"), F.lit(False).alias("fixed"))
        mismatch = (size > 1) & F.exists(held, lambda a: ~near(a, first))
        if mode == "check":
            return F.struct(first.alias("v"), mismatch.alias("mismatch"), F.lit(False).alias("fixed"))
        winner = F.get(F.filter(held, lambda a: F.size(F.filter(held, lambda b: near(a, b))) * 2 > size), F.lit(0))
        return F.struct(F.coalesce(F.when(mismatch, winner), first).alias("v"), mismatch.alias("mismatch"), (mismatch & winner.isNotNull()).alias("fixed"))

    return let(F.filter(values, lambda v: v.isNotNull()), of)


def merge_series(series: DataFrame, mode: str = "normal", epsilon: float = 0.0) -> DataFrame:
    """name, start, step, values, points, mismatches and fixed: one series for each name of ``series``
    (replica, name, start, step, values), decided as by ``merge``. Replicas of a name meet as whole
    arrays, so that slots are never shuffled singly."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    finest = series.withColumn("finest", F.min("step").over(Window.partitionBy("name"))).filter(F.col("step") == F.col("finest"))
    held = finest.groupBy("name", "step").agg(F.sort_array(F.collect_list(F.struct("replica", "start", "values"))).alias("held"), F.min("start").alias("start"), F.max(F.col("start") + F.size("values") * F.col("step")).alias("stop"))
    count = ((F.col("stop") - F.col("start")) / F.col("step")).cast("int")
    shifted = F.transform("held", lambda h: F.struct(h["values"].alias("v"), ((h["start"] - F.col("start")) / F.col("step")).cast("int").alias("by")))
    slots = F.when(count > 0, let(shifted, lambda s: F.transform(F.sequence(F.lit(0), count - 1), lambda i: _decided(F.transform(s, lambda h: F.when(i >= h["by"], F.get(h["v"], i - h["by"]))), mode, epsilon))))
    out = held.select("name", "start", "step", F.inline_outer(F.array(F.struct(slots.alias("slots")))))
    number = lambda field: F.size(F.filter("slots", lambda x: x[field])).cast("long")
    return out.select("name", "start", "step", F.transform("slots", lambda x: x["v"]).alias("values"), F.size("slots").cast("long").alias("points"), number("mismatch").alias("mismatches"), number("fixed").alias("fixed"))


def merge(replicas: DataFrame, mode: str = "normal", epsilon: float = 0.0) -> Merged:
    """One series for each name of ``replicas`` (replica, name, step, ts, v).

    Only replicas of the finest step count. A slot takes the value of the first replica that has
    one. ``check`` also counts slots in which values differ (by more than a share ``epsilon`` of the
    larger); ``majority`` takes the value that more than half of them have, if there is one. All is
    one aggregate by name and slot after the finest step is known, which a broadcast-free window
    over names gives."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    finest = replicas.withColumn("finest", F.min("step").over(Window.partitionBy("name"))).filter(F.col("step") == F.col("finest"))
    held = F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("replica", "v"))))
    slots = finest.groupBy("name", "ts").agg(held.alias("held"))
    decided = F.inline_outer(F.array(_decided(F.transform("held", lambda x: x["v"]), mode, epsilon)))
    out = slots.select("name", "ts", decided)
    stats = out.groupBy("name").agg(F.count("*").alias("points"), F.count_if("mismatch").alias("mismatches"), F.count_if("fixed").alias("fixed"))
    return Merged(out.select("name", "ts", "v"), stats)
