"""Functions that only rename series."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function


def metric(name: Column) -> Column:
    """The innermost metric path of a name such as ``scale(a.b,2)``."""
    inner = F.regexp_extract(name, r"^(?:.*?\()*([^(),{}]*(?:\{[^{}]*\}[^(),{}]*)*)", 1)
    return F.when(name.contains("("), inner).otherwise(name)


def nodes(name: Column) -> Column:
    return F.split(metric(name), "[.]")


def picked(parts: Column, places: list[int]) -> Column:
    """Nodes at places (negative ones from the end), joined; places out of range are skipped."""
    found = [F.get(parts, F.lit(k) if k >= 0 else F.size(parts) + k) for k in places]
    return F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull()), ".") if found else F.lit("")


@function("alias", args="seriesList, newName", group="Alias")
def alias(c: Context, e: Expr) -> SeriesList:
    """A new name."""
    return c.series(e.args[0]).named(F.lit(e.string(1)))


@function("aliasByMetric", args="seriesList", group="Alias")
def alias_by_metric(c: Context, e: Expr) -> SeriesList:
    """The last node of the metric."""
    return c.series(e.args[0]).named(frame.let(nodes(F.col("name")), lambda p: F.get(p, F.size(p) - 1)))


@function("aliasByNode", args="seriesList, *nodes", group="Alias")
def alias_by_node(c: Context, e: Expr) -> SeriesList:
    """Some nodes of the metric."""
    return c.series(e.args[0]).named(frame.let(nodes(F.col("name")), lambda p: picked(p, e.integers(1))))


@function("aliasSub", args="seriesList, search, replace", group="Alias")
def alias_sub(c: Context, e: Expr) -> SeriesList:
    r"""Replaces what a regular expression matches; ``\1`` stands for a group."""
    return c.series(e.args[0]).named(F.regexp_replace("name", F.lit(e.string(1)), F.lit(re.sub(r"\\(\d+)", r"$\1", e.string(2)))))


@function("substr", args="seriesList, start=0, stop=0", group="Special")
def substr(c: Context, e: Expr) -> SeriesList:
    """Nodes from start to before stop; negative places count from the end, stop 0 is the end."""
    start, stop = e.integer(1, 0, name="start"), e.integer(2, 0, name="stop")

    def part(p: Column) -> Column:
        low = F.lit(start) if start >= 0 else F.greatest(F.size(p) + start, F.lit(0))
        high = F.least(F.lit(stop), F.size(p)) if stop > 0 else F.size(p) + stop
        return F.array_join(F.slice(p, low + 1, F.greatest(high - low, F.lit(0))), ".")

    return c.series(e.args[0]).named(frame.let(nodes(F.col("name")), part))
