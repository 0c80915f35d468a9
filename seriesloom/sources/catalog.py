"""The tree of names: find, expand and info."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.plans.registry import FUNCTIONS
from seriesloom.sources.store import Store, glob_regex, matches, ordering


def names(store: Store, glob: str) -> DataFrame:
    """Distinct names of the tables that the glob's first node matches."""
    found = [t.points.select("name", F.lit(t.step).alias("step")).distinct() for t in store.tables_for(glob)]
    if not found:
        return store.spark.createDataFrame([], "name string, step int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def find(store: Store, query: str) -> DataFrame:
    """path and is_leaf of what a glob matches at its own depth."""
    depth = query.count(".") + 1
    parts = F.split("name", "[.]")
    path = F.array_join(F.slice(parts, 1, depth), ".")
    rows = names(store, query).filter(F.size(parts) >= depth).select(path.alias("path"), (F.size(parts) == depth).alias("is_leaf"))
    return rows.filter(F.col("path").rlike(glob_regex(query))).distinct()


def complete(store: Store, query: str) -> DataFrame:
    """Find for an unfinished query: slashes are dots, and anything may follow."""
    return find(store, query.replace("/", ".") + ("" if query.endswith("*") else "*"))


def expand(store: Store, queries: list[str], leaves_only: bool = False) -> DataFrame:
    """The distinct paths of several queries."""
    out = None
    for query in queries:
        rows = find(store, query)
        out = rows if out is None else out.unionByName(rows)
    rows = out.filter("is_leaf") if leaves_only else out
    return rows.select("path").distinct()


def info(store: Store, glob: str) -> DataFrame:
    """name, step, points, first and last time of stored series."""
    out = None
    for t in store.tables_for(glob):
        rows = t.points.filter(matches(F.col("name"), glob)).groupBy("name").agg(F.lit(t.step).cast("long").alias("step"), F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        out = rows if out is None else out.unionByName(rows)
    return out


def functions(store: Store) -> DataFrame:
    """name, signature, group and description of all functions."""
    import seriesloom.operators  # noqa: F401

    return store.spark.createDataFrame([(f.name, f.signature, f.group, f.description) for f in FUNCTIONS.values()], "name string, signature string, group string, description string")


__all__ = ["complete", "expand", "find", "functions", "info", "names", "ordering"]
