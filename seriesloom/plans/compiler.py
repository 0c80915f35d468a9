"""Targets to plans: scans with their time ranges, then one builder for each function call."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.dates import epoch
from seriesloom.functions.parser import Expr, ParseError, parse
from seriesloom.plans.frame import COLUMNS, SCHEMA, SeriesList, placed, points, under
from seriesloom.plans.registry import FUNCTIONS
from seriesloom.sources.store import Store


@dataclass(frozen=True)
class Context:
    """A request: where series come from and the time range asked for."""

    store: Store
    start: int
    stop: int

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def shifted(self, by: int, until: int | None = None) -> Context:
        return replace(self, start=self.start + by, stop=self.stop + (by if until is None else until))

    def series(self, e: Expr) -> SeriesList:
        """The series of an expression; a glob without matches has none."""
        if e.kind == "name":
            return self.store.scan(e.target, self.start, self.stop)
        if e.kind == "const":
            row = [(([], e.text), e.text, self.start, self.stop, max(1, self.stop - self.start), [e.value], None, None)]
            return SeriesList(self.spark.createDataFrame(row, SCHEMA), frozenset({max(1, self.stop - self.start)}))
        if e.kind != "func":
            raise ParseError(f"{e} is no series")
        if e.target not in FUNCTIONS:
            raise ParseError(f"unknown function {e.target}")
        if not e.args:
            raise ParseError(f"{e.target} needs an argument")
        return FUNCTIONS[e.target].build(self, e)

    def all(self, args: list[Expr]) -> SeriesList:
        """The lists of several arguments, one after the other."""
        lists = [self.series(a) for a in args]
        if len(lists) == 1:
            return lists[0]
        return concatenated(lists)

    def empty(self) -> SeriesList:
        return SeriesList(self.spark.createDataFrame([], SCHEMA), frozenset())


def concatenated(lists: list[SeriesList]) -> SeriesList:
    frames = [s.df.select(COLUMNS).withColumn("ord", under(k)) for k, s in enumerate(lists)]
    return SeriesList(reduce(DataFrame.unionByName, frames), frozenset().union(*(s.steps for s in lists)))


class Engine:
    """Evaluates targets over a store."""

    def __init__(self, store: Store):
        import seriesloom.operators  # noqa: F401  registers the functions

        self.store = store

    def evaluate(self, target: str | list[str], start: int | str, stop: int | str) -> DataFrame:
        """The series of one target or of several, one after the other. Times are epoch seconds or text
        such as ``-1d``, ``noon_yesterday`` or ``20240131``."""
        start, stop = (epoch(t) if isinstance(t, str) else t for t in (start, stop))
        if start >= stop:
            raise ParseError("the range is empty")
        context = Context(self.store, start, stop)
        targets = [target] if isinstance(target, str) else target
        found = concatenated([context.series(parse(t)) for t in targets]) if len(targets) > 1 else context.series(parse(targets[0]))
        return found.df

    def render(self, target: str | list[str], start: int | str, stop: int | str) -> DataFrame:
        """As ``evaluate``, with places 0, 1, ..., in order."""
        df = self.evaluate(target, start, stop)
        return placed(df).drop("ord").withColumnRenamed("position", "ord").select(COLUMNS).orderBy("ord")

    def points(self, target: str | list[str], start: int | str, stop: int | str) -> DataFrame:
        """name, ts and v of every slot."""
        df = points(self.evaluate(target, start, stop), "name", "start", "step")
        return df.select("name", (F.col("start") + F.col("i") * F.col("step")).alias("ts"), "v")
