"""Where series come from: point tables addressed by dotted names, with globs.

A table gives points ``name, ts, v`` on a grid with a step. A scan tells the table its time range and
glob: a table of raw rows (``RawTable``) filters its own columns by them, so that the file format
skips what does not match. The whole glob is then matched as a regular expression, and points are
folded to dense arrays; slots without a point are absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.plans.frame import COLUMNS, SCHEMA, SeriesList, by_number, by_text, order


@dataclass(frozen=True)
class PointTable:
    """prefix: the first node of its names; points: name, ts (epoch seconds, on the grid), v."""

    prefix: str
    points: DataFrame
    step: int
    agg: str | None = None

    def within(self, glob: str, start: int, stop: int) -> DataFrame:
        """The points of [start, stop) that the glob may match."""
        return self.points.filter((F.col("ts") >= start) & (F.col("ts") < stop))


@dataclass(frozen=True)
class RawTable:
    """Rows with a time that sum up to points on a grid.

    Names are the prefix, ``nodes`` and a measure. nodes: columns of strings, as stored or computed;
    measures: what is summed, by the last node of the name."""

    prefix: str
    rows: DataFrame
    nodes: tuple[Column | str, ...]
    time: str
    measures: dict[str, str]
    step: int
    agg: str | None = None

    @property
    def points(self) -> DataFrame:
        return self._summed(self.rows, list(self.measures))

    def within(self, glob: str, start: int, stop: int) -> DataFrame:
        """The points of [start, stop) that the glob may match: the range and plain nodes are filters
        on the columns as they are stored."""
        wanted = glob_nodes(glob)
        measures = [m for m in self.measures if len(wanted) == len(self.nodes) + 2 and re.match(glob_regex(wanted[-1]), m)]
        if not measures:
            return self.points.filter(F.lit(False))
        first, last = (-(-t // self.step) * self.step for t in (start, stop))
        rows = self.rows.filter((F.col(self.time) >= instant(first)) & (F.col(self.time) < instant(last)))
        for column, node in zip(self.nodes, wanted[1:], strict=False):
            choices = plain_choices(node)
            if isinstance(column, str) and choices:
                rows = rows.filter(F.col(column).isin(choices))
        return self._summed(rows, measures)

    def _summed(self, rows: DataFrame, measures: list[str]) -> DataFrame:
        nodes = [F.col(n) if isinstance(n, str) else n for n in self.nodes]
        seconds = F.unix_seconds(F.col(self.time).cast("timestamp"))
        sums = [F.sum(self.measures[m]).alias(f"m{k}") for k, m in enumerate(measures)]
        slots = rows.groupBy(F.concat_ws(".", F.lit(self.prefix), *nodes).alias("head"), (seconds - F.pmod(seconds, F.lit(self.step))).alias("ts")).agg(*sums)
        if len(measures) == 1:
            return slots.select(F.concat("head", F.lit(f".{measures[0]}")).alias("name"), "ts", F.col("m0").alias("v"))
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"m{k}").alias("v")) for k, m in enumerate(measures)]))
        return slots.select("head", "ts", each.alias("x")).select(F.concat_ws(".", "head", "x.m").alias("name"), "ts", "x.v")


@dataclass(frozen=True)
class RunningTable:
    """The sums so far of another table's points: what was before a range is one sum for each name."""

    table: RawTable
    prefix: str
    renamed: dict[str, str]

    @property
    def step(self) -> int:
        return self.table.step

    @property
    def agg(self) -> str | None:
        return self.table.agg

    @property
    def points(self) -> DataFrame:
        return self._running(self._named(self.table.points))

    def within(self, glob: str, start: int, stop: int) -> DataFrame:
        every = ".".join("*" * (len(self.table.nodes) + 2))
        before = self._named(self.table.within(every, 0, start)).groupBy("name").agg(F.sum("v").alias("base"))
        running = self._running(self._named(self.table.within(every, start, stop)))
        return running.join(before, "name", "left").select("name", "ts", (F.col("v") + F.coalesce("base", F.lit(0.0))).alias("v"))

    def _named(self, points: DataFrame) -> DataFrame:
        name = F.coalesce(*[F.when(F.col("name") == old, F.lit(new)) for old, new in self.renamed.items()])
        return points.filter(F.col("name").isin(list(self.renamed))).withColumn("name", name)

    @staticmethod
    def _running(points: DataFrame) -> DataFrame:
        return points.withColumn("v", F.sum("v").over(Window.partitionBy("name").orderBy("ts")))


Table = PointTable | RawTable | RunningTable


def instant(seconds: int) -> Column:
    """A time as a literal, which filters on stored times can be compared with before rows are read."""
    return F.lit(datetime.fromtimestamp(seconds, UTC))


def glob_nodes(glob: str) -> list[str]:
    """The nodes of a glob; points within braces do not part them."""
    nodes, depth, node = [], 0, ""
    for c in glob + ".":
        depth += (c == "{") - (c == "}")
        if c == "." and not depth:
            nodes.append(node)
            node = ""
        else:
            node += c
    return nodes


def plain_choices(node: str) -> list[str] | None:
    """What a node may be, if it is plain or plain alternatives in braces."""
    inner = re.fullmatch(r"\{([^*?\[\]{}]*)\}", node)
    if inner:
        return inner[1].split(",")
    return None if is_glob(node) else [node]


def glob_regex(glob: str) -> str:
    """``*``, ``?``, ``[..]`` and ``{a,b}`` within nodes, as an anchored regular expression."""
    out, depth = "", 0
    for c in glob:
        if c == "*":
            out += "[^.]*"
        elif c == "?":
            out += "[^.]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}":
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c in "[]-":
            out += c
        else:
            out += re.escape(c)
    return f"^{out}$"


def literal_prefix(glob: str) -> str:
    return re.split(r"[*?\[{]", glob, maxsplit=1)[0]


def is_glob(name: str) -> bool:
    return literal_prefix(name) != name


def matches(name: Column, glob: str) -> Column:
    if not is_glob(glob):
        return name == glob
    prefix = literal_prefix(glob)
    match = name.rlike(glob_regex(glob))
    return name.startswith(prefix) & match if prefix else match


def ordering(name: Column, glob: str) -> list[Column]:
    """The parts of the order of a glob's series: node by node, alternatives in braces as they are
    written."""
    keys = []
    parts = F.split(name, "[.]")
    for k, node in enumerate(glob_nodes(glob)):
        if re.search(r"[*?\[{]", node):
            part = F.get(parts, F.lit(k))
            brace = re.search(r"\{([^{}]*)\}", node)
            if brace:
                before, after = node[: brace.start()], node[brace.end() :]
                rank = F.lit(len(brace[1]))
                for j, choice in reversed(list(enumerate(brace[1].split(",")))):
                    rank = F.when(part.rlike(glob_regex(before + choice + after)), F.lit(j)).otherwise(rank)
                keys.append(by_number(rank))
            keys.append(by_text(part))
    return [*keys, by_text(name)]


class Store:
    """Point tables by the first node of their names."""

    def __init__(self, spark: SparkSession, tables: list[Table]):
        self.spark, self.tables = spark, tables
        self._scans: dict[tuple[str, int, int], SeriesList] = {}

    def tables_for(self, glob: str) -> list[Table]:
        first = glob.split(".")[0]
        return [t for t in self.tables if re.match(glob_regex(first), t.prefix)]

    def scan(self, glob: str, start: int, stop: int) -> SeriesList:
        """The series that match, over [start, stop). Equal scans of a request are one plan."""
        key = (glob, start, stop)
        if key not in self._scans:
            found = [self._scan(t, glob, start, stop) for t in self.tables_for(glob)]
            if not found:
                self._scans[key] = SeriesList(self.spark.createDataFrame([], SCHEMA), frozenset())
            else:
                df = found[0]
                for more in found[1:]:
                    df = df.unionByName(more)
                ranked = df.withColumn("ord", order(ordering(F.col("name"), glob), F.col("name")))
                self._scans[key] = SeriesList(ranked.select(COLUMNS), frozenset(t.step for t in self.tables_for(glob)))
        return self._scans[key]

    def _scan(self, table: Table, glob: str, start: int, stop: int) -> DataFrame:
        first = -(-start // table.step) * table.step
        size = max(0, -(-(stop - first) // table.step))
        rows = table.within(glob, start, stop).filter(matches(F.col("name"), glob))
        slot = ((F.col("ts") - first) / table.step).cast("int")
        held = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(slot.alias("i"), F.col("v").alias("v")))).alias("p"))
        return held.select("name", dense(F.col("p"), size).alias("values")).withColumns({
            "start": F.lit(first).cast("long"), "stop": F.lit(first + size * table.step).cast("long"), "step": F.lit(table.step).cast("long"),
            "agg": F.lit(table.agg).cast("string"), "graph": F.lit(None).cast("map<string,string>"),
        })


def dense(sorted_points: Column, size: int) -> Column:
    """Sorted (i, v) with gaps as an array of ``size`` values: each point brings the gap before it."""
    filled = F.flatten(
        F.transform(
            sorted_points,
            lambda p, k: F.concat(F.array_repeat(F.lit(None).cast("double"), p["i"] - F.coalesce(F.get(sorted_points, k - 1)["i"], F.lit(-1)) - 1), F.array(p["v"])),
        )
    )
    return F.concat(filled, F.array_repeat(F.lit(None).cast("double"), F.lit(size) - F.size(filled)))
