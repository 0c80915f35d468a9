"""Connected components of an edge table, and cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only on one machine, as in tests, a temporary folder
    stands in where this is unset: executors elsewhere could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: What holds for the actions in ``tidy``: shuffle files go when an action ends, and small partitions
#: of a shuffle are read together up to Spark's advisory size, also where that leaves cores idle.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Actions within delete their shuffle files when they end, and don't write a small table in many files."""
    was = {setting: spark.conf.get(setting) for setting in TIDY}
    for setting, value in TIDY.items():
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        for setting, value in was.items():
            spark.conf.set(setting, value)


#: Files of a table for each core, at most.
FILES = 2


def compact(df: DataFrame) -> DataFrame:
    """The rows in ``FILES`` partitions a core at most, each of which takes whole ones of ``df``, one
    after the other, without a shuffle. Hadoop's local file system starts three processes for each
    file that it writes, and each of them is for a moment a second process of the executor's size."""
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


class Tables:
    """Tables that are cut for a while, and filters that are broadcast, dropped together."""

    def __init__(self):
        self.held: list[DataFrame] = []
        self.filters: list[Broadcast] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.held.append(cut(df))
        return self.held[-1]

    def drop(self) -> None:
        for table in self.held:
            drop(table)
        for filter_ in self.filters:
            filter_.destroy()
        self.held.clear()
        self.filters.clear()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared folder and read again: what follows doesn't depend
    on the executors that made them. ``drop`` deletes tables that nothing needs any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with tidy(spark):
        compact(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote and nothing needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The most keys that ``spread_join`` broadcasts.
HOT = 1024


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The inner join of rows with ``keyed``, which has one row for each key and tells in ``weight``
    how many of ``rows`` have it. Keys with more than 1 / HOT of all rows, of which there are HOT at
    most, are broadcast, so that no task of the shuffle for the others gets more than such a share
    of a key. ``keyed`` is read several times: a table that ``cut`` wrote."""
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    often = F.col(weight) * HOT > total
    hot = keyed.filter(often)
    others = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(keyed.filter(~often), keys))


#: Bits of the filters that are broadcast: 16 MB whatever the data.
BITS = 1 << 27


class Bitmap:
    """A bitmap that travels compressed, since filters of small data are nearly empty."""

    def __init__(self, bits: np.ndarray):
        self.packed, self.held = zlib.compress(bits.tobytes(), 1), None

    def __getstate__(self) -> bytes:
        return self.packed

    def __setstate__(self, packed: bytes) -> None:
        self.packed, self.held = packed, None

    def bits(self) -> np.ndarray:
        if self.held is None:
            self.held = np.frombuffer(zlib.decompress(self.packed), np.int64)
        return self.held


def bloom(keys: DataFrame, column: str, tables: Tables | None = None) -> Broadcast:
    """A filter of fixed size over 64-bit keys, dropped with ``tables``. Only the words of its bitmap that are set reach the
    driver. It never misses a key; what else it lets through is decided by a join that follows, so
    a filter that fills up on very large data costs time and loses nothing."""
    spark = keys.sparkSession
    at = F.pmod(F.col(column), F.lit(BITS))
    with tidy(spark):
        words = keys.select(at.alias("at")).filter("at is not null").groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) AS INT))) AS bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    if words.num_rows:
        bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(Bitmap(bitmap))
    if tables is not None:
        tables.filters.append(shared)
    return shared


def passes(filter_: Bitmap, keys: np.ndarray) -> np.ndarray:
    bitmap, at = filter_.bits(), keys & (BITS - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 > 0


def kept_by(filter_: Broadcast, inside: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the rows whose first column, a 64-bit key, passes the filter (or doesn't)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(filter_.value, batch.column(0).to_numpy()) == inside))

    return keep


def _print(links: DataFrame) -> tuple:
    """What two different sets of links share with a probability of 2^-128."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for all nodes of ``edges`` (a, b: long).

    Large-star and small-star steps alternate until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours and itself. Each step is an
    aggregate and a join on nodes; a hub's neighbours are aggregated to their minimum before the
    shuffle and never gathered."""
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _print(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.filter("a <> b").distinct())
        # At the end every node has one link, to the smallest of its component, and a step changes nothing.
        drop(links)
        links, before, was = after, was, _print(after)
        if was == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
