"""Exact search for repeated windows of values by content-defined anchors.

A window is ``length`` consecutive values (bytes or words) of one text. Its anchor is the k-gram in
it with the smallest hash, the leftmost of equal ones; this depends on the window's content alone.
Successive windows with one anchor form a *segment*, a path of windows without branches. Equal
windows have equal anchors, so they are found among segments with the anchor in common:

* segments whose anchor occurs once hold no repeated window and are dropped, after one aggregate of
  anchors (about two for each ``length - k`` values);
* equal segments (a 64-bit anchor and a 64-bit content hash) fall into classes; in all documents but
  the first of a class every window of the segment is repeated;
* only for anchors with several classes the windows of each class's first segment are compared.

Segments are held equal by a 64-bit fingerprint of their anchor and another, independent one of their
content; single windows by two. Nothing is gathered by key: anchors and classes are pre-aggregated to
a row, and the joins back broadcast the few hot ones (see ``spread_join``). Rows without a doc_id are
documents of their own before all others; null text counts as empty. Rows that repeat a doc_id count
as places of one document and are each given their own result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import text as T
from seriesloom.llm.graph import Tables, bloom, cut, drop, kept_by, passes, spread_join

#: Keys below this stand for rows without a doc_id.
NO_ID = -(1 << 62)


def doc_key(doc_id: Column, text: Column) -> Column:
    """The doc_id; for a row without one a number of its text below ``NO_ID``, so that such rows are
    documents of their own, before all others, and equal ones the same."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND((1 << 62) - 1) - F.lit(-NO_ID) - F.lit(-NO_ID))


def ids(keys: pa.Array) -> pa.Array:
    """The doc_ids that keys stand for, null for rows without one."""
    return pa.array([None if k < NO_ID else k for k in keys.to_pylist()], pa.int64())



@dataclass
class Segments:
    """Segments of a chunk: row, anchor hash, first window and number of windows; ``contents`` gives the
    content hashes of some."""

    row: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    contents: Callable[[np.ndarray], np.ndarray]

    def content(self) -> np.ndarray:
        """The content hashes of all, signed."""
        return T.signed(self.contents(np.arange(len(self.row))))


@dataclass(frozen=True)
class Shape:
    length: int
    k: int


#: An odd number, whose powers weight the values of a k-gram when anchors are chosen.
_BASE = 0x9E3779B97F4A7C15


def _gram_order(values: np.ndarray, k: int) -> np.ndarray:
    """A number for each k-gram, from prefix sums of weighted values. It only decides which k-gram of a
    window is its anchor; nothing is held equal by it."""
    powers = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(len(values) + 1, base, T.U64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p, out=p))
    up, down = powers
    run = np.zeros(len(values) + 1, T.U64)
    np.cumsum(values * up[: len(values)], out=run[1:])
    n = len(values) - k + 1
    return T.mix((run[k:] - run[:n]) * down[:n])


def content_hash(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Fingerprints of runs of values."""
    return T.chained(T.mix(sizes.astype(T.U64) ^ T.U64(T.SEEDS[seed])), sizes, lambda rows, j: values[starts[rows] + j])


def least_places(key: np.ndarray, wide: int) -> np.ndarray:
    """For each window of ``wide`` keys the place of the smallest (by its upper half), the leftmost of
    equal ones. Texts have fewer than 2^31 values."""
    least, have = key >> T.U64(32) << T.U64(32) | np.arange(len(key), dtype=T.U64), 1
    while 2 * have <= wide:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if wide > have:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    return least


def segments(values: np.ndarray, offs: np.ndarray, shape: Shape, content: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None) -> Segments:
    """All segments of texts given as one array of 64-bit values with n + 1 offsets. content: the
    fingerprints of runs of values from their starts, ends and a seed."""
    n, length, k = len(values), shape.length, shape.k
    none = np.zeros(0, np.int64)
    if n < length:
        return Segments(none, none.view(T.U64), none, none, lambda at: at.view(T.U64))
    least = least_places(_gram_order(values, k), length - k + 1)
    inside = np.zeros(n + 1, np.int32)
    size = np.diff(offs)
    long = size >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(window):
        return Segments(none, none.view(T.U64), none, none, lambda at: at.view(T.U64))
    place = (least[window] & T.U64(2**32 - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start, place = window[first], place[first]
    hashed = content or (lambda a, b, seed: content_hash(values, a, b - a, seed))
    return Segments(np.searchsorted(offs, start, "right") - 1, hashed(place, place + k, 0), start, count, lambda at: hashed(start[at], start[at] + count[at] - 1 + length, 1))


#: From the bytes and offsets of a chunk to its segments.
Reader = Callable[[np.ndarray, np.ndarray], Segments]


def plain(docs: DataFrame) -> DataFrame:
    """doc (the key) and text."""
    text = F.col("text").cast("string")
    return docs.select(doc_key(F.col("doc_id"), text).alias("doc"), text.alias("text"))


def _first_of_each(row: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Places of one entry for each (row, content)."""
    by = np.lexsort((content, row))
    new = np.ones(len(by), bool)
    new[1:] = (row[by][1:] != row[by][:-1]) | (content[by][1:] != content[by][:-1])
    return by[new]


def repeated_anchors(texts: DataFrame, read: Reader) -> DataFrame:
    """anchor and n of the anchors that occur more than once."""
    one = pa.schema([("anchor", pa.int64())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in T.chunks(batch, "text"):
                yield T.batch_of(one, T.signed(read(data, offs).anchor))

    counted = texts.select("text").mapInArrow(hashes, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    return cut(counted.filter("n > 1"))


def repeated_segments(texts: DataFrame, read: Reader, often: DataFrame, tables: Tables) -> DataFrame:
    """anchor, content and doc of the segments whose anchor is among those that occur often."""
    arrow = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64())])

    likely = bloom(often, "anchor", tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                found = read(data, offs)
                anchor = T.signed(found.anchor)
                at = np.flatnonzero(passes(likely.value, anchor))
                content = T.signed(found.contents(at))
                one = _first_of_each(found.row[at], content)
                at = at[one]
                yield T.batch_of(arrow, anchor[at], content[one], part.column(0).to_numpy()[found.row[at]])

    return spread_join(texts.select("doc", "text").mapInArrow(run, "anchor long, content long, doc long"), often, ["anchor"], "n").select("anchor", "content", "doc")


@dataclass
class Found:
    """later: doc and contents (whole segments that an earlier document has); open_: doc and the
    segments (anchor, content, number of classes) whose windows are still to be compared."""

    texts: DataFrame
    later: DataFrame
    open_: DataFrame


def search(docs: DataFrame, read: Reader) -> Found:
    texts = plain(docs)
    tables = Tables()
    often = repeated_anchors(texts, read)
    shared = tables.cut(repeated_segments(texts, read, often, tables))
    drop(often)
    classes = tables.cut(shared.groupBy("anchor", "content").agg(F.min("doc").alias("first"), F.count("*").alias("n")))
    several = tables.cut(classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1"))
    later = spread_join(shared, classes.filter("n > 1"), ["anchor", "content"], "n").filter("doc > first").groupBy("doc").agg(F.collect_set("content").alias("later"))
    of = spread_join(classes.select("anchor", "content", "first"), several, ["anchor"], "classes")
    open_ = of.groupBy(F.col("first").alias("doc")).agg(F.collect_list(F.struct("anchor", "content", "classes")).alias("open"))
    found = Found(texts, cut(later), cut(open_))
    tables.drop()
    return found


def opened(found: Found) -> DataFrame:
    """The texts that have open segments, with them. Others are filtered before the shuffle."""
    return found.texts.mapInArrow(kept_by(bloom(found.open_, "doc")), "doc long, text string").join(found.open_, "doc")


#: Makes the result's batches from batches of doc, text, later and single.
Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def finished(found: Found, single: DataFrame, finish: Finish, schema: str) -> DataFrame:
    """``finish`` over doc, text, later and single (content, place) of all rows. Only texts that may
    lose something are shuffled to meet what they lose."""
    single = cut(single)
    filter_ = bloom(found.later.select("doc").union(single.select("doc")), "doc")
    losing = found.texts.mapInArrow(kept_by(filter_), "doc long, text string").join(found.later, "doc", "left").join(single, "doc", "left")
    others = kept_by(filter_, False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filled() -> Iterator[pa.RecordBatch]:
            for batch in others(batches):
                none = pa.nulls(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, none, none], names=["doc", "text", "later", "single"])

        return finish(filled())

    return losing.select("doc", "text", "later", "single").mapInArrow(finish, schema).union(found.texts.mapInArrow(whole, schema))


def chosen(found: Segments, content: np.ndarray, row: int, contents: np.ndarray) -> np.ndarray:
    """The first segments of a row with the given contents, in order of start. content: of all segments."""
    a, b = np.searchsorted(found.row, [row, row + 1])
    content = content[a:b]
    hit = np.flatnonzero(np.isin(content, contents))
    return a + np.sort(hit[np.unique(content[hit], return_index=True)[1]])


def covered(found: Segments, content: np.ndarray, row: int, later: np.ndarray, windows: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, merged and in order, of what is to be removed from a row.

    later: contents whose segments go; windows: contents and places in them of single windows that
    go from their first copy. A segment that the row has had before goes too."""
    a, b = np.searchsorted(found.row, [row, row + 1])
    content, start, count = content[a:b], found.start[a:b], found.windows[a:b]
    values, first = np.unique(content, return_index=True)
    gone = np.ones(len(content), bool)
    gone[first] = False
    gone |= np.isin(content, later)
    s, e = [start[gone]], [start[gone] + count[gone] - 1 + length]
    if len(windows[0]) and len(values):
        k = np.searchsorted(values, windows[0])
        ok = (k < len(values)) & (values[np.minimum(k, len(values) - 1)] == windows[0])
        place = start[first[k[ok]]] + windows[1][ok]
        s.append(place)
        e.append(place + length)
    s, e = np.concatenate(s), np.concatenate(e)
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order]) if len(e) else e
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1] if len(s) else e
