"""Substring dedup of word spans by a compacted De Bruijn graph.

Nodes are runs of 12 words, edges windows of 13, from the node of their first 12 words to that of their
last 12. A window that starts in a document with a smaller doc_id is repeated; the words that repeated
windows cover are removed.

* Edges are dealt by their minimizer, as is usual where a graph does not fit one machine: successive
  edges of a text with one minimizer are a *run*, from the node before its first edge to that behind
  its last. Minimizers that occur once hold no repeated edge and are dropped, after one aggregate.
* Runs with the same words are one run of the graph; its source is its first place in the first document.
* Nodes between runs get their degrees, the numbers of different runs that enter and leave. Where one
  enters and one leaves, a join puts the two together, if both are repeated and follow each other
  in their source: chains of these are the nonbranching paths, known by their head's source.
* Occurrences of runs in later documents, in coordinates of the document and of the path, are put
  together to spans of each path.
* Where runs with one minimizer differ, that is where the graph branches inside runs, single edges are
  compared instead: an aggregate gives each edge its source, a join back the later occurrences.
* The source coordinates verify: the words of each span are read again at its source, and a span is
  only removed if a digest of its own words is the same.

Runs are held equal by 64-bit fingerprints of their minimizer and, independently, of all their words,
single edges by two of the latter. Words are runs of ``[^\\x20\\x09-\\x0D]``; texts stay unchanged but
for the removal. Null text counts as empty; documents below 13 words lose nothing. Rows without a
doc_id are documents of their own before all others. Rows that repeat a doc_id lose nothing to each
other; they are told apart by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from seriesloom.llm import anchors as A
from seriesloom.llm import text as T
from seriesloom.llm.graph import Tables, bloom, drop, kept_by, passes, spread_join

SHAPE = A.Shape(13, 4)
NODE = SHAPE.length - 1
#: Spans that are asked of a source in one row, about; a source that many documents have parts of gets
#: several rows.
ASKED = 1 << 12
#: A place in a text: its document, its text's print and the number of the word.
SOURCE = ["sdoc", "sprint", "sstart"]


def read(data: np.ndarray, offs: np.ndarray) -> A.Segments:
    starts, ends, first = T.words(data, offs)
    return A.segments(T.span_hash(data, starts, ends), first, SHAPE)


def _texts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """doc (the key), print, text and the struct ``row`` of the columns carried."""
    text = F.col("text").cast("string")
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in carried])
    return docs.select(A.doc_key(F.col("doc_id"), text).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"), row.alias("row"))


def occurrences(texts: DataFrame, often: DataFrame, tables: Tables) -> DataFrame:
    """anchor, content, before, behind (the nodes at its ends), doc, print, start and windows of each run
    whose minimizer occurs often."""
    arrow = pa.schema([(c, pa.int64()) for c in ("anchor", "content", "before", "behind", "doc", "print", "start", "windows")])
    likely = bloom(often, "anchor", tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                starts, ends, first = T.words(data, offs)
                h = T.span_hash(data, starts, ends)
                found = A.segments(h, first, SHAPE)
                at = np.flatnonzero(passes(likely.value, T.signed(found.anchor)))
                row, start, windows = found.row[at], found.start[at], found.windows[at]
                content = T.signed(found.contents(at))
                nodes = [T.signed(A.content_hash(h, x, np.full(len(at), NODE), 0)) for x in (start, start + windows)]
                yield T.batch_of(arrow, T.signed(found.anchor)[at], content, *nodes, part.column("doc").to_numpy()[row], part.column("print").to_numpy()[row], start - first[row], windows)

    schema = ", ".join(f"{c} long" for c in arrow.names)
    return spread_join(texts.select("doc", "print", "text").mapInArrow(run, schema), often, ["anchor"], "n").select(arrow.names)


def _first(rows: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """For each key the first and last document that have it, the number of rows, and columns that are
    the same in all of them."""
    return rows.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in also])


def _sourced(rows: DataFrame, found: DataFrame, keys: list[str], tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The rows of later documents, for keys (with first and n) that several documents have, and the
    source of each key with its number n of such rows."""
    met = tables.cut(spread_join(rows, found, keys, "n").drop("n"))
    source = F.min(F.when(F.col("doc") == F.col("first"), F.struct("print", "start")))
    sources = met.groupBy(*keys).agg(F.first("first").alias("sdoc"), source.alias("s"), F.count_if(F.col("doc") > F.col("first")).alias("n"))
    return met.filter(F.col("doc") > F.col("first")).drop("first"), tables.cut(sources.select(*keys, "sdoc", F.col("s.print").alias("sprint"), F.col("s.start").alias("sstart"), "n"))


def paths(runs: DataFrame) -> DataFrame:
    """SOURCE and head (the head's sstart) of the repeated runs: maximal nonbranching paths of runs
    (before, behind, windows, SOURCE or null) that follow each other in their source."""
    leaving = runs.groupBy(F.col("before").alias("node")).agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in SOURCE]).filter("k = 1 AND sdoc IS NOT NULL")
    entering = runs.groupBy(F.col("behind").alias("node")).agg(F.count("*").alias("k"), *[F.first(c).alias(f"p_{c}") for c in (*SOURCE, "windows")]).filter("k = 1 AND p_sdoc IS NOT NULL")
    follows = (F.col("p_sdoc") == F.col("sdoc")) & (F.col("p_sprint") == F.col("sprint")) & (F.col("p_sstart") + F.col("p_windows") == F.col("sstart"))
    joined = leaving.drop("k").join(entering.drop("k"), "node").filter(follows).select(*SOURCE, F.lit(True).alias("joined"))
    repeated = runs.filter("sdoc IS NOT NULL").select(SOURCE).join(joined, SOURCE, "left")
    so_far = Window.partitionBy("sdoc", "sprint").orderBy("sstart")
    return repeated.select(*SOURCE, F.max(F.when(F.col("joined").isNull(), F.col("sstart"))).over(so_far).alias("head"))


def spans(pieces: DataFrame, path: str) -> DataFrame:
    """doc, print, start, windows and SOURCE of the spans that pieces (the same) of one path make up."""
    held = pieces.groupBy("doc", "print", "sdoc", "sprint", path, (F.col("start") - F.col("sstart")).alias("shift")).agg(F.sort_array(F.collect_set(F.struct("sstart", "windows"))).alias("p"))

    def ends(x: Column) -> Column:
        return x["sstart"] + x["windows"]

    heads = F.filter("p", lambda x, k: (k == 0) | (ends(F.get("p", k - 1)) != x["sstart"]))
    tails = F.filter("p", lambda x, k: (k == F.size("p") - 1) | (ends(x) != F.get("p", k + 1)["sstart"]))
    whole = F.explode(F.zip_with(heads, tails, lambda a, b: F.struct(a["sstart"].alias("sstart"), (ends(b) - a["sstart"]).alias("windows"))))
    return held.select("doc", "print", "sdoc", "sprint", "shift", whole.alias("x")).select("doc", "print", (F.col("x.sstart") + F.col("shift")).alias("start"), "x.windows", "sdoc", "sprint", "x.sstart")


def _edges(texts: DataFrame, open_: DataFrame, tables: Tables) -> DataFrame:
    """e1, e2, doc, print and start of the edges of runs that differ under one minimizer."""
    arrow = pa.schema([(c, pa.int64()) for c in ("e1", "e2", "doc", "print", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                starts, ends, first = T.words(data, offs)
                h = T.span_hash(data, starts, ends)
                found = A.segments(h, first, SHAPE)
                content = found.content()
                bounds = np.searchsorted(found.row, np.arange(part.num_rows + 1))
                lists = part.column("open")
                wanted = [np.arange(a, b)[np.isin(content[a:b], lists[k].values.to_numpy())] for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
                at = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
                count = found.windows[at]
                row = np.repeat(found.row[at], count)
                start = np.repeat(found.start[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                size = np.full(len(start), SHAPE.length)
                e1, e2 = (T.signed(A.content_hash(h, start, size, seed)) for seed in (0, 1))
                yield T.batch_of(arrow, e1, e2, part.column("doc").to_numpy()[row], part.column("print").to_numpy()[row], start - first[row])

    likely = kept_by(bloom(open_, "doc", tables))
    rows = texts.select("doc", "print", "text").mapInArrow(likely, "doc long, print long, text string").join(open_, "doc")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in arrow.names))


def repeats(texts: DataFrame) -> DataFrame:
    """doc, print, start, windows and SOURCE of the spans that a document with a smaller key has."""
    tables = Tables()
    often = A.repeated_anchors(texts, read)
    rows = tables.cut(occurrences(texts, often, tables))
    drop(often)
    run, edge = ["anchor", "content"], ["e1", "e2"]
    runs = tables.cut(_first(rows, run, ("before", "behind", "windows")))
    several = tables.cut(runs.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"))
    open_ = spread_join(runs.select(*run, "first"), several, ["anchor"], "k").groupBy(F.col("first").alias("doc")).agg(F.collect_list("content").alias("open"))
    edges = tables.cut(_edges(texts, tables.cut(open_), tables))
    shared = tables.cut(_first(edges, edge).filter(F.col("last") > F.col("first")).select(*edge, "first", "n"))
    later, sources = _sourced(edges, shared, edge, tables)
    single = spread_join(later, sources, edge, "n").select("doc", "print", "start", F.lit(1).cast("long").alias("windows"), F.lit(-1).cast("long").alias("head"), *SOURCE)
    repeated = tables.cut(runs.filter(F.col("last") > F.col("first")).select(*run, "first", "n"))
    later, sources = _sourced(rows.select(*run, "doc", "print", "start", "windows"), repeated, run, tables)
    graph = tables.cut(runs.select(*run, "before", "behind", "windows").join(sources, run, "left"))
    known = tables.cut(sources.join(paths(graph), SOURCE))
    whole = spread_join(later, known, run, "n").select("doc", "print", "start", "windows", "head", *SOURCE)
    out = A.cut(spans(whole, "head").union(spans(single, "head")))
    tables.drop()
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _words(data: np.ndarray, offs: np.ndarray) -> Callable[[int], list[bytes]]:
    """The words of a row."""
    starts, ends, first = T.words(data, offs)

    def of(row: int) -> list[bytes]:
        base, raw = offs[row], data[offs[row] : offs[row + 1]].tobytes()
        at = slice(int(first[row]), int(first[row + 1]))
        return [raw[s:e] for s, e in zip((starts[at] - base).tolist(), (ends[at] - base).tolist(), strict=True)]

    return of


def digested(texts: DataFrame, found: DataFrame) -> DataFrame:
    """SOURCE, windows, digest and uses of the sources of spans, from their texts."""
    tables = Tables()
    wanted = tables.cut(found.groupBy(*SOURCE, "windows").agg(F.count("*").alias("uses")))
    each = tables.cut(wanted.groupBy("sdoc", "sprint").agg(F.count("*").alias("k")))
    share = F.pmod(F.xxhash64("sstart", "windows"), F.ceil(F.col("k") / ASKED)).alias("share")
    shared = spread_join(wanted, each, ["sdoc", "sprint"], "k").select(F.col("sdoc").alias("doc"), F.col("sprint").alias("print"), share, F.struct("sstart", "windows", "uses").alias("a"))
    asked = tables.cut(shared.groupBy("doc", "print", "share").agg(F.collect_list("a").alias("asked")).drop("share"))
    arrow = pa.schema([*[(c, pa.int64()) for c in (*SOURCE, "windows")], ("digest", pa.binary()), ("uses", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                of, rows = _words(data, offs), []
                for k, (doc, print_, asked_) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc", "print", "asked")), strict=True)):
                    words = of(k)
                    rows += [(doc, print_, a["sstart"], a["windows"], _digest(words[a["sstart"] : a["sstart"] + a["windows"] + NODE]), a["uses"]) for a in asked_]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    rows = texts.select("doc", "print", "text").mapInArrow(kept_by(bloom(asked, "doc", tables)), "doc long, print long, text string").join(asked, ["doc", "print"])
    schema = "sdoc long, sprint long, sstart long, windows long, digest binary, uses long"
    # Rows that repeat a document and its text give the same digests.
    out = A.cut(rows.mapInArrow(run, schema).dropDuplicates([*SOURCE, "windows"]))
    tables.drop()
    return out


#: Makes the result's batches from batches of doc, text, row and spans (start, windows and digest).
Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def removed(docs: DataFrame, finish: Finish, schema: str | StructType, carried: list[str] | None = None) -> DataFrame:
    """``finish`` over doc, text, row (the columns carried) and spans (start, windows, digest) of all
    rows. Only texts that may lose something are shuffled to meet what they lose."""
    texts = _texts(docs, carried or [])
    found = repeats(texts)
    sources = digested(texts, found)
    known = spread_join(found, sources, [*SOURCE, "windows"], "uses")
    lost = A.cut(known.groupBy("doc", "print").agg(F.collect_set(F.struct("start", "windows", "digest")).alias("spans")))
    drop(found)
    drop(sources)
    filter_ = bloom(lost, "doc")
    losing = texts.mapInArrow(kept_by(filter_), texts.schema).join(lost, ["doc", "print"], "left")
    others = kept_by(filter_, False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filled() -> Iterator[pa.RecordBatch]:
            for batch in others(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.nulls(batch.num_rows)], names=["doc", "text", "row", "spans"])

        return finish(filled())

    return losing.select("doc", "text", "row", "spans").mapInArrow(finish, schema).union(texts.mapInArrow(whole, schema))


def _kept(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """n_words, n_removed and the kept words, joined by one space, of each row."""
    of = _words(data, offs)
    for row, spans_ in enumerate(part.column("spans").to_pylist()):
        words = of(row)
        keep = np.ones(len(words), bool)
        for span in spans_ or ():
            at = slice(span["start"], span["start"] + span["windows"] + NODE)
            if _digest(words[at]) == span["digest"]:
                keep[at] = False
        kept = int(keep.sum())
        yield len(words), len(words) - kept, b" ".join(words if kept == len(words) else [words[k] for k in np.flatnonzero(keep).tolist()])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                rows = [(n, gone, hashlib.sha256(words).hexdigest()) for n, gone, words in _kept(part, data, offs)]
                yield T.batch_of(arrow, A.ids(part.column("doc")), *zip(*rows, strict=True))

    return removed(docs, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the word spans that an earlier document has: texts that lose words
    become the others, joined by a space; the rest stay as they are. A column n_chars follows the text."""
    others = [c for c in docs.columns if c.lower() != "text"]
    text = next(c for c in docs.columns if c.lower() == "text")
    schema = StructType([StructField("row", StructType([StructField("_", BooleanType()), *[docs.schema[c] for c in others]])), StructField("text", StringType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                rows = [(w.decode() if gone else old, gone) for old, (_, gone, w) in zip(part.column("text").to_pylist(), _kept(part, data, offs), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["row", "text", "n_removed"])

    made = removed(docs, run, schema, others)
    columns = {c: F.col(f"row.`{c}`") for c in others} | {text: F.col("text").cast(docs.schema[text].dataType)}
    for c in others:
        if c.lower() == "n_chars":
            columns[c] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns[c]).cast(docs.schema[c].dataType)
    return made.select([columns[c].alias(c) for c in docs.columns])
