"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words the
whole sequence is one shingle, and without words the set is empty. Documents with an intersection
of ``threshold`` per cent of the union or more are linked: 85 in ``near_duplicates``, 80 in
``kept_documents``, which the pipeline runs.

* Documents with equal sets fall into classes, by a digest of the set; only one of each goes on.
* A sketch keeps the K smallest hash values of a set. Sets that are linked share at least ``least_overlap``
  retained values with a probability of failure below 1e-8 a link; a set that is no larger than its
  sketch shares ``least_shared`` with certainty, which allows for what a larger set's sketch drops. So in the order of rarity two such sketches meet in their first
  K - least_overlap + 1 values: an inverted list of a value holds only documents with the value there,
  and values that very many documents share hardly occur.
* Lists generate pairs through pivots. The member whose retained values are the most common is
  paired with the others, which costs a pair for each member and mostly joins a dense group at once.
* The members of all lists with the same pivot are a family; linked documents have a family in
  common. Families that are still in several components are compared whole, in blocks of bounded
  size, by the exact intersections of full sets as a matrix product. A block gives a spanning
  forest of its links, never its pairs.
* The estimate from the union's sketch drops pairs far below the threshold; the exact intersection
  of the full sets, made anew from the texts of the documents concerned, decides.

Shingles are held equal by a 64-bit fingerprint (of two sets of 10,000, two different shingles are
taken for one with a probability of 5e-12), sets by 128 bits. Null text counts as empty: such
documents are linked with nothing. Rows that repeat a doc_id get a row each. A row without a doc_id is a document named by its
text: it is no component's id, and stays only where it is the first of a component without ids.
Copies are never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import text as T
from seriesloom.llm.anchors import NO_ID, doc_key
from seriesloom.llm.graph import Tables, bloom, components, cut, drop, kept_by, spread_join

SHINGLE = 5
#: Per cent of the union: what ``near_duplicates`` links, and what the pipeline's stage does.
THRESHOLD = 85
PIPELINE_THRESHOLD = 80
K = 48


@lru_cache
def least_overlap(threshold: int, failure: float = 1e-8) -> int:
    """The number of shared values that the sketches of sets at the threshold fall below with a
    probability under ``failure``. The worst case is a set inside the other: each of the K smallest
    values of the union is shared with the probability of the threshold, and values drawn without
    replacement spread less than the binomial distribution here."""
    p, below = threshold / 100, 0.0
    for m in range(K + 1):
        below += comb(K, m) * p**m * (1 - p) ** (K - m)
        if below >= failure:
            return m
    return K


@lru_cache
def least_shared(n: int, threshold: int) -> int:
    """The fewest retained values that a set of n <= K values shares with any set it is linked with:
    of a set of m values, the sketch drops m - K, and all of these may be shared."""
    least = n
    for m in range(-(-n * threshold // 100), n * 100 // threshold + 1):
        common = -(-threshold * (n + m) // (100 + threshold))
        if common <= min(n, m):
            least = min(least, common - max(0, m - K))
    return least


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the sorted shingle hashes of each document."""
    for part, data, offs in T.chunks(batch, "text"):
        data = T.LOWER[data]
        starts, ends, first = T.words(data, offs)
        h = T.span_hash(data, starts, ends)
        g = T.signed(T.grams(h, SHINGLE))
        sets = []
        for at, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if end - at >= SHINGLE:
                sets.append(np.unique(g[at : end - SHINGLE + 1]))
            else:
                sets.append(T.signed(T.grams(h[at:end], end - at, 1)) if end > at else np.zeros(0, np.int64))
        yield part, sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _digests(sets: list[np.ndarray]) -> tuple[list[int | None], list[int | None]]:
    """Two independent digests of each set, null if it is empty."""
    raw = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return tuple([None if r is None else int.from_bytes(r[at : at + 8], "little", signed=True) for r in raw] for at in (0, 8))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(doc_key(F.col("doc_id"), text).alias("doc"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc (the key), print (of the text), n_shingles, digest and check (null if empty) and sketch of
    each row of ``docs``."""
    arrow = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.int64()), ("check", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch):
                yield T.batch_of(arrow, part.column("doc"), part.column("print"), [len(s) for s in sets], *_digests(sets), _lists([s[:K] for s in sets]).cast(arrow.field(5).type))

    return _keyed(docs).withColumn("print", F.xxhash64("text")).mapInArrow(run, "doc long, print long, n_shingles long, digest long, check long, sketch array<long>")


def set_classes(rows: DataFrame) -> DataFrame:
    """node, digest, check, doc, n, sketch and rows of the different sets of ``rows``; doc is the smallest
    with an id that has the set, rows how many have it. Sets are equal if both digests are; the node is the first, and another number
    for the very few classes that share it."""
    made = rows.filter("n_shingles > 0").groupBy("digest", "check").agg(F.coalesce(F.min(F.when(F.col("doc") >= NO_ID, F.col("doc"))), F.min("doc")).alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    classes = cut(made)
    shared = cut(classes.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest", F.lit(True).alias("shared")))
    if shared.isEmpty():
        return classes.withColumn("node", F.col("digest"))
    return cut(classes.join(shared, "digest", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("digest", "check")).otherwise(F.col("digest"))).drop("shared"))


def _full_sets(docs: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """node and set of the classes in ``wanted`` (doc, node, digest, check), from the text of the document named."""
    arrow = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch):
                told = zip(part.column("digest").to_pylist(), part.column("check").to_pylist(), strict=True)
                right = [k for k, (want, got) in enumerate(zip(told, zip(*_digests(sets), strict=True), strict=True)) if want == got]  # rows that repeat a doc_id may differ
                yield T.batch_of(arrow, part.column("node").take(pa.array(right, pa.int64())), _lists([sets[k] for k in right]).cast(arrow.field(1).type))

    likely = kept_by(bloom(wanted, "doc", tables))
    rows = _keyed(docs).mapInArrow(likely, "doc long, text string").join(wanted, "doc")
    return rows.select("node", "digest", "check", "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def _long_enough(a: Column, b: Column, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def inverted(classes: DataFrame, threshold: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The lists of values that are worth meeting in: value, node and n; and value, pivot, np and df
    (the list's length) of lists of two or more."""
    posted = classes.select("node", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    own = Tables()
    often = own.cut(posted.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = spread_join(posted, often, ["value"], "df")
    by_node = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sum("df").alias("common"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    need = F.when(F.col("n") <= K, F.element_at(F.array(*[F.lit(least_shared(n, threshold)) for n in range(1, K + 1)]), F.least("n", F.lit(K)).cast("int"))).otherwise(F.lit(least_overlap(threshold)))
    first = F.greatest(F.lit(0), F.col("k") - need + 1 - (F.col("k") - F.size("values")))  # values of one document come first
    front = tables.cut(by_node.select("node", "n", "common", F.explode(F.slice("values", 1, first.cast("int"))).alias("v")).select("node", "n", "common", "v.value"))
    own.drop()
    best = F.min(F.struct((-F.col("common")).alias("common"), "node", "n"))  # the most common values
    pivots = tables.cut(front.groupBy("value").agg(best.alias("p"), F.count("*").alias("df")).select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("np"), "df"))
    return front.select("value", "node", "n"), pivots


#: Shingles and sets in a block of a family that is compared whole, about.
BLOCK, BLOCK_SETS = 1 << 18, 1 << 10


def links(docs: DataFrame, classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The components (node, component) of classes (node, digest, check, doc, n, sketch) that are linked."""
    tables, own = Tables(), Tables()
    lists, pivots = inverted(classes, threshold, own)
    pivots = pivots.filter("df > 1")
    families = tables.cut(spread_join(lists, pivots, ["value"], "df").select("pivot", "np", "node", "n").distinct())
    own.drop()
    sets = tables.cut(_full_sets(docs, tables.cut(classes.join(families.select("node").distinct(), "node", "left_semi").select("doc", "node", "digest", "check")), tables))
    pairs = families.filter((F.col("pivot") != F.col("node")) & _long_enough(F.col("np"), F.col("n"), threshold)).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    edges = tables.cut(verified(classes, sets, pairs, threshold))
    label = components(edges)
    marked = families.select("pivot", "node", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("pivot").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).filter((F.col("x") != F.col("y")) & (F.col("k") > 2)).select("pivot")
    found = tables.cut(compared(marked.join(mixed, "pivot", "left_semi"), sets, threshold, own))
    own.drop()
    out = components(edges.union(found))
    tables.drop()
    return out


def verified(classes: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: sketches first, then full sets."""
    side = classes.select("node", "n", "sketch")
    near = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    share = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    near = near.filter(share >= least_overlap(threshold, 1e-9) / K).select("a", "b", "na", "nb")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", "na", "nb", common.alias("c")).filter(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * threshold).select("a", "b")


def linked_pairs(sets: list[np.ndarray], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of sorted sets, by exact intersections."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[value] > 1
    row, value = row[shared], value[shared]
    _, column = np.unique(value, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    wide = max(1, (1 << 24) // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [low, low + wide])
        matrix = np.zeros((len(sets), min(wide, int(column[-1]) + 1 - low)), np.float32)
        matrix[row[a:b], column[a:b] - low] = 1
        common += matrix @ matrix.T
    near = common.astype(np.float64) * 100 >= (n[:, None] + n[None, :] - common) * threshold
    return np.nonzero(np.triu(near, 1))


def compared(members: DataFrame, sets: DataFrame, threshold: int, tables: Tables) -> DataFrame:
    """Links (a, b) that join the components in families (pivot, node, n, component), by blocks.

    Members of a family are dealt by size, in steps of 4 per cent, and members of like size to as many
    blocks as they need, by a hash; blocks meet where their sizes allow a link."""
    placed = tables.cut(members.withColumn("like", F.floor(F.log2("n") / F.lit(log2(1.04))).cast("int")))
    sizes = placed.groupBy("pivot", "like").agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    sizes = tables.cut(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("all") / BLOCK, F.col("k") / BLOCK_SETS)).cast("int")))
    placed = spread_join(placed, sizes.select("pivot", "like", "blocks", "k"), ["pivot", "like"], "k").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    ends = sizes.select("pivot", "like", "low", "high", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    own = ends.select("pivot", F.struct("like", "part").alias("i"), F.col("high").alias("h"))
    met = own.join(ends.select("pivot", F.struct("like", "part").alias("j"), F.col("low").alias("l")), "pivot")
    met = met.filter((F.col("i") <= F.col("j")) & (F.col("h") * 100 >= F.col("l") * threshold)).select("pivot", "i", "j")
    sides = met.select("pivot", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).select("pivot", "i", "j", "block.*")
    rows = placed.join(sides, ["pivot", "like", "part"]).join(sets, "node").select("pivot", "i", "j", "node", "component", "set")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        component = group["component"].to_numpy()
        if (component == component[0]).all():
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = linked_pairs([np.asarray(s, np.int64) for s in group["set"]], threshold)
        root = {x: x for x in component.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        node = group["node"].to_numpy()
        differ = component[a] != component[b]
        for x, y in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
            p, q = top(int(component[x])), top(int(component[y]))
            if p != q:
                root[p] = q
                out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)

    return rows.groupBy("pivot", "i", "j").applyInPandas(compare, "a long, b long")


def _decided(docs: DataFrame, threshold: int) -> DataFrame:
    """doc, print, n_shingles, component_id and first (the key of the document that stays) of each row."""
    whole = cut(sketches(docs))
    classes = set_classes(whole)
    rows = cut(whole.drop("sketch"))
    drop(whole)
    found = links(docs, classes, threshold)
    of = classes.select("node", "digest", "check", "doc", "rows").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    has_id = F.col("doc") >= NO_ID
    smallest = of.groupBy("component").agg(F.min(F.when(has_id, F.col("doc"))).alias("component_id"), F.min("doc").alias("any"))
    smallest = smallest.select("component", "component_id", F.coalesce("component_id", "any").alias("first"))
    class_of = cut(of.select("digest", "check", "component", "rows").join(smallest, "component").select("digest", "check", "component_id", "first", "rows"))
    drop(classes)
    columns = ["doc", "print", "n_shingles", "component_id", "first"]
    linked = spread_join(rows.filter("n_shingles > 0"), class_of, ["digest", "check"], "rows").select(columns)
    empty = rows.filter("n_shingles = 0").select("doc", "print", "n_shingles", F.when(has_id, F.col("doc")).alias("component_id"), F.col("doc").alias("first"))
    return linked.unionByName(empty)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    out = _decided(docs, threshold)
    return out.select(F.when(F.col("doc") >= NO_ID, F.col("doc")).alias("doc_id"), "n_shingles", "component_id", (F.col("doc") == F.col("first")).alias("kept"))


def kept_documents(docs: DataFrame, threshold: int = PIPELINE_THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component: of rows that repeat a
    doc_id each is decided by its own text, and of rows that repeat both one stays."""
    decided = cut(_decided(docs, threshold).select("doc", "print", "first"))
    gone = decided.filter(F.col("doc") != F.col("first")).select("doc", "print").distinct()
    twice = cut(decided.groupBy("doc", "print").agg(F.count("*").alias("k")).filter("k > 1").select("doc", "print"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key(F.col("doc_id"), text).alias("doc"), F.xxhash64(text).alias("print"))
    rows = rows.join(gone, ["doc", "print"], "left_anti")
    if not twice.isEmpty():
        rows = rows.join(twice, ["doc", "print"], "left_anti").unionByName(rows.join(twice, ["doc", "print"], "left_semi").dropDuplicates(["doc", "print"]))
    return rows.select("row.*")
