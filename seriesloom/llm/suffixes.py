"""Suffix-array dedup of byte strings by longest-previous-factor arrays.

Every byte that lies in a 100-byte string which also starts earlier (in a document with a smaller
doc_id, or earlier in the same one) is removed; the first place stays.

Anchors (see ``anchors``) deal the places that can match into buckets: all places of a 100-byte
string share its anchor. Segments that equal an earlier one whole are decided by an aggregate. For
the others a task sorts the suffixes of many buckets into one suffix array to the depth of 100
bytes, with the longest common prefixes of neighbours. The nearest suffix before and behind in this
order that starts earlier gives the longest previous factor; places where it reaches 100 bytes go.
Buckets with very many segments are dealt further, by the content of single windows.

Null text counts as empty; texts below 100 bytes lose nothing. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import anchors as A
from seriesloom.llm import text as T
from seriesloom.llm.graph import drop

SHAPE = A.Shape(100, 20)
#: Segments of one anchor from which its windows are dealt singly, and windows in a share of them.
HOT_SEGMENTS, SHARE = 50_000, 40_000
BATCH = 1 << 19


#: What bytes weigh when anchors are chosen.
WEIGHTS = T.mix(np.arange(1, 257, dtype=T.U64))


def read(data: np.ndarray, offs: np.ndarray) -> A.Segments:
    return A.segments(WEIGHTS[data], offs, SHAPE, lambda a, b, seed: T.span_hash(data, a, b, seed))


def previous_factors(text: np.ndarray, starts: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For suffixes at ``starts``, at least ``depth`` bytes long: the length, to ``depth``, of the
    longest prefix that a suffix with a smaller ``order`` has too. Suffixes of equal order don't count."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(text, depth)[starts]
    rank = np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")
    rows = rows[rank]
    differ = rows[1:] != rows[:-1]
    common = [0, *np.where(differ.any(1), differ.argmax(1), depth).tolist()]
    place = order[rank].tolist()
    best = [0] * n
    for k_range, step in ((range(n), 1), (range(n - 1, -1, -1), -1)):
        stack: list[tuple[int, int]] = []  # orders, growing, each with the common prefix to the one before
        for k in k_range:
            lcp = common[k] if step == 1 else (common[k + 1] if k + 1 < n else 0)
            while stack and stack[-1][0] >= place[k]:
                lcp = min(lcp, stack.pop()[1])
            if stack:
                best[k] = max(best[k], lcp)
            else:
                lcp = 0
            stack.append((place[k], lcp))
    out = np.zeros(n, np.int64)
    out[rank] = best
    return out


def repeated(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes that share their first ``depth`` bytes with another: what has neighbours
    with such a common prefix in the suffix order. All others reach no factor of that length."""
    words = np.zeros((len(starts), -(-depth // 8) * 8), np.uint8)
    words[:, :depth] = np.lib.stride_tricks.sliding_window_view(text, depth)[starts]
    key = T.mix(np.full(len(starts), depth, T.U64))
    for column in words.view("<u8").T:
        key = T.mix(key ^ column)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(starts), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    return np.flatnonzero(shared)


def _fetched(found: A.Found) -> DataFrame:
    """Segments (or single windows of hot anchors) to compare: bucket, doc, start, content, place, bytes."""
    arrow = pa.schema([("anchor", pa.int64()), ("share", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("content", pa.int64()), ("place", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                segments = read(data, offs)
                contents, anchors = segments.content(), T.signed(segments.anchor)
                rows: list[tuple] = []
                for row, (doc, open_) in enumerate(zip(part.column("doc").to_pylist(), part.column("open"), strict=True)):
                    fields = open_.values
                    hot = {a: c for a, c in zip(fields.field("anchor").to_pylist(), fields.field("classes").to_pylist(), strict=True) if c > HOT_SEGMENTS}
                    for k in A.chosen(segments, contents, row, fields.field("content").to_numpy()).tolist():
                        at, n = int(segments.start[k]), int(segments.windows[k])
                        anchor, content = int(anchors[k]), int(contents[k])
                        raw = data[at : at + n - 1 + SHAPE.length].tobytes()
                        begin = at - int(offs[row])
                        if anchor not in hot:
                            rows.append((anchor, 0, doc, begin, content, 0, raw))
                            continue
                        shares = -(-hot[anchor] * (SHAPE.length - SHAPE.k) // SHARE)
                        for j in range(n):
                            window = raw[j : j + SHAPE.length]
                            share = 1 + int.from_bytes(hashlib.blake2b(window, digest_size=4).digest(), "little") % shares
                            rows.append((anchor, share, doc, begin + j, content, j, window))
                if rows:
                    yield T.batch_of(arrow, *zip(*rows, strict=True))

    return A.opened(found).mapInArrow(run, "anchor long, share int, doc long, start long, content long, place int, bytes binary")


def _later_windows(rows: DataFrame) -> DataFrame:
    """doc, content and place of the windows that start earlier elsewhere."""
    arrow = pa.schema([("doc", pa.int64()), ("content", pa.int64()), ("place", pa.int32())])

    def decide(buckets: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(buckets).combine_chunks()
        sizes = np.array([len(x) for x in table["bytes"].to_pylist()], np.int64)
        text = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        doc, start = table["doc"].to_numpy(), table["start"].to_numpy()
        windows = sizes - SHAPE.length + 1
        row = np.repeat(np.arange(len(sizes)), windows)
        j = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + j
        by = np.lexsort((start[row] + j, doc[row]))
        d, s = doc[row][by], (start[row] + j)[by]
        step = np.ones(len(by), bool)
        step[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(step)
        gone = np.zeros(len(at), bool)
        again = repeated(text, at, SHAPE.length)
        gone[again] = previous_factors(text, at[again], order[again], SHAPE.length) >= SHAPE.length
        return T.batch_of(arrow, doc[row[gone]], table["content"].to_numpy()[row[gone]], (table["place"].to_numpy()[row[gone]] + j[gone]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        last = None
        for batch in batches:
            anchor, share = batch.column("anchor").to_numpy(), batch.column("share").to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])
            if batch.num_rows:
                new[0] = (anchor[0], share[0]) != last
                last = (anchor[-1], share[-1])
            at, length = 0, np.cumsum([len(x) for x in batch.column("bytes").to_pylist()])
            for cut_at in np.flatnonzero(new).tolist():
                grown = size + int(length[cut_at - 1] if cut_at else 0) - int(length[at - 1] if at else 0)
                if grown >= BATCH and (held or cut_at > at):
                    yield decide([*held, batch.slice(at, cut_at - at)] if cut_at > at else held)
                    held, size, at = [], 0, cut_at
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += int(length[-1]) - int(length[at - 1] if at else 0)
        if held:
            yield decide(held)

    return rows.repartition("anchor", "share").sortWithinPartitions("anchor", "share").mapInArrow(run, "doc long, content long, place int")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                segments = read(data, offs)
                content = segments.content()
                rows = []
                for row, (later, single) in enumerate(zip(part.column("later"), part.column("single"), strict=True)):
                    a, b = int(offs[row]), int(offs[row + 1])
                    whole = later.values.to_numpy() if later.is_valid else np.zeros(0, np.int64)
                    windows = (single.values.field("content").to_numpy(), single.values.field("place").to_numpy()) if single.is_valid else (whole[:0], whole[:0])
                    s, e = A.covered(segments, content, row, whole, windows, SHAPE.length)
                    raw = data[a:b].tobytes()
                    digest, at = hashlib.sha256(), 0
                    for x, y in zip((s - a).tolist(), (e - a).tolist(), strict=True):
                        digest.update(raw[at:x])
                        at = y
                    digest.update(raw[at:])
                    rows.append((b - a, int((e - s).sum()), len(s), digest.hexdigest()))
                yield T.batch_of(arrow, A.ids(part.column("doc")), *zip(*rows, strict=True))

    found = A.search(docs, read)
    single = _later_windows(_fetched(found)).groupBy("doc").agg(F.collect_set(F.struct("content", "place")).alias("single"))
    out = A.finished(found, single, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    drop(found.open_)
    return out
