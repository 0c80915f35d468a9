"""Vectorised byte, word and fingerprint primitives shared by the corpus operators.

Arrow batches are cut into chunks of bounded byte size, and every chunk is handled as one flat
UTF-8 buffer with document offsets, so that numpy sees long arrays however short the texts are.
Fingerprints are 64-bit hashes that take their input value after value through a bijective
finaliser; they are equal for equal input on every executor because they start from fixed seeds, and
those of two seeds are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Words are maximal runs of bytes other than these (\x20 and \x09-\x0D).
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True
#: UTF-8 of Unicode's white space beyond ASCII.
WIDE_SPACES = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
LEAD = np.zeros(256, bool)
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True

U64 = np.uint64


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    data, offs = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def unicode_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters of Unicode's White_Space."""
    space = IS_SPACE[data]
    lead = np.flatnonzero(LEAD[data])
    if len(lead):
        three = np.concatenate([data, np.zeros(2, np.uint8)])[lead[:, None] + np.arange(3)].astype(np.int64)
        code = three[:, 0] << 16 | three[:, 1] << 8 | three[:, 2]
        two = np.isin(code >> 8, WIDE_SPACES[WIDE_SPACES < 1 << 16])
        long = np.isin(code, WIDE_SPACES[WIDE_SPACES >= 1 << 16])
        space[lead[two | long]] = True
        space[lead[two | long] + 1] = True
        space[lead[long] + 2] = True
    return space


def coded_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column's texts, for each word in order its place among these, and for
    each text the range of its words (n + 1 offsets).

    Words are runs without Unicode white space, with A-Z lower-cased, and a point or comma at the end
    after an ASCII letter is a word of its own: what a tokenizer that lower-cases, drops white space
    and never joins letters to points makes the same of. Where a text may hold special tokens,
    which have a case, nothing is lower-cased."""
    data, offs = flat(column)
    if b"<|" not in data.tobytes():
        data = LOWER[data]
    space = unicode_space(data)
    mark = np.flatnonzero((data == 46) | (data == 44))
    mark = mark[mark > 0]
    after = np.concatenate([space, [True]])[mark + 1] | np.isin(mark + 1, offs)
    mark = mark[after & LETTER[data[mark - 1]] & ~np.isin(mark, offs)]
    starts, ends, first = words(data, offs, space, mark)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[~space])).dictionary_encode()
    return held.dictionary.to_pylist(), held.indices.to_numpy(), first


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray | None = None, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the range of its words (n + 1 offsets).
    space: what counts as white space; also: places inside words where another word starts."""
    solid = ~(IS_SPACE[data] if space is None else space)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    starts[cut] |= solid[cut]
    ends[cut - 1] |= solid[cut - 1]
    if also is not None:
        starts[also] = True
        ends[also - 1] = True
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Where the fingerprints of a seed start from.
SEEDS = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
#: Spans with more bytes are hashed by BLAKE2b.
LONG_SPAN = 256


def chained(h: np.ndarray, count: np.ndarray, value: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """h after ``count`` values each. value(rows, j): the values j of some rows."""
    order = np.argsort(-count, kind="stable")
    more = count[order]
    for j in range(int(more[0]) if len(more) else 0):
        rows = order[: len(more) - int(np.searchsorted(more[::-1], j, "right"))]
        h[rows] = mix(h[rows] ^ value(rows, j))
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of the byte spans [start, end): eight bytes after eight go through the
    finaliser, which no sum of bytes undoes."""
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(U64) ^ U64(SEEDS[seed]))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    tail = U64(2**64 - 1) >> (U64(8) * (U64(8) - np.arange(9, dtype=U64)).clip(0, 7).astype(U64))
    short = np.flatnonzero(size <= LONG_SPAN)
    first, left = starts[short], size[short]
    h[short] = chained(h[short], (left + 7) // 8, lambda rows, j: eight[first[rows] + 8 * j] & tail[np.minimum(left[rows] - 8 * j, 8)])
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        h[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of all k consecutive values (also of those that cross documents)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, SEEDS[seed] + k, U64)
    for j in range(k):
        out ^= h[j : n + j]
        out *= U64(0xBF58476D1CE4E5B9)
        out ^= out >> U64(29)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def long_column(values) -> pa.Array:
    return pa.array(values, pa.int64())


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
