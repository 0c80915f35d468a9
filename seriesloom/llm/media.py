"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized, stored as NPY tiles.

``decode`` reads PBM/PGM/PPM (plain and raw) and uncompressed 8/24/32-bit BMP; ``area_resize``
averages exact pixel areas through an integral image; ``tiles`` / ``npy_bytes`` store samples
losslessly; ``difference_hash`` compares neighbours of a 9 x 8 thumbnail.

``media_features`` carries texts through that path: a payload becomes a grey image of 24 columns,
is encoded as raw PGM, decoded, cut into 24 x 24 tiles, written as NPY, read back, and described.
Null text counts as empty; an empty text has one tile of 255. Repeated rows give repeated results.
The work is one narrow pass without shuffle, and memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 24
PAD = 255


class MediaError(ValueError):
    """Bytes that are no supported image."""


def _header(raw: bytes, count: int) -> tuple[list[int], int]:
    """The next ``count`` numbers of a Netpbm header (after the magic) and the place behind them."""
    found: list[int] = []
    at = 2
    while len(found) < count:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            end = raw.find(b"\n", at)
            at = len(raw) if end < 0 else end + 1
            continue
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise MediaError("header cut short")
        found.append(int(raw[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1-P6 as a uint8 or uint16 array of rows x columns (x 3 for colour); PBM's 1 is black (0)."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm magic")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _header(raw, 2 if bitmap else 3)
    wide, high, top = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if not 0 < top < 65536:
        raise MediaError("bad maximum value")
    shape = (high, wide, 3) if kind in (b"P3", b"P6") else (high, wide)
    count = int(np.prod(shape))
    if kind == b"P1":
        bits = np.frombuffer(raw[at - 1 :], np.uint8)
        bits = bits[(bits == 48) | (bits == 49)][:count] - 48
        values = (1 - bits) * 255
    elif kind in (b"P2", b"P3"):
        values = np.array(raw[at:].split()[:count], dtype=np.int64)
    elif kind == b"P4":
        row = (wide + 7) // 8
        packed = np.frombuffer(raw, np.uint8, offset=at)[: row * high]
        if len(packed) < row * high:
            raise MediaError("samples cut short")
        values = ((1 - np.unpackbits(packed.reshape(high, row), axis=1)[:, :wide]) * 255).ravel()
    else:
        kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
        values = np.frombuffer(raw, kind_of, count=min(count, (len(raw) - at) // kind_of.itemsize), offset=at)
    if len(values) < count:
        raise MediaError("samples cut short")
    return values.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as rows x columns x 3, top row first."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise MediaError("no BMP magic")
    start, size, wide, high, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if packing != 0 or bits not in (8, 24, 32) or wide <= 0 or high == 0:
        raise MediaError("unsupported BMP")
    row = (wide * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(raw, np.uint8, offset=start)[: row * abs(high)]
    if len(body) < row * abs(high):
        raise MediaError("samples cut short")
    body = body.reshape(abs(high), row)[:, : wide * bits // 8]
    if bits == 8:
        colours = np.frombuffer(raw, np.uint8, offset=14 + size)[: (start - 14 - size) // 4 * 4].reshape(-1, 4)
        image = colours[body][:, :, 2::-1]
    else:
        image = body.reshape(abs(high), wide, bits // 8)[:, :, 2::-1]
    return image[::-1] if high > 0 else image


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_pgm(samples: np.ndarray) -> bytes:
    high, wide = samples.shape
    return b"P5\n%d %d\n255\n" % (wide, high) + samples.astype(np.uint8).tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """One channel; colour by the weights 0.299, 0.587 and 0.114."""
    return image.astype(np.float64) if image.ndim == 2 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over exact, possibly fractional pixel areas, from an integral image."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def lines(size: int, parts: int, axis: int) -> np.ndarray:
        at = np.arange(parts + 1) * (size / parts)
        low = np.minimum(at.astype(np.int64), size - 1)
        part = at - low
        a, b = np.take(total, low, axis), np.take(total, low + 1, axis)
        part = part[:, None] if axis == 0 else part[None, :]
        return a + (b - a) * part

    total = lines(image.shape[0], high, 0)
    total = lines(image.shape[1], wide, 1)
    area = (image.shape[0] / high) * (image.shape[1] / wide)
    return (total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8 x 9 thumbnail is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tiles(image: np.ndarray, side: int = TILE) -> np.ndarray:
    """Tiles x side x side of an image whose sides are multiples of ``side``, row by row."""
    high, wide = image.shape
    return image.reshape(high // side, side, wide // side, side).swapaxes(1, 2).reshape(-1, side, side)


def npy_bytes(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(samples), allow_pickle=False)
    return out.getvalue()


def stored_form(payload: bytes) -> bytes:
    """A payload of 576 k bytes as NPY tiles, by way of a PGM image of 24 columns."""
    image = decode(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, TILE)))
    return npy_bytes(tiles(image))


def read_back(stored: bytes) -> np.ndarray:
    return np.load(io.BytesIO(stored), allow_pickle=False)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tiles", pa.int64())])


def describe(text: bytes) -> tuple:
    step = TILE * TILE
    size = max(step, -(-len(text) // step) * step)
    stored = stored_form(text + bytes([PAD]) * (size - len(text)))
    samples = read_back(stored)
    back = samples.tobytes()
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(samples.reshape(-1, TILE)), len(samples)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [describe(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.large_binary())]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(ARROW)[1:], strict=True))], schema=ARROW)


def media_features(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text); other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_describe, SCHEMA)
