"""Token counts: lengths of byte-level BPE encodings; the ids never leave the Arrow function.

Texts are cut at safe boundaries, where the vocabulary's pattern ends a pre-token whatever stands
around it, so that the lengths of the parts add up to that of the whole. Single white space between
words is one: it parts texts into short units, of which Arrow finds the distinct ones. These go to the
tokenizers library's batch call in batches of about ``BATCH`` bytes, whatever the number of rows in an
Arrow batch, and their lengths are added up for each text. Units that are longer than ``SPLIT`` are cut
after the last of letters or of digits, and before a single space between two characters that are no
white space; never inside a special token. A run without such a place (white space, signs or letters
alone) is one pre-token, which the library takes whole.

Null text counts as empty and has no tokens. Repeated rows give repeated results. One narrow pass,
no shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import text as T

SPLIT = 1 << 16
BATCH = 1 << 20
#: Units whose lengths a worker keeps.
TABLE = 600_000
SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?= \S)")


@lru_cache(2)
def engine(path: str):
    """The library's encoder and its special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder, tuple(t.content for t in encoder.get_added_tokens_decoder().values())


def parts(text: str, special: tuple[str, ...], size: int = SPLIT) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe boundaries only."""
    at = look = 0
    while len(text) - at > size:
        look = max(look, at + size)
        found = SAFE.search(text, look)
        if not found:
            break
        cut = look = found.start()
        if any(0 <= text.find(t, max(at, cut - len(t) + 1), cut + len(t) - 1) < cut for t in special):
            look += 1
            continue
        yield text[at:cut]
        at = cut
    yield text[at:]


def units(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of a chunk's texts, for each unit in order its place among these, and for each
    text the range of its units (n + 1 offsets). Units make up the texts; they begin at single white
    space between words, which ends a pre-token whatever stands around it, but for words that may begin
    with a special token."""
    starts, ends, first = T.words(data, offs)
    safe = np.zeros(len(starts), bool)
    safe[1:] = (starts[1:] - ends[:-1] == 1) & (data[starts[1:]] != ord("<"))
    safe[first[:-1][first[:-1] < first[1:]]] = False
    begin = np.union1d(offs[:-1][offs[:-1] < offs[1:]], starts[safe] - 1)
    bounds = np.append(begin, len(data)).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return held.dictionary, held.indices.to_numpy(), np.searchsorted(begin, offs)


class Lengths:
    """The numbers of tokens of texts; those of short ones are kept in a table of bounded size."""

    def __init__(self, path: str):
        self.encoder, self.special = engine(path)
        self.known: dict[str, int] = {}

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > TABLE:
            self.known = {}
        known = self.known
        totals = np.array([known.get(t, -1) for t in texts], np.int64)
        batch: list[str] = []
        rows: list[int] = []
        held = 0

        def run() -> None:
            for row, found in zip(rows, self.encoder.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                totals[row] += len(found)
            batch.clear()
            rows.clear()

        fresh = np.flatnonzero(totals < 0).tolist()
        totals[fresh] = 0
        for row in fresh:
            for part in parts(texts[row], self.special):
                batch.append(part)
                rows.append(row)
                held += len(part) if part.isascii() else len(part.encode())
                if held >= BATCH:
                    run()
                    held = 0
        run()
        known.update((texts[row], int(totals[row])) for row in fresh if len(texts[row]) <= 64)
        return totals


@lru_cache(1)
def counter(path: str) -> Lengths:
    return Lengths(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs`` (doc_id, text)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(path)
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text", 2 * BATCH):
                distinct, place, first = units(data, offs)
                run = np.concatenate([[0], np.cumsum(lengths.of(distinct.to_pylist())[place])]) if len(place) else np.zeros(1, np.int64)
                n = run[first[1:]] - run[first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(n, pa.int64()), pa.array(n > limit)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(count, SCHEMA)
