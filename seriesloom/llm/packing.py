"""Packing of documents into sequences of 2048 tokens, shortest pack first over length counts.

Documents become ids with one end id; those longer than a sequence are cut into full pieces and a
rest. The plan is made from the number of pieces of each length alone: lengths are placed from the
longest down, each into the pack that is the shortest so far, and a pack pattern stands for as many
packs as share it. Where no open pack has room, new ones open, though no more than the tokens still
to be placed can fill. Then pieces are ranked within their length, and a rank selects a place in a
pattern. The histogram has 2048 rows at most; pieces never leave the executors.

The ids are those of the tokenizers library for whole texts: texts are cut at white space, which
this vocabulary drops. The words of many texts become codes of their distinct words in Arrow, and
each distinct word is encoded once; those met before are taken from a bounded table.

Null text counts as empty: a piece with the end id alone. Repeated rows are packed as often as they
occur. A full piece is a sequence by itself.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.bpe import groups
from seriesloom.llm.graph import cut
from seriesloom.llm.text import coded_words

SEQUENCE = 2048
END_ID = 1
TABLE = 600_000
#: Pieces of one length that are ranked in one group.
RANKED = 4096


class WordIds:
    """Ids of words as little-endian 32-bit values.

    Many words of letters, each of which is one pre-token, are encoded as one text, and their ids are
    told apart by the tokens that end a word. Other words are encoded by themselves."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        vocab = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        plain, odd = [], []
        for word in new:
            is_plain = word.isalpha() and (word.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", word.lower()))
            (plain if is_plain else odd).append(word)
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            ids = np.array(self.encoder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(part):
                odd += part
                continue
            raw, start = ids.astype("<u4").tobytes(), 0
            for word, stop in zip(part, (4 * end).tolist(), strict=True):
                self.known[word] = raw[start:stop]
                start = stop
        for at in range(0, len(odd), 4096):
            self.known.update(zip(odd[at : at + 4096], self._ids(odd[at : at + 4096]), strict=True))

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column. Each distinct word is looked up once."""
        distinct, code, first = coded_words(column)
        if len(self.known) > TABLE:
            self.known = {}
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the table is large
        try:
            self.learn([w for w in distinct if w not in self.known])
        finally:
            if collecting:
                gc.enable()
        ids = [self.known[w] for w in distinct]
        for word in [w for w in distinct if len(w) > 64]:
            del self.known[word]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield b"".join([ids[c] for c in code[a:b].tolist()])


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece."""
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for at, texts in groups(batch.column(1)):
                rows = []
                for doc, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), words.texts(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(lengths: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Pack patterns with their numbers: every piece of ``lengths`` (length: number) in one pack."""
    open_: dict[int, Counter[tuple[int, ...]]] = defaultdict(Counter)  # by room left
    room = 0
    to_place = sum(k * n for k, n in lengths.items())
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            widest = max((r for r, packs in open_.items() if packs), default=0)
            if widest >= length:
                pack, count = next(iter(open_[widest].items()))
                n = min(count, left)
                open_[widest][pack] -= n
                if not open_[widest][pack]:
                    del open_[widest][pack]
                room -= n * length
            else:
                widest, pack = size, ()
                n = min(left, max(1, -(-(to_place - room) // size)))
                room += n * (size - length)
            open_[widest - length][(*pack, length)] += n
            left -= n
            to_place -= n * length
    return [(n, pack) for packs in open_.values() for pack, n in packs.items() if n]


def places(found: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each slot of a pattern, the sequence of that rank, its offset."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: Counter[int] = Counter()
    sequence = 0
    for n, pack in found:
        offset = 0
        for length in pack:
            out[length].append((rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def packed(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    cut_ = cut(pieces(docs, path, size, end_id))
    lengths = {r["length"]: r["n"] for r in cut_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    table = places(patterns(lengths, size))
    buckets = 1 + sum(lengths.values()) // RANKED
    rows = cut_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = rows.withColumn("own", own).join(before, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own") - 1).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, base, where = shared.value[k]
                slot = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[slot] + rank[at] - first[slot], where[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
