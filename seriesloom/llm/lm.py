"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A trie of byte contexts of orders 0 to 5 holds how often each symbol followed each context in the
training texts. The probability of a symbol starts at the longest context the trie has. Escape
estimation is method C: a context seen T times with q distinct symbols escapes with q / (T + q).
After an escape the symbols of the longer context are excluded from the shorter one. Below order 0
the symbols not seen yet share what is left evenly. A text is its bytes, A-Z lower-cased, and an
end symbol, so that the probabilities of all texts sum to one; a text's start is part of its
contexts.

Pretrained, the trie is made by distributed counts over all training texts and keeps every context,
so it grows with the corpus and never leaves the cluster. A symbol's probability depends on it and its
ORDER symbols before alone. Contexts of more than ``SHARED`` symbols lie in shards by the last
SHARED + 1 symbols, where all longer ones with these are at hand; the shorter ones, which the
alphabet bounds, are broadcast. Each shard gives the probabilities of all symbols in context that
occur in any text. The ``COMMON`` most frequent of these are broadcast, all others are aggregated for
each document and joined. ``CONTEXTS`` is for trials with a smaller trie: where it is set, a context
stays if at least 1 / ``CONTEXTS`` of the training symbols follow it. As a context's suffix is at least
as common, exclusion sets are nested. ``adaptive_code_length`` scores one text by a trie that starts empty.

The base is a unigram model of words with add-0.1 smoothing. Its counts are not bounded and never
leave the cluster: the ``HEAD`` most common words, which are also the skewed keys, are broadcast, all
others are aggregated for each document and joined.

Null text counts as empty: one end token. A null doc_id counts as the empty string in the choice of
the held-out part. Rows that repeat a doc_id or a whole row keep a row each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm import text as T
from seriesloom.llm.anchors import NO_ID, doc_key
from seriesloom.llm.graph import cut

ORDER = 5
END, START = 256, 257
BITS = 9
CONTEXTS: int | None = None
SHARED = 2
COMMON = 1 << 21
#: Symbols in context in a shard, about.
SHARD = 1 << 20
HEAD = 1 << 16
ALPHABET = 257
#: The key of the token at the end of each text.
END_TOKEN = -1
WORDS, GRAMS = 0, 1


def _mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text (its bytes, then the end) the symbol with its context as one
    number, the symbol lowest; and the n + 1 offsets of the texts."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    symbols = np.full(len(data) + n * (ORDER + 1), START, np.int64)
    symbols[np.arange(len(data)) + (row + 1) * ORDER + row] = data
    ends = offs[1:] + np.arange(1, n + 1) * (ORDER + 1) - 1
    symbols[ends] = END
    out = symbols.copy()
    for j in range(1, ORDER + 1):
        out[j:] |= symbols[:-j] << BITS * j
    return out[symbols != START], offs + np.arange(n + 1)


class Tally:
    """Counts of 64-bit keys, merged as they come; given out when they grow past ``most``."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > 2 * self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([x for _, x in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        merged = keys[first], np.add.reduceat(n, first) if len(first) else n
        self.parts, self.held = [merged], len(merged[0])
        return merged

    def full(self) -> bool:
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.parts, self.held = [], 0
        return out


def _word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = T.words(data, offs)
    return T.signed(T.span_hash(data, starts, ends)), first


def training_counts(docs: DataFrame) -> DataFrame:
    """kind, key and n: counts of words (by fingerprint) and of symbols in context over the rows of
    ``docs`` (text, held_out) that are not held out; 0 for symbols in context of the others alone."""
    arrow = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {WORDS: Tally(), GRAMS: Tally()}

        def give(kind: int) -> pa.RecordBatch:
            keys, n = tallies[kind].take()
            return T.batch_of(arrow, np.full(len(keys), kind, np.int32), keys, n)

        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                data = T.LOWER[data]
                trained = ~part.column("held_out").to_numpy(zero_copy_only=False)
                keys, first = _word_keys(data, offs)
                tallies[WORDS].add(keys[np.repeat(trained, np.diff(first))])
                if trained.any():
                    tallies[WORDS].add(np.array([END_TOKEN]), np.array([trained.sum()]))
                code, code_offs = codes(data, offs)
                seen = np.repeat(trained, np.diff(code_offs))
                tallies[GRAMS].add(code[seen])
                others = np.unique(code[~seen])
                tallies[GRAMS].add(others, np.zeros(len(others), np.int64))
                for kind, tally in tallies.items():
                    if tally.full():
                        tally.merge()
                        if tally.full():
                            yield give(kind)
        for kind in tallies:
            yield give(kind)

    return docs.select("text", "held_out").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Context statistics by order, for many symbols at once."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        """rows: for each order the symbols in context and their counts."""
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order, gram, n in sorted(rows, key=lambda r: r[0]):
            by = np.argsort(gram)
            gram, n = gram[by].astype(np.int64), n[by].astype(np.float64)
            self.grams.append((gram, n))
            context, first = np.unique(gram >> BITS, return_index=True)
            if not len(gram):
                self.contexts.append((context, *[np.zeros(0)] * 3))
                continue
            total, distinct = np.add.reduceat(n, first), np.diff(np.append(first, len(gram)))
            below = np.zeros(len(gram))
            if order:  # what the symbols of this context count in the shorter one
                below = self._find(self.grams[order - 1], gram & _mask(order))
            self.contexts.append((context, total, distinct.astype(np.float64), np.add.reduceat(below, first)))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, values = table
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], 0.0)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        out = np.zeros(len(code))
        live = np.arange(len(code))
        gone_total, gone_symbols = np.zeros(len(code)), np.zeros(len(code))
        for order in range(len(self.grams) - 1, -1, -1):
            context, total, distinct, below = self.contexts[order]
            if not len(context) or not len(live):
                continue
            gram = code[live] & _mask(order + 1)
            at = np.minimum(np.searchsorted(context, gram >> BITS), len(context) - 1)
            known = context[at] == gram >> BITS
            seen = self._find(self.grams[order], gram)
            left, kinds = total[at] - gone_total[live], distinct[at] - gone_symbols[live]
            use = known & (kinds > 0)
            hit = use & (seen > 0)
            escape = use & ~hit
            with np.errstate(divide="ignore", invalid="ignore"):
                out[live] += np.where(hit, np.log10(seen / (left + kinds)), 0) + np.where(escape, np.log10(kinds / (left + kinds)), 0)
            gone_total[live[known]], gone_symbols[live[known]] = below[at[known]], distinct[at[known]]
            live = live[~hit]
        lowest = self.contexts[0][2].sum() if self.contexts else 0
        out[live] -= np.log10(np.maximum(ALPHABET - lowest, 1))
        return out


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """Bits for a text under a trie that starts empty and learns each symbol after coding it."""
    counts: dict[tuple[int, ...], dict[int, int]] = defaultdict(lambda: defaultdict(int))
    past = (START,) * order
    bits = 0.0
    for symbol in [*text, END]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            here = {s: n for s, n in counts.get(past[order - k :], {}).items() if s not in excluded}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if symbol in here:
                bits -= log10(here[symbol] / total) / log10(2)
                break
            bits -= log10(len(here) / total) / log10(2)
            excluded |= here.keys()
        else:
            bits += log10(ALPHABET - len(excluded)) / log10(2)
        for k in range(order + 1):
            counts[past[order - k :]][symbol] += 1
        past = (*past[1:], symbol) if order else ()
    return bits


def probabilities(counts: DataFrame) -> DataFrame:
    """key, n and p, log10 of the probability, of each symbol in context of counts (kind, key, n)."""
    grams = counts.filter(F.col("kind") == GRAMS).select("key", "n")
    size, symbols = grams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(1, -(-symbols // CONTEXTS)) if CONTEXTS else 1
    short = grams.filter("n > 0").groupBy(F.col("key").bitwiseAND(_mask(SHARED + 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    shared = counts.sparkSession.sparkContext.broadcast((short["gram"].to_numpy(), short["n"].to_numpy()))
    arrow = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("p", pa.float64())])

    def level(order: int, key: np.ndarray, n: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        gram, where = np.unique(key & _mask(order + 1), return_inverse=True)
        count = np.bincount(where, n, len(gram))
        # Exclusion needs all symbols of a context: contexts stay or go as a whole.
        _, context = np.unique(gram >> BITS, return_inverse=True)
        stays = np.bincount(context, count)[context] >= least
        return order, gram[stays], count[stays]

    def shard(table: pa.Table) -> pa.Table:
        key, n = table["key"].to_numpy(), table["n"].to_numpy()
        seen = n > 0
        rows = [level(k, *shared.value) for k in range(SHARED + 1)] + [level(k, key[seen], n[seen]) for k in range(SHARED + 1, ORDER + 1)]
        return pa.table([pa.array(key), pa.array(n), pa.array(Trie(rows).log10(key))], schema=arrow)

    context = F.shiftright("key", BITS).bitwiseAND(_mask(SHARED + 1))
    shards = F.pmod(F.xxhash64(context), F.lit(max(1, -(-size // SHARD))))
    return grams.withColumn("shard", shards).groupBy("shard").applyInArrow(shard, "key long, n long, p double")


def common_codes(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """key and p of the most frequent rows (key, n, p) of ``table``, ``COMMON`` at most, by key."""
    often = F.floor(F.log2(F.col("n") + 1) * 16).cast("int")
    held, least = 0, None
    for bucket, rows in sorted((tuple(x) for x in table.groupBy(often).count().collect()), reverse=True):
        held += rows
        if held > COMMON:
            break
        least = bucket
    found = table.filter(often >= least if least is not None else F.lit(False)).select("key", "p").toArrow()
    key, p = found["key"].to_numpy(), found["p"].to_numpy()
    by = np.argsort(key)
    return key[by], p[by]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 10
    rows = docs.select(doc_key(F.col("doc_id"), F.col("text").cast("string")).alias("doc"), F.col("text").cast("string").alias("text"), (fold == 0).alias("held_out"))
    counts = cut(training_counts(rows))
    words = counts.filter(F.col("kind") == WORDS).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = words.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    key, n = common["key"].to_numpy(), common["n"].to_numpy()
    by = np.argsort(key)
    spark = docs.sparkSession
    table = cut(probabilities(counts))
    shared = spark.sparkContext.broadcast((common_codes(table), key[by], n[by]))
    arrow = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    tail = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("print", pa.int64()), ("n", pa.int64())])

    def lookup(part_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, head, often = shared.value
        if not len(head):
            return np.zeros(len(part_keys), bool), np.zeros(len(part_keys))
        at = np.minimum(np.searchsorted(head, part_keys), len(head) - 1)
        hit = head[at] == part_keys
        return hit, np.where(hit, often[at], 0)

    def chances(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (known, p), *_ = shared.value
        if not len(known):
            return np.zeros(len(code), bool), np.zeros(len(code))
        unique, where = np.unique(code, return_inverse=True)
        at = np.minimum(np.searchsorted(known, unique), len(known) - 1)
        hit = known[at] == unique
        return hit[where], np.where(hit, p[at], 0.0)[where]

    def prints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return T.signed(T.span_hash(data, offs[:-1], offs[1:]))

    def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
        run = np.zeros(len(values) + 1)
        np.cumsum(values, out=run[1:])
        return run[offs[1:]] - run[offs[:-1]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                low = T.LOWER[data]
                code, code_offs = codes(low, offs)
                ends = np.full(len(offs) - 1, END_TOKEN)
                keys, first = _word_keys(low, offs)
                hit, c = lookup(keys)
                end_hit, end_c = lookup(ends)
                base = sums(np.where(hit, np.log10(c + 0.1), 0), first) + np.where(end_hit, np.log10(end_c + 0.1), 0)
                known = sums(hit, first).astype(np.int64) + end_hit
                yield T.batch_of(arrow, part.column("doc"), prints(data, offs), part.column("held_out"), np.diff(first) + 1, np.diff(offs), known, base, sums(chances(code)[1], code_offs))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in T.chunks(batch, "text"):
                low = T.LOWER[data]
                keys, first = _word_keys(low, offs)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                out = ~lookup(keys)[0]
                ends = np.full(len(offs) - 1, END_TOKEN)
                left = ~lookup(ends)[0]
                doc, hashed = part.column("doc").to_numpy(), prints(data, offs)
                code, code_offs = codes(low, offs)
                other = np.flatnonzero(~chances(code)[0])
                code_row = np.searchsorted(code_offs, other, "right") - 1
                words_ = np.concatenate([keys[out], ends[left]]), np.concatenate([row[out], np.flatnonzero(left)])
                for kind, (keys, row) in ((WORDS, words_), (GRAMS, (code[other], code_row))):
                    by = np.lexsort((keys, row))
                    keys, row = keys[by], row[by]
                    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))) if len(keys) else np.zeros(0, np.int64)
                    yield T.batch_of(tail, np.full(len(new), kind, np.int32), keys[new], doc[row[new]], hashed[row[new]], np.diff(np.append(new, len(keys))))

    scored = rows.mapInArrow(score, "doc long, print long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double")
    others = rows.select("doc", "text").mapInArrow(rare, "kind int, key long, doc long, print long, n long")
    known = words.select(F.lit(WORDS).alias("kind"), "key", F.col("n").alias("c"), F.lit(None).cast("double").alias("p")).union(table.select(F.lit(GRAMS).alias("kind"), "key", F.col("n").alias("c"), "p"))
    others = others.join(known, ["kind", "key"], "left")
    word = F.col("kind") == WORDS
    others = others.groupBy("doc", "print").agg(
        F.sum(F.when(word, F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1)).otherwise(0.0)).alias("more"),
        F.sum(F.when(word & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.when(word, 0.0).otherwise(F.col("n") * F.col("p"))).alias("more_score"),
    )
    copies = F.count("*").over(Window.partitionBy("doc", "print"))  # repeated rows are summed together above
    out = scored.withColumn("copies", copies).join(others, ["doc", "print"], "left")
    out = out.withColumn("score", F.col("score") + F.coalesce(F.col("more_score") / F.col("copies"), F.lit(0.0)))
    scale = log10(total + 0.1 * (distinct + 1))
    return out.select(
        F.when(F.col("doc") >= NO_ID, F.col("doc")).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce((F.col("more_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
