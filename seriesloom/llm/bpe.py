"""BPE encoding and decoding by dynamic programming over prefixes.

A BPE encoding is the one token sequence whose neighbours are all *compatible*: merging the two
side by side gives the two again. So every prefix of a word has a unique last token. Walking the
word through an automaton over the vocabulary's suffix links gives all tokens that end at each
prefix; of these exactly one is compatible with the last token of the prefix before it. Following
the back-pointers from the whole word emits the ids.

Two tokens are compatible when no merge across their border would have come first. Those merges
join a part on the right spine of the left token with one on the left spine of the right token;
one of them wins if it has a lower rank than the merges that use up its two parts (at equal ranks
the leftmost merge wins).

Texts are cut at white space, which this vocabulary drops, and words recur: a worker keeps the
encodings of those it has met in tables of bounded size. Null text counts as empty and has no ids.
Repeated rows give repeated results. One narrow pass, no shuffle.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.text import coded_words

END = b"\xff"  # no byte of UTF-8
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = [""] * 256, 256
    for b in range(256):
        if b in kept:
            letters[b] = chr(b)
        else:
            letters[b], more = chr(more), more + 1
    return letters


class HashMap:
    """Non-negative 64-bit keys to 32-bit values in flat arrays, looked up for many keys at once."""

    def __init__(self, room: int):
        self.bits = max(4, (2 * room).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        out = np.full(len(keys), default, np.int32)
        at, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(at):
            found = self.keys[slot]
            hit = found == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            at, slot = at[go], (slot[go] + 1) & mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and new."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.values[held]
            self.__init__(2 * (self.size + len(keys)))
            self.put(*old)
        self.size += len(keys)
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & mask


class SuffixAutomaton:
    """All tokens that end at a place: states of a trie of tokens, joined by suffix links.

    A state is the longest suffix of what has been read that begins some token; ``out`` is the state
    of the longest token among its suffixes, ``after`` leads from there to the next shorter one.
    """

    def __init__(self, tokens: dict[bytes, int]):
        step: dict[int, int] = {}
        token, depth = [-1], [0]
        for text, i in tokens.items():
            state = 0
            for byte in text:
                key = state << 8 | byte
                state = step.get(key, 0)
                if not state:
                    state = step[key] = len(token)
                    token.append(-1)
                    depth.append(depth[key >> 8] + 1)
            token[state] = i
        link = [0] * len(token)
        order = sorted(step, key=lambda key: depth[key >> 8])
        for key in order:
            parent, byte, state = key >> 8, key & 255, step[key]
            at = link[parent] if parent else -1
            while at >= 0 and (at << 8 | byte) not in step:
                at = link[at] if at else -1
            link[state] = step[at << 8 | byte] if at >= 0 else 0
        out, after = [0] * len(token), [0] * len(token)
        for key in order:
            state = step[key]
            after[state] = out[link[state]]
            out[state] = state if token[state] >= 0 else after[state]
        self.token, self.depth = np.array(token, np.int32), np.array(depth, np.int32)
        self.link, self.out, self.after = (np.array(x, np.int32) for x in (link, out, after))
        self.steps = HashMap(len(step))
        self.steps.put(np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))

    def read(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        result = np.zeros(len(state), np.int32)
        at, now = np.arange(len(state)), state
        while len(at):
            to = self.steps.get(now.astype(np.int64) << 8 | byte[at])
            result[at[to >= 0]] = to[to >= 0]
            go = (to < 0) & (now > 0)
            at, now = at[go], self.link[now[go]]
        return result


class PrefixEncoder:
    """Exact encodings for a tokenizers file of a byte-level BPE with word ends."""

    def __init__(self, path: str, table: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.table = table
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (1 + max(*vocab.values(), *self.added.values()))
        for text, i in (vocab | self.added).items():
            self.token[i] = text
        self.number = list(map(str, range(len(self.token))))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        of = {letter: b for b, letter in enumerate(byte_letters())}
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = vocab[a], vocab[b]
            self.rank.setdefault(x << 20 | y, rank)
            parts.setdefault(vocab[a + b], (x, y, rank))
        tokens: dict[bytes, int] = {}
        self.spines: list[dict[int, tuple[tuple[int, int], ...]]] = [{}, {}]
        for text, i in vocab.items():
            last = bool(suffix) and text.endswith(suffix)
            plain = bytes(of[c] for c in (text[: -len(suffix)] if last else text)) if i not in self.added.values() else b""
            if plain and (i in parts or len(plain) == 1):
                tokens[plain + END * last] = i
                for side in (0, 1):
                    self.spines[side][i] = self._spine(i, parts, side)
        self.automaton = SuffixAutomaton(tokens)
        self.pairs = HashMap(1 << 16)
        self.path, self.rules = path, None
        self.words: dict[str, tuple[int, str, str]] = {}
        self.pieces: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def _spine(i: int, parts: dict, side: int) -> tuple[tuple[int, int], ...]:
        """The token and its outer parts on one side, each with the rank of the merge that uses it up."""
        out = [(i, NEVER)]
        while i in parts:
            rank, i = parts[i][2], parts[i][side]
            out.append((i, rank))
        return tuple(out)

    def compatible(self, a: int, b: int) -> bool:
        ranks = self.rank
        for y, until_y in self.spines[0][b]:
            for x, until_x in self.spines[1][a]:
                r = ranks.get(x << 20 | y)
                if r is not None and r < until_x and r <= until_y:
                    return False
        return True

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) << 20 | token
        known = self.pairs.get(keys)
        if (new := known < 0).any():
            if self.pairs.size > 1 << 20:
                self.pairs = HashMap(1 << 16)
            fresh = np.unique(keys[new])
            told = np.fromiter((self.compatible(k >> 20, k & 0xFFFFF) for k in fresh.tolist()), np.int32, len(fresh))
            held = self.pairs.get(fresh) < 0
            self.pairs.put(fresh[held], told[held])
            known[new] = told[np.searchsorted(fresh, keys[new])]
        return known > 0

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many pre-tokens; those of like length walk through the automaton together."""
        out: list[list[int]] = [[] for _ in pieces]
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        at = 0
        while at < len(order):
            end, cells = at, 0
            while end < len(order) and (end == at or cells < 1 << 18):
                cells = (end + 1 - at) * (len(pieces[order[end]]) + 2)
                end += 1
            self._walk([pieces[k] for k in order[at:end]], order[at:end], out)
            at = end
        return out

    def _walk(self, pieces: list[bytes], places: list[int], out: list[list[int]]) -> None:
        auto = self.automaton
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        wide, rows = int(size.max()), len(pieces)
        text = np.zeros((wide, rows), np.uint8)
        flat = np.frombuffer(b"".join(p + END for p in pieces), np.uint8)
        row = np.repeat(np.arange(rows), size)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = flat
        last = np.full((wide + 1, rows), -1, np.int32)
        start = np.zeros((wide + 1, rows), np.int32)
        state = np.zeros(rows, np.int32)
        for i in range(1, wide + 1):
            live = np.flatnonzero(size >= i)
            state[live] = auto.read(state[live], text[i - 1, live])
            node = auto.out[state[live]]
            while len(live := live[node > 0]):
                node = node[node > 0]
                token, begin = auto.token[node], i - auto.depth[node]
                before = last[begin, live]
                fits = begin == 0
                ask = np.flatnonzero((begin > 0) & (before >= 0))
                fits[ask] = self._fit(before[ask], token[ask])
                last[i, live[fits]], start[i, live[fits]] = token[fits], begin[fits]
                live, node = live[~fits], auto.after[node[~fits]]
        where, place, found = np.arange(rows), size.copy(), []
        while len(where):
            ids = last[place, where]
            if (ids < 0).any():
                raise ValueError("a piece has no encoding")
            found.append((where, ids))
            place = start[place, where]
            where, place = where[place > 0], place[place > 0]
        of = np.concatenate([x for x, _ in reversed(found)])
        ids = np.concatenate([x for _, x in reversed(found)])[np.argsort(of, kind="stable")].tolist()
        end = np.cumsum(np.bincount(of, minlength=rows)).tolist()
        at = 0
        for k, to in zip(places, end, strict=True):
            out[k] = ids[at:to]
            at = to

    def pieces_of(self, word: str) -> list[str | int]:
        """The pre-tokens of a text without white space; special tokens as ids."""
        if word.isascii() or unicodedata.is_normalized("NFC", word):
            mark = word[-1] if word[-1] in ".," else ""
            core = (word[:-1] if mark else word).lower()
            if core.isalpha() and "Σ" not in word:
                return [core, mark] if mark else [core]
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(word) if "<" in word else [word]):
            if k % 2:
                out.append(self.added[part])
            elif not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                out += self._library_cut(part)
            else:
                part = unicodedata.normalize("NFC", part)
                out += self.pattern.findall(part.lower() if "Σ" not in part else "".join(c.lower() for c in part))
        return out

    def _library_cut(self, part: str) -> list[str]:
        """The pre-tokens as the library's rules cut them: it, Python and ``regex`` know different versions
        of Unicode, and take what is unassigned in one for letters in another."""
        if self.rules is None:
            from tokenizers import Tokenizer

            self.rules = Tokenizer.from_file(self.path)
        text = self.rules.normalizer.normalize_str(part)
        return [text[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set[str], keep: dict[str, tuple[int, str, str]]) -> None:
        """Encodes words into ``keep``: the number of ids, ids as text, tokens joined by spaces."""
        cut = {w: self.pieces_of(w) for w in words}
        pieces = {p for parts in cut.values() for p in parts if isinstance(p, str)}
        number, token = self.number.__getitem__, self.token.__getitem__
        fresh = list(pieces - self.pieces.keys())
        for p, ids in zip(fresh, self.encode_pieces([p.encode() for p in fresh]), strict=True):
            self.pieces[p] = len(ids), " ".join(map(number, ids)), " ".join(map(token, ids))
        known = self.pieces
        for w, parts in cut.items():
            if len(parts) == 1 and isinstance(parts[0], str):
                keep[w] = known[parts[0]]
            else:
                all_ = [known[p] if isinstance(p, str) else (1, number(p), token(p)) for p in parts]
                keep[w] = sum([x[0] for x in all_]), " ".join([x[1] for x in all_]), " ".join([x[2] for x in all_])

    def texts(self, column: pa.Array) -> Iterator[tuple[list[tuple[int, str, str]], np.ndarray]]:
        """The encodings of the distinct words of a column's texts, with the words of each text as
        places among these."""
        distinct, code, first = coded_words(column)
        if len(self.words) > self.table:
            self.words, self.pieces = {}, {}
        if len(self.pieces) > self.table:
            self.pieces = {}
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the tables are large
        try:
            self.learn({w for w in distinct if w not in self.words}, self.words)
        finally:
            if collecting:
                gc.enable()
        known = [self.words[w] for w in distinct]
        for w in [w for w in distinct if len(w) > 64]:
            del self.words[w]
        for w in [w for w in self.pieces if len(w) > 64]:
            del self.pieces[w]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield known, code[a:b]


def groups(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``limit`` bytes, with the place of the first."""
    size = np.cumsum(pc.binary_length(texts.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield at, texts.slice(at, end - at)
        at = end


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each text; the general form of the operator."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at, texts in groups(batch.column(1)):
                ids = [list(map(int, " ".join([known[c][1] for c in code.tolist()]).split())) for known, code in bpe.texts(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, arrow.field(1).type)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row's ids: the tokens joined by a space, as a file without decoder gives them."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(path).token
        for batch in batches:
            texts = [" ".join(token[i] for i in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=arrow)

    return rows.select(F.col("doc_id").cast("long"), F.col("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (doc_id, text)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def sha(parts: list[bytes]) -> str:
        return hashlib.sha256(b" ".join(parts)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at, texts in groups(batch.column(1)):
                n, ids, tokens = [], [], []
                held: list | None = None
                for known, code in bpe.texts(texts):
                    if held is not known:
                        held, size = known, np.array([k[0] for k in known], np.int64)
                        id_text, token_text = [k[1].encode() for k in known], [k[2].encode() for k in known]
                    n.append(int(size[code].sum()))
                    places = code.tolist()
                    ids.append(sha([id_text[c] for c in places]))
                    tokens.append(sha([token_text[c] for c in places]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(ids), pa.array(tokens)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
