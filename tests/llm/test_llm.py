"""Corpus operators against brute force, on odd texts: null, empty, very long, ties, repeated rows."""

import collections
import hashlib
import html
import math
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import bpe, graph, html_pages, lm, media, near, packing, quality, substrings, suffixes, token_counts
from seriesloom.llm import queries as Q
from seriesloom.llm import text as text_module

P = pytest.importorskip("public_tokenizers")
W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, later string, node long, doc long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(k, n, size=400):
    rng = np.random.default_rng(k)
    return " ".join(f"w{x}" for x in rng.integers(0, size, n))


def odd_texts():
    passage = words(1, 80)
    base = words(2, 300, 5000)
    edited = base.split()
    edited[10] = edited[200] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "one", "One two three four", passage, passage, f"{words(3, 60)} {passage} {words(4, 70)}", f"{passage} x {passage}",
        base, base.upper(), " ".join(edited), base, words(5, 30000, 9000), "é日本 ß🎉 " * 40, "a" * 5000, "ab\x00\x1c c d <|endoftext|> <|startoftext|>x", "it's 12 we'll\n\nit's\n \nx", "ABC  def   \n\nghi " * 30,
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(10, base), (None, "no id " + passage)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_empty_tables(spark, none):
    path = P.path("word_bpe_49k.json")
    for df in (lm.scores(none), token_counts.token_counts(none, P.path("byte_bpe_50k.json")), quality.quality(none), near.near_duplicates(none), substrings.digests(none), bpe.digests(none, path), suffixes.digests(none), media.media_features(none), packing.packed(none, path)):
        assert df.count() == 0
    assert html_pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_token_counts(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs, P.path("byte_bpe_50k.json")))
    for i, t in odd_texts():
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert all((r.n_tokens, r.n_bytes, r.over_limit) == (n, len((t or "").encode()), n > 512) for r in got[i])


PIECES = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("ab é\n\t.,'1日 <|>\u0301\x1c\x85\u00a0")), st.sampled_from(["<|endoftext|>", "it's", "  ", "we'll "]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(1, 12))
def test_counts_of_parts(text, size):
    encoder, special = token_counts.engine(P.path("byte_bpe_50k.json"))
    cut = list(token_counts.parts(text, special, size))
    assert "".join(cut) == text
    ids = [e.ids for e in encoder.encode_batch_fast(cut, add_special_tokens=False)]
    assert sum(ids, []) == encoder.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=1, max_size=6))
def test_counts_of_units(texts):
    encoder, _ = token_counts.engine(P.path("byte_bpe_50k.json"))
    data, offs = text_module.flat(pa.array(texts))
    distinct, place, first = token_counts.units(data, offs)
    made = [[distinct[c].as_py() for c in place[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert ["".join(x) for x in made] == texts
    for t, cut in zip(texts, made, strict=True):
        ids = [e.ids for e in encoder.encode_batch_fast(cut, add_special_tokens=False)] if cut else []
        assert sum(ids, []) == encoder.encode(t, add_special_tokens=False).ids


def test_counts_of_long_runs(spark):
    texts = [" " * 1_500_000, "x" * 300_000, "word " * 100_000, "a1" * 100_000, "=" * 200_000]
    encoder, _ = token_counts.engine(P.path("byte_bpe_50k.json"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(encoder.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_bpe_ids_and_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = by_id(bpe.digests(docs, path))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in odd_texts():
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False)))
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want for r in got[i])
    one = bpe.encode(docs.filter("doc_id = 18"), path)
    assert bpe.decode(one, path).first().text == tk.decode(tk.encode(dict(odd_texts())[18], add_special_tokens=False).ids, skip_special_tokens=False)


ODD_LETTERS = st.one_of(st.characters(), st.sampled_from(list("aZ.,'1 Iİ\u0307\u0301\u00a0\u2003\u3000\x1c\x85<|>éÉΣςß")), st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "A.", "x,"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_LETTERS, max_size=30).map("".join).filter(lambda t: t.isprintable() or t.encode("utf-8", "ignore").decode() == t))
def test_bpe_any_text(text):
    from tokenizers import Tokenizer

    global _tk
    _tk = globals().get("_tk") or Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = pa.array([text, text.upper(), f"{text}. {text},", None])
    words = packing.word_ids(P.path("word_bpe_49k.json"))
    found = bpe.encoder(P.path("word_bpe_49k.json")).texts(texts)
    for t, (known, code), ids in zip(texts.to_pylist(), found, words.texts(texts), strict=True):
        want = _tk.encode(t or "", add_special_tokens=False).ids
        assert [int(x) for c in code.tolist() for x in known[c][1].split()] == want
        assert array("I", ids).tolist() == want


def test_bpe_of_code_points_younger_than_python():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = [chr(c) for c in (0x558, 0x58B, 0x88F, 0x1C89, 0x209D, 0xA7CB, 0xA7DA, 0x10D50, 0x11DE0, 0x16EA0, 0x18E00, 0x323B0, 0x3D000, 0x3FC3F, 0xE0080)]
    texts = pa.array([f.format(c) for c in odd for f in ("{0}", "{0}. a{0}1{0},", "A{0}<|endoftext|>{0}É.", "e\u0301{0}Σ ΑΣ")])
    for t, (known, code) in zip(texts.to_pylist(), bpe.encoder(P.path("word_bpe_49k.json")).texts(texts), strict=True):
        assert [int(x) for c in code.tolist() for x in known[c][1].split()] == tk.encode(t, add_special_tokens=False).ids


def test_quality(docs):
    got = by_id(quality.quality(docs.select("doc_id", "text")))
    for i, t in odd_texts():
        w = W.findall(t or "")
        lines = [x for x in (t or "").split("\n") if W.search(x)]
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {x for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for x in (k, k + 1, k + 2)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            assert not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    prose = "the of and to a in is that it for was on with as " * 3 + " ".join(f"sentence{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))
    junk = " ".join(f"word{k}&&&%%%$$$###" for k in range(120))
    rows = spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")
    got = by_id(quality.quality(rows))
    assert got[2][0].class_distance > got[1][0].class_distance and not got[2][0].kept
    assert quality.kept_documents(rows).columns == ["doc_id", "text"]


def test_quality_references_are_the_fitted_ones(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    rows = quality.fitted(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert {r.lang: tuple(r.classes) for r in rows} == quality.CLASS_REFERENCE
    assert {r.lang: {w.word: w.share for w in r.words} for r in rows} == quality.WORD_REFERENCE


def shingles(t):
    w = W.findall(lower(t or ""))
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(rows, threshold=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                root[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return {(i, len(s), least.get(top(x)) if s else i) for x, (i, s) in enumerate(sets)}


def test_near_duplicates(docs):
    got = near.near_duplicates(docs)
    rows = got.collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == near_brute(odd_texts())
    assert len(rows) == len(odd_texts())


def test_near_duplicates_of_a_dense_group(spark):
    base = words(7, 220, 10**6).split()
    rng = np.random.default_rng(3)
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(1, 9), replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    rows += [(200 + k, " ".join(base[40:100]) + " " + words(50 + k, 100, 10**6)) for k in range(30)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == near_brute(rows)


def test_near_duplicates_nested_around_the_sketch(spark):
    rows = []
    for size, more in [(48, 8)] * 24 + [(47, 8), (49, 8), (44, 7), (40, 7)]:
        k = len(rows)
        text = words(1000 + k, size + 4, 10**6)
        rows += [(k, text), (k + 1, text + " " + words(2000 + k, more, 10**6))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == near_brute(rows)


def thue_morse():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_sums_of_powers_confuse(spark):
    """Two words that polynomial hashes modulo 2^64 hold equal for every base."""
    start = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(k + 1, f"{start} {w}") for k, w in enumerate(thue_morse())], "doc_id long, text string")
    assert {r.n_removed for r in substrings.digests(docs).collect()} == {0}
    assert {r.component_id for r in near.near_duplicates(docs).collect()} == {1, 2}


def test_no_link_is_lost_from_sketches(spark):
    """Pairs at 0.85 to 0.90 with sets of 50 to 5,000 shingles, every one of them."""
    rows, rng = [], np.random.default_rng(11)
    for size in (50, 80, 200, 1000, 5000):
        for _ in range(24):
            k = len(rows)
            base = words(3000 + k, size + 4, 10**6).split()
            m = int(size * rng.uniform(0.05, 0.081))  # other words at the end: m shingles less and m more
            rows += [(k, " ".join(base)), (k + 1, " ".join([*base[:-m], *words(9000 + k, m, 10**6).split()]))]
    want = {(i, c) for i, _, c in near_brute_pairs(rows)}
    assert len({c for _, c in want}) < len(rows) * 0.6
    assert {(r.doc_id, r.component_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


def near_brute_pairs(rows):
    """As ``near_brute`` where only neighbours can be linked."""
    out = []
    for x, y in zip(rows[::2], rows[1::2], strict=True):
        out += sorted(near_brute([x, y]))
    return out


def test_kept_documents_decide_rows_by_their_text(spark):
    base, other = words(21, 60, 10**6), words(22, 60, 10**6)
    rows = [(1, base), (2, base), (2, other), (3, other + " more"), (3, other + " more"), (4, ""), (4, None), (None, words(23, 40)), (None, words(23, 40)), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near.kept_documents(docs).collect()), key=repr)
    assert got == sorted([(1, base), (2, other), (4, ""), (4, None), (None, words(23, 40))], key=repr)


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(k % 5 if k % 3 else 0, k) for k in range(300)], "k long, v long")
    keyed = graph.cut(rows.filter("k < 4").groupBy("k").count())
    want = sorted(map(tuple, rows.join(keyed, "k").collect()))
    for hot in (1, 3, 1024):
        graph.HOT, was = hot, graph.HOT
        try:
            assert sorted(map(tuple, graph.spread_join(rows, keyed, ["k"], "count").collect())) == want
        finally:
            graph.HOT = was


def test_tables_are_few_files(spark, tmp_path, monkeypatch):
    """However many partitions there are: each file costs the executor three processes of its size."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in (*conf, *graph.TIDY)}
    most = graph.FILES * spark.sparkContext.defaultParallelism
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        table = graph.cut(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")))
        assert len(table.inputFiles()) <= most
        assert sorted((r.k, r.n) for r in table.collect()) == [(k, 5) for k in range(1000)]
    finally:
        for k in conf:
            spark.conf.set(k, was[k])
    assert all(spark.conf.get(k) == v for k, v in was.items())
    docs = spark.createDataFrame([(i, words(i, 60)) for i in range(40)], "doc_id long, text string").repartition(40)
    for module, name in ((quality, "kept_documents"), (near, "kept_documents"), (substrings, "deduplicated"), (packing, "packed")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").rdd.getNumPartitions() <= most
        assert stage(spark, docs, "").count() == 40


def test_linked_pairs_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 38)) for _ in range(60)]
    a, b = near.linked_pairs(sets)
    want = {(x, y) for x in range(60) for y in range(x + 1, 60) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_pipeline_drops_copies_from_80_percent(spark):
    base = words(8, 104, 10**6).split()  # 100 shingles
    edited = [*base]
    edited[50] = edited[100] = "changed"  # 10 shingles less, 10 more: 90 of 110
    rows = [(0, " ".join(base)), (1, " ".join(edited)), (2, words(9, 104, 10**6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 80 * 110 <= 100 * len(shingles(rows[0][1]) & shingles(rows[1][1])) < 85 * 110
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {0, 2}
    assert {r.doc_id for r in near.near_duplicates(docs).filter("kept").collect()} == {0, 1, 2}


def test_least_overlap_follows_the_threshold():
    rng = np.random.default_rng(1)
    for threshold in (80, 85):
        least = near.least_overlap(threshold)
        assert (rng.binomial(near.K, threshold / 100, 10**6) >= least).all()
    assert near.least_overlap(80) < near.least_overlap(85)


def substring_brute(rows):
    """doc_id, words and kept text of each row."""
    first = {}
    for i, t in rows:
        w = W.findall(t or "")
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, t in rows:
        w = W.findall(t or "")
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        yield i, w, gone, " ".join(x for k, x in enumerate(w) if k not in gone)


def test_substring_dedup(docs):
    rows = [(i, t) for i, t in odd_texts() if i is not None]
    got = by_id(substrings.digests(docs.filter("doc_id is not null")))
    for i, w, gone, kept in substring_brute(rows):
        assert all((r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()) for r in got[i])
    assert len(substrings.digests(docs).collect()) == len(odd_texts())


def test_repeated_paths_are_compacted(spark):
    shared, rows = words(31, 400, 10**6), []
    for k in range(4):
        rows.append((k, f"{words(100 + k, 50, 10**6)} {shared} {words(200 + k, 50, 10**6)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeats(substrings._texts(docs, [])).collect()
    for k in range(1, 4):
        own = [r for r in found if r.doc == k]
        assert sum(r.windows for r in own) == 388 and len(own) <= 3 and max(r.windows for r in own) > 350
        assert {r.sdoc for r in own} == {0}
    assert all(r.start >= 50 and r.start + r.windows + 12 <= 450 for r in found)


def suffix_brute(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if seen.setdefault(s, (i, k)) < (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()
    return out


def test_suffix_dedup(docs, monkeypatch):
    rows = list({i: (i, t) for i, t in odd_texts() if i is not None}.values())
    want = suffix_brute(rows)
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    for hot in (50_000, 1):  # the second deals every bucket by windows
        monkeypatch.setattr(suffixes, "HOT_SEGMENTS", hot)
        got = by_id(suffixes.digests(unique))
        assert {i: (r[0].n_bytes, r[0].n_removed, r[0].n_spans, r[0].kept_sha256) for i, r in got.items()} == want


def test_previous_factors():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 300).astype(np.uint8)
    starts = np.arange(0, 280)
    got = suffixes.previous_factors(text, starts, starts, 20)
    for i in starts:
        best = max((next((k for k in range(20) if text[i + k] != text[j + k]), 20) for j in range(i)), default=0)
        assert got[i] == best


def test_media(docs):
    got = by_id(media.media_features(docs))
    for i, t in odd_texts():
        raw = (t or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (size - len(raw))
        for r in got[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert len(r.feature) == 16 and r.media_bytes == size + 128


def test_image_formats():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # x\n4 3\n255\n" + b" ".join(b"%d" % x for x in range(12))) == grey).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    import struct

    pixels = b"\x03\x02\x01\x06\x05\x04\x00\x00" + b"\x09\x08\x07\x0c\x0b\x0a\x00\x00"
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(pixels), 0, 0, 0, 0) + pixels
    assert media.decode(bmp).tolist() == [[[7, 8, 9], [10, 11, 12]], [[1, 2, 3], [4, 5, 6]]]
    with pytest.raises(media.MediaError):
        media.decode(b"P5\n9 9\n255\n\x00")
    image = np.random.default_rng(0).random((17, 23))
    assert np.isclose(media.area_resize(image, 1, 1)[0, 0], image.mean())
    assert np.allclose(media.area_resize(image[:16, :20], 4, 5), image[:16, :20].reshape(4, 4, 5, 4).mean((1, 3)))


def test_packing(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rows = packing.packed(docs, path).collect()
    sequences, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    want = collections.Counter()
    for i, t in odd_texts():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(array("I", part).tobytes()), len(ids)] += 1
    assert pieces == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_patterns_hold_every_piece(lengths):
    found = packing.patterns(lengths, 64)
    held = collections.Counter()
    for n, pack in found:
        assert sum(pack) <= 64 and n > 0
        for length in pack:
            held[length] += n
    assert held == lengths


def test_packing_of_equal_lengths_is_tight():
    found = packing.patterns({600: 300}, 2048)
    assert sum(n for n, _ in found) == 100


def ppm_brute(train, text, contexts):
    counts, total = [collections.defaultdict(collections.Counter) for _ in range(lm.ORDER + 1)], 0
    for b in train:
        past = (lm.START,) * lm.ORDER
        for y in [*b, lm.END]:
            total += 1
            for k in range(lm.ORDER + 1):
                counts[k][past[lm.ORDER - k :]][y] += 1
            past = (*past[1:], y)
    least = max(1, -(-total // contexts))
    counts = [{c: n for c, n in level.items() if sum(n.values()) >= least} for level in counts]
    out, past = 0.0, (lm.START,) * lm.ORDER
    for y in [*text, lm.END]:
        gone = set()
        for k in range(lm.ORDER, -1, -1):
            here = {s: n for s, n in counts[k].get(past[lm.ORDER - k :], {}).items() if s not in gone}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if y in here:
                out += math.log10(here[y] / whole)
                break
            out += math.log10(len(here) / whole)
            gone |= set(here)
        else:
            out -= math.log10(lm.ALPHABET - len(gone))
        past = (*past[1:], y)
    return out


@pytest.mark.parametrize("contexts", [1 << 18, 40])
def test_language_model(docs, monkeypatch, contexts):
    monkeypatch.setattr(lm, "CONTEXTS", contexts)
    monkeypatch.setattr(lm, "HEAD", 5)
    rows = [(i, t) for i, t in odd_texts() if i is not None]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = collections.Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*W.findall(lower(t or "")), None])
    n, v = sum(counts.values()), len(counts)
    train = [lower(t or "").encode() for i, t in rows if not held[i]]
    got = by_id(lm.scores(docs.filter("doc_id is not null")))
    for i, t in rows:
        w = [*W.findall(lower(t or "")), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            if len(t or "") < 3000:
                assert r.score == pytest.approx(ppm_brute(train, lower(t or "").encode(), contexts), rel=1e-9)


@pytest.mark.parametrize(("common", "shard"), [(1 << 21, 1 << 20), (50, 40), (0, 1)])
def test_language_model_keeps_rare_contexts(spark, monkeypatch, common, shard):
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "SHARD", shard)
    rows = [(i, f"rare{i} words {i % 3}") for i in range(24)]
    long = "".join(chr(97 + x) for x in np.random.default_rng(4).integers(0, 26, 300000))  # over 2^18 symbols
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [t.encode() for i, t in rows if i not in held]
    big = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10)
    docs = spark.createDataFrame([*rows, (big, long)], "doc_id long, text string").repartition(3)
    got = by_id(lm.scores(docs))
    assert held
    for i, t in [rows[held[0]], rows[5]]:
        assert got[i][0].score == pytest.approx(ppm_brute([*train, long.encode()], t.encode(), 1 << 62), rel=1e-9)


def test_probabilities_sum_to_one():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    code, _ = lm.codes(data, np.array([0, len(data)]))
    rows = []
    for k in range(lm.ORDER + 1):
        gram, n = np.unique(code & lm._mask(k + 1), return_counts=True)
        rows.append((k, gram, n))
    trie = lm.Trie(rows)
    context = int(code[7]) >> lm.BITS << lm.BITS
    every = np.array([context | s for s in range(lm.ALPHABET)])
    assert (10 ** trie.log10(every)).sum() == pytest.approx(1, abs=1e-9)
    assert lm.adaptive_code_length(b"ab" * 50) < 8 * 50


PAGE = "<html><head><title>t</title><script>x='<p>'</script></head><body><div class=top><a href=/>Home</a> Site of news</div><nav>menu {k}</nav><{main}><h1>Title {k}</h1><p>First <b>bold {k}</b> &amp; text<p>Second\n {k}<br>line</{main}><div class='comments'><p>nice {k}</p></div><form>Search {k}</form><div>Always the same words</div><footer>foot {k}</footer></body></html>"


@pytest.mark.parametrize("main", ["article", "div"])
def test_html(spark, main):
    rows = [(k, f"https://Example.org/{k}", PAGE.format(k=k, main=main)) for k in range(8)] + [(100, None, None), (101, "x", ""), (102, "http://a.b/c", "<p>unclosed <p>two")]
    got = {r.page_id: r for r in html_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k].text == f"Title {k} First bold {k} & text Second {k} line" and got[k].n_chars == len(got[k].text)
    assert (got[100].text, got[101].text, got[102].text) == ("", "", "unclosed two")


def html_texts(spark, pages):
    rows = [(k, "https://example.org/" + str(k), h) for k, h in enumerate(pages)]
    return {r.page_id: r.text for r in html_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_copies_and_inline_links_stay(spark):
    page = "<body><div>Same top</div><article><h1>{0}</h1><p>Text of {0} with <a href=x>link {0}</a> in it.</p></article></body>"
    got = html_texts(spark, [page.format(x) for x in ["one"] * 11 + ["two"]])
    assert got == {k: f"{x} Text of {x} with link {x} in it." for k, x in enumerate(["one"] * 11 + ["two"])}
    got = html_texts(spark, [page.format(k) for k in range(8)])
    assert got == {k: f"{k} Text of {k} with link {k} in it." for k in range(8)}


def test_html_template_the_first_page_lacks(spark):
    page = "<body><section>Notice for all</section><div><p>Story {0}</p></div><section class=low>Low {1}</section></body>"
    first = "<body><div><p>Story first</p></div></body>"
    assert html_texts(spark, [first, *(page.format(k, "part") for k in range(6))]) == {0: "Story first"} | {k + 1: f"Story {k}" for k in range(6)}
    assert html_texts(spark, [None, *(page.format(k, "part") for k in range(6))]) == {0: ""} | {k + 1: f"Story {k}" for k in range(6)}
    assert html_texts(spark, [page.format(k, "part") for k in range(2)]) == {k: f"Story {k}" for k in range(2)}


def test_html_of_plain_pages_matches_their_article(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    pages = spark.read.parquet(path)
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_pages.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        clean = (re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(b)).strip() for b in blocks)
        assert r.text == " ".join(b for b in clean if b)


def without_marks(page):
    """The page with divisions for every element that tells what it is."""
    page = re.sub(r"<(/?)(article|footer|nav|h1)\b", r"<\1div", page)
    return page.replace('class="ad"', 'class="k"')


def test_html_by_induction_alone(spark):
    """Pages without telling tags or classes give the same texts, where hosts have some pages."""
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    rows = [(r.page_id, f"https://h{k % 8}.example.org/{k}", r.html) for k, r in enumerate(spark.read.parquet(path).orderBy("page_id").collect())]
    plain = [(i, u, without_marks(h)) for i, u, h in rows]
    got, want = ({r.page_id: r.text for r in html_pages.extract(spark.createDataFrame(x, "page_id long, url string, html string")).collect()} for x in (plain, rows))
    assert sum(got[i] != want[i] for i in want) <= len(want) // 50
    marks_alone = {i: html_pages.marked_text(html_pages.parse(h)) for i, _, h in plain}
    assert sum(marks_alone[i] != want[i] for i in want) > len(want) // 2  # the wrapper decides


def brute_match(x, y):
    """The size of the largest simple tree matching, by plain recursion."""
    if x.label != y.label:
        return 0
    best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, p in enumerate(x.children):
        for j, q in enumerate(y.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(p, q))
    return 1 + best[-1][-1]


TREES = st.recursive(st.sampled_from(["<b>t</b>", "<i>u</i>", "<p>v</p>", "w"]), lambda inner: st.tuples(st.sampled_from(["div", "ul", "li", "b"]), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(TREES, TREES)
def test_matching_is_the_largest(a, b):
    x, y = (html_pages.numbered(html_pages.shape(html_pages.parse(t))) for t in (a, b))
    pairs = html_pages.match(x, y)
    assert len(pairs) == brute_match(x[0], y[0])
    assert len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)
    assert all(p.label == q.label for p, q in pairs)


def places(pairs, x, y):
    of = {id(s): k for shape in (x, y) for k, s in enumerate(shape)}
    return sorted((of[id(p)], of[id(q)]) for p, q in pairs)


def test_matching_of_wide_shapes_keeps_order():
    a, b = (f"<div>{t}</div>" for t in ("<b>t</b><i>u</i>" * 4200, "<i>u</i><b>t</b>" * 4200))
    x, y = (html_pages.numbered(html_pages.shape(html_pages.parse(t))) for t in (a, b))
    pairs = places(html_pages.match(x, y), x, y)
    assert len(pairs) == len(x) - 1
    assert [q for _, q in pairs] == sorted({q for _, q in pairs})


@settings(max_examples=100, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=30), st.lists(TREES, min_size=1, max_size=30), st.sampled_from([1, 3, 64]), st.sampled_from([0, 5, 1024]), st.sampled_from([0, 1000, 1 << 26]))
def test_matching_is_the_same_by_parts(a, b, step, narrow, held):
    x, y = (html_pages.numbered(html_pages.shape(html_pages.parse(f"<div>{''.join(t)}</div>"))) for t in (a, b))
    want = places(html_pages.match(x, y), x, y)
    assert len(want) == brute_match(x[0], y[0])
    with pytest.MonkeyPatch.context() as m:
        for name, size in (("STEP", step), ("NARROW", narrow), ("HELD", held)):
            m.setattr(html_pages, name, size)
        assert places(html_pages.match(x, y), x, y) == want


def test_html_of_wide_pages(spark):
    """A paragraph before all others moves none of thousands of slots."""
    n = 4200
    page = "<body><div>{0}" + "".join(f"<h2>{{1}} {k}</h2><p>Note {k}</p>" for k in range(n)) + "</div></body>"
    got = html_texts(spark, [page.format("", f"Part {i}") for i in range(11)] + [page.format("<p>An extra word</p>", "Last")])
    assert got == {i: " ".join(f"Part {i} {k}" for k in range(n)) for i in range(11)} | {11: " ".join(["An extra word", *(f"Last {k}" for k in range(n))])}


def test_html_deep_and_broken_pages(spark):
    deep, broken = "<div>" * 100_000 + "x", "<p>text</p>" + '<a "' * 50_000
    unclosed = "<b>" * 20_000 + "<hr>" * 20_000 + "</x>" * 20_000 + "<ul>" + "<b>" * 20_000 + "<li></li>" * 20_000
    assert html_texts(spark, [deep, deep + " y", broken, unclosed]) == {0: "x", 1: "x y", 2: "text", 3: ""}


def test_pipeline_stages(spark, docs, tmp_path):
    rows = docs.filter("doc_id is not null").drop("later", "node", "doc")
    kept = corpus_pipeline.quality_stage(spark, rows, "")
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(rows).filter("kept").collect()}
    single = corpus_pipeline.near_stage(spark, rows, "")
    assert single.columns == rows.columns and 11 not in {r.doc_id for r in single.collect()}
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.substring_stage(spark, rows, "").collect()}
    text = dict(odd_texts())
    assert (6, text[6]) in cut and (7, "") in cut and (14, text[14]) in cut
    assert corpus_pipeline.substring_stage(spark, rows, "").count() == rows.count()


def test_pipeline_runs_whole(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    common = "the of and to a in is that it for was on with as".split()
    prose = [" ".join(common[x] if x < 14 else f"{chr(97 + x % 26)}o{chr(97 + x % 7)}e{chr(97 + x // 26)}" for x in np.where(rng.random(180) < 0.3, rng.integers(0, 5, 180), rng.integers(14, 500, 180))) for _ in range(12)]
    edited = prose[0].split()
    edited[90] = "changed"
    texts = [*prose, " ".join(edited), prose[1], prose[2] + " " + " ".join(prose[3].split()[20:90]), "too short", None, "&&& %%% " * 90]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    good = {r.doc_id for r in quality.quality(spark.read.parquet(str(tmp_path / "documents.parquet"))).filter("kept").collect()}
    assert {0, 12, 13, 14} <= good and not {15, 16, 17} & good
    kept = [(i, t) for i, t in enumerate(texts) if i in good]
    least = {i for i, _, c in near_brute(kept, 80) if i == c}
    kept = [(i, t) for i, t in kept if i in least]
    assert not {12, 13} & least and 14 in least
    tk, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.Counter()
    for i, w, gone, text in substring_brute(kept):
        assert bool(gone) == (i == 14)
        ids = [*tk.encode(text if gone else texts[i], add_special_tokens=False).ids, 1]
        want[i, 0, len(ids), zlib.crc32(array("I", ids).tobytes()), len(ids)] += 1
    assert got == want


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in Q.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "packing"]
