"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and its histogram of common words are compared with
language references by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1).
The nearest language counts, so that no language column is needed. Distances are only judged from
``MIN_CLASS_WORDS`` and ``MIN_COMMON_WORDS`` words on, because short histograms are noise. References
are fitted by ``fitted`` on a bounded sample of labelled documents. Text in a language without a
reference is far from all of them and is rejected, once it has enough words to be judged.

Words are runs of ``[^\\x20\\x09-\\x0D]``. ``base_failed`` is the plain rule: fewer than 50 words, or
over half of the words in three-word windows that occur twice or more. Repeated windows are found by
sorting a text's windows with their places, only where a text has any; equal neighbours mark the
places, and the gaps between marked places give the number of covered words.

Null text has no words and fails. Empty texts, repeated rows and null ids pass through, a row each.
One narrow pass over whole texts, no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of characters, stripped in this order; what is left is the last class.
CLASSES = (
    ("lower", r"[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"[A-Z]+"),
    ("letter", r"\p{L}+"),
    ("digit", r"\p{N}+"),
    ("sentence", r"[.,;:!?\x27\x22()\-]+"),
    ("symbol", r"[#*$%&|<>]+"),
)
#: Shares of the classes, and of other characters, as ``fitted`` gives them from the test tables at
#: scale 0.1: 200 documents of each language that are labelled as of good quality.
CLASS_REFERENCE = {
    "en": (0.7952, 0.1666, 0.0136, 0.0001, 0.0008, 0.0236, 0.0, 0.0),
    "de": (0.7732, 0.1544, 0.0122, 0.0381, 0.0004, 0.0217, 0.0, 0.0),
    "fr": (0.708, 0.1667, 0.0104, 0.0906, 0.0008, 0.0236, 0.0, 0.0),
    "es": (0.7243, 0.1614, 0.012, 0.0782, 0.001, 0.0231, 0.0, 0.0),
}
#: Shares of the most common words in the same documents.
WORD_REFERENCE = {
    "en": {"the": 0.0553, "of": 0.0287, "and": 0.0225, "to": 0.0166, "a": 0.014, "in": 0.0118, "is": 0.0112, "that": 0.0094, "for": 0.008, "it": 0.0077},
    "de": {"der": 0.0542, "die": 0.0288, "und": 0.0228, "in": 0.017, "den": 0.0136, "von": 0.0122, "zu": 0.0098, "das": 0.0096, "sich": 0.0079, "mit": 0.0075},
    "fr": {"de": 0.0562, "la": 0.0305, "le": 0.0217, "et": 0.0171, "les": 0.0141, "des": 0.0121, "en": 0.0111, "un": 0.0094, "du": 0.0078, "une": 0.007},
    "es": {"de": 0.0546, "la": 0.0287, "que": 0.0219, "el": 0.0165, "en": 0.0137, "y": 0.0115, "los": 0.0107, "se": 0.0088, "las": 0.0087, "del": 0.0075},
}
#: Documents of each language that ``fitted`` takes.
FITTED = 200
MIN_WORDS, MAX_REPEATED = 50, 50
#: Limits a third above the largest distances, 0.250 and 0.218, of the 3243 good documents of the same
#: tables that pass the plain rule.
MIN_CLASS_WORDS, MAX_CLASS_DISTANCE = 50, 0.33
MIN_COMMON_WORDS, MAX_COMMON_DISTANCE = 100, 0.292
COMMON = sorted({w for words in WORD_REFERENCE.values() for w in words})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, n: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def joined(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))

    def places(s: Column) -> Column:
        equal = F.filter(s, lambda x, j: (F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(equal, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def count(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == n - 2, F.lit(0)).otherwise(let(placed, lambda s: let(places(s), covered)))

    return F.when(n < 4, F.lit(0)).otherwise(let(F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), joined), count)).cast("long")


def count_of(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column) -> Column:
    """The number of characters of each class, and of the others."""

    def strip(rest: Column, left: tuple, counts: list[Column]) -> Column:
        if not left:
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, left[0][1], ""), lambda after: strip(after, left[1:], [*counts, F.length(rest) - F.length(after)]))

    return strip(text, CLASSES, [])


def opaque(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns made by a generator of one row: neither a filter on them nor what is built
    on them makes the optimiser copy what they are computed from."""
    made = F.struct(*[c.alias(k) for k, c in columns.items()])
    return rows.select("*", F.inline_outer(F.array(made)))


def divergence(shares: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon divergence in bits between an array of shares and a reference."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*[F.lit(float(q)) for q in reference]), term)
    return F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` with the rule's figures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, common_distance, base_failed and kept. Columns of these names are replaced; what
    else ``docs`` has stays, whatever its names."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed", "kept"]
    given = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))

    def by_words(words: Column) -> Column:
        n = F.size(words)
        common = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(COMMON))
        counts = let(common, lambda c: F.array(*[count_of(c, x) for x in COMMON]))
        return F.struct(n.cast("long").alias("n"), repeated_words(words, n).alias("again"), counts.alias("common"))

    rows = opaque(rows, chars=class_counts(F.col("whole")), words=let(word_array(F.col("whole")), by_words), again_lines=duplicate_lines(F.col("whole")), size=F.length("whole"))
    n, names = F.col("words.n"), [name for name, _ in CLASSES]
    rates = F.transform("words.common", lambda x: x / F.greatest(n, F.lit(1)))

    def of(language: dict[str, float]) -> Column:
        held = F.transform(F.array(*[F.lit(COMMON.index(w)) for w in language]), lambda k: F.get(F.col("rates"), k))
        rest = F.greatest(F.lit(1.0) - F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        return divergence(F.concat(held, F.array(rest)), [*language.values(), 1 - sum(language.values())])

    rows = opaque(rows, shares=F.transform("chars", lambda x: x / F.greatest(F.col("size"), F.lit(1))), rates=rates)
    rows = opaque(
        rows,
        n_words=n,
        word_chars=(F.col("size") - F.get("chars", F.lit(names.index("space")))).cast("long"),
        n_symbols=F.get("chars", F.lit(names.index("symbol"))).cast("long"),
        n_dup_lines=F.col("again_lines"),
        n_repeat_words=F.col("words.again"),
        class_distance=F.sqrt(F.least(*[divergence(F.col("shares"), list(q)) for q in CLASS_REFERENCE.values()])),
        common_distance=F.sqrt(F.least(*[of(x) for x in WORD_REFERENCE.values()])),
        base_failed=(n < MIN_WORDS) | (F.col("words.again") * 100 > n * MAX_REPEATED),
    )
    odd_class = (F.col("n_words") >= MIN_CLASS_WORDS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("common_distance") > MAX_COMMON_DISTANCE)
    rows = opaque(rows, kept=~F.col("base_failed") & ~odd_class & ~odd_words)
    return rows.select("row.*", *own)


def fitted(docs: DataFrame, labels: DataFrame, languages: tuple[str, ...] = tuple(CLASS_REFERENCE), most: int = FITTED) -> DataFrame:
    """lang, classes (shares in the order of CLASSES and the rest) and words (the ten most common with
    their shares, most common first), rounded to four places, from the documents of good quality in
    ``labels`` (doc_id, quality): of each language those with the ``most`` smallest doc_ids."""
    good = docs.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id").filter(F.col("lang").isin(list(languages)) & F.col("text").isNotNull())
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "text"))
    rows = good.select("lang", F.col("text").alias("whole"), place.alias("place")).filter(F.col("place") <= most)
    rows = opaque(rows, chars=class_counts(F.col("whole")), words=word_array(F.lower("whole")))
    shares = [F.round(F.sum(F.get("chars", F.lit(k))) / F.sum(F.length("whole")), 4) for k in range(len(CLASSES) + 1)]
    classes = rows.groupBy("lang").agg(F.array(*shares).alias("classes"), F.sum(F.size("words")).alias("all"))
    counted = rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).filter("rank <= 10").join(classes, "lang")
    share = F.struct("rank", "word", F.round(F.col("n") / F.col("all"), 4).alias("share"))
    return top.groupBy("lang", "classes").agg(F.transform(F.sort_array(F.collect_list(share)), lambda x: F.struct(x["word"], x["share"])).alias("words"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return quality(rows).filter("kept").select("row.*")
