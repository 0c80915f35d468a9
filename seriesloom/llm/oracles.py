"""DuckDB SQL for the corpus queries that SQL can express, on small tables."""

from __future__ import annotations

from seriesloom.llm import quality as Q

SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array({{}}, '{SPACE}'), lambda x: x <> '')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def substrings() -> str:
    return (
        f"WITH w AS (SELECT doc_id, {WORDS.format('coalesce(text, chr(32))')} AS ws FROM documents), "
        "g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)), "
        "f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k), "
        "p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE m < doc_id), "
        "a AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)), "
        "r AS (SELECT a.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY i) AS t FROM a LEFT JOIN p ON p.doc_id = a.doc_id AND p.p = a.i WHERE p.p IS NULL GROUP BY a.doc_id) "
        "SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id"
    )


def near() -> str:
    low = "translate(coalesce(text, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(low)} AS ws FROM documents), "
        "s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
        "c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2), "
        "l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), "
        "e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), "
        "r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), "
        "m AS (SELECT a, min(b) AS b FROM r GROUP BY a) "
        "SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id"
    )


def quality() -> str:
    """The rule's counts and verdict; the distances themselves are left to the verdict."""
    strips, before = [], "t"
    for k, (_, pattern) in enumerate(Q.CLASSES):
        strips.append(f"s{k} AS (SELECT *, regexp_replace({before}, {_literal(pattern)}, '', 'g') AS t{k} FROM {'d' if not k else f's{k - 1}'})")
        before = f"t{k}"
    last = len(Q.CLASSES) - 1
    counts = [f"length({'t' if not k else f't{k - 1}'}) - length(t{k})" for k in range(last + 1)] + [f"length(t{last})"]

    def distance(shares: list[str], reference: list[float]) -> str:
        terms = []
        for p, q in zip(shares, reference, strict=True):
            m = f"(({p}) + {q!r}) / 2"
            terms.append(f"CASE WHEN ({p}) > 0 THEN ({p}) * log2(({p}) / ({m})) ELSE 0 END" + (f" + {q!r} * log2({q!r} / ({m}))" if q > 0 else ""))
        return f"greatest(({' + '.join(terms)}) / 2, 0)"

    shares = [f"c{k} / greatest(length(t), 1)" for k in range(last + 2)]
    classes = f"sqrt(least({', '.join(distance(shares, list(q)) for q in Q.CLASS_REFERENCE.values())}))"
    words = []
    for reference in Q.WORD_REFERENCE.values():
        found = [f"w{Q.COMMON.index(x)} / greatest(n_words, 1)" for x in reference]
        words.append(distance([*found, f"greatest(1.0 - ({' + '.join(found)}), 0.0)"], [*reference.values(), 1 - sum(reference.values())]))
    common = ", ".join(f"CAST(len(list_filter(ws, lambda x: lower(x) = {_literal(x)})) AS DOUBLE) AS w{k}" for k, x in enumerate(Q.COMMON))
    names = [n for n, _ in Q.CLASSES]
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        f"{', '.join(strips)}, "
        f"a AS (SELECT doc_id, t, {', '.join(f'CAST({c} AS DOUBLE) AS c{k}' for k, c in enumerate(counts))}, {WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM s{last}), "
        f"b AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words, {common} FROM a), "
        "g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM a)), "
        "h AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1), "
        "r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN h ON h.doc_id = g.doc_id AND h.k = g.k) GROUP BY doc_id), "
        f"v AS (SELECT b.*, coalesce(r.n, 0) AS n_repeat_words, {classes} AS dc, sqrt(least({', '.join(words)})) AS dw FROM b LEFT JOIN r ON r.doc_id = b.doc_id), "
        f"z AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words AS base_failed FROM v) "
        f"SELECT doc_id, n_words, CAST(length(t) - c{names.index('space')} AS BIGINT) AS word_chars, CAST(c{names.index('symbol')} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, "
        f"CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (n_words >= {Q.MIN_CLASS_WORDS} AND dc > {Q.MAX_CLASS_DISTANCE}) AND NOT (n_words >= {Q.MIN_COMMON_WORDS} AND dw > {Q.MAX_COMMON_DISTANCE}) AS kept FROM z"
    )


ORACLES = {"op3_quality_rules": quality(), "op4_minhash_near_dedup": near(), "op6_substring_dedup": substrings()}
