"""Pieces of SQL that several oracle queries share: the same tokens, sentences and sides as the operators make."""

from __future__ import annotations

from prosegrid.functions import draws
from prosegrid.functions import text as T
from prosegrid.operators import chars


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


RULE_VALUES = ", ".join(f"({g}, {r}, '{name}', {a}, {b})" for g, name in enumerate(chars.GROUPS) for r, (a, b, _, _) in enumerate(chars.GROUPS[name]))

PIECE = T.PIECE.replace("'", "''")

TOKENS = rf"""
    lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_id FROM documents
    ), pieces AS (
        SELECT doc_id, block_id, unnest(regexp_extract_all(line, '{PIECE}')) AS piece, generate_subscripts(regexp_extract_all(line, '{PIECE}'), 1) - 1 AS pos FROM lines
    ), spelled AS (
        SELECT doc_id, block_id, pos, piece, regexp_replace(piece, '^\s+', '') AS text FROM pieces
    ), tokens AS (
        SELECT doc_id, block_id, pos, piece <> text AS spaced, text, lower(replace(text, '’', '''')) AS folded, CASE
            WHEN regexp_matches(text, '^`.*`$') AND length(text) > 1 THEN 'Code'
            WHEN regexp_matches(text, '^https?://') THEN 'Url'
            WHEN regexp_matches(text, '\p{{L}}') THEN 'Word'
            WHEN regexp_matches(text, '\p{{N}}') THEN 'Number'
            WHEN text IN ({quoted(T.SYMBOLS)}) THEN 'Symbol'
            WHEN regexp_matches(text, '^[\p{{P}}_]+$') THEN 'Punctuation'
            ELSE 'Symbol' END AS kind
        FROM spelled
    )"""

SENTENCES = rf"""
    settled AS (
        SELECT *, CASE WHEN text IN ({quoted(T.TERMINALS)}) THEN true WHEN text IN ({quoted(T.CLOSERS)}) AND NOT spaced THEN NULL ELSE false END AS ends FROM tokens
    ), begun AS (
        SELECT *, coalesce(last_value(ends IGNORE NULLS) OVER (PARTITION BY doc_id, block_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            AND spaced AND NOT regexp_matches(text, '^\p{{Ll}}'), false)::INT AS begins FROM settled
    ), sents AS (
        SELECT *, sum(begins) OVER (PARTITION BY doc_id, block_id ORDER BY pos) AS sent_id FROM begun
    )"""

#: Labelled English documents: side 0 is low quality, side 1 high.
SIDES = """
    sides AS (
        SELECT d.doc_id, l.quality AS side, d.source AS repo FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality IS NOT NULL
    )"""


def grams(n: int) -> str:
    """The n-grams of tokens as a query."""
    w = "OVER (PARTITION BY doc_id, block_id ORDER BY pos)"
    prose = f"(kind IN ('Word', 'Number', 'Punctuation', 'Symbol') AND text NOT IN ({quoted(T.TERMINALS)}))"
    edge = "(kind IN ('Word', 'Number'))"
    ahead = " || ' ' || ".join(f"lead(folded, {k}) {w}" if k else "folded" for k in range(n))
    good = " AND ".join([edge, f"lead({edge}, {n - 1}) {w}" if n > 1 else edge, *(f"lead({prose}, {k}) {w}" for k in range(1, n))])
    return f"SELECT doc_id, block_id, pos, gram FROM (SELECT doc_id, block_id, pos, {ahead} AS gram, {good} AND {prose} AS good FROM tokens) WHERE good"


def generated(seeds: str) -> str:
    """The draws of (k, seed, most) rows as a recursive query: gen(k, i, s), and drawn(k, i, v) with the draws from 0 on. Goes first, after WITH RECURSIVE."""
    return f"""
    gen AS (
        SELECT k, 0::BIGINT AS i, seed AS s, most FROM {seeds}
        UNION ALL
        SELECT k, i + 1, xor(b, b >> 27), most FROM (SELECT k, i, most, xor(a, (a & 549755813887::UBIGINT) << 25) AS b FROM (SELECT k, i, most, xor(s, s >> 12) AS a FROM gen WHERE i < most))
    ), drawn AS (
        SELECT k, i - 1 AS i, ((s::UHUGEINT * {draws.MULTIPLIER}::UHUGEINT) & 18446744073709551615::UHUGEINT)::UBIGINT AS v FROM gen WHERE i > 0
    )"""


def label_seed(label: str) -> str:
    """The seed that a label makes."""
    hashed = f"list_reduce(list_concat([{draws.FNV_START}::UHUGEINT], list_transform(string_split({label}, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, b: (xor(h, b) * {draws.FNV_PRIME}::UHUGEINT) & 18446744073709551615::UHUGEINT)"
    return f"xor({hashed}::UBIGINT, {draws.SEED}::UBIGINT)"
