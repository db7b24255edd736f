"""The prose lints as queries: documents with a planted line each, beside the SQL that must agree.

The driver's texts are invented words, so a line of plain English goes at the end of each of them;
lints run over all lines, planted or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.functions import text as T
from prosegrid.operators import chars, lints
from prosegrid.operators import tokens as K
from prosegrid.plans.check import Settings, check_documents
from prosegrid.plans.fragments import RULE_VALUES, SENTENCES, TOKENS, quoted

PLANTED = [
    "The ferry carries no lorries, and the pier needs no paint. There is no lighthouse.",
    "A tenant pays no rent this year; the landlord says no word and takes no longer walks.",
    "The well holds nothing, the bucket has none, and the rope means nothing.",
    "The choir sings nothing but hymns. The organist plays nothing new. A thief finds none of the silver.",
    "The goat does not sleep at all. The sheep have no shade at all, and the dog doesn't mind at all.",
    "Why would the clock not ring at all? Not at all. A: Not at all. The mill grinds well or not at all.",
    "It is not at all cold, never windy at all (the almanac says so), and nobody cannot sleep at all.",
    "We moored at the village's own quay and drank the innkeeper's very own cider.",
    "The weavers' own looms hum, and one's own bed is best; the weaver's and dyer's own guild agreed.",
    "Each valley’s own cheese is sold in the valley's own 3 shops, and it's own stall is full.",
    "Paint the fence with two thin coats of oil, not with one thick coat.",
    "Keep the seedlings in the warm shed by the wall - never on the windy terrace.",
    "Bring the letters to the old post office — not to the new one; the clerk is kind.",
    "The orchard was sold by the elder sister, not only for money.",
    "Not a single boat that the harbour keeper counted, not a raft.",
    "Lay the tiles from the middle of the room outward -- not from a corner.",
    "She painted the door, the gate and the well/pump handle green, never the low/high shutters.",
    "Store the apples on straw in the loft; never let them touch.",
    "PLEASE DO NOT FEED THE GEESE. The sign says KEEP OUT, and RYE OR SPELT is sold here.",
    "ALWAYS SHUT THE GATE! The NW RAIL timetable is on the wall, AND THE BELL rings.",
    "The **last train** leaves at _noon_; **mind the gap** and *wave*.",
    "A plain line that no lint minds, with its own commas, colons: and dashes - like this.",
    "The judge hears no appeal, hears no plea has no pity, and reads no letters no longer.",
    "Nothing is wrong. None came. The scale shows nothing wrong, and the cook makes nothing else.",
]

WORD_KIND = "kind = 'Word'"
BY = "PARTITION BY doc_id, block_id, sent_id"
W = f"OVER ({BY} ORDER BY pos)"
WHOLE = f"OVER ({BY})"

_VALUES = ", ".join(f"({n}, {quoted([line])})" for n, line in enumerate(PLANTED))
READ = f"""
    lines_to_plant(k, line) AS (VALUES {_VALUES}),
    planted AS (SELECT doc_id, text || chr(10) || line AS text FROM documents JOIN lines_to_plant ON doc_id % {len(PLANTED)} = k),
    {TOKENS.replace("FROM documents", "FROM planted")}, {SENTENCES}"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of the lines at its end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.get(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % len(PLANTED)).cast("int"))
    return docs.withColumn("text", F.concat("text", F.lit("\n"), line))


def planted_sentences(spark: SparkSession, sf_dir: str, lint: str) -> DataFrame:
    """Tokens of the lines that hold a word without which the lint has no place; all lines are read where they lie, and only those move."""
    lines = K.line_blocks(planted(spark, sf_dir)).where(F.col("text").rlike(lints.NEEDED[lint]))
    return K.sentences(K.tokens(lines.repartition("doc_id", "block_id")))


def _places(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("block_id", "sent_id", "pos", "length")), *more)


def _lint(name: str, sql: str) -> None:
    def places(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _places(lints.LINTS[name](planted_sentences(spark, sf_dir, name)))

    QUERIES[f"lint_{name}"] = places
    ORACLES[f"lint_{name}"] = f"WITH {READ}, {sql}"


def _kept(hits: str) -> str:
    """Of hits that overlap the one before, every second is taken: leftmost, without overlap."""
    return f"""
        fresh AS (SELECT *, CASE WHEN pos < lag(pos + length) {W} THEN 0 ELSE 1 END AS apart FROM ({hits})),
        islands AS (SELECT *, sum(apart) {W} AS island FROM fresh),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, sent_id, island ORDER BY pos) AS n FROM islands)
        SELECT doc_id, block_id::BIGINT AS block_id, sent_id::BIGINT AS sent_id, pos::BIGINT AS pos, length::BIGINT AS length FROM kept WHERE n % 2 = 1"""


def _verb_sql(excluded: list[str]) -> str:
    return f"({WORD_KIND} AND ends_with(folded, 's') AND NOT contains(folded, '''') AND folded NOT IN ({quoted(excluded)}))"


_lint(
    "verbs_no_nouns",
    f"""ahead AS (
            SELECT *, {_verb_sql(lints.FUNCTION_WORDS + lints.CLAUSE_VERBS)} AS verb, lead(folded) {W} AS f1, lead(kind) {W} AS k1, lead(folded, 2) {W} AS f2, lead(kind, 2) {W} AS k2 FROM sents
        ), {_kept(f"SELECT doc_id, block_id, sent_id, pos, 3 AS length FROM ahead WHERE verb AND f1 = 'no' AND k1 = 'Word' AND k2 = 'Word' AND f2 NOT IN ({quoted(lints.NO_STOP_WORDS)})")}""",
)
_lint(
    "verbs_nothing",
    f"""ahead AS (
            SELECT *, {_verb_sql([w for w in lints.FUNCTION_WORDS + lints.CLAUSE_VERBS if w != "does"] + lints.RETURN)} OR ({WORD_KIND} AND folded IN ({quoted(lints.READ_AS_VERBS)})) AS verb,
                lead(folded) {W} AS f1, lead(text) {W} AS t1, lead(kind) {W} AS k1, lead(folded, 2) {W} AS f2, lead(kind, 2) {W} AS k2 FROM sents
        ), {_kept(f"SELECT doc_id, block_id, sent_id, pos, 2 AS length FROM ahead WHERE verb AND f1 IN ({quoted(lints.NOTHING_OBJECTS)}) AND k1 = 'Word' AND t1 NOT IN ('None', 'Nothing', 'NONE', 'NOTHING') AND NOT coalesce(k2 = 'Word' AND f2 IN ({quoted([*lints.NOTHING_STOP_WORDS, 'of', 'wrong'])}), false)")}""",
)
_lint(
    "not_at_all",
    f"""marked AS (
            SELECT *, {WORD_KIND} AND (folded IN ({quoted(lints.NEGATORS)}) OR ends_with(folded, 'n''t')) AS negates, text IN (',', ';', ':') AND kind IN ('Punctuation', 'Symbol') AS parts,
                lag(folded) {W} = 'or' AND lag(kind) {W} = 'Word' AS after_or FROM sents
        ), near AS (
            SELECT *, max(CASE WHEN negates THEN pos END) {W[:-1]} ROWS BETWEEN {lints.AT_ALL_GAP + 1} PRECEDING AND 1 PRECEDING) AS first, max(CASE WHEN parts THEN pos END) {W[:-1]} ROWS BETWEEN {lints.AT_ALL_GAP + 1} PRECEDING AND 1 PRECEDING) AS part,
                lead(folded) {W} AS f1, lead(kind) {W} AS k1, lead(kind, 2) {W} AS k2 FROM marked
        ), ends AS (
            SELECT * FROM near WHERE folded = 'at' AND kind = 'Word' AND f1 = 'all' AND k1 = 'Word' AND coalesce(k2, '') <> 'Word' AND first IS NOT NULL AND coalesce(part, -1) < first
        ), whole AS (
            SELECT doc_id, block_id, sent_id, arg_max(text, pos) FILTER (text IN ({quoted(T.TERMINALS)})) AS closing, count(*) FILTER (kind NOT IN ('Punctuation', 'Symbol')) AS words, max(pos) FILTER (text = ':') AS colon FROM sents GROUP BY ALL
        ), found AS (
            SELECT e.doc_id, e.block_id, e.sent_id, e.first AS pos, max(e.pos) + 2 - e.first AS length FROM ends e JOIN marked m ON m.doc_id = e.doc_id AND m.block_id = e.block_id AND m.pos = e.first WHERE NOT coalesce(m.after_or, false) GROUP BY e.doc_id, e.block_id, e.sent_id, e.first
        )
        SELECT f.doc_id, f.block_id::BIGINT AS block_id, f.sent_id::BIGINT AS sent_id, f.pos::BIGINT AS pos, length::BIGINT AS length FROM found f JOIN whole w ON w.doc_id = f.doc_id AND w.block_id = f.block_id AND w.sent_id = f.sent_id
        WHERE coalesce(closing, '') <> '?' AND NOT (length = 3 AND words - CASE WHEN coalesce(colon < pos, false) THEN least(words - 3, 3) ELSE 0 END = 3)""",
)

_AFTER = f"({{k}} = 'Word' AND {{f}} NOT IN ({quoted(lints.PREPOSITIONS + lints.CONJUNCTIONS + lints.DETERMINERS + lints.AUXILIARIES)}) OR {{k}} IN ('Code', 'Number'))"


def _own(start: str, first: int) -> str:
    """Hits whose possessive is read up to the token before first: own there, or very and own."""
    f, k = (lambda n: f"f{n}"), (lambda n: f"k{n}")
    plain = f"{f(first)} = 'own' AND {k(first)} = 'Word' AND {_AFTER.format(k=k(first + 1), f=f(first + 1))}"
    very = f"{f(first)} = 'very' AND {k(first)} = 'Word' AND {f(first + 1)} = 'own' AND {k(first + 1)} = 'Word' AND {_AFTER.format(k=k(first + 2), f=f(first + 2))}"
    return f"SELECT doc_id, block_id, sent_id, pos, CASE WHEN {very} THEN {first + 3} ELSE {first + 2} END AS length FROM ahead WHERE {start} AND coalesce(({plain}) OR ({very}), false)"


_lint(
    "possessive_own",
    f"""marked AS (
            SELECT *, {WORD_KIND} AND ends_with(folded, '''s') AND folded NOT IN ({quoted(lints.PRONOUNS_IN_S)}) AS owner, {WORD_KIND} AND ends_with(folded, 's') AS plural,
                text IN ('''', '’') AND NOT spaced AS mark, {WORD_KIND} AND folded IN ('and', 'or') OR text = ',' AND kind IN ('Punctuation', 'Symbol') AS connects, {WORD_KIND} AND folded IN ({quoted(lints.DETERMINERS)}) AS det FROM sents
        ), ended AS (SELECT *, owner OR (mark AND coalesce(lag(plural) {W}, false)) AS owns FROM marked),
        coupled AS MATERIALIZED (SELECT *, connects AND coalesce(last_value(CASE WHEN NOT connects THEN owns END IGNORE NULLS) {W}, false) AS joined FROM ended),
        ahead AS MATERIALIZED (
            SELECT *, lag(joined) {W} OR (lag(det) {W} AND lag(joined, 2) {W}) AS coordinated, lead(mark) {W} AS mark1, {", ".join(f"lead(folded, {n}) {W} AS f{n}, lead(kind, {n}) {W} AS k{n}" for n in (1, 2, 3, 4))} FROM coupled
        ), single AS ({_own("owner", 1)}), several AS ({_own("plural AND coalesce(mark1, false)", 2)}),
        fresh AS (SELECT *, CASE WHEN pos < lag(pos + length) OVER (PARTITION BY way, doc_id, block_id, sent_id ORDER BY pos) THEN 0 ELSE 1 END AS apart FROM (SELECT 1 AS way, * FROM single UNION ALL SELECT 2, * FROM several)),
        islands AS (SELECT *, sum(apart) OVER (PARTITION BY way, doc_id, block_id, sent_id ORDER BY pos) AS island FROM fresh),
        kept AS (SELECT *, row_number() OVER (PARTITION BY way, doc_id, block_id, sent_id, island ORDER BY pos) AS n FROM islands)
        SELECT k.doc_id, k.block_id::BIGINT AS block_id, k.sent_id::BIGINT AS sent_id, k.pos::BIGINT AS pos, k.length::BIGINT AS length
        FROM kept k JOIN ahead a ON a.doc_id = k.doc_id AND a.block_id = k.block_id AND a.pos = k.pos WHERE k.n % 2 = 1 AND NOT coalesce(a.coordinated, false)""",
)


def _at(column: str, k: int = 0) -> str:
    """What stands k tokens after the one that follows a dash or comma; two hyphens are one dash."""
    return f"CASE WHEN dbl THEN lead({column}, {2 + k}) {W} ELSE lead({column}, {1 + k}) {W} END"


_ONE = [p for p in lints.NOT_THEN if " " not in p]
_TWO = [p.split() for p in lints.NOT_THEN if " " in p]
_TWO_SQL = " OR ".join(f"(n1 = {quoted([a])} AND n2 = {quoted([b])})" for a, b in _TWO)
_lint(
    "denial_tail",
    f"""d0 AS (
            SELECT *, coalesce(text = '-' AND lead(text) {W} = '-' AND NOT lead(spaced) {W}, false) AS dbl, kind IN ('Word', 'Number', 'Code', 'Url') AS counts FROM sents
        ), d1 AS (
            SELECT *, spaced AND ((text IN ('–', '-') AND NOT dbl AND coalesce(lead(spaced) {W}, false)) OR (dbl AND coalesce(lead(spaced, 2) {W}, false))) AS spaced_dash, text = '—' AS em,
                coalesce(lag(text) {W} IN ('-', '/') AND NOT spaced AND NOT lag(spaced) {W} AND lag(counts, 2) {W}, false) AS joined,
                text IN ('→', '=') OR (text = '>' AND NOT spaced AND coalesce(lag(text) {W} IN ('-', '='), false)) AS arrow,
                max(CASE WHEN text NOT IN ({quoted(lints.TAIL_CLOSING)}) THEN pos END) {WHOLE} AS last, min(pos) {WHOLE} AS first_pos FROM d0
        ), d2 AS (
            SELECT *, spaced_dash OR em AS dash, text IN (',', ';', ':', '(') OR spaced_dash OR (em AND spaced AND coalesce(lead(spaced) {W}, false)) AS splits,
                CASE WHEN kind = 'Code' THEN greatest(1, len(string_split_regex(trim(replace(text, '`', '')), '\\s+'))) WHEN counts AND NOT joined THEN 1 ELSE 0 END AS size FROM d1
        ), d3 AS (SELECT *, splits AND NOT (text = ',' AND coalesce(lead(folded) {W} IN ({quoted(lints.TAIL_COMMA_THEN)}), false)) AS parts FROM d2),
        d4 AS (
            SELECT *, sum(size) {W} AS words, sum(parts::INT) {W} AS parts_here, sum(arrow::INT) {W} AS arrows_here, sum(splits::INT) {W} AS clause,
                sum(CASE WHEN pos <= last THEN size ELSE 0 END) {WHOLE} AS all_words, sum(CASE WHEN pos <= last THEN parts::INT ELSE 0 END) {WHOLE} AS all_parts, sum(CASE WHEN pos <= last THEN arrow::INT ELSE 0 END) {WHOLE} AS all_arrows FROM d3
        ), d5 AS (
            SELECT *, arg_min(kind, pos) FILTER (kind <> 'Punctuation') OVER (PARTITION BY doc_id, block_id, sent_id, clause) AS opener_kind,
                arg_min(folded, pos) FILTER (kind <> 'Punctuation') OVER (PARTITION BY doc_id, block_id, sent_id, clause) AS opener FROM d4
        ), d6 AS (
            SELECT *, coalesce(lag(opener_kind) {W} = 'Word' AND lag(opener) {W} IN ({quoted(lints.DENIALS)}), false) AS denied, {_at("folded")} AS n0, {_at("text")} AS t0, {_at("folded", 1)} AS n1, {_at("folded", 2)} AS n2,
                coalesce({_at("text", 1)} = '-' AND NOT {_at("spaced", 1)}, false) AS hyphenated, all_words - {_at("words")} AS tail, {_at("parts_here")} AS parts_then, {_at("arrows_here")} AS arrows_then FROM d5
        )
        SELECT doc_id, block_id::BIGINT AS block_id, sent_id::BIGINT AS sent_id, min(pos)::BIGINT AS pos, (max(last) + 1 - min(pos))::BIGINT AS length FROM d6
        WHERE (text IN (',', ';') OR dash) AND pos > first_pos AND n0 IN ('not', 'never') AND NOT hyphenated AND NOT (dash AND coalesce(regexp_matches(t0, '^\\p{{Lu}}\\p{{Ll}}*$'), false))
            AND NOT coalesce(n1 IN ({quoted(_ONE)}), false) AND NOT coalesce({_TWO_SQL}, false) AND NOT denied
            AND coalesce(tail BETWEEN {lints.LEAST_TAIL} AND {lints.MOST_TAIL} AND tail < words - size AND all_parts = parts_then AND all_arrows = arrows_then, false)
        GROUP BY doc_id, block_id, sent_id""",
)


def caps_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lints.caps_runs(K.tokens(K.line_blocks(planted(spark, sf_dir), windowed=True)))
    return found.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("pos").cast("long").alias("pos"), "words")


SETTINGS = Settings(max_size_bytes=8000, char_groups=list(chars.GROUPS), allowed_chars=["é", "§"], banned_chars={"ß": "ss", "§": "section", "|": "or"}, phrases=["of the", "is sold"], allowed_phrases=["of the silver"], density=True)
#: Exempt: the tails of one planted line, and the phrase of another.
EXEMPT = [(10, "denial_tail"), (9, "banned_phrases")]


def check_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check over all documents by stand-in settings, lines as paragraphs, with exemptions: how many findings of a lint a line has."""
    docs = planted(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    blocks = K.line_blocks(docs.select(F.col("path").alias("doc_id"), "text"), windowed=True).select("doc_id", "block_id", F.lit("Paragraph").alias("kind"), F.lit(None).cast("string").alias("heading"), (F.col("block_id") + 1).alias("first_line"), "text")
    entries = None
    for k, lint in EXEMPT:
        rows = docs.where(F.col("doc_id") % len(PLANTED) == k).select(F.col("doc_id").alias("entry"), "path", F.lit(lint).alias("lint"), F.lit(PLANTED[k].upper()).alias("quote"))
        entries = rows if entries is None else entries.unionByName(rows)
    found = check_documents(docs.select("path", "text"), settings=SETTINGS, allowed=entries, blocks=blocks)
    return found.groupBy("path", "lint", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"))


def _sentence_lint(name: str) -> str:
    """The lint's places as a subquery of its own query's SQL."""
    return f"SELECT doc_id, block_id + 1 AS line, '{name}' AS lint, pos FROM (WITH {ORACLES[f'lint_{name}'].removeprefix(f'WITH {READ}, ')})"


_PHRASE = f"lead(folded) {W}"
QUERIES["check_findings"] = check_findings
ORACLES["check_findings"] = rf"""
    WITH {READ}, rules(group_ord, rule_ord, char_group, first, last) AS (VALUES {RULE_VALUES}),
    near AS (SELECT *, lead(folded) OVER (PARTITION BY doc_id, block_id ORDER BY pos) AS f1, lead(folded, 2) OVER (PARTITION BY doc_id, block_id ORDER BY pos) AS f2 FROM sents),
    places AS (SELECT doc_id, block_id + 1 AS line, unnest(regexp_extract_all(line, '[^\x00-\x7F]|[|]')) AS ch FROM lines),
    judged AS (SELECT ch FROM (SELECT DISTINCT ch FROM places) WHERE ch NOT IN ('é', '§') AND (ch IN ('ß', '§', '|') OR EXISTS (SELECT 1 FROM rules WHERE unicode(ch) BETWEEN first AND last))),
    found AS (
        SELECT doc_id, NULL::BIGINT AS line, 'max_size_bytes' AS lint, 0 AS pos FROM planted WHERE octet_length(encode(text)) > 8000
        UNION ALL SELECT doc_id, line, 'banned_chars', 0 FROM places SEMI JOIN judged USING (ch)
        UNION ALL SELECT doc_id, block_id + 1, 'banned_phrases', pos FROM near WHERE (folded = 'of' AND f1 = 'the' AND coalesce(f2, '') <> 'silver') OR (folded = 'is' AND f1 = 'sold' AND doc_id % {len(PLANTED)} <> 9)
        UNION ALL SELECT doc_id, block_id + 1, 'density', 0 FROM lines WHERE length(line) > 600
        {" ".join(f"UNION ALL {_sentence_lint(name)}" for name in lints.LINTS)}
    )
    SELECT doc_id::VARCHAR AS path, lint, line::BIGINT AS line, count(*) AS n FROM found
    WHERE NOT (lint = 'denial_tail' AND doc_id % {len(PLANTED)} = 10 AND line = (SELECT max(block_id) + 1 FROM lines l WHERE l.doc_id = found.doc_id)) GROUP BY ALL"""


QUERIES["caps_runs"] = caps_runs
ORACLES["caps_runs"] = rf"""
    WITH {READ}, caps AS (SELECT *, kind = 'Word' AND length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]') AS caps FROM tokens),
    islands AS (SELECT *, sum(CASE WHEN caps THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, block_id ORDER BY pos) AS island FROM caps)
    SELECT doc_id, block_id, min(pos) AS pos, count(*) AS words FROM islands WHERE caps GROUP BY doc_id, block_id, island
    HAVING count(*) >= 2 AND count(*) FILTER (replace(text, '’', '''') IN ({quoted(lints.SHOUTED_WORDS)})) >= 1"""


# Lints of whole documents, over Markdown made from the documents' words and numbers.

FREE_SPANS, MOST_PERCENT = 3, 5.0


def lint_max_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words as a paragraph, a stretch of them, by its number, strong or light: those with too much emphasis."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    # The stretch begins at a word of the text by its number, and takes up to an eighth of the words.
    size = F.size("words")
    begins, spans = (F.col("doc_id") % F.greatest(size, F.lit(1))).cast("int"), F.floor(size * (F.col("doc_id") % 7) / 48).cast("int")
    held = F.transform(F.slice("words", begins + 1, spans), lambda w, i: F.when(i % 2 == 0, F.concat(F.lit("**"), w, F.lit("**"))).otherwise(F.concat(F.lit("*"), w, F.lit("*"))))
    marked = F.concat(F.slice("words", F.lit(1), begins), held, F.slice("words", begins + spans + 1, size))
    placed = docs.select("doc_id", words.alias("words"))
    made = placed.select(F.col("doc_id").cast("string").alias("path"), F.array_join(marked, " ").alias("text"))
    found = check_documents(made, ["max_emphasis"], settings=Settings(max_emphasis=(FREE_SPANS, MOST_PERCENT)))
    return found.select("path", "quote")


QUERIES["lint_max_emphasis"] = lint_max_emphasis
ORACLES["lint_max_emphasis"] = f"""
    WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT *, ws[doc_id % greatest(len(ws), 1) + 1:doc_id % greatest(len(ws), 1) + len(ws) * (doc_id % 7) // 48] AS held FROM w),
    m AS (SELECT doc_id, len(held) AS spans, length(array_to_string(held, '')) AS chars, length(array_to_string(ws, ' ')) AS prose FROM p)
    SELECT doc_id::VARCHAR AS path, printf('%d spans, %.2f %%', spans, ceil(100.0 * chars / prose * 100) / 100) AS quote FROM m WHERE spans > {FREE_SPANS} AND 100.0 * chars / prose > {MOST_PERCENT}"""


def lint_repo_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines and then a layout index, as long and as broken as its number says, against twelve known paths."""
    n = F.col("doc_id")
    path = lambda i: F.concat(F.lit("p"), i.cast("string"))
    entry = lambda i: F.concat(F.rpad(path(i), F.when((n % 4 == 1) & (i == 2), 9).otherwise(8), " "), F.lit("<- part "), i.cast("string"))
    row = lambda i: F.when((n % 3 == 0) & (i % 5 == 4), "no arrow here").otherwise(entry(i))
    rows = F.transform(F.sequence(F.lit(0), (n % 15 + 2).cast("int")), row)
    heading = F.when(n % 10 == 9, "Other").otherwise("Repository layout")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("w"), F.regexp_replace(F.lower(x), "[^a-z]+", " ")))
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n\n## "), heading, F.lit("\n\n```\n"), F.array_join(rows, "\n"), F.lit("\n```\n"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(n.cast("string").alias("path"), text.alias("text"))
    known = spark.range(12).select(path(F.col("id")).alias("path"))
    found = check_documents(docs, ["repo_layout"], settings=Settings(repo_layout="Repository layout"), files=known)
    return found.select("path", F.col("line").cast("long").alias("line"), "quote")


QUERIES["lint_repo_layout"] = lint_repo_layout
ORACLES["lint_repo_layout"] = """
    WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents),
    r AS (SELECT doc_id, lines, unnest(range(0, doc_id % 15 + 3)) AS i FROM d),
    e AS (SELECT *, doc_id % 3 = 0 AND i % 5 = 4 AS bare, doc_id % 4 = 1 AND i = 2 AS off FROM r WHERE doc_id % 10 <> 9),
    c AS (SELECT doc_id, lines, count(*) FILTER (NOT bare) AS n FROM e GROUP BY doc_id, lines)
    SELECT doc_id::VARCHAR AS path, lines + 5 + i AS line, CASE WHEN bare THEN 'no entry' WHEN off THEN 'out of column' ELSE 'no such path' END AS quote FROM e WHERE bare OR off OR i >= 12
    UNION ALL SELECT doc_id::VARCHAR, lines + 5, CASE WHEN n < 5 THEN 'too few entries' ELSE 'too many entries' END FROM c WHERE n < 5 OR n > 15
    UNION ALL SELECT doc_id::VARCHAR, NULL, 'no heading' FROM documents WHERE doc_id % 10 = 9"""
