"""Layered reading as queries: whole documents, line by line, planted into Markdown and into code, beside SQL that knows where each line went."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.operators import fixes, tree
from prosegrid.plans.check import Settings, check_documents
from prosegrid.sources import ignores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: How deep the lines of a nested list are, over and over.
DEPTHS = [0, 1, 2, 1, 2, 3, 0, 1, 1, 0]
PHRASE = "mauve heron"
#: Where a line of a document goes in Markdown: {0} is the line's letters and the phrase.
QUOTED = ["{0}", "> {0}", "> > {0}", "- > {0}", "- a\n  > - {0}"]
#: Where it goes in Rust; the last {p} of each is in a comment, in a fence of a comment, or in Markdown of one.
CODED = [
    "// {0}",
    'let s = "// {0}"; // tail {p}',
    "/* {l} /* nested */ {p} */",
    "/// - {0}",
    'let r = r#"/* " {0} "#; f();\n/* first\n * {p} */',
    "/// > ```rust\n/// > x('\"'); // {0}\n/// > ```\nfn f() {{}}",
]
#: Lines of text after the one with the phrase.
AFTER = [0, 0, 0, 0, 0, 2]


def _letters(line: Column) -> Column:
    return F.concat(F.lit("w"), F.regexp_replace(F.lower(line), "[^a-z]+", " "))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.split("text", "\n").alias("lines"))


def _filled(template: str, letters: Column) -> Column:
    """The template with the letters and the phrase in their places."""
    whole = F.concat(letters, F.lit(f" {PHRASE}"))
    found = F.lit(template.replace("{{}}", "\x01").replace("{p}", PHRASE))
    return F.replace(F.replace(F.replace(found, F.lit("{0}"), whole), F.lit("{l}"), letters), F.lit("\x01"), F.lit("{}"))


def _planted(spark: SparkSession, sf_dir: str, templates: list[str], between: str, suffix: str) -> DataFrame:
    def row(line: Column, i: Column) -> Column:
        found = F.lit("")
        for k, template in enumerate(templates):
            found = F.when(i % len(templates) == k, _filled(template, _letters(line))).otherwise(found)
        return found

    made = F.array_join(F.transform("lines", row), between)
    return _lines(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), made.alias("text"))


def _places(docs: DataFrame) -> DataFrame:
    found = check_documents(docs, ["banned_phrases"], settings=Settings(phrases=[PHRASE]))
    return found.select("path", *(F.col(c).cast("long").alias(c) for c in ("line", "column", "end_line", "end_column")))


def _sql_template(template: str) -> str:
    """The template as an SQL expression over the column l, the line's letters."""
    text = template.replace("{{}}", "\x01").replace("{p}", PHRASE).replace("'", "''").replace("{0}", "{l} " + PHRASE)
    return "('" + text.replace("{l}", "' || l || '").replace("\x01", "{}").replace("\n", "' || chr(10) || '") + "')"


def _places_sql(templates: list[str], after: list[int], gap: int, suffix: str) -> str:
    """Lines and columns of the last phrase of each planted line; gap: line ends between two of them."""
    cases = lambda values: "CASE " + " ".join(f"WHEN i % {len(templates)} = {k} THEN {v}" for k, v in enumerate(values)) + " END"
    sizes = [t.count("\n") + gap for t in templates]
    before = [sum(sizes[:k]) for k in range(len(templates))]
    own = [t.count("\n") - n for t, n in zip(templates, after)]
    return f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
        ), made AS (
            SELECT doc_id, i, 'w' || regexp_replace(lower(line), '[^a-z]+', ' ', 'g') AS l FROM lines
        ), held AS (
            SELECT doc_id, i, string_split({cases([_sql_template(t) for t in templates])}, chr(10))[{cases([n + 1 for n in own])}] AS line FROM made
        ), found AS (
            SELECT doc_id, {sum(sizes)} * (i // {len(templates)}) + {cases(before)} + {cases(own)} + 1 AS line,
                length(line) - strpos(reverse(line), reverse('{PHRASE}')) - {len(PHRASE) - 1} + 1 AS col FROM held
        )
        SELECT doc_id || '{suffix}' AS path, line::BIGINT AS line, col::BIGINT AS "column", line::BIGINT AS end_line, (col + {len(PHRASE)})::BIGINT AS end_column FROM found"""


def nested_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase in every line of every document, the lines paragraphs in quotes and lists: where the file has it."""
    return _places(_planted(spark, sf_dir, QUOTED, "\n\n", ".md"))


def comment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as strings and comments of Rust, nested ones, in Markdown of comments, in fences of that: where the file has the phrase as prose."""
    return _places(_planted(spark, sf_dir, CODED, "\n", ".rs"))


def block_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as items of a nested list, every fourth in a quote: all containers of each paragraph."""

    def row(line: Column, i: Column) -> Column:
        depth = F.get(F.array(*map(F.lit, DEPTHS)), (i % len(DEPTHS)).cast("int"))
        return F.concat(F.repeat(F.lit("  "), depth), F.when(i % 4 == 3, "- > ").otherwise("- "), _letters(line))

    made = _lines(spark, sf_dir).select("doc_id", F.array_join(F.transform("lines", row), "\n").alias("text"))
    blocks = tree.blocks(made, ["doc_id"])
    lines = blocks.select("doc_id", F.col("pre").alias("ancestor"), F.col("first_line").alias("ancestor_line"))
    leaves = blocks.where("kind = 'Paragraph'").select("doc_id", "pre", F.col("first_line").alias("line"))
    found = tree.ancestors(blocks, ["doc_id"]).join(leaves, ["doc_id", "pre"]).join(lines, ["doc_id", "ancestor"])
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line", "ancestor_line", "ancestor_depth")), "ancestor_kind")


#: Where a line goes in a text to fix, and what becomes of it: a bullet at a line's start would make it a list item, so its line is held.
BROKEN = ["• {0} …", "{l} — … {l}", "{l}•", "{l}"]
MENDED = ["• {0} …", "{l} - ... {l}", "{l}-", "{l}"]
INSTEAD = {"•": "-", "…": "...", "—": "-"}


def fixed_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with characters that a fix replaces, unless that changes the blocks: each text's digest after it, and how many lines are held."""
    docs = _planted(spark, sf_dir, BROKEN, "\n\n", ".md")
    found, held, _ = fixes.fix(docs, fixes.char_edits(INSTEAD))
    n = held.groupBy("path").agg(F.count("*").alias("n_held"))
    return found.join(n, "path", "left").select("path", "fixed", F.md5("text").alias("text_md5"), F.coalesce("n_held", F.lit(0)).alias("n_held"))


def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of a file for each document, by language and source, and what its ignore files leave out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id")
    name = F.concat(F.lit("f"), n.cast("string"), F.when(n % 5 == 0, ".log").when(n % 5 == 1, ".tmp").otherwise(".md"))
    paths = docs.select(F.concat_ws("/", "lang", "source", F.when(n % 7 == 0, F.concat(F.lit("deep/"), name)).otherwise(name)).alias("path"))
    rules = spark.createDataFrame(list(IGNORES.items()), "path string, text string")
    return ignores.left_out(paths, ignores.rules_of(rules))


#: Ignore files of the tree, by path.
IGNORES = {".gitignore": "# logs\n*.log\n!f?0.log\n/de/src1\n", "en/.gitignore": "src1?/deep/\n!*.log\n", "fr/src2/.gitignore": "*.tmp\n!f1*\n", "de/src1/.gitignore": "!*.md\n"}


QUERIES |= {"fixed_by_place": fixed_by_place, "ignored_paths": ignored_paths, "nested_places": nested_places, "comment_places": comment_places, "block_ancestors": block_ancestors}
_CASES = " ".join(f"WHEN i % {len(MENDED)} = {k} THEN {_sql_template(t)}" for k, t in enumerate(MENDED))
ORACLES |= {
    "fixed_by_place": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
        ), made AS (
            SELECT doc_id, i, 'w' || regexp_replace(lower(line), '[^a-z]+', ' ', 'g') AS l FROM lines
        )
        SELECT doc_id || '.md' AS path, count(*) > 1 AS fixed, md5(string_agg(CASE {_CASES} END, chr(10) || chr(10) ORDER BY i)) AS text_md5, count(*) FILTER (i % {len(MENDED)} = 0) AS n_held FROM made GROUP BY doc_id""",
    "ignored_paths": """
        WITH t AS (
            SELECT lang, source, doc_id % 7 = 0 AS deep, 'f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.tmp' ELSE '.md' END AS name FROM documents
        )
        SELECT DISTINCT lang || '/' || source || '/' || CASE WHEN deep THEN 'deep/' ELSE '' END || name AS path, coalesce(lang, '') = 'de' AND source = 'src1'
            OR lang = 'en' AND deep AND regexp_full_match(source, 'src1.') OR lang <> 'en' AND name LIKE '%.log' AND NOT regexp_full_match(name, 'f.0[.]log')
            OR lang = 'fr' AND source = 'src2' AND name LIKE '%.tmp' AND name NOT LIKE 'f1%' AS ignored FROM t""",
    "nested_places": _places_sql(QUOTED, [0] * len(QUOTED), 2, ".md"),
    "comment_places": _places_sql(CODED, AFTER, 1, ".rs"),
    "block_ancestors": f"""
        WITH RECURSIVE lines AS (
            SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
        ), items AS (
            SELECT doc_id, i, {DEPTHS}[i % {len(DEPTHS)} + 1] AS depth, i % 4 = 3 AS quoted FROM lines
        ), above AS (
            SELECT a.doc_id, a.i, max(b.i) AS parent FROM items a JOIN items b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - {len(DEPTHS)} AND a.i - 1 AND b.depth = a.depth - 1 GROUP BY ALL
        ), chain AS (
            SELECT doc_id, i, i AS item FROM items UNION ALL SELECT c.doc_id, c.i, a.parent FROM chain c JOIN above a ON a.doc_id = c.doc_id AND a.i = c.item
        )
        SELECT c.doc_id, c.i + 1 AS line, c.item + 1 AS ancestor_line, t.depth::BIGINT AS ancestor_depth, 'Item' AS ancestor_kind FROM chain c JOIN items t ON t.doc_id = c.doc_id AND t.i = c.item
        UNION ALL SELECT doc_id, i + 1, i + 1, depth + 1, 'Quote' FROM items WHERE quoted""",
}
