"""Markdown's blocks, and what lints of whole documents ask of them: emphasis, layouts, comment runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.operators import tree

def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0) and source, dealt by document; LF, CRLF and lone CR end lines, and a byte order mark is no text."""
    text = F.regexp_replace("text", r"^\x{FEFF}", "")
    return docs.select("doc_id", text.alias("text")).repartition("doc_id").select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "source"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_id, kind, level, task, info, heading, first_line, last_line, text; lines from 1, those of a fence with its marks."""
    found = tree.blocks(docs.select("doc_id", "text").repartition("doc_id"), ["doc_id"])
    item = found.select("doc_id", F.col("pre").alias("parent"), F.col("task").alias("_task")).where("_task is not null")
    leaves = found.where("kind not in ('Item', 'Quote')").drop("task").join(item, ["doc_id", "parent"], "left")
    kind = F.when((F.col("kind") == "Paragraph") & F.col("within").isNotNull(), F.col("within")).otherwise(F.col("kind"))
    return leaves.select("doc_id", F.col("pre").alias("block_id"), kind.alias("kind"), "level", F.col("_task").alias("task"), "info", "heading", "first_line", "last_line", "text")


def visible(text: Column) -> Column:
    """What a reader sees of inline Markdown: no images, link targets, tags or emphasis marks."""
    for pattern, kept in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"), (r"(?<![\w*])([*_])(?=\S)([^*_]+?)(?<=\S)\1(?![\w*])", "$2"), (r"`+([^`]+)`+", "$1")):
        text = F.regexp_replace(text, pattern, kept)
    return text


def emphasis(rows: DataFrame) -> DataFrame:
    """doc_id, block_id, kind (Strong, Emphasis) and quote of the outermost spans outside code."""
    text = F.regexp_replace("text", r"`+[^`]+`+", "``")
    strong = r"(?:\*\*(?=\S).+?(?<=\S)\*\*|__(?=\S).+?(?<=\S)__)"
    light = r"(?:(?<![\w*])\*(?=[^\s*])[^*]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_]+?(?<=[^\s_])_(?![\w_]))"
    spans = F.regexp_extract_all(text, F.lit(f"{strong}|{light}"), F.lit(0))
    prose = rows.where(~F.col("kind").isin("Code", "Frontmatter", "Html"))
    found = prose.select("doc_id", "block_id", F.explode(spans).alias("quote"))
    return found.withColumn("kind", F.when(F.col("quote").rlike(r"^(\*\*|__)"), "Strong").otherwise("Emphasis")).select("doc_id", "block_id", "kind", "quote")


def comments(docs: DataFrame, markers: list[str]) -> DataFrame:
    """doc_id, region, marker, first_line, last_line, text: runs of whole-line comments of one marker at one column.

    markers, the longest first: ///, //! and // for Rust and C++, # for TOML.
    """
    pattern = r"^(\s*)(" + "|".join(m.replace("/", "/") for m in markers) + r")(?: ?)(.*)$"
    rows = lines(docs).where(F.col("source").rlike(pattern))
    rows = rows.select("doc_id", "line", F.char_length(F.regexp_extract("source", pattern, 1)).alias("column"), F.regexp_extract("source", pattern, 2).alias("marker"), F.regexp_extract("source", pattern, 3).alias("text"))
    key = Window.partitionBy("doc_id", "marker", "column").orderBy("line")
    rows = rows.withColumn("_island", F.col("line") - F.row_number().over(key))
    runs = rows.groupBy("doc_id", "marker", "column", "_island").agg((F.min("line") + 1).alias("first_line"), (F.max("line") + 1).alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["text"]), "\n")
    runs = runs.select("doc_id", "marker", "first_line", "last_line", text.alias("text")).where(F.trim("text") != "")
    return runs.withColumn("region", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")))


def over_emphasised(rows: DataFrame, runs: DataFrame, free_spans: int, max_percent: float) -> DataFrame:
    """doc_id, spans, percent of documents with more spans than are free and more of their characters in them than may be.

    rows: blocks. runs: caps runs (doc_id and words), each a span.
    """
    chars = rows.where(~F.col("kind").isin("Code", "Frontmatter", "Html")).groupBy("doc_id").agg(F.sum(F.char_length(visible(F.col("text")))).alias("prose"))
    marked = emphasis(rows).select("doc_id", F.char_length(F.regexp_replace("quote", r"^[*_]+|[*_]+$", "")).alias("chars"))
    spans = marked.unionByName(runs.select("doc_id", "chars")).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("chars").alias("chars"))
    share = F.when(F.col("prose") > 0, 100.0 * F.col("chars") / F.col("prose")).otherwise(0.0)
    found = spans.join(chars, "doc_id").withColumn("share", share).where((F.col("spans") > free_spans) & (F.col("share") > max_percent))
    return found.select("doc_id", "spans", (F.ceil(F.col("share") * 100) / 100).alias("percent"))


def layout_problems(rows: DataFrame, files: DataFrame, heading: str = "Repository layout", least: int = 5, most: int = 15, width: int = 100) -> DataFrame:
    """doc_id, line, problem of the first code block under a heading that lists ``path <- description`` rows.

    files: path. Problems: no heading, no block, too few or many entries, a row that is no entry, a
    wide row, an arrow out of column, a path that isn't there.
    """
    # A fence's first line is its mark.
    at = F.col("text_line") if "text_line" in rows.columns else F.col("first_line") + F.when(F.col("info").isNull(), 0).otherwise(1)
    under = rows.where((F.col("kind") == "Code") & (F.col("heading") == heading))
    first = under.groupBy("doc_id").agg(F.min_by(F.struct(at.alias("at"), "text"), "block_id").alias("b"))
    entries = first.select("doc_id", F.posexplode(F.split("b.text", "\n")).alias("n", "row"), F.col("b.at").alias("at")).where(F.trim("row") != "")
    parsed = entries.select("doc_id", (F.col("at") + F.col("n")).alias("line"), "row", F.trim(F.regexp_extract("row", r"^\s*(\S+)\s+<-\s+\S", 1)).alias("path"), F.instr("row", "<-").alias("column"))
    order = Window.partitionBy("doc_id").orderBy("line")
    parsed = parsed.withColumn("_column", F.first(F.when(F.col("path") != "", F.col("column")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    known = parsed.join(files.select(F.regexp_replace("path", "/$", "").alias("_path"), F.lit(True).alias("_there")).distinct(), F.regexp_replace("path", "/$", "") == F.col("_path"), "left")
    problem = (
        F.when(F.col("path") == "", "no entry")
        .when(F.char_length("row") > width, "too wide")
        .when(F.col("column") != F.col("_column"), "out of column")
        .when(F.col("_there").isNull(), "no such path")
    )
    bad = known.withColumn("problem", problem).where("problem is not null").select("doc_id", "line", "problem")
    counted = parsed.groupBy("doc_id").agg(F.min("line").alias("line"), F.count_if(F.col("path") != "").alias("n")).where((F.col("n") < least) | (F.col("n") > most))
    missing = rows.groupBy("doc_id").agg(F.count_if((F.col("kind") == "Heading") & (F.col("text") == heading)).alias("h"), F.count_if((F.col("kind") == "Code") & (F.col("heading") == heading)).alias("c")).where("h = 0 or c = 0")
    return bad.unionByName(counted.select("doc_id", "line", F.when(F.col("n") < least, "too few entries").otherwise("too many entries").alias("problem"))).unionByName(
        missing.select("doc_id", F.lit(None).cast("int").alias("line"), F.when(F.col("h") == 0, "no heading").otherwise("no block").alias("problem"))
    )
