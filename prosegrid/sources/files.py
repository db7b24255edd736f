"""Files, sidecars, batches, treebanks and patches as tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrid.functions import globs
from prosegrid.sources.ignores import left_out, rules_of

#: What a fixture's sidecar holds, as far as it is checked here.
SIDECAR = (
    "sidecar_version int, fixture string, captured string, "
    "source struct<host:string,repo:string,path:string,commit:string,commit_date:string,license:string>, "
    "history struct<commits:int,authors:int,ai_commits:int,ai_tools:array<string>>, authorship struct<label:string,basis:string>, "
    "content struct<size_bytes:bigint,sha256:string,kind:string,line_endings:string>"
)


def rule_files(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """path (relative) and text of the ignore files under root, down to that many folders.

    Spark lists no names that begin with a dot, so the file system is asked for these few by pattern, level by level.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    rows = []
    for level in range(depth + 1):
        for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(base + "*/" * level + "{.gitignore,.ignore}")) or []:
            stream = system.open(status.getPath())
            try:
                rows.append((status.getPath().toUri().getPath().removeprefix(base), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return spark.createDataFrame([r for r in rows if not re.search(r"(^|/)\.git/", r[0])], "path string, text string")


def walk(spark: SparkSession, root: str, include: list[str], exclude: list[str], ignores: bool = True) -> DataFrame:
    """path (relative) and content of the files under root that the globs select; .git is left out, and so is what .gitignore and .ignore files say unless ignores is false.

    Files and folders whose names begin with a dot or an underscore are none to Spark, and not walked.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    path = F.substring_index(clean, base, -1) if base != "/" else clean
    found = files.select(path.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.git/"))
    chosen = found.where(globs.selected(F.col("path"), include, exclude))
    if not ignores:
        return chosen
    depth = found.agg(F.max(F.size(F.split("path", "/")) - 1)).first()[0] or 0
    rules = rules_of(rule_files(spark, root, depth))
    return chosen.join(left_out(chosen.select("path"), rules).where("ignored").select("path"), "path", "left_anti")


def _lossless(data: bytes) -> str:
    """Each byte that is no UTF-8 as one dollar sign, so that offsets stay."""
    out, rest = [], bytes(data)
    while rest:
        try:
            out.append(rest.decode())
            break
        except UnicodeDecodeError as bad:
            out += [rest[: bad.start].decode(), "$" * (bad.end - bad.start)]
            rest = rest[bad.end :]
    return "".join(out)


def decoded(content: Column) -> Column:
    """Text of bytes; only what is no UTF-8 leaves the built-in functions."""

    @F.pandas_udf("string")
    def lossless(contents: pd.Series) -> pd.Series:
        return contents.map(_lossless)

    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(lossless(content))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIDECAR).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def checked(fixtures: DataFrame, cards: DataFrame) -> DataFrame:
    """Fixtures (path, content) beside their sidecars by digest, with the first fault of each, null where they agree."""
    known = fixtures.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content").cast("long")})
    met = known.join(cards.select("fixture", "source", "history", "authorship", F.col("content").alias("facts")), F.col("path") == F.col("fixture"), "full_outer")
    fault = (
        F.when(F.col("path").isNull(), "no fixture")
        .when(F.col("fixture").isNull(), "no sidecar")
        .when(F.col("sha256") != F.col("facts.sha256"), "other bytes")
        .when(F.col("size") != F.col("facts.size_bytes"), "other size")
        .when(~F.col("authorship.label").isin("human", "llm", "mixed"), "unknown label")
    )
    return met.withColumn("fault", fault)


def live(batches: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The last version of each path over the batches in name order, without what a later batch excludes.

    batches: batch, path. exclusions: batch, path.
    """
    last = Window.partitionBy("path").orderBy(F.desc("batch"))
    rows = batches.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    gone = exclusions.select(F.col("path").alias("_path"), F.col("batch").alias("_batch"))
    return rows.join(gone, (F.col("path") == F.col("_path")) & (F.col("_batch") > F.col("batch")), "left_anti")


def budgets(text: Column) -> tuple[Column, Column]:
    """Front matter's size budget, and whether it is there but no number."""
    front = F.regexp_extract(text, r"(?s)^\x{FEFF}?(?:---|\+\+\+)[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.|\+\+\+)[ \t]*(?:\r?\n|$)", 1)
    given = F.regexp_extract(front, r"(?m)^max_size_bytes[ \t]*[:=][ \t]*(\S+)", 1)
    number = F.when(given.rlike(r"^\d+$"), given.cast("long"))
    return number, (given != "") & number.isNull()


def oversized(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, bytes, budget, unreadable: documents over their own budget or else the limit; at the budget is well."""
    own, unreadable = budgets(F.col("text"))
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.coalesce(own, F.lit(limit)).alias("budget"), unreadable.alias("unreadable"))
    return rows.where((F.col("bytes") > F.col("budget")) | F.col("unreadable"))


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, comments, word_id, form, lemma, upos, feats and misc of CoNLL-U files, a row for each word."""
    texts = spark.read.text(path, wholetext=True)
    sents = texts.select(F.explode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("block")).where(F.trim("block") != "")
    rows = F.split("block", "\n")
    notes = F.filter(rows, lambda x: F.startswith(x, F.lit("#")))
    pairs = F.map_from_entries(F.transform(F.filter(notes, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^#\s*([^=]+)=", 1)), F.trim(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)))))
    words = F.filter(rows, lambda x: x.rlike(r"^\d+\t"))
    flat = sents.select(pairs.alias("comments"), F.explode(words).alias("row")).withColumn("c", F.split("row", "\t"))
    mapped = lambda i: F.when(F.col("c")[i] == "_", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(F.col("c")[i], F.lit(r"\|"), F.lit("=")))
    return flat.select(F.col("comments")["sent_id"].alias("sent_id"), "comments", F.col("c")[0].cast("int").alias("word_id"), F.col("c")[1].alias("form"), F.col("c")[2].alias("lemma"), F.col("c")[3].alias("upos"), mapped(5).alias("feats"), mapped(9).alias("misc"))


def hunks(patches: DataFrame) -> DataFrame:
    """path, removed_start, removed_end, added_start, added_end of unified diffs (patch_id, text); ends are exclusive."""
    rows = patches.select("patch_id", F.posexplode(F.split("text", "\n")).alias("line", "source"))
    order = Window.partitionBy("patch_id").orderBy("line")
    target = F.when(F.col("source").rlike(r"^\+\+\+ "), F.regexp_replace("source", r'^\+\+\+ "?(?:b/)?|"?\s*$', ""))
    rows = rows.withColumn("path", F.last(target, ignorenulls=True).over(order)).where(F.col("source").rlike(r"^@@ -\d"))
    header = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda i: F.regexp_extract("source", header, i)
    size = lambda i: F.when(number(i) == "", 1).otherwise(number(i).try_cast("int"))
    # Git counts an empty range from the line before it.
    start = lambda i, n: number(i).cast("int") + F.when(size(n) == 0, 1).otherwise(0)
    return rows.select("path", start(1, 2).alias("removed_start"), (start(1, 2) + size(2)).alias("removed_end"), start(3, 4).alias("added_start"), (start(3, 4) + size(4)).alias("added_end"))
