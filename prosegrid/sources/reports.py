"""Findings as JSON, SARIF, GitHub commands and text lines.

Findings: path, lint, line, end_line, column, end_column, quote. Reports are tables of strings, one
row for each path or finding, so that any writer can store them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["line", "column", "end_line", "end_column"]


def json_report(findings: DataFrame) -> DataFrame:
    """path and json: the findings of a path by lint, marks by place."""
    marks = findings.groupBy("path", "lint").agg(F.array_sort(F.collect_list(F.struct(*PLACE, F.col("quote").alias("note")))).alias("marks"))
    found = marks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lint", "marks"))).alias("findings"))
    return found.select("path", F.to_json(F.struct(F.lit(1).alias("format_version"), "path", "findings")).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """path and result: SARIF 2.1.0 results, one for each finding."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("lint").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.col("quote").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "lint", "line", F.to_json(result).alias("result"))


def uri(path: Column) -> Column:
    """Percent-encoded but for slashes."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def github_commands(findings: DataFrame) -> DataFrame:
    """path and command: a workflow command for each finding, escaped."""

    def escaped(text: Column, more: bool) -> Column:
        for plain, code in [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if more else []):
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    line, end = F.col("line").cast("string"), F.col("end_line").cast("string")
    command = F.concat(F.lit("::error file="), escaped(F.col("path"), True), F.lit(",line="), line, F.lit(",endLine="), end, F.lit(",title="), escaped(F.col("lint"), True), F.lit("::"), escaped(F.col("quote"), False))
    return findings.select("path", "lint", "line", command.alias("command"))


def text_lines(findings: DataFrame) -> DataFrame:
    """path, lint and text: lines 3, 5: each distinct line once, in order."""
    found = findings.groupBy("path", "lint").agg(F.array_sort(F.array_distinct(F.collect_list("line"))).alias("lines"))
    label = F.when(F.size("lines") == 1, "line ").otherwise("lines ")
    return found.select("path", "lint", F.concat(label, F.array_join(F.transform("lines", lambda n: n.cast("string")), ", ")).alias("text"))


def tally(findings: DataFrame) -> DataFrame:
    """lint, files, places."""
    return findings.groupBy("lint").agg(F.count_distinct("path").alias("files"), F.count("*").alias("places"))
