"""Which paths of a tree its ignore files leave out, as joins.

A rule file is rows of a table. Every directory and file is a node, tested once, against the rules of the
directories above it: of all rules that match, the last one of the deepest file decides. A node that is
left out closes what is under it, whatever its own rules say.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_pattern(line: str) -> str | None:
    """A rule's pattern as a regular expression over paths from its file's directory, where a directory ends in a slash; null for what is no rule."""
    line = line.rstrip("\r\n")
    bare = line.rstrip(" ")
    if bare.endswith("\\") and len(bare) < len(line):
        bare += " "
    if not bare or bare.startswith("#"):
        return None
    bare = bare[1:] if bare.startswith("!") else bare
    only_folders = bare.endswith("/")
    body = bare.rstrip("/") if only_folders else bare
    if not body:
        return None
    anchored = "/" in body
    body = body.removeprefix("/")
    found, at = "" if anchored else "(?:.*/)?", 0
    while at < len(body):
        rest = body[at:]
        if rest.startswith("**/") and (at == 0 or body[at - 1] == "/"):
            found, at = found + "(?:.*/)?", at + 3
        elif rest == "**" and at and body[at - 1] == "/":
            found, at = found + ".+", at + 2
        elif rest[0] == "*":
            found, at = found + "[^/]*", at + len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            found, at = found + "[^/]", at + 1
        elif rest[0] == "[" and (close := rest.find("]", 3 if rest[1:2] in ("!", "^") else 2)) > 0:
            inside = rest[1:close]
            inside = "^" + inside[1:] if inside[0] in "!^" else inside
            found, at = found + "(?!/)[" + inside.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]", at + close + 1
        elif rest[0] == "\\" and len(rest) > 1:
            found, at = found + re.escape(rest[1]), at + 2
        else:
            found, at = found + re.escape(rest[0]), at + 1
    return f"^{found}{'/' if only_folders else '/?'}$"


def patterns(lines: Column) -> Column:
    def read(lines: pa.Array) -> pa.Array:
        return pa.array([rule_pattern(x or "") for x in lines.to_pylist()], pa.string())

    read.__annotations__ = {"lines": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "string")(lines)


def rules_of(files: DataFrame) -> DataFrame:
    """(path, text) rows of ignore files to folder, place, out and pattern of each rule; a folder ends in a slash, and the root's is empty."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    lines = files.select(folder.alias("folder"), F.posexplode(F.split("text", r"\r?\n")).alias("place", "line"))
    read = lines.select("folder", "place", (~F.startswith("line", F.lit("!"))).alias("out"), patterns(F.col("line")).alias("pattern"))
    return read.where("pattern is not null")


def nodes_of(paths: DataFrame) -> DataFrame:
    """node: every path and every folder above one, each once, folders with a slash at the end."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    folders = paths.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("node")).distinct()
    return folders.unionAll(paths.select(F.col("path").alias("node")).distinct())


def left_out(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path and ignored of each different path. rules: as rules_of() makes them, or its like for rules above the tree with a negative place."""
    nodes = nodes_of(paths)
    bare = F.regexp_replace("node", "/$", "")
    parts = F.split(bare, "/")
    holders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    met = nodes.select("node", F.explode(holders).alias("folder")).join(rules, "folder")
    hits = met.where(F.expr("substring(node, char_length(folder) + 1) rlike pattern"))
    decided = hits.groupBy("node").agg(F.max_by("out", F.struct(F.char_length("folder"), "place")).alias("out"))
    closed = decided.where("out").select("node")
    asked = paths.select("path").distinct()
    own = F.split("path", "/")
    chain = F.concat(F.transform(F.slice(F.sequence(F.lit(1), F.size(own)), F.lit(1), F.size(own) - 1), lambda k: F.concat(F.array_join(F.slice(own, F.lit(1), k), "/"), F.lit("/"))), F.array("path"))
    shut = asked.select("path", F.explode(chain).alias("node")).join(closed, "node").select("path").distinct()
    return asked.join(shut.withColumn("ignored", F.lit(True)), "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
