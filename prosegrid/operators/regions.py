"""The comments of code as regions of prose.

A scanner finds comments and nothing else: it knows strings, raw strings, characters and, where a
language has them, nested comments, so that a mark inside of one is no comment. Everything after that is
tables: a comment's lines are rows, whole-line comments of one marker at one column on lines that follow
each other are a run, a run or a block comment is a region, and its marker, gutter and least indent are
taken off each row, which keeps the offset where its text begins.

Line breaks are read as in Markdown. A comment that isn't closed is no region, nor is one without text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.operators.maps import line_parts

# What in a comment is licence text or a mark of a tool, and no prose.
LICENCE_STARTS = ["Copyright "]
LICENCE_HOLDS = [
    "Copyright (C)", "Copyright (c)", "Copyright ©", "All rights reserved", "Permission is hereby granted", "Permission is granted",
    "use, copy, modify", "Redistribution and use in source and binary forms", "Redistributions of source code", "Redistributions in binary form",
    "Neither the name of", "Licensed under the", "except in compliance with the License", "WITHOUT WARRANTY", "WITHOUT ANY WARRANTY", '"AS IS"', "'as-is'",
    "is free software", "General Public License", "Use of this source code is governed by", "licensed as described in the file", "THIS SOFTWARE IS PROVIDED",
    "THE SOFTWARE IS PROVIDED", "IN NO EVENT SHALL", "MERCHANTABILITY", "copyright notice", "permission notice", "in the public domain",
    "to the public domain", "This notice may not be removed", "under the terms of the",
]
MARKERS = ["@generated", "DO NOT EDIT", "SPDX-FileCopyrightText:", "SPDX-License-Identifier:"]
BANNER = r"^[ \t]*([-=*/#~_.])(?:[ ]*\1){2,}[ \t]*$"
LICENCE_ENTRIES = 2
# End of the fixed values.

LANGUAGES = ("rust", "cpp", "toml")
SPAN = "array<struct<start: long, end: long, marker: string, closed: boolean>>"

TO_QUOTE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
TO_APOSTROPHE = re.compile(r"[^'\\]*(?:\\.[^'\\]*)*'", re.S)
RUST = re.compile(r"""//|/\*|(?:\b(?:br|cr|r)(#*)|)"|'""")
RUST_CHAR = re.compile(r"'(?:\\u\{[^}\n]*\}|\\x..|\\.|[^\\'\n])'", re.S)
NESTED = re.compile(r"/\*|\*/")
CPP = re.compile(r"""//|/\*|\b(?:u8|u|U|L)?R"([^ ()\\\t\v\f\n]{0,16})\(|"|(?<![0-9A-Fa-f])'""")
SPLICED = re.compile(r"(?:[^\r\n\\]|\\(?:\r\n|[\s\S])|\\$)*")
TO_LINE_END = re.compile(r"[^\r\n]*")
TOML = re.compile(r"#|\"\"\"|'''|\"|'")


def _end(pattern: re.Pattern, text: str, at: int) -> int:
    found = pattern.match(text, at)
    return found.end() if found else len(text)


def _after(mark: str, text: str, at: int) -> int:
    found = text.find(mark, at)
    return found + len(mark) if found >= 0 else len(text)


def rust_comments(text: str) -> Iterator[tuple[int, int, str, bool]]:
    at = 0
    while found := RUST.search(text, at):
        start, at, mark = found.start(), found.end(), found[0]
        if mark == "//":
            at = _end(TO_LINE_END, text, start)
            third, fourth = text[start + 2 : start + 3], text[start + 3 : start + 4]
            yield start, at, "//!" if third == "!" else "///" if third == "/" and fourth != "/" else "//", True
        elif mark == "/*":
            depth = 1
            while depth and (edge := NESTED.search(text, at)):
                depth, at = depth + (1 if edge[0] == "/*" else -1), edge.end()
            at = len(text) if depth else at
            opener = text[start : start + 4]
            doc = "/*!" if opener[:3] == "/*!" else "/**" if opener[:3] == "/**" and opener[3:] not in ("*", "/") else "/*"
            yield start, at, doc, not depth
        elif mark == "'":
            character = RUST_CHAR.match(text, start)
            at = character.end() if character else at
        elif found[1] is not None:
            at = _after('"' + found[1], text, at)
        else:
            at = _end(TO_QUOTE, text, at)


def cpp_comments(text: str) -> Iterator[tuple[int, int, str, bool]]:
    at = 0
    while found := CPP.search(text, at):
        start, at, mark = found.start(), found.end(), found[0]
        if mark == "//":
            at = _end(SPLICED, text, start)
        elif mark == "/*":
            close = text.find("*/", at)
            at = close + 2 if close >= 0 else len(text)
            if close < 0:
                yield start, at, "/*", False
                continue
        else:
            at = _after(f'){found[1]}"', text, at) if found[1] is not None else _end(TO_QUOTE if mark == '"' else TO_APOSTROPHE, text, at)
            continue
        body = text[start:at]
        doc = re.match(r"//[/!](?!/)<?|/\*[*!](?![*/])<?", body)
        yield start, at, doc[0] if doc else mark, True


def toml_comments(text: str) -> Iterator[tuple[int, int, str, bool]]:
    at = 0
    while found := TOML.search(text, at):
        start, at, mark = found.start(), found.end(), found[0]
        if mark == "#":
            at = _end(TO_LINE_END, text, start)
            yield start, at, "#", True
        elif len(mark) == 3:
            close = re.compile(r'(?:[^\\]|\\.)*?"{3,5}' if mark[0] == '"' else r"[\s\S]*?'{3,5}", re.S)
            at = _end(close, text, at)
        else:
            # A string of one line ends with it, closed or not.
            line_end = _end(TO_LINE_END, text, at)
            at = min(_end(TO_QUOTE, text, at) if mark == '"' else _after("'", text, at), line_end)


SCANNERS = {"rust": rust_comments, "cpp": cpp_comments, "toml": toml_comments}


def comment_spans(text: Column, language: Column) -> Column:
    """start, end, marker and closed of each comment, in code points; none of a language that isn't known."""

    def read(texts: pa.Array, languages: pa.Array) -> pa.Array:
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marker", pa.string()), ("closed", pa.bool_())])
        found = [SCANNERS[name](text or "") if name in SCANNERS else () for text, name in zip(texts.to_pylist(), languages.to_pylist())]
        return pa.array([[dict(zip(("start", "end", "marker", "closed"), c)) for c in comments] for comments in found], pa.list_(kind))

    read.__annotations__ = {"texts": pa.Array, "languages": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, SPAN)(text, language)


def _slice(start: Column, end: Column) -> Column:
    return F.substring(F.col("text"), start + 1, end - start)


def runs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region, marker, doc, start and body of each closed comment of (keys, language, text), with the region that it belongs to."""
    spans = docs.select(*keys, "language", "text", F.posexplode(comment_spans(F.col("text"), F.col("language"))).alias("n", "s")).select(*keys, "language", "text", "n", "s.*")
    order = Window.partitionBy(*keys).orderBy("n")
    start, before = F.col("start"), F.lag("end").over(order)
    # Only what lies between two comments is looked at, so a text is read once in all.
    gap = _slice(F.coalesce(before, F.lit(0)), start)
    line = F.when(gap.rlike(r"[\r\n]") | before.isNull(), F.regexp_replace(gap, r"(?s)^.*[\r\n]", ""))
    spans = spans.select(*keys, "language", "n", "start", "end", "marker", "closed", gap.alias("_gap"), line.alias("_lead"), _slice(start, F.col("end")).alias("body"))
    alone = F.coalesce(F.col("_lead").rlike(r"^\x{FEFF}?[ \t]*$"), F.lit(False))
    lined = ~F.startswith("marker", F.lit("/*"))
    spans = spans.withColumns({"doc": F.col("marker").rlike(r"^(///|//!|/\*\*|/\*!)"), "_alone": alone & lined & F.col("closed"), "_column": F.char_length(F.regexp_replace("_lead", r"^\x{FEFF}", ""))})
    attributes = r"^[ \t]*(?:\r\n|\r|\n)(?:[ \t]*#!?\[[^\r\n]*\][ \t]*(?:\r\n|\r|\n))*[ \t]*\z"
    bare = r"^[ \t]*(?:\r\n|\r|\n)[ \t]*\z"
    # An attribute of Rust between two lines of one doc comment doesn't part them.
    close = F.col("_gap").rlike(bare) | ((F.col("language") == "rust") & F.col("doc") & F.col("_gap").rlike(attributes))
    same = lambda c: F.lag(c).over(order) == F.col(c)
    goes_on = F.col("_alone") & F.lag("_alone").over(order) & same("marker") & same("_column") & close
    spans = spans.withColumn("region", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    return spans.where("closed").select(*keys, "region", "marker", "doc", "start", "body")


def rows_of(comments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region, marker, doc, at and text of each line of a comment, without its marker and closing mark."""
    block = F.startswith("marker", F.lit("/*"))
    size = F.char_length("marker")
    body = F.expr("substring(body, char_length(marker) + 1, char_length(body) - char_length(marker) - if(startswith(marker, '/*'), 2, 0))")
    rows = comments.select(*keys, "region", "marker", "doc", block.alias("block"), (F.col("start") + size).alias("start"), F.posexplode(line_parts(body)).alias("n", "part"))
    before = Window.partitionBy(*keys, "region", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0))
    text = F.regexp_replace("part", r"[\r\n]+$", "")
    return rows.select(*keys, "region", "marker", "doc", "block", at.alias("at"), text.alias("text"))


def with_hidden(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds hidden: whether a row is licence text, a mark of a tool or, outside of doc comments, a banner.

    A comment of two different entries at least is licence text in the paragraphs that hold any.
    """
    bare = F.regexp_replace("text", r"^[ \t*]+", "")
    held = [F.when(F.contains("text", F.lit(e)), e) for e in LICENCE_HOLDS] + [F.when(F.startswith(bare, F.lit(e)), e) for e in LICENCE_STARTS]
    marks = F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains("text", m))
    order = Window.partitionBy(*keys, "region").orderBy("n")
    whole = Window.partitionBy(*keys, "region")
    rows = rows.withColumns({"_entries": F.array_compact(F.array(*held)), "_para": F.sum((bare == "").cast("int")).over(order)})
    licence = F.size(F.array_distinct(F.flatten(F.collect_list("_entries").over(whole)))) >= LICENCE_ENTRIES
    meant = F.max(F.size("_entries") > 0).over(Window.partitionBy(*keys, "region", "_para"))
    return rows.withColumn("hidden", marks | (~F.col("doc") & F.col("text").rlike(BANNER)) | (licence & meant)).drop("_entries", "_para")


def _row(row: Column, at: Column, text: Column) -> Column:
    return F.struct(at.alias("at"), text.alias("text"), row["hidden"].alias("hidden"))


def regions(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, language, text) rows to keys, region, doc, pieces (at, text) and text of each comment or run of comments that has any prose.

    What is hidden is a blank line. Indents are taken before that.
    """
    rows = rows_of(runs(docs, keys), keys)
    rows = with_hidden(rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "region").orderBy("at"))), keys)
    listed = rows.groupBy(*keys, "region").agg(F.first("doc").alias("doc"), F.first("block").alias("block"), F.transform(F.sort_array(F.collect_list(F.struct("n", "at", "text", "hidden"))), lambda r: _row(r, r["at"], r["text"])).alias("rows"))
    blank = lambda r: r["text"].rlike(r"^[ \t]*$")
    # A block comment's first and last lines of stars and space alone are none of its text.
    edge = lambda i: (i == 0) | (i == F.size("rows") - 1)
    bared = F.transform("rows", lambda r, i: _row(r, r["at"], F.when(edge(i) & r["text"].rlike(r"^[ \t*]*$"), "").otherwise(r["text"])))
    listed = listed.withColumn("rows", F.when(F.col("block") & (F.size("rows") > 1), bared).otherwise(F.col("rows")))
    # Stars at one column in all lines but the first are a gutter.
    rest = F.filter(F.slice("rows", F.lit(2), F.size("rows")), lambda r: ~blank(r))
    stars = F.array_distinct(F.transform(rest, lambda r: F.when(r["text"].rlike(r"^[ \t]*\*"), F.instr(r["text"], "*")).otherwise(0)))
    listed = listed.withColumn("gutter", F.when(F.col("block") & (F.size(stars) == 1), F.get(stars, F.lit(0))).otherwise(0))
    off = lambda i, r: F.when((i > 0) & ~blank(r), F.col("gutter")).otherwise(0)
    listed = listed.withColumn("rows", F.transform("rows", lambda r, i: _row(r, r["at"] + off(i, r), F.substr(r["text"], off(i, r) + 1))))
    indents = F.transform(F.filter("rows", lambda r: ~blank(r)), lambda r: F.char_length(r["text"]) - F.char_length(F.regexp_replace(r["text"], r"^[ \t]+", "")))
    listed = listed.withColumn("indent", F.coalesce(F.array_min(indents), F.lit(0)))
    shown = lambda r: F.when(blank(r) | r["hidden"], "").otherwise(F.regexp_replace(F.substr(r["text"], F.col("indent") + 1), r"[ \t]+$", ""))
    pieces = F.transform("rows", lambda r: F.struct((r["at"] + F.when(blank(r) | r["hidden"], 0).otherwise(F.col("indent"))).alias("at"), shown(r).alias("text")))
    found = listed.withColumn("pieces", pieces).withColumn("text", F.array_join("pieces.text", "\n"))
    return found.where(F.col("text").rlike(r"\S")).select(*keys, "region", "doc", "pieces", "text")
