"""Markdown as a tree of blocks.

One pass over a text's lines keeps the stack of open quotes and list items, and gives each line to a
block. Every block, container or leaf, has a number in pre-order, and the last number below it; so what
lies in what is a question of intervals. A leaf keeps each of its lines with the offset where its text
begins, which is all that a source map needs.

Tabs count to the next multiple of four. Link reference definitions are paragraphs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = re.compile(r"[^\r\n]*(\r\n|\r|\n|$)")
RULE = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
MARKER = re.compile(r"([-*+]|\d{1,9}[.)])(?=[ \t]|$)")
TASK = re.compile(r"\[([ xX])\][ \t]")
HTML = re.compile(r"<(?:/?[a-zA-Z]|!--|\?)")
TABLE = re.compile(r"\|.*\|[ \t]*$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")

PIECE = pa.struct([("line", pa.int32()), ("at", pa.int64()), ("text", pa.string())])
BLOCK = pa.struct([("pre", pa.int32()), ("until", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("within", pa.string()), ("level", pa.int32()), ("task", pa.bool_()), ("info", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("pieces", pa.list_(PIECE))])
BLOCK_DDL = "array<struct<pre int, until int, parent int, depth int, kind string, within string, level int, task boolean, info string, first_line int, last_line int, pieces array<struct<line int, at long, text string>>>>"


@dataclass
class Block:
    pre: int
    parent: int | None
    depth: int
    kind: str
    first_line: int
    within: str | None = None
    until: int = 0
    last_line: int = 0
    level: int | None = None
    task: bool | None = None
    info: str | None = None
    pieces: list[tuple[int, int, str]] = field(default_factory=list)
    #: Columns that a line must be indented by to be in an item.
    indent: int = 0

    def row(self) -> dict:
        names = ("pre", "until", "parent", "depth", "kind", "within", "level", "task", "info", "first_line", "last_line")
        return {n: getattr(self, n) for n in names} | {"pieces": [dict(zip(("line", "at", "text"), p)) for p in self.pieces]}


def spaces(line: str, at: int) -> tuple[int, int]:
    """Columns of white space from there on, and where it ends."""
    columns = 0
    while at < len(line) and line[at] in " \t":
        columns += 4 - columns % 4 if line[at] == "\t" else 1
        at += 1
    return columns, at


def skip(line: str, at: int, columns: int) -> int:
    """Where the line goes on after so many columns of white space, or after all of it."""
    done = 0
    while at < len(line) and line[at] in " \t" and done < columns:
        done += 4 - done % 4 if line[at] == "\t" else 1
        at += 1
    return at


class Reader:
    """The open containers and the open leaf of one text, line after line."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Block] = []
        self.leaf: Block | None = None
        self.fence: tuple[str, int, int] | None = None

    def open(self, kind: str, line: int) -> Block:
        parent = self.stack[-1] if self.stack else None
        block = Block(len(self.blocks), parent.pre if parent else None, len(self.stack), kind, line, parent.kind if parent else None)
        self.blocks.append(block)
        return block

    def keep(self, count: int) -> None:
        """Closes all containers but the first ones, and the leaf in them."""
        if count < len(self.stack):
            self.end_leaf()
            del self.stack[count:]

    def end_leaf(self) -> None:
        self.leaf = self.fence = None

    def begin(self, kind: str, line: int) -> Block:
        self.leaf = self.open(kind, line)
        return self.leaf

    def entered(self, line: str) -> tuple[int, int]:
        """How many open containers the line is in, and where its text goes on."""
        at = 0
        for count, block in enumerate(self.stack):
            columns, text = spaces(line, at)
            if block.kind == "Quote":
                if columns > 3 or text == len(line) or line[text] != ">":
                    return count, at
                at = skip(line, text + 1, 1)
            elif text < len(line):
                if columns < block.indent:
                    return count, at
                at = skip(line, at, block.indent)
        return len(self.stack), at

    def containers(self, line: str, number: int, count: int, at: int) -> tuple[int, int]:
        """Opens the quotes and items that begin here."""
        while True:
            columns, text = spaces(line, at)
            open_paragraph = count == len(self.stack) and self.leaf is not None and self.leaf.kind == "Paragraph"
            if text == len(line) or columns > 3 or RULE.match(line, text):
                return count, at
            if line[text] == ">":
                self.keep(count)
                self.end_leaf()
                self.stack.append(self.open("Quote", number))
                at = skip(line, text + 1, 1)
            else:
                marker = MARKER.match(line, text)
                if not marker:
                    return count, at
                after, content = spaces(line, marker.end())
                blank = content == len(line)
                if open_paragraph and (blank or marker[1][:-1] not in ("", "1")):
                    return count, at
                self.keep(count)
                self.end_leaf()
                item = self.open("Item", number)
                width = 1 if blank or after > 4 else after
                item.indent = columns + len(marker[1]) + width
                at = skip(line, marker.end(), width)
                task = TASK.match(line, at)
                if task:
                    item.task, at = task[1] != " ", task.end()
                self.stack.append(item)
            count += 1

    def read(self, line: str, number: int, offset: int) -> None:
        count, at = self.entered(line)
        whole = count == len(self.stack)
        if self.fence and whole:
            mark, size, indent = self.fence
            columns, text = spaces(line, at)
            close = line[text:].rstrip(" \t")
            if columns <= 3 and len(close) >= size and not close.strip(mark):
                self.leaf.last_line = number
                self.end_leaf()
            else:
                begin = skip(line, at, indent)
                self.add(line, begin, len(line), number, offset)
            return
        if self.fence:
            self.keep(count)
        count, at = self.containers(line, number, count, at)
        columns, text = spaces(line, at)
        if text == len(line):
            self.keep(count)
            if self.leaf is not None and self.leaf.kind == "Raw":
                self.add(line, at, len(line), number, offset)
            else:
                self.end_leaf()
            return
        lazy = count < len(self.stack) and self.leaf is not None and self.leaf.kind == "Paragraph"
        fence, heading = FENCE.match(line, text), HEADING.match(line, text)
        if lazy and (columns > 3 or not (fence or heading or RULE.match(line, text) or HTML.match(line, text))):
            self.add(line, text, len(line), number, offset)
            return
        self.keep(count)
        kind = self.leaf.kind if self.leaf else None
        if columns > 3 and kind != "Paragraph":
            if kind != "Raw":
                self.begin("Raw", number)
            self.add(line, skip(line, at, 4), len(line), number, offset)
        elif kind == "Html":
            self.add(line, at, len(line), number, offset)
        elif kind == "Paragraph" and columns <= 3 and UNDERLINE.match(line, text):
            self.leaf.kind, self.leaf.level, self.leaf.last_line = "Heading", 1 if line[text] == "=" else 2, number
            self.end_leaf()
        elif columns <= 3 and heading:
            block = self.begin("Heading", number)
            block.level = len(heading[1])
            words = line[heading.end() :].rstrip(" \t")
            bare = words.rstrip("#")
            if not bare or bare[-1] in " \t":
                words = bare.rstrip(" \t")
            self.add(line, heading.end(), heading.end() + len(words), number, offset)
            self.end_leaf()
        elif columns <= 3 and RULE.match(line, text):
            self.begin("Rule", number)
            self.add(line, text, len(line), number, offset)
            self.end_leaf()
        elif columns <= 3 and fence:
            block = self.begin("Code", number)
            mark = fence[1] or fence[3]
            block.info, block.last_line = (fence[2] or fence[4] or "").strip(), number
            self.fence = (mark[0], len(mark), columns)
        elif columns <= 3 and kind != "Paragraph" and HTML.match(line, text):
            self.begin("Html", number)
            self.add(line, at, len(line), number, offset)
        elif kind == "Table" or kind != "Paragraph" and TABLE.match(line, text):
            if kind != "Table" or not TABLE.match(line, text):
                self.begin("Table" if TABLE.match(line, text) else "Paragraph", number)
            self.add(line, text, len(line), number, offset)
        else:
            if kind != "Paragraph":
                self.begin("Paragraph", number)
            self.add(line, text, len(line), number, offset)

    def add(self, line: str, begin: int, end: int, number: int, offset: int) -> None:
        self.leaf.pieces.append((number, offset + begin, line[begin:end]))
        self.leaf.last_line = number

    def finish(self) -> list[Block]:
        for block in reversed(self.blocks):
            block.until = max(block.until, block.pre)
            block.last_line = max(block.last_line, block.first_line)
            if block.kind == "Raw":
                while block.pieces and not block.pieces[-1][2].strip():
                    block.last_line = max(block.pieces.pop()[0] - 1, block.first_line)
                block.kind = "Code"
            if block.parent is not None:
                above = self.blocks[block.parent]
                above.until, above.last_line = max(above.until, block.until), max(above.last_line, block.last_line)
        return self.blocks


def lines_of(text: str) -> list[tuple[int, str]]:
    """Offset and text of each line, without a byte order mark and the ends."""
    first = 1 if text.startswith("﻿") else 0
    return [(m.start(), text[m.start() : m.start(1)]) for m in LINE.finditer(text, first) if m.start() < len(text) or m.start() == first]


def read_markdown(text: str) -> list[Block]:
    reader, lines = Reader(), lines_of(text)
    begin = 0
    if lines and re.fullmatch(r"---[ \t]*", lines[0][1]):
        begin = next((n + 1 for n, (_, line) in enumerate(lines) if n and re.fullmatch(r"(---|\.\.\.)[ \t]*", line)), 0)
        if begin:
            reader.begin("Frontmatter", 1)
            for n, (offset, line) in enumerate(lines[:begin]):
                reader.add(line, 0, len(line), n + 1, offset)
            reader.end_leaf()
    for n, (offset, line) in enumerate(lines[begin:], begin + 1):
        reader.read(line, n, offset)
    return reader.finish()


def read_plain(text: str) -> list[Block]:
    """Paragraphs between blank lines; a line of four columns or more of white space is raw."""
    reader = Reader()
    for n, (offset, line) in enumerate(lines_of(text), 1):
        columns, at = spaces(line, 0)
        kind = None if at == len(line) else "Raw" if columns > 3 else "Paragraph"
        if kind is None or reader.leaf is not None and reader.leaf.kind != kind:
            reader.end_leaf()
        if kind:
            if reader.leaf is None:
                reader.begin(kind, n)
            reader.add(line, at, len(line), n, offset)
    return reader.finish()


READERS = {"markdown": read_markdown, "plain": read_plain}


def block_column(text: Column, reader: Column) -> Column:
    """The blocks of a text by its reader, markdown or plain."""

    def read(texts: pa.Array, readers: pa.Array) -> pa.Array:
        return pa.array([[b.row() for b in READERS[name](text or "")] for text, name in zip(texts.to_pylist(), readers.to_pylist())], pa.list_(BLOCK))

    read.__annotations__ = {"texts": pa.Array, "readers": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, BLOCK_DDL)(text, reader)


def blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """All blocks of (keys, text) rows, which may have a reader (markdown or plain; Markdown if they haven't): pre, until, parent, depth, kind, within, level, task, info, heading, first_line, last_line, pieces and text.

    within is the kind of the container that a block lies in directly; heading the text of the last
    heading before it. A container has no text.
    """
    rows = docs.select(*keys, F.explode(block_column(F.col("text"), F.col("reader") if "reader" in docs.columns else F.lit("markdown"))).alias("b")).select(*keys, "b.*")
    rows = rows.withColumn("text", F.array_join("pieces.text", "\n"))
    order = Window.partitionBy(*keys).orderBy("pre")
    return rows.withColumn("heading", F.last(F.when(F.col("kind") == "Heading", F.col("text")), ignorenulls=True).over(order))


def pieces_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The source map of blocks' texts (keys, pieces): a verbatim segment for each piece; the line breaks between are written as line ends outside."""
    parts = rows.select(*keys, F.posexplode("pieces").alias("n", "p"))
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("p.text")
    following = F.lead("p.at").over(Window.partitionBy(*keys).orderBy("n"))
    parts = parts.withColumns({"start": F.coalesce(F.sum(size + 1).over(before), F.lit(0)), "after": following})
    at, after = F.col("p.at"), F.col("after")
    ends = F.struct((F.col("start") + size).alias("start"), F.lit(1).cast("long").alias("length"), (at + size).alias("outer_start"), (after - at - size).alias("outer_length"), F.lit("E").alias("kind"))
    text = F.struct("start", size.cast("long").alias("length"), at.alias("outer_start"), size.cast("long").alias("outer_length"), F.lit("V").alias("kind"))
    found = parts.select(*keys, F.explode(F.when(after.isNull(), F.array(text)).otherwise(F.array(text, ends))).alias("s"))
    return found.select(*keys, "s.*").where("length > 0")


def ancestors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pre, and pre, kind and depth of each container around a block, as ancestor, ancestor_kind, ancestor_depth.

    A block's containers are the intervals that hold its number. In pre-order those still open form a
    stack, of which a block has depth; the last one of each smaller depth is the one that is open.
    """
    containers = rows.where("kind in ('Item', 'Quote')").select(*keys, F.col("pre").alias("ancestor"), "until", F.col("kind").alias("ancestor_kind"), F.col("depth").alias("ancestor_depth"))
    asked = rows.select(*keys, "pre", F.explode(F.sequence(F.lit(0), F.greatest("depth", F.lit(1)) - 1)).alias("at_depth"), "depth").where("at_depth < depth")
    held = containers.select(*keys, F.col("ancestor").alias("pre"), F.col("ancestor_depth").alias("at_depth"), F.struct("ancestor", "ancestor_kind", "ancestor_depth", "until").alias("_held"))
    order = Window.partitionBy(*keys, "at_depth").orderBy("pre", F.col("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.withColumn("_asks", F.lit(1)).unionByName(held.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    found = both.withColumn("_found", F.last("_held", ignorenulls=True).over(order)).where("_asks = 1 and _found.until >= pre")
    return found.select(*keys, "pre", "_found.ancestor", "_found.ancestor_kind", "_found.ancestor_depth")
