"""Source maps, block trees, comment regions and layered reading against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from prosegrid.operators import layers, maps, regions, tree
from prosegrid.operators.settings import Section
from prosegrid.plans.check import Settings, check_documents, check_sections


def random_map(rnd, outer_length):
    """Segments over an outer text of that length, as (start, length, outer_start, outer_length, kind)."""
    found, inner, outer = [], 0, 0
    while outer < outer_length:
        outer = min(outer_length, outer + rnd.choice([0, 0, 1, 2]))
        kind = rnd.choice("VVVES")
        size = 0 if kind == "S" else min(outer_length - outer, rnd.randint(1, 5))
        if kind != "S" and not size:
            break
        length = size if kind == "V" else rnd.randint(1, 3)
        found.append((inner, length, outer, size, kind))
        inner, outer = inner + length, outer + size
    return found, inner


def plain_outer(segments, start, end):
    first = [s for s in segments if s[0] <= start][-1]
    last = [s for s in segments if s[0] <= max(end - 1, start)][-1]
    begin = first[2] + start - first[0] if first[4] == "V" else first[2] + (first[3] if start >= first[0] + first[1] else 0)
    if end <= start:
        return begin, begin, first[4] == "V"
    return begin, last[2] + end - last[0] if last[4] == "V" else last[2] + last[3], first == last and first[4] == "V"


MAP = "doc_id int, block_id int, start long, length long, outer_start long, outer_length long, kind string"


def test_maps(spark):
    """Every span is where mapping by hand says; a composed map holds what mapping twice gives, exactly where that is editable."""
    rnd = random.Random(3)
    outer_rows, inner_rows, spans, expected = [], [], [], {}
    kept = {}
    for doc in range(12):
        outer, middle = random_map(rnd, 40)
        inner, size = random_map(rnd, middle)
        outer_rows += [(doc, 0, *s) for s in outer]
        inner_rows += [(doc, doc % 3, *s) for s in inner]
        kept[doc] = (outer, inner, size)
        for _ in range(25):
            start = rnd.randint(0, size - 1)
            end = rnd.randint(start, size)
            spans.append((doc, doc % 3, start, end))
            expected[doc, start, end] = plain_outer(inner, start, end)
    inner_map, outer_map = spark.createDataFrame(inner_rows, MAP), spark.createDataFrame(outer_rows, MAP).drop("block_id")
    asked = spark.createDataFrame(sorted(set(spans)), "doc_id int, block_id int, start long, end long")
    found = {(r.doc_id, r.start, r.end): (r.outer_start, r.outer_end, r.editable) for r in maps.to_outer(asked, inner_map, ["doc_id", "block_id"]).collect()}
    assert found == expected
    composed = maps.compose(inner_map, outer_map, ["doc_id"], ["block_id"]).orderBy("doc_id", "start").collect()
    for doc, (outer, inner, size) in kept.items():
        whole = [(r.start, r.length, r.outer_start, r.outer_length, r.kind) for r in composed if r.doc_id == doc]
        assert [s[0] for s in whole] == [sum(x[1] for x in whole[:k]) for k in range(len(whole))] and sum(s[1] for s in whole) == size
        assert all(a[2] + a[3] <= b[2] for a, b in zip(whole, whole[1:]))
        for at in range(size):
            begin, end, sure = plain_outer(inner, at, at + 1)
            twice = plain_outer(outer, begin, end)
            once = plain_outer(whole, at, at + 1)
            assert once[0] <= twice[0] and twice[1] <= once[1]
            if sure and twice[2]:
                assert once == twice


LINES = ["a b", "- x", "  - y", "    deep", "> q", "> > r", "> - s", "1. n", "", "```rust", "```", "# H", "Head", "===", "---", "| a |", "<b>", "    raw", "\tt", "* [x] done", "- > > z", "  more", "~~~", ">"]


def test_tree():
    """Pieces are what the text has at their offsets, numbers are nested, and lines are read once, in order."""
    rnd = random.Random(8)
    for _ in range(600):
        text = rnd.choice(["", "﻿"]) + rnd.choice(["\n", "\r\n", "\r"]).join(rnd.choice(LINES) for _ in range(rnd.randint(0, 14)))
        blocks = tree.read_markdown(text)
        assert [b.pre for b in blocks] == list(range(len(blocks)))
        seen = []
        for b in blocks:
            assert all(text[at : at + len(part)] == part for _, at, part in b.pieces)
            seen += [line for line, _, _ in b.pieces]
            assert b.pre <= b.until < len(blocks) and (b.until == b.pre or b.kind in ("Item", "Quote"))
            if b.parent is not None:
                above = blocks[b.parent]
                assert above.pre < b.pre <= b.until <= above.until and above.depth == b.depth - 1 and above.kind == b.within
                assert above.first_line <= b.first_line <= b.last_line <= above.last_line
        assert seen == sorted(set(seen))


def test_tree_cases():
    shape = lambda text: [(b.kind, b.depth, b.first_line, b.last_line) for b in tree.read_markdown(text)]
    assert shape("- a\n  > b\n  c\n\n  d\n- e") == [("Item", 0, 1, 5), ("Paragraph", 1, 1, 1), ("Quote", 1, 2, 3), ("Paragraph", 2, 2, 3), ("Paragraph", 1, 5, 5), ("Item", 0, 6, 6), ("Paragraph", 1, 6, 6)]
    assert shape("> ```\n> x\ny") == [("Quote", 0, 1, 2), ("Code", 1, 1, 2), ("Paragraph", 0, 3, 3)]
    assert shape("T\n===\n\n    raw\n\n    more\n\np\n1) no\n2) list") == [("Heading", 0, 1, 2), ("Code", 0, 4, 6), ("Paragraph", 0, 8, 8), ("Item", 0, 9, 9), ("Paragraph", 1, 9, 9), ("Item", 0, 10, 10), ("Paragraph", 1, 10, 10)]
    assert shape("a paragraph\n2. goes on\n- [ ] but not here") == [("Paragraph", 0, 1, 2), ("Item", 0, 3, 3), ("Paragraph", 1, 3, 3)]
    assert shape("```a\nb") == [("Code", 0, 1, 2)] and shape("") == [] and shape("- ***") == [("Item", 0, 1, 1), ("Rule", 1, 1, 1)]


def plain_rust(text):
    """One character at a time."""
    found, at = [], 0
    while at < len(text):
        two = text[at : at + 2]
        if two == "//":
            end = min((text.find(c, at) for c in "\r\n" if c in text[at:]), default=len(text))
            found.append((at, end))
            at = end
        elif two == "/*":
            depth, end = 1, at + 2
            while end < len(text) and depth:
                if text[end : end + 2] in ("/*", "*/"):
                    depth += 1 if text[end] == "/" else -1
                    end += 1
                end += 1
            if not depth:
                found.append((at, end))
            at = end
        elif text[at] == "r" and text[at + 1 :].lstrip("#")[:1] == '"' and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            hashes = len(text[at + 1 :]) - len(text[at + 1 :].lstrip("#"))
            close = text.find('"' + "#" * hashes, at + 2 + hashes)
            at = len(text) if close < 0 else close + 1 + hashes
        elif text[at] == '"':
            at += 1
            while at < len(text) and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
            at += 1
        elif text[at] == "'" and text[at + 1 : at + 2] == "\\" and text[at + 3 : at + 4] == "'":
            at += 4
        elif text[at] == "'" and text[at + 2 : at + 3] == "'" and text[at + 1] not in "\\'\n":
            at += 3
        else:
            at += 1
    return found


def test_rust_comments():
    rnd = random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice(["//", "/*", "*/", '"', "\\", "'", "r", "#", '"#', "x", " ", "\n", "é", "/", "'\"'", 'r#"']) for _ in range(rnd.randint(0, 16)))
        assert [(a, b) for a, b, _, closed in regions.rust_comments(text) if closed] == plain_rust(text), text


@pytest.mark.parametrize(("language", "text", "expected"), [
    ("cpp", '/** a */ "/*" /* b */ // c \\\n d\n/// e\n//! f\n///< g\n//// h\n/***/ R"x(// )" // )x" // i', ["/**", "/*", "//", "///", "//!", "///<", "//", "/*", "//"]),
    ("cpp", "int x = 1'000; // a\nchar c = '\"'; // b\n/* open // ", ["//", "//"]),
    ("toml", 'a = "# no" # yes\nb = """\n# no "\\""" # still\n""" # two\nc = \'#\' # three\nd = \'\'\'\n# no\'\'\'\n# four', ["#", "#", "#", "#"]),
    ("toml", 'a = "open # no\n# yes', ["#"]),
    ("rust", "/// d\n//! m\n//// n\n/** o */ /*! p */ /*** q */ /**/", ["///", "//!", "//", "/**", "/*!", "/*", "/*"]),
])
def test_markers(language, text, expected):
    assert [m for _, _, m, closed in regions.SCANNERS[language](text) if closed] == expected


RUST = """//! Top doc.
//! - an item
//!   ```rust
//!   let s = "// no"; // it sells no honey
//!   ```
#[derive(Debug)]
/* block /* nested */
 * gutter text
 *   more
 */
fn main() { let x = r#"/* not "# ; } // trailing
/// doc one
#[attr]
/// doc two

/// apart
// @generated by hand
// ------
// kept
let c = '"'; // after char
/* unclosed
"""
CPP = '/** Doc brief.\n * second\n */\nint a; // splice \\\n goes on\n//  Copyright (c) me\n// All rights reserved\n//\n// real prose\nchar *s = "/* x */";\n'
MARKDOWN = "> - quoted item sells no honey\n>   goes on\n>\n> > ```toml\n> > a = 1 # it sells no bread\n> > ```\n\nPlain ```rust\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.rs", RUST), ("b.md", MARKDOWN), ("c.cpp", CPP), ("d.toml", "a = 1\r\n# one\r\n# two\r\n\r\n# three # four\r\n"), ("e.bin", "x"), ("f.md", ""), ("g.rs", None)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_layers(spark, files):
    blocks, segments = layers.read(files)
    found = sorted((r.doc_id, r.layer, r.kind, r.first_line, r.last_line, r.text) for r in blocks.collect())
    assert found == sorted([
        ("a.rs", 1, "Paragraph", 1, 1, "Top doc."), ("a.rs", 1, "Item", 2, 2, "an item"), ("a.rs", 3, "Paragraph", 4, 4, "it sells no honey"),
        ("a.rs", 1, "Paragraph", 7, 9, "block /* nested */\ngutter text\nmore"), ("a.rs", 1, "Paragraph", 11, 11, "trailing"), ("a.rs", 1, "Paragraph", 12, 14, "doc one\ndoc two"),
        ("a.rs", 1, "Paragraph", 16, 16, "apart"), ("a.rs", 1, "Paragraph", 19, 19, "kept"), ("a.rs", 1, "Paragraph", 20, 20, "after char"),
        ("b.md", 0, "Item", 1, 2, "quoted item sells no honey\ngoes on"), ("b.md", 2, "Paragraph", 5, 5, "it sells no bread"), ("b.md", 0, "Paragraph", 8, 8, "Plain ```rust"),
        ("c.cpp", 1, "Paragraph", 1, 2, "Doc brief.\nsecond"), ("c.cpp", 1, "Paragraph", 4, 5, "splice \\\ngoes on"), ("c.cpp", 1, "Paragraph", 9, 9, "real prose"),
        ("d.toml", 1, "Paragraph", 2, 3, "one\ntwo"), ("d.toml", 1, "Paragraph", 5, 5, "three # four"),
    ])
    texts = {(r.doc_id, r.block_id): r.text for r in blocks.collect()}
    sources = {r.doc_id: r.text for r in files.collect()}
    for s in segments.collect():
        if s.kind == "V" and (s.doc_id, s.block_id) in texts:
            assert texts[s.doc_id, s.block_id][s.start : s.start + s.length] == sources[s.doc_id][s.outer_start : s.outer_start + s.outer_length]
    assert layers.read(files.limit(0))[0].collect() == []


def test_check_in_layers(spark, files):
    found = {(r.path, r.line, r.column, r.end_column, r.quote) for r in check_documents(files.select(F.col("doc_id").alias("path"), "text"), ["verbs_no_nouns"]).collect()}
    assert found == {("a.rs", 4, 30, 44, "sells no honey"), ("b.md", 1, 17, 31, "sells no honey"), ("b.md", 5, 16, 30, "sells no bread")}
    allowed = spark.createDataFrame([(1, "b.md", "banned_chars", "> -  QUOTED item sells no honey"), (2, "b.md", "banned_chars", "no such line")], "entry int, path string, lint string, quote string")
    settings = Settings(banned_chars={"q": "k", "#": "no"})
    on = check_documents(files.where("doc_id = 'b.md'").select(F.col("doc_id").alias("path"), "text"), ["banned_chars"], settings=settings, allowed=allowed)
    assert {(r.line, r.quote) for r in on.collect()} == {(5, "#")}


def test_sections(spark):
    docs = spark.createDataFrame([("docs/a.md", "one two"), ("src/b.rs", "// one two"), ("other.md", "one two")], "path string, text string")
    sections = [(Section("docs", ["docs/**"]), Settings(phrases=["one"])), (Section("code", ["src/**"]), Settings(phrases=["two"]))]
    found = {(r.section, r.path, r.column) for r in check_sections(docs, sections).where("lint = 'banned_phrases'").collect()}
    assert found == {("docs", "docs/a.md", 1), ("code", "src/b.rs", 8)}
