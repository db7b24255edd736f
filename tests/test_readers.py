import hashlib
import json

import pytest
from pyspark.sql import functions as F

from prosegrid.operators import chars, lints, markdown
from prosegrid.plans.check import check_documents
from prosegrid.sources import files, reports
from prosegrid.streaming.watch import watch

TEXT = """---
max_size_bytes: 90
---
# Title #

A paragraph of *light* and **strong words** with `*code*`
that goes on. DO NOT stop.

- item one
  goes on
- [x] done task
1. numbered

> quoted
lazy

```rust title
let x = "**no**";

```

## Repository layout

```
src/      <- the code
README.md <- the text
gone.md   <- not there
bad row
docs/   <- out of column
```

| a | b |
|---|---|

***
<div>raw</div>
"""


@pytest.fixture(scope="module")
def blocks(spark):
    return markdown.blocks(spark.createDataFrame([("a.md", TEXT), ("b.md", "﻿plain\r\nline\r\rlast")], "doc_id string, text string")).cache()


def test_blocks(blocks):
    rows = blocks.where("doc_id = 'a.md'").orderBy("block_id").collect()
    assert [(r.kind, r.first_line, r.last_line) for r in rows] == [
        ("Frontmatter", 1, 3), ("Heading", 4, 4), ("Paragraph", 6, 7), ("Item", 9, 10), ("Item", 11, 11), ("Item", 12, 12), ("Quote", 14, 15),
        ("Code", 17, 20), ("Heading", 22, 22), ("Code", 24, 30), ("Table", 32, 33), ("Rule", 35, 35), ("Html", 36, 36),
    ]
    assert (rows[1].text, rows[1].level, rows[4].task, rows[4].text) == ("Title", 1, True, "done task")
    assert (rows[6].text, rows[7].info, rows[7].heading) == ("quoted\nlazy", "rust title", "Title")
    assert rows[7].text == 'let x = "**no**";\n' and rows[3].text == "item one\ngoes on"
    other = blocks.where("doc_id = 'b.md'").orderBy("block_id").collect()
    assert [(r.first_line, r.last_line, r.text) for r in other] == [(1, 2, "plain\nline"), (4, 4, "last")]


def test_emphasis_and_layout(spark, blocks):
    spans = markdown.emphasis(blocks).orderBy("quote").collect()
    assert [(r.kind, r.quote) for r in spans] == [("Strong", "**strong words**"), ("Emphasis", "*light*")]
    caps = lints.caps_runs(lints.read(blocks)).select("doc_id", (F.col("words") * 4).alias("chars"))
    over = markdown.over_emphasised(blocks, caps, 2, 5.0).collect()
    assert [(r.doc_id, r.spans) for r in over] == [("a.md", 3)] and over[0].percent > 5
    paths = spark.createDataFrame([("src",), ("README.md",), ("docs",)], "path string")
    found = {(r.doc_id, r.line, r.problem) for r in markdown.layout_problems(blocks, paths, least=5).collect()}
    assert {("a.md", 27, "no such path"), ("a.md", 28, "no entry"), ("a.md", 29, "out of column"), ("a.md", 25, "too few entries"), ("b.md", None, "no heading")} == found


def test_visible(spark):
    row = spark.createDataFrame([("a ![i](u) [t](u) **b** *c* `d` <b>e</b> snake_case_x",)], "t string").select(markdown.visible(F.col("t")).alias("v")).first()
    assert row.v == "a  t b c d e snake_case_x"


def test_comments(spark):
    source = "/// One\n/// two\nfn x() {}\n    // inner\n// top\n//\n"
    rows = markdown.comments(spark.createDataFrame([(1, source)], "doc_id int, text string"), ["///", "//!", "//"]).orderBy("region").collect()
    assert [(r.marker, r.first_line, r.last_line, r.text) for r in rows] == [("///", 1, 2, "One\ntwo"), ("//", 4, 4, "inner"), ("//", 5, 6, "top\n")]


def test_check_and_reports(spark):
    docs = spark.createDataFrame([("a b.md", "# T\n\nFirst line here.\nIt sells no honey, and the farm's\nown geese.\n\n```\nIt sells no bread.\n```\n"), ("c.md", "It sells no cat.")], "path string, text string")
    rows = check_documents(docs).cache()
    found = {(r.path, r.lint, r.line, r.column, r.end_line, r.quote) for r in rows.collect()}
    assert found == {("a b.md", "verbs_no_nouns", 4, 4, 4, "sells no honey"), ("a b.md", "possessive_own", 4, 28, 5, "farm's own geese"), ("c.md", "verbs_no_nouns", 1, 4, 1, "sells no cat")}
    hunks = files.hunks(spark.createDataFrame([(1, "--- a/c.md\n+++ b/c.md\n@@ -1 +1 @@ x\n-a\n+b\n--- a/a b.md\n+++ b/a b.md\n@@ -9,0 +10,2 @@\n")], "patch_id int, text string"))
    assert [r.path for r in check_documents(docs, hunks=hunks).collect()] == ["c.md"]
    assert {(r.path, r.added_start, r.added_end, r.removed_start, r.removed_end) for r in hunks.collect()} == {("c.md", 1, 2, 1, 2), ("a b.md", 10, 12, 10, 10)}
    report = json.loads(reports.json_report(rows).where("path = 'a b.md'").first().json)
    assert [f["lint"] for f in report["findings"]] == ["possessive_own", "verbs_no_nouns"]
    result = json.loads(reports.sarif_results(rows).where("lint = 'possessive_own'").first().result)
    assert result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b.md"
    assert reports.github_commands(rows).where("path = 'c.md'").first().command == "::error file=c.md,line=1,endLine=1,title=verbs_no_nouns::sells no cat"
    assert {(r.lint, r.files, r.places) for r in reports.tally(rows).collect()} == {("verbs_no_nouns", 2, 2), ("possessive_own", 1, 1)}
    assert reports.text_lines(rows).where("path = 'c.md'").first().text == "line 1"


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / ".git").mkdir()
    for name, data in {"a.md": b"ok \xff\xfe x", "docs/b.md": b"b", ".git/c.md": b"c", "docs/d.txt": b"d"}.items():
        (tmp_path / name).write_bytes(data)
    rows = files.walk(spark, str(tmp_path), ["*.md"], []).withColumn("text", files.decoded(F.col("content")))
    assert sorted((r.path, r.text) for r in rows.collect()) == [("a.md", "ok $$ x"), ("docs/b.md", "b")]
    cards = spark.createDataFrame(
        [("a.md", hashlib.sha256(b"ok \xff\xfe x").hexdigest(), 7, "llm"), ("docs/b.md", "0", 1, "llm"), ("gone.md", "0", 1, "llm")], "fixture string, sha string, size long, label string"
    ).select("fixture", F.struct(F.lit(1)).alias("source"), F.struct(F.lit(1)).alias("history"), F.struct("label").alias("authorship"), F.struct(F.col("sha").alias("sha256"), F.col("size").alias("size_bytes")).alias("content"))
    found = {(r.path or r.fixture): r.fault for r in files.checked(rows.select("path", "content"), cards).collect()}
    assert found == {"a.md": None, "docs/b.md": "other bytes", "gone.md": "no fixture"}
    docs = spark.createDataFrame([(1, TEXT), (2, "x" * 50), (3, "---\nmax_size_bytes: soon\n---\n"), (4, "y" * 51)], "doc_id int, text string")
    assert sorted((r.doc_id, r.unreadable) for r in files.oversized(docs, 50).collect()) == [(1, False), (3, True), (4, False)]


def test_batches_and_treebank(spark, tmp_path):
    batches = spark.createDataFrame([("b1", "x"), ("b2", "x"), ("b1", "y"), ("b3", "z")], "batch string, path string")
    gone = spark.createDataFrame([("b2", "y"), ("b1", "z"), ("b2", "x")], "batch string, path string")
    assert {(r.batch, r.path) for r in files.live(batches, gone).collect()} == {("b2", "x"), ("b3", "z")}
    (tmp_path / "t.conllu").write_text("# sent_id = s1\n# text = Cats run\n1\tCats\tcat\tNOUN\t_\tNumber=Plur|Case=Nom\t2\t_\t_\tSpaceAfter=No\n2\trun\trun\tVERB\t_\t_\t0\t_\t_\t_\n\n# sent_id = s2\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n1\tHi\thi\tINTJ\t_\t_\t0\t_\t_\t_\n")
    rows = files.treebank(spark, str(tmp_path / "t.conllu")).orderBy("sent_id", "word_id").collect()
    assert [(r.sent_id, r.word_id, r.form, r.upos) for r in rows] == [("s1", 1, "Cats", "NOUN"), ("s1", 2, "run", "VERB"), ("s2", 1, "Hi", "INTJ")]
    assert rows[0].feats == {"Number": "Plur", "Case": "Nom"} and rows[0].misc == {"SpaceAfter": "No"} and rows[1].feats == {}


def test_chars(spark):
    texts = spark.createDataFrame([(1, "a — b → c … § ✅ ⇒ é")], "k int, text string")
    found = {r.label: r.verdict for r in chars.verdicts(chars.histogram(texts, "k", "text"), chars.rule_table(spark, ["dashes", "emoji"]), ["→"], {"é": "e"}).collect()}
    assert found == {"U+2014": "group dashes", "U+2192": "allowed", "U+2026": "free", "U+00A7": "free", "U+2705": "group emoji", "U+21D2": "free", "U+00E9": "banned"}
    assert chars.fixed(texts, "text", ["dashes", "arrows", "ellipsis", "section"]).first()._fixed == "a - b -> c ... § ✅ => é"


def test_watch(spark, tmp_path):
    rows = [("a.md", "It sells no cat.", "2024-01-01 00:00:00"), ("b.md", "It sells no cat.", "2024-01-01 00:01:00"), ("c.md", "Fine.", "2024-01-01 00:02:00")]
    frame = spark.createDataFrame(rows, "path string, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(f"{tmp_path}/in")
    found = []
    query = watch(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), lambda df, n: found.extend(df.collect()), f"{tmp_path}/state", ["verbs_no_nouns"])
    query.awaitTermination(120)
    assert [r.quote for r in found] == ["sells no cat"]
