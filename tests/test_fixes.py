"""Fixing by place against a plain loop, one text at a time."""

import random

import pytest
from pyspark.sql import functions as F

from prosegrid.operators import chars, fixes, tree

INSTEAD = {"•": "-", "…": "...", "—": "-", "α": "β", "β": "+"}


def shape(text):
    return sorted({(line, b.kind, b.depth) for b in tree.read_markdown(text) for line in {b.first_line, *(p[0] for p in b.pieces)}})


def plain_fix(text, held):
    """Each round replaces what every line that isn't held has, all at once; what breaks the blocks is undone, and held."""
    held, rounds = set(held), 0
    while True:
        rounds += 1
        lines = text.split("\n")
        edited = {n for n, line in enumerate(lines, 1) if n not in held and any(c in INSTEAD for c in line)}
        if not edited:
            return text, held, rounds
        new = "\n".join("".join(INSTEAD.get(c, c) for c in line) if n in edited else line for n, line in enumerate(lines, 1))
        changed = {line for line, *_ in set(shape(text)) ^ set(shape(new))}
        if not changed:
            text = new
        else:
            held |= changed & edited or edited


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(6)
    parts = ["• item", "plain … text", "a — b", "αα", "β", "", "> •", "- x", "```", "# —", "—", "1 • 2", "• •"]
    return {f"{n}.md": "\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for n in range(60)} | {"none.md": "", "held.md": "a … b\nc … d"}


def test_fixpoint(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    kept = spark.createDataFrame([("held.md", 2)], "path string, line int")
    found, held, reads = fixes.fix(docs, fixes.char_edits(INSTEAD), kept)
    expected = {path: plain_fix(text, {2} if path == "held.md" else ()) for path, text in texts.items()}
    rows = {r.path: r for r in found.collect()}
    assert {p: r.text for p, r in rows.items()} == {p: t for p, (t, _, _) in expected.items()}
    assert all(r.fixed == (r.text != texts[p]) for p, r in rows.items())
    assert {(r.path, r.line) for r in held.collect()} == {(p, n) for p, (_, lines, _) in expected.items() for n in lines}
    longest = max(rounds for *_, rounds in expected.values())
    assert reads == [sum(rounds > k for *_, rounds in expected.values()) for k in range(longest)] + [0]
    assert rows["held.md"].text == "a ... b\nc … d" and fixes.fix(docs.limit(0), fixes.char_edits(INSTEAD))[0].collect() == []


def test_overlapping_edits_and_no_end(spark):
    docs = spark.createDataFrame([("a.txt", "aaaa b\r\nx")], "path string, text string")
    both = lambda t: t.where(F.contains("text", F.lit("aa"))).select("path", F.lit(1).alias("line"), F.explode(F.array(F.lit(1), F.lit(2))).alias("start"), (F.col("start") + 2).alias("end"), F.lit("a").alias("replacement"))
    found, _, reads = fixes.fix(docs, both)
    assert found.first().text == "a b\r\nx" and reads == [1, 1, 1, 1, 0]
    grows = lambda t: t.select("path", F.lit(1).alias("line"), F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("y").alias("replacement"))
    with pytest.raises(ValueError, match="still change"):
        fixes.fix(docs, grows, most=2)


def test_written_instead():
    found = fixes.written_instead(list(chars.GROUPS), {"ß": "ss", "|": "/"}, ["…"])
    assert found["—"] == "-" and "…" not in found and "ß" not in found and found["|"] == "/"


def test_retained_by_place(spark):
    before = spark.createDataFrame([("a.md", "x … y … z\n• w")], "path string, text string")
    propose = fixes.char_edits(INSTEAD)
    after = fixes.fix(before, propose)[0].select("path", "text")
    findings = spark.createDataFrame([("a.md", "banned_chars", 1, 3, 4), ("a.md", "banned_chars", 2, 1, 2), ("a.md", "max_size_bytes", None, None, None)], "path string, lint string, line int, column int, end_column int")
    assert sorted((r.lint, r.line) for r in fixes.retained(findings, before, after, propose).collect()) == [("banned_chars", 2), ("max_size_bytes", None)]
