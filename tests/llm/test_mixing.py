"""Mixing against a plain version, and its hard rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from prosegrid.llm import mixing

CYCLE, SHARE, CAP = (3, 1, 2), 1.5, 2.0
SCHEMA = "doc_id long, text string, source string, size string, target int, _range string, start long"


def filled(sizes, weights, budget):
    """Water by weight, one stopped source after another."""
    stopped = {s: 0.0 for s in sizes if sizes[s] == 0}
    while True:
        open_ = [s for s in sizes if s not in stopped]
        rate = (budget - sum(stopped.values())) / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if rate * weights[s] > CAP * sizes[s]]
        if not over:
            return {s: stopped[s] if s in stopped else rate * weights[s] for s in sizes}
        stopped |= {s: CAP * sizes[s] for s in over}


def key(doc_id, text):
    digest = hashlib.md5(f"42:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
    share = (1 + sum(c not in mixing.ODD_MARKS for c in text or "")) / (1 + len(text or "")) if text is not None else 1
    return -math.log((int(digest[:13], 16) + 0.5) / 2**52) / share**2


def plain(rows):
    """(doc_id, source, size, taken) of each row, and the targets."""
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = filled(sizes, {s: CYCLE[i % 3] for i, s in enumerate(order)}, SHARE * sum(sizes.values()))
    found = []
    for source in order:
        quota = math.floor(target[source] + 0.5)
        epochs, rest = divmod(quota, sizes[source]) if sizes[source] else (0, 0)
        for doc_id, text, _, *_ in sorted((r for r in rows if r[2] == source), key=lambda r: key(r[0], r[1])):
            size = len((text or "").encode().split())
            cut = max(0, min(size, rest))
            rest -= cut
            found.append((doc_id, source, size, epochs * size + cut))
    return found, target


ROWS = (
    [(i, f"word{i} and more words " * (i % 7 + 1), f"s{i % 4}", "x", 1, "y", 2) for i in range(60)]
    + [(100 + i, "a b c", "s9", None, None, None, None) for i in range(300)]
    + [(None, "lone words here", None, None, None, None, None)] * 3
    + [(7, "same row again", "s1", None, None, None, None)] * 4
    + [(500, None, "empty", None, None, None, None), (501, " \n", "empty", None, None, None, None), (502, "w " * 30000, "é", None, None, None, None)]
)


def test_against_plain(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    found = mixing.mix(docs, CYCLE, SHARE, CAP).collect()
    expected, target = plain(ROWS)
    assert sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in found) == sorted((str(d), str(s), n, t) for d, s, n, t in expected)
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= CAP * r.size
    taken = {s: sum(r.taken for r in found if r.source == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 10)
    rows = [(i, "some words " * (i % 5), f"h{i % 90}", None, None, None, None) for i in range(400)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA), CYCLE, SHARE, CAP).collect()
    assert sorted((r.doc_id, r.source, r.size, r.taken) for r in found) == sorted(plain(rows)[0])


def test_all_stopped_and_empty(spark):
    docs = spark.createDataFrame(ROWS[:8], SCHEMA)
    assert all(r.taken == 2 * r.size for r in mixing.mix(docs, CYCLE, 5.0, CAP).collect())
    assert mixing.mix(docs.limit(0), CYCLE, SHARE, CAP).collect() == []
    blank = spark.createDataFrame([(1, None, "a", None, None, None, None)], SCHEMA)
    assert [(r.target, r.taken) for r in mixing.mix(blank, CYCLE, SHARE, CAP).collect()] == [(0.0, 0)]


def test_weights_and_texts(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(10)), "good" if i % 2 else "bad", None, None, None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weight = F.when(F.col("doc_id") < 100, 20.0).when(F.col("doc_id") < 110, F.lit(None)).otherwise(1.0)
    found = mixing.mix(docs, (1,), 0.5, CAP, weight).cache()
    taken = {r.doc_id: r.taken for r in found.collect()}
    assert sum(taken[i] > 0 for i in range(100)) > 90 and not any(taken[i] for i in range(100, 110))
    mixed = mixing.mixed_texts(docs, found).collect()
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}
    assert all(dict((r[0], r[1]) for r in rows)[r.doc_id].startswith(r.text) for r in mixed)


def test_native(spark):
    found = mixing.mix(spark.createDataFrame(ROWS, SCHEMA), CYCLE, SHARE, CAP)
    assert "Python" not in found._jdf.queryExecution().toString()
