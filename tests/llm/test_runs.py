"""Runs against all periods tried one by one, and hard rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from prosegrid.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, least):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            length = at - start + period
            if length >= max(least, 2 * period):
                found.setdefault((start, length), period)
            at += 1
    return sorted((start, length, period) for (start, length), period in found.items())


def left_of(words, found):
    dropped = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_small_alphabets():
    rnd = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            letters = rnd.choice([1, 2, 2, 3, 6])
            words = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(0, 70))]
            if words and rnd.random() < 0.6:
                start, period = rnd.randrange(len(words)), rnd.randint(1, 9)
                words = [words[start + (i - start) % period] if i >= start and start + period <= len(words) else w for i, w in enumerate(words)]
            texts.append(words + words[::-1] + words if rnd.random() < 0.4 else words)
        least = rnd.choice([2, 3, 5, 12])
        for words, (found, left) in zip(texts, runs.runs_of(texts, least)):
            assert sorted(found) == plain_runs(words, least)
            assert left.decode() == left_of([w.decode() for w in words], found)


def test_words_of_fibonacci():
    """A text of as many nested runs as there are, all of them inside of earlier factors."""
    a, b = ["x"], ["x", "y"]
    while len(b) < 2000:
        a, b = b, b + a
    words = [w.encode() for w in b]
    assert sorted(runs.runs_of([words, words], 12)[1][0]) == plain_runs(words, 12)


def test_small_pieces(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS_AT_ONCE", 7)
    words = ["a b c a b c a b c a b c a b d".split() * 3][0]
    assert sorted(runs.runs_of([[w.encode() for w in words]], 12)[0][0]) == plain_runs(words, 12)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", 50)
    texts = [None, "", " \t\n", "one", "a " * 30000, "x y " * 6, "   ", "a b " * 9 + "c " + "b a " * 9] + ["p q r s " * 4] * 3
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    found = docs.select("doc_id", "runs", runs.find_runs(spark, F.col("text")).alias("r")).orderBy("doc_id").collect()
    for row, text in zip(found, texts):
        words = [w.decode() for w in (text or "").encode().split()]
        expected = [(0, 30000, 1)] if len(words) == 30000 else plain_runs(words, 12)
        assert [tuple(r) for r in row.r.runs] == expected and row.r.collapsed == left_of(words, expected)
    assert docs.limit(0).select(runs.find_runs(spark, F.col("text"))).collect() == []


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op12_runs(spark, SF).collect()}
    assert len(found) == len(rows) and any(r.n_runs > 1 for r in found.values())
    for row in rows:
        words, h = [w.decode() for w in (row.text or "").encode().split()], zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        expected, r = plain_runs(words, 12), found[row.doc_id]
        assert r.n_runs == len(expected)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in expected).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left_of(words, expected).encode()).hexdigest()
        if expected:
            s, n, p = min(expected, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, p, 1000 * n // p)
