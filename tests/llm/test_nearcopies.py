import numpy as np
import pytest

import corpus_pipeline
from prosegrid.llm import nearcopies


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, edits, rng):
    """The words with so many of them replaced, ten apart."""
    out = list(words)
    for at in rng.choice(len(words) // 10 - 1, edits, replace=False):
        out[10 * at + 5] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def planted(rng):
    """Texts of 600 words, each with a copy of another similarity, from 0.7 to 0.96."""
    for n in range(60):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 600)]
        yield 2 * n, " ".join(words)
        yield 2 * n + 1, edited(words, (2, 6, 9, 13, 16, 21)[n % 6], rng)


def components(rows):
    """Smallest id of each class, over all pairs."""
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and root[i] != root[j] and similarity(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_planted_copies(spark):
    rows = list(planted(np.random.default_rng(3)))
    found = [similarity(rows[2 * n][1], rows[2 * n + 1][1]) for n in range(60)]
    assert min(found) < 0.75 and sum(0.8 <= x <= 0.95 for x in found) == 30
    rows += [(900, None), (901, " \n"), (902, "one"), (903, "ONE"), (904, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == components(rows)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, r in components(rows).items() if i == r}


@pytest.mark.parametrize("part", [8, 512])
def test_large_family(spark, monkeypatch, part):
    """Copies of one text that are less alike among themselves, in one lane and in many."""
    monkeypatch.setattr(nearcopies, "PART", part)
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 1 << 30, 400)]
    rows = [(100 + n, edited(words, 5 + n % 4, rng)) for n in range(40)] + [(500, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == components(rows)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nearcopies.near_copies(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words are here")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in nearcopies.near_copies(rows).collect()) == ["5", "5", "5", "None"]


def test_links_through_repeated_and_missing_ids(spark):
    """A row without an id ties its near copies on either side, and rows that repeat an id tie theirs."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 1 << 30, 400)]
    low, high = words.copy(), words.copy()
    for n in range(6):
        low[60 + 10 * n], high[260 + 10 * n] = f"low{n}", f"high{n}"
    left, middle, right = " ".join(low), " ".join(words), " ".join(high)
    assert similarity(left, middle) >= 0.8 <= similarity(middle, right) and similarity(left, right) < 0.8
    docs = spark.createDataFrame([(4, left), (None, middle), (9, right), (9, "something else"), (12, "something else"), (15, "alone here")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id) for r in nearcopies.near_copies(docs).collect()), key=str)
    assert found == sorted([(4, 4), (None, 4), (9, 4), (9, 4), (12, 4), (15, 15)], key=str)
