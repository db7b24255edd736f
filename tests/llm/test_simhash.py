import numpy as np
import xxhash
from pyspark.sql import functions as F

from prosegrid.llm import simhash
from prosegrid.llm.components import components

DOCS = "/root/testdata/sf0.001/documents.parquet"


def plain_print(text):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """Smallest id of each class, over all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if b > a and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, rows[0][1]), (1007, rows[0][1] + " x"), (1008, "É É É"), (1009, "é é é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    assert {i: r.fingerprint & (1 << 64) - 1 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute(prints)
    assert prints[1000] == 0 and prints[1008] != prints[1009]


def test_hot_bucket_is_dealt_into_lanes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(1)
    values = set()
    for center in rng.integers(0, 1 << 62, 4):
        for _ in range(120):
            value = int(center)
            for bit in rng.integers(0, 20, 4):
                value ^= 1 << int(bit)
            values.add(value)
    prints = dict(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(v, i) for i, v in prints.items()], "fingerprint long, node long")
    links = simhash.links(nodes)
    expected = brute(prints)
    assert links.count() < 10 * 20 * len(prints)
    labels = {r.node: r.label for r in components(links).collect()}
    assert {i: labels.get(i, i) for i in prints} == expected


def test_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in components(chain).collect()} == {0}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words are here")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(rows).collect()) == ["5", "5", "5", "None"]


def test_links_through_repeated_and_missing_ids(spark, monkeypatch):
    """Fingerprints stand for texts here: rows that repeat a doc_id tie theirs, and a row without one ties its neighbours."""

    def component(rows):
        frame = spark.createDataFrame(rows, "doc_id long, fingerprint long")
        monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: frame)
        return [(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).orderBy("doc_id", "fingerprint").collect()]

    a, b = 0x0F0F0F0F0F0F0F0F, 0x3333333333333333
    assert component([(3, a), (5, a), (5, b), (9, b)]) == [(3, 3), (5, 3), (5, 3), (9, 3)]
    assert component([(1, 0), (None, 0b111), (2, 0b111111)]) == [(None, 1), (1, 1), (2, 1)]
    assert component([(None, a), (None, b), (7, 0)]) == [(None, None), (None, None), (7, 7)]


def test_long_text(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"w{n}" for n in rng.integers(0, 5000, 120_000))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "short")], "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert found[1].fingerprint & (1 << 64) - 1 == plain_print(text)
    assert (found[2].component_id, found[3].component_id) == (1, 3)
