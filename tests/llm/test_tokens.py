import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosegrid.llm import bpe, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"
EDGES = [
    None, "", " ", "\n\n", "a", "The cat's  hat", "x\n \ny", "a   b", "a \n b", "tabs\t\tand\r\nlines", "ends  ", "  begins",
    "Straße ΣΑΣ İstanbul ﬁ é é", "１２３ 123 4.5", "日本語のテキスト", "🙂🙂 ok🙂", "<|endoftext|> in <|startoftext|> text", "a\x1cb\x1fc", "nb\xa0sp thin　wide",
    "don't WE'RE they'll", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thethethetheinging" * 40, "$$$ ### %%%&&&!!!", "\x00\x01 nul", "word " * 3000,
]


def library(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [tokenizer.decode(x, skip_special_tokens=False) for x in ids]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(DOCS).select("text").collect()] + EDGES


def test_automaton_agrees_with_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = docs.select("doc_id", bpe.bpe_encode(spark, F.col("text"), WORDS).alias("ids"))
    rows = ids.withColumn("decoded", bpe.bpe_decode(spark, F.col("ids"), WORDS)).orderBy("doc_id").collect()
    expected_ids, expected_texts = library(WORDS, texts)
    for text, row, a, b in zip(texts, rows, expected_ids, expected_texts):
        assert (row.ids, row.decoded) == (a, b), text


def test_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "The cat's hat"), (1, "The cat's hat"), (None, "The cat's hat")], "doc_id long, text string")
    rows = docs.withColumn("ids", bpe.bpe_encode(spark, F.col("text"), WORDS)).withColumn("decoded", bpe.bpe_decode(spark, F.col("ids"), WORDS)).collect()
    assert len(rows) == 3 and len({(tuple(r.ids), r.decoded) for r in rows}) == 1
    none = docs.limit(0).withColumn("ids", bpe.bpe_encode(spark, F.col("text"), WORDS))
    assert none.withColumn("decoded", bpe.bpe_decode(spark, F.col("ids"), WORDS)).collect() == []


def test_packing_repeated_rows(spark):
    """Each row is packed, repeated or without an id."""
    docs = spark.createDataFrame([(1, "The cat's hat"), (1, "The cat's hat"), (None, "The cat's hat")], "doc_id long, text string")
    rows = packing.pack(docs, BYTES, window=4).collect()
    ids = library(BYTES, ["The cat's hat"])[0][0] + [1]
    assert sum(r.length for r in rows) == 3 * len(ids) and {r.doc_tokens for r in rows} == {len(ids)}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_automaton_against_merging():
    """Random merge lists, with tokens that lead and end like each other."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        known, merges = list(base), []
        for _ in range(14):
            u, v = (known[rng.integers(len(known))] for _ in range(2))
            if not u.endswith("</w>") and u + v not in known:
                merges.append((u, v))
                known.append(u + v)
        automaton = bpe.Automaton(base, merges)
        for _ in range(60):
            word = ["abc"[k] for k in rng.integers(0, 3, rng.integers(1, 9))]
            word[-1] += "</w>"
            parts = list(word)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (u, v):
                        parts[k : k + 2] = [u + v]
                    k += 1
            read = automaton.read("".join(word).replace("</w>", bpe.END))
            assert [automaton.label[t].replace(bpe.END, "</w>") for t in read] == parts


def check_packing(rows, texts, window):
    expected = [ids + [1] for ids in library(BYTES, texts)[0]]
    pieces = {}
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for n, ids in enumerate(expected):
        parts = sorted(pieces[n])
        assert sum((p[1] for p in parts), []) == ids
        assert all(p[2] == len(ids) for p in parts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert len(sequences) == -(-sum(map(len, expected)) // window)


def test_packing(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check_packing(packing.pack(docs, BYTES).collect(), texts, 2048)
    check_packing(packing.pack(docs.limit(len(texts)).withColumn("ids", F.lit("x")), BYTES, window=7).collect(), texts, 7)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).collect() == []


def test_checksum(spark):
    row = packing.pack(spark.createDataFrame([(7, None)], "doc_id long, text string"), BYTES).select("doc_id", F.crc32("ids").alias("c"), "length").first()
    assert (row.doc_id, row.c, row.length) == (7, zlib.crc32(b"\x01\0\0\0"), 1)


def test_too_many_tokens(monkeypatch):
    from prosegrid.llm import bpe

    monkeypatch.setattr(bpe, "MOST_TOKENS", 3)
    with pytest.raises(ValueError, match="more than 3 tokens"):
        bpe.Automaton(["a", "b", "c"], [("a", "b")])
