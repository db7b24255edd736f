"""Queries that SQL can express, against their SQL, and the pipeline against a plain version of its stages."""

import duckdb
import pytest

import corpus_pipeline
from prosegrid.llm import queries

def shingle_set(text):
    """The text's runs of five words."""
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    result = con.sql(queries.ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(found.columns)
    expected = [tuple(dict(zip(result.columns, r))[c] for c in columns) for r in result.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_pipeline(spark):
    """What each stage keeps is what its operator says, one document at a time; the packed pieces are of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in queries.op3_quality(spark, SF).where("keep = 1").collect()}
    assert 0.5 * len(rows) < len(good) < len(rows)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert kept == good
    after = docs.where(docs.doc_id.isin(sorted(kept)))
    spoken = corpus_pipeline.language(spark, after, SF)
    assert spoken.columns == docs.columns and {r.doc_id for r in spoken.collect()} == kept
    shingles = {i: shingle_set(rows[i].text) for i in kept}
    root = {}
    for i in sorted(kept):
        near = {root[j] for j in root if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
        root |= {j: min(near) for j in root if root[j] in near} | {i: min(near | {i})}
    left = {i for i in kept if root[i] == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, after, SF).collect()} == left
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == left
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
