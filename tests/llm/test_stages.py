import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _quality string, _language string, _host int, fingerprint string, component_id long, part int"
ROWS = [
    (1, "the cat sat on the mat and then it ran off to the old barn", "en", "a", 58), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "word " * 30_000, "en", "b", 150_000),
    (5, "the cat sat on the mat and then it ran off to the old barn", "en", "b", 58), (5, "the cat sat on the mat and then it ran off to the old barn", "en", "b", 58),
    (None, "no name here but some words all the same", "en", None, 40), (6, "\t\n", "xx", "a", 2),
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 0), (9, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*r, "c", "c", 0, "c", 7, 1) for r in ROWS], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_hard_rows(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stage(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert {r.fingerprint for r in rows} == {"c"} and all(r in docs.collect() for r in rows)
    if name == "near duplicates":  # null, empty and blank texts share a fingerprint
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "4", "None"]
    assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_run_on_hard_rows(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {1, None} <= {r.doc_id for r in pieces}
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert corpus_pipeline.packing(spark, empty, sf_dir).collect() == []
    assert corpus_pipeline.packing(spark, empty.withColumn("ids", F.lit(1)), sf_dir).columns[0] == "doc_id"


def test_language_stage_drops_noise_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(8)
    letters = np.array(list("bcdfghjklmnpqrstvwxz0123456789#%"))
    of = {r.lang: r.text for r in docs.where("length(text) > 3000").orderBy(F.desc("doc_id")).collect()}
    planted = [(9001, "".join(rng.choice(letters, 1500)), "en", "src1", 1500), (9002, of["en"][:2800] + of["fr"][:2800], "en", "src1", 5600), (9003, None, "en", "src1", 0)]
    kind = docs.schema["n_chars"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(planted, f"doc_id long, text string, lang string, source string, n_chars {kind}"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, rows, "").collect()}
    assert {9001, 9002}.isdisjoint(kept) and 9003 in kept
    assert len(kept) > 0.99 * docs.count()
