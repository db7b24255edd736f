"""From documents to packed sequences, in stages that are each written as Parquet and read again.

Every stage but the last returns the columns of its documents, whatever their names. Null and empty
texts, repeated rows and empty tables have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm import langid, nearcopies, queries
from prosegrid.llm.shared import table, written


#: Ids of copies that are broadcast, 16 MB; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: A column name that no table has.
GONE = "_pipeline_gone"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, rejects go."""
    return docs.where(queries.graded(docs, table(spark, sf_dir, "labels"))["score"] >= 0.5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't surely in one known language go: noise, unknown languages, mixtures."""
    return queries.spoken(docs).where(queries.in_one_language()).drop(langid.RESULT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Near copies share four fifths of their five-word shingles or more; every link is verified. Rows that repeat a doc_id are one document and stay together; rows without a doc_id stay.
    """
    gone = written(spark, nearcopies.near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(GONE)).distinct(), "gone")
    few = gone.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone[GONE], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that stay, packed into sequences; no document goes."""
    return queries.packed_pieces(docs)


STAGES = [("quality", quality), ("language", language), ("near duplicates", near_duplicates), ("packing", packing)]

#: The stages' fingerprints and tokens are outside SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
