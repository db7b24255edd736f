"""Gold words against tokens: alignment by span, and each sentence's tally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.operators.settings import overlap_groups

LEVELS = ["Sure", "Likely", "Unsure", "Unknown"]


def aligned(gold: DataFrame, tokens: DataFrame) -> DataFrame:
    """Groups of gold words and tokens of a sentence whose spans chain by overlap, and what each can be scored as.

    gold: sent_id, start, end, gold (tag; null for marks and others). tokens: sent_id, start, end,
    kind, tag, kept, confidence. A group of one word token is scored against its first gold word's
    tag; one of several word tokens can't be aligned.
    """
    spans = gold.select("sent_id", "start", "end", "gold", F.lit(None).cast("struct<tag:string,kept:array<string>,confidence:string>").alias("reading"), F.lit(False).alias("word")).unionByName(
        tokens.select("sent_id", "start", "end", F.lit(None).cast("string").alias("gold"), F.struct("tag", "kept", "confidence").alias("reading"), (F.col("kind") == "Word").alias("word"))
    )
    grouped = overlap_groups(spans, "sent_id").groupBy("sent_id", "group").agg(
        F.min_by("gold", F.when(F.col("gold").isNotNull(), F.col("start"))).alias("gold"),
        F.count("gold").alias("n_gold"),
        F.count_if("word").alias("n_words"),
        F.min_by("reading", F.when(F.col("word"), F.col("start"))).alias("reading"),
    )
    status = F.when(F.col("n_gold") == 0, "no gold").when(F.col("n_words") == 1, "scored").otherwise("unalignable")
    return grouped.withColumn("status", status)


def tallies(groups: DataFrame) -> DataFrame:
    """A row of counts for each sentence."""
    scored = F.col("status") == "scored"
    right = scored & (F.col("reading.tag") == F.col("gold"))
    committed = scored & F.col("reading.confidence").isin("Sure", "Likely")
    columns = [F.count_if(scored).alias("tokens"), F.count_if(right).alias("right"), F.count_if(committed).alias("committed"), F.count_if(committed & right).alias("committed_right")]
    columns.append(F.count_if(scored & F.array_contains("reading.kept", F.col("gold"))).alias("retained"))
    for level in LEVELS:
        at = scored & (F.col("reading.confidence") == level)
        columns += [F.count_if(at).alias(level.lower()), F.count_if(at & right).alias(f"{level.lower()}_right")]
    columns += [F.sum("n_gold").alias("tagged"), F.sum(F.when(F.col("status") == "unalignable", F.col("n_gold")).otherwise(0)).alias("unalignable")]
    rows = groups.groupBy("sent_id").agg(*columns)
    return rows.withColumns({"sentences": (F.col("tokens") > 0).cast("long"), "clean": ((F.col("tokens") > 0) & (F.col("committed") == F.col("committed_right"))).cast("long")})


def summed(rows: DataFrame) -> DataFrame:
    """Shares over all sentences, null without a denominator."""
    share = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return rows.agg(
        share("right", "tokens").alias("accuracy"),
        share("committed", "tokens").alias("commitment"),
        share("committed_right", "committed").alias("precision"),
        share("retained", "tokens").alias("retention"),
        share("clean", "sentences").alias("clean"),
        share("unalignable", "tagged").alias("unalignable"),
    )
