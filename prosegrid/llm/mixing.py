"""Mixing sources to target weights with Spark expressions only.

Sources share a budget of words by weight; no source gets more than ``cap`` times its size, and what
the weights would give it beyond that is shared again by weight among the others. A source's target is
spent in whole epochs over all its documents first. What is left goes by weighted sampling without
replacement after Efraimidis and Spirakis: a document's key is an exponential draw divided by its
quality weight, a source's documents are sorted by key, and the words before each document, a prefix
sum, say whether it still fits. The document at the border gives its first words only, so a source's
taken words are its target, rounded.

Draws come from a hash of seed, doc_id and text, so reruns agree. Prefix sums are global: rows are laid
out in ranges of their order, ranges are summed up, and a row adds what lies before its range to what
lies before it in its range; so a hot source is as many ranges as it needs, and no source is one task.
Sources are ranked and filled in the same way, whatever their number.

Defined results: a null text has no words, and no words are taken of it; a null source is a source of
its own, the last; rows that repeat a doc_id are documents of their own, and of rows that agree in all
that counts, which one is cut is open; a quality weight that is null, not finite or not positive puts a
document after all others; an empty table, or one without words, takes nothing; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Marks that prose has few of.
ODD_MARKS = "0123456789#$%&*+/<=>@[]^_`{|}~\\"
#: Sources whose targets are broadcast, some 30 MB of rows; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 200_000
PART = "_range"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plainness(text: Column) -> Column:
    """A quality weight in (0, 1]: the share of characters that prose is made of, squared."""
    share = (1 + F.char_length(F.translate(text, ODD_MARKS, ""))) / (1 + F.char_length(text))
    return F.coalesce(share * share, F.lit(1.0))


def uniform(seed: int, *parts: Column) -> Column:
    """A number between 0 and 1, never either, from a hash of the parts."""
    digest = F.md5(F.concat(F.lit(str(seed)), *(F.concat(F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def running(frame: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """The frame with, for each sum's name, the sum over all rows before a row in a global order."""
    laid = written(frame.sparkSession, frame.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name)
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(PART).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    starts = totals.select(F.col(PART).alias(f"{PART}_at"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{PART}_{n}") for n in sums))
    placed = laid.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()})
    met = placed.join(F.broadcast(starts), F.col(PART) == F.col(f"{PART}_at"))
    return met.withColumns({n: F.col(n) + F.col(f"{PART}_{n}") for n in sums}).drop(PART, f"{PART}_at", *(f"{PART}_{n}" for n in sums))


def targets(sources: DataFrame, cycle: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size) rows with start, the words of all sources before it, and target.

    Sources weigh as the cycle says, in order of code points, null last.
    """
    spark = sources.sparkSession
    listed = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1), "start": F.col("source_size")}, "sources")
    weights = F.array(*(F.lit(w).cast("long") for w in cycle))
    weighed = listed.withColumn("weight", F.get(weights, (F.col("rank") % len(cycle)).cast("int"))).drop("rank")
    # In order of size by weight, those that their caps stop come first.
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    filled = written(spark, running(weighed, order, {"smaller": F.col("source_size"), "lighter": F.col("weight")}, "weights"), "filling")
    all_words, all_weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (all_words or 0)
    size, weight = F.col("source_size"), F.col("weight")
    capped = filled.withColumn("capped", cap * (size * (F.lit(all_weight) - F.col("lighter")) + F.col("smaller") * weight) <= budget * weight)
    stopped, left = capped.agg(F.sum(F.when(F.col("capped"), size)), F.sum(F.when(~F.col("capped"), weight))).first()
    rate = (budget - cap * (stopped or 0)) / left if left else 0.0
    return capped.select("source", "source_size", "start", F.when(F.col("capped"), cap * size).otherwise(rate * weight).alias("target"))


def mix(docs: DataFrame, cycle: Sequence[int], share: float, cap: float, quality: Column | None = None, seed: int = 42) -> DataFrame:
    """doc_id, source, text_md5, size, source_size, target, epochs (whole ones), cut (words of one more) and taken."""
    spark = docs.sparkSession
    text = F.col("text")
    weight = plainness(text) if quality is None else quality
    sure = (weight > 0) & (weight < float("inf"))
    drawn = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.md5(text).alias("text_md5"),
        n_words(text).alias("size"),
        F.when(sure, -F.log(uniform(seed, F.col("doc_id"), text)) / weight).otherwise(float("inf")).alias("key"),
    )
    sized = written(spark, drawn, "sized")
    sources = written(spark, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, cap), "targets")
    few = sources.count() <= MAX_BROADCAST_SOURCES
    # Rows alike in all else are told apart, so that any number of them is as many ranges as it needs.
    salted = sized.withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("source").asc_nulls_last(), *map(F.col, ("key", "doc_id", "size", "salt"))]
    placed = running(salted, order, {"before": F.col("size")}, "sorted").withColumnRenamed("source", "_source")
    met = placed.join(F.broadcast(sources) if few else sources, F.col("_source").eqNullSafe(F.col("source")))
    quota = F.round("target").cast("long")
    met = met.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long"))
    rest = quota - F.col("epochs") * F.col("source_size")
    met = met.withColumn("cut", F.greatest(F.lit(0), F.least("size", rest - (F.col("before") - F.col("start")))).cast("long"))
    return met.select("doc_id", "source", "text_md5", "size", "source_size", "target", "epochs", "cut", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"))


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: doc_id, source and text, a row for each time that a text is taken; a cut text is its first words, one space apart."""
    key = lambda digest: F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), digest)
    texts = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").dropDuplicates()
    kept = mixed.where("taken > 0").select(key(F.col("text_md5")).alias("at"), F.col("source").alias("of"), "size", "epochs", "cut")
    whole = kept.groupBy("at", "of").agg(F.sum(F.col("epochs") + F.when(F.col("cut") == F.col("size"), 1).otherwise(0)).alias("times"), F.max(F.when(F.col("cut") < F.col("size"), F.col("cut")).otherwise(0)).alias("cut"))
    met = texts.join(whole, (key(F.md5("text")) == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, F.col("cut").cast("int")), " ")
    again = met.where("times > 0").select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    return again.unionAll(met.where("cut > 0").select("doc_id", "source", part.alias("text")))
