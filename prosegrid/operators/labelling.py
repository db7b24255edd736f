"""The flow of labels: draws, capacities, gold, audits, exemptions that came in, runs compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions import draws, stats
from prosegrid.sources.tables import numbered


def order_key(seed: str, key: Column) -> Column:
    """Where a row stands in a shuffle: the same for a seed and key on every run, whatever the partitions."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def drawn(rows: DataFrame, seed: str, key: str, most: int) -> DataFrame:
    """An audit's draw: the first rows of the seed's shuffle."""
    return rows.orderBy(order_key(seed, F.col(key)), key).limit(most)


def capacity(rows: DataFrame, strata: list[str], caps: list[tuple[str, int]]) -> DataFrame:
    """strata and capacity: how many rows of a cell its caps let through at most, each group of a cap giving no more than it may.

    Caps apply from the narrowest group to the widest, and each is a bound on the sum before it.
    """
    counted = rows.groupBy(*strata, *(g for g, _ in caps)).agg(F.count("*").alias("capacity"))
    groups = [g for g, _ in caps]
    for n, (_, most) in enumerate(caps):
        counted = counted.withColumn("capacity", F.least("capacity", F.lit(most))).groupBy(*strata, *groups[n + 1 :]).agg(F.sum("capacity").alias("capacity"))
    return counted


def unsure_first(sentences: DataFrame, points: str, words: str, key: str, most: int) -> DataFrame:
    """Adds score, points over words and four; the least sure sentences first, ties by key."""
    return sentences.withColumn("score", F.col(points) / (F.col(words) + 4)).orderBy(F.desc("score"), key).limit(most)


def assembled(agreed: DataFrame, adjudicated: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys, tag and source: an adjudicated answer where there is one, else what the voters agreed on; rows with neither are open."""
    met = agreed.select(*keys, F.col(tag).alias("_agreed")).join(adjudicated.select(*keys, F.col(tag).alias("_adjudicated")), keys, "full_outer")
    source = F.when(F.col("_adjudicated").isNotNull(), "adjudicated").when(F.col("_agreed").isNotNull(), "agreed").otherwise("open")
    return met.select(*keys, F.coalesce("_adjudicated", "_agreed").alias(tag), source.alias("source"))


def accuracy_table(rows: DataFrame, voter: str, split: str, right: Column) -> DataFrame:
    """voter, split, words, right and share for each split, and for all of them together."""
    counted = rows.withColumn("_right", right.cast("int")).groupingSets([[voter, split], [voter]], voter, split)
    found = counted.agg(F.count("*").alias("words"), F.sum("_right").alias("right"), F.grouping(split).alias("_all"))
    return found.select(voter, F.when(F.col("_all") == 1, "all").otherwise(F.col(split)).alias("split"), "words", "right", F.try_divide("right", "words").alias("share"))


def must_pass(rows: DataFrame, agree: Column, right: Column, sure: Column) -> DataFrame:
    """Adds listed (voters agree, and they are right and sure) and miss: what else an agreed row lacks."""
    listed = agree & right & sure
    miss = F.when(agree & ~right & sure, "sure and wrong").when(agree & ~right, "wrong").when(agree & ~sure, "not sure").when(~agree, "disputed")
    return rows.select("*", F.coalesce(listed, F.lit(False)).alias("listed"), miss.alias("miss"))


def audit(rows: DataFrame, group: str, agrees: Column, bar: float, least: int) -> DataFrame:
    """group, n, agreed and verdict against a bar; a group of too few rows is not judged."""
    found = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(agrees.cast("int")).alias("agreed"))
    verdict = F.when(F.col("n") < least, "not judged").when(F.col("agreed") >= bar * F.col("n"), "pass").otherwise("fail")
    return found.withColumn("verdict", verdict)


def cost_table(rows: DataFrame, model: str, sums: list[str]) -> DataFrame:
    """model, calls and the sum of each measure."""
    return rows.groupBy(model).agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in sums))


def added_entries(entries: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that the base doesn't have, null keys being equal."""
    old = base.select(*(F.col(k).alias(f"_base_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_base_{k}"))
    return entries.join(old, same, "left_anti")


def zipped(a: DataFrame, b: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """key, pairs, same and unmatched: two sequences of a key joined place by place."""
    met = a.select(key, pos, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, pos, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), [key, pos], "full_outer")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return met.groupBy(key).agg(F.count_if(both).alias("pairs"), F.count_if(both & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"), F.count_if(~both).alias("unmatched"))


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Inner spans (start, end) that lie within some outer span of their key."""
    spans = outer.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return inner.join(spans, (F.col(key) == F.col("_key")) & (F.col("start") >= F.col("_start")) & (F.col("end") <= F.col("_end")), "left_semi")


def compared_ranges(oracle: DataFrame, scanner: DataFrame, key: str) -> DataFrame:
    """key, start, end, bucket of two scanners' ranges (start, end, kind): equal, kind differs, overlap, missing or extra.

    Ranges of one place settle first; what is left meets by overlap within its key.
    """
    on = [key, "start", "end"]
    a, b = oracle.select(*on, F.col("kind").alias("_a")).distinct(), scanner.select(*on, F.col("kind").alias("_b")).distinct()
    met = a.join(b, on, "full_outer")
    placed = met.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(*on, F.when(F.col("_a") == F.col("_b"), "equal").otherwise("kind differs").alias("bucket"))
    lone = {side: met.where(F.col(other).isNull()).select(*on) for side, other in (("_a", "_b"), ("_b", "_a"))}

    def touching(rows: DataFrame, others: DataFrame, alone: str) -> DataFrame:
        spans = others.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end")).withColumn("_hit", F.lit(True))
        joined = rows.join(spans, (F.col(key) == F.col("_key")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left")
        return joined.groupBy(*on).agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_hit")).select(*on, F.when(F.col("_hit"), "overlap").otherwise(alone).alias("bucket"))

    return placed.unionByName(touching(lone["_a"], lone["_b"], "missing")).unionByName(touching(lone["_b"], lone["_a"], "extra"))


def marked_by(rows: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Adds marks: the names of the patterns (name, regular expression), a list of bounded length, that the text has."""
    hits = F.array(*(F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in patterns))
    return rows.withColumn("marks", F.array_sort(F.array_distinct(F.array_compact(hits))))


def share_intervals(tallies: DataFrame, group: str, unit: str) -> DataFrame:
    """group, share, low and high: right over n of all units of a group, and the middle 95 % over draws of units.

    tallies: group, unit (a sentence), n, right. A group's draws are those of the seed that its name
    makes, its units numbered by name; draws without any row are dropped.
    """
    return _replicates(tallies, group, unit, {"share": ("right", "n")})


def paired_difference(tallies: DataFrame, group: str, unit: str) -> DataFrame:
    """group, before, after, low, high and verdict: the difference of two runs over the same units, draw by draw.

    tallies: group, unit, n, before, after. better or worse where the interval leaves zero out.
    """
    found = _replicates(tallies, group, unit, {"before": ("before", "n"), "after": ("after", "n")})
    verdict = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("same")
    return found.withColumn("verdict", verdict)


def unpaired_difference(tallies: DataFrame, group: str, unit: str, first: str, second: str) -> DataFrame:
    """before, after, low, high and verdict: the share of the second group less that of the first, each drawn by itself.

    tallies: group, unit, n, right. Draws are paired by number.
    """
    both = tallies.where(F.col(group).isin(first, second))
    drawn = _drawn(both, group, unit, ["n", "right"]).withColumn("share", F.try_divide("right", "n"))
    of = lambda name, c: F.max(F.when(F.col(group) == name, F.col(c)))
    pairs = drawn.groupBy("replicate").agg((of(second, "share") - of(first, "share")).alias("gap")).where("gap is not null")
    sums = lambda name, c: F.sum(F.when(F.col(group) == name, F.col(c)))
    whole = both.agg(F.try_divide(sums(first, "right"), sums(first, "n")).alias("before"), F.try_divide(sums(second, "right"), sums(second, "n")).alias("after"))
    interval = pairs.agg(stats.percentile("gap", 0.025).alias("low"), stats.percentile("gap", 0.975).alias("high"))
    # One row each.
    verdict = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("same")
    return whole.withColumn("_", F.lit(1)).join(interval.withColumn("_", F.lit(1)), "_").drop("_").withColumn("verdict", verdict)


def _drawn(tallies: DataFrame, group: str, unit: str, columns: list[str]) -> DataFrame:
    """group, replicate and the columns, summed over a replicate's draws of the group's units. Groups are few; their units need not be."""
    spark = tallies.sparkSession
    listed = numbered(tallies.where(F.col(group).isNotNull()).select(group, unit, *columns), [group, unit], "units")
    sizes = listed.groupBy(group).agg(F.min("number").alias("first"), F.count("*").alias("n")).collect()
    drawn = spark.createDataFrame([], "at long, replicate int, times long")
    for row in sizes:
        one = draws.resampled(spark, {0: row.n}, draws.SEED ^ draws.fnv1a64(str(row[group])))
        drawn = drawn.unionByName(one.select((F.col("unit") + row["first"]).alias("at"), "replicate", F.col("n").alias("times")))
    met = drawn.join(listed.withColumnRenamed("number", "at"), "at")
    return met.groupBy(group, "replicate").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in columns))


def _replicates(tallies: DataFrame, group: str, unit: str, shares: dict[str, tuple[str, str]]) -> DataFrame:
    """Each share over all units, and the interval of the last minus the first, or of the only one, over draws."""
    columns = sorted({c for pair in shares.values() for c in pair})
    of = {name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in shares.items()}
    first, *rest = of.values()
    ratio = rest[-1] - first if rest else first
    summed = _drawn(tallies, group, unit, columns)
    interval = summed.select(group, ratio.alias("ratio")).where("ratio is not null").groupBy(group).agg(stats.percentile("ratio", 0.025).alias("low"), stats.percentile("ratio", 0.975).alias("high"))
    whole = tallies.groupBy(group).agg(*(F.sum(c).alias(c) for c in columns)).select(group, *(c.alias(name) for name, c in of.items()))
    return whole.join(interval, group, "left")
