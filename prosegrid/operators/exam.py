"""Grading of labels against gold: tallies, metrics, confusion, calibration, gates, voters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a range of scores over which sums run one by one.
STEPS = 1000


def confusion(rows: DataFrame, gold: str, guess: str, values: list) -> DataFrame:
    """A row for each gold value and a column for each guess."""
    return rows.groupBy(gold).pivot(guess, values).count().na.fill(0)


def metrics(rows: DataFrame, right: Column, committed: Column, strata: list[str]) -> DataFrame:
    """stratum, value, and the shares right, committed, and right of the committed, over all rows and by stratum; null without rows."""
    rows = rows.withColumns({"_right": right.cast("int"), "_committed": committed.cast("int")})
    counted = lambda r: r.agg(F.count("*").alias("n"), F.sum("_right").alias("right"), F.sum("_committed").alias("committed"), F.sum(F.col("_right") * F.col("_committed")).alias("both"))
    found = counted(rows.groupBy()).select(F.lit("all").alias("stratum"), F.lit("").alias("value"), "*")
    for s in strata:
        found = found.unionByName(counted(rows.groupBy(F.col(s).cast("string").alias("value"))).select(F.lit(s).alias("stratum"), "*"))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return found.select("stratum", "value", "n", share("right", "n").alias("accuracy"), share("committed", "n").alias("commitment"), share("both", "committed").alias("precision"))


def calibration(rows: DataFrame, score: str, right: str, bins: int = 10) -> DataFrame:
    """bin, n, right, mean score; a score within a millionth below an edge belongs above it."""
    bin_ = F.least(F.floor(F.col(score) * bins + 1e-6), F.lit(bins - 1))
    return rows.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.avg(score).alias("mean_score"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Mean distance of accuracy and score, weighted by rows."""
    return bins.agg((F.sum(F.abs(F.col("right") - F.col("mean_score") * F.col("n"))) / F.sum("n")).alias("error"))


def gates(tallies: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """name, n, d, verdict: n * 1000 >= floor * d in integers; too few rows are not judged.

    tallies: name, n, d. gate_rows: name, floor (per mille), least.
    """
    verdict = F.when(F.coalesce("d", F.lit(0)) < F.col("least"), "not judged").when(F.col("n") * 1000 >= F.col("floor") * F.col("d"), "pass").otherwise("fail")
    return gate_rows.join(tallies, "name", "left").select("name", "n", "d", verdict.alias("verdict"))


def most_common(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """key and its most frequent tag, ties by tag order."""
    counts = rows.groupBy(key, tag).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), tag)))
    return ranked.where("_rank = 1").select(key, tag, "n")


def agreement(answers: DataFrame, voters: list[str], strata: str) -> DataFrame:
    """stratum, a, b, words, agreed for each pair of voters; an abstention (null) leaves a word out of the pair."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(voters) for b in voters[i + 1 :]))
    rows = answers.select(F.col(strata).alias("stratum"), F.explode(pairs).alias("p")).where("p.x is not null and p.y is not null")
    return rows.groupBy("stratum", "p.a", "p.b").agg(F.count("*").alias("words"), F.count_if(F.col("p.x") == F.col("p.y")).alias("agreed"))


def merged(answers: DataFrame, voters: list[str]) -> DataFrame:
    """Adds base and status: agreed where all that answer give one base, else disputed; abstained where none answers."""
    given = F.array_distinct(F.array_compact(F.array(*voters)))
    status = F.when(F.size(given) == 0, "abstained").when(F.size(given) == 1, "agreed").otherwise("disputed")
    return answers.withColumn("status", status).withColumn("base", F.when(F.col("status") == "agreed", F.get(given, F.lit(0))))


def wilson(right: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share; null without rows."""
    p = F.try_divide(right, n)
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (centre - margin) / scale), F.when(n > 0, (centre + margin) / scale)


def cutoff(rows: DataFrame, score: str, right: str, floor: float) -> DataFrame:
    """The lowest score down to which the share right is at least the floor, and the rows at or above it.

    Rows are counted by score first, and scores by STEPS equal parts of their range; sums run over
    the parts, and within each part over its scores.
    """
    by = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(right).alias("right"))
    ends = by.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    part = F.coalesce(F.floor(F.try_divide(F.col(score) - F.col("_low"), F.col("_high") - F.col("_low")) * STEPS), F.lit(0))
    parted = by.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("_low", "_high")
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # STEPS + 1 rows at most
    bases = parted.groupBy("_part").agg(F.sum("n").alias("_pn"), F.sum("right").alias("_pr"))
    bases = bases.select("_part", F.coalesce(F.sum("_pn").over(above), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_pr").over(above), F.lit(0)).alias("_br"))
    down = Window.partitionBy("_part").orderBy(F.desc(score))
    run = parted.join(F.broadcast(bases), "_part").withColumns({"_n": F.col("_bn") + F.sum("n").over(down), "_right": F.col("_br") + F.sum("right").over(down)})
    return run.where(F.col("_right") >= floor * F.col("_n")).orderBy(F.col(score)).limit(1).select(F.col(score).alias("cutoff"), F.col("_n").alias("n"), F.col("_right").alias("right"))


def paired(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many keys both runs have, one alone has, and which way values changed."""
    met = before.select(key, F.col(value).alias("_a")).join(after.select(key, F.col(value).alias("_b")), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return met.agg(F.count_if(both).alias("both"), F.count_if(~both).alias("alone"), F.count_if(both & (F.col("_b") > F.col("_a"))).alias("up"), F.count_if(both & (F.col("_b") < F.col("_a"))).alias("down"))


def largest_confusions(rows: DataFrame, gold: str, guess: str, most: int) -> DataFrame:
    wrong = rows.where(F.col(gold) != F.col(guess)).groupBy(gold, guess).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), gold, guess).limit(most)
