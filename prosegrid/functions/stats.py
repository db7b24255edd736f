"""Rates, ratios and intervals over repositories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 1000


def per_million(occurrences: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, occurrences * 1e6 / tokens).otherwise(F.lit(0.0))


def smoothing(reference_tokens: Column) -> Column:
    """Half an occurrence per million tokens of the reference side, as a rate."""
    return F.when(reference_tokens > 0, 0.5e6 / reference_tokens).otherwise(F.lit(0.0))


def ratio(focus: Column, reference: Column, smooth: Column) -> Column:
    return (focus + smooth) / (reference + smooth)


def percentile(column: str, fraction: float) -> Column:
    """Nearest rank: the smallest value that a share of fraction is at or below."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {column})")


def repo_rates(hits: DataFrame, repos: DataFrame, item: str) -> DataFrame:
    """item, side, occurrences and the mean over all repositories of a side of their per-million rates.

    hits: item, side, repo, n. repos: side, repo, tokens. Repositories without hits count as 0.
    """
    sides = repos.groupBy("side").agg(F.count("*").alias("n_repos"))
    rates = hits.groupBy(item, "side", "repo").agg(F.sum("n").alias("n")).join(repos, ["side", "repo"])
    rates = rates.withColumn("rate", per_million(F.col("n"), F.col("tokens")))
    summed = rates.groupBy(item, "side").agg(F.sum("n").alias("occurrences"), F.count("*").alias("repos"), F.sum("rate").alias("summed"))
    return summed.join(F.broadcast(sides), "side").select(item, "side", "occurrences", "repos", (F.col("summed") / F.col("n_repos")).alias("rate"))


def draw_weight(draw: Column, *keys: Column) -> Column:
    """How often a repository is in a draw: a Poisson number of mean one from a hash of its keys, the same on every run.

    Numbers above seven, one in 100,000, count as seven.
    """
    at = F.pmod(F.xxhash64(*keys, draw), F.lit(1 << 40)) / float(1 << 40)
    weight, below, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 8):
        below, term = below + term, term / k
        weight = F.when(at >= below, k).otherwise(weight)
    return weight


def bootstrap_ratio(rates: DataFrame, repos: DataFrame, smooth: float, seed: int = 1) -> DataFrame:
    """item, low and high: the middle 95 % of the smoothed ratio over REPLICATES draws of repositories.

    rates: item, side (0 focus, 1 reference), repo, rate; only repositories with hits. repos: side,
    repo, all of them. Each repository's weight in a draw comes from a hash, so every item sees the
    same draws, nothing is drawn ahead, and sums add up by partition. A draw's mean is over the
    weights it has.
    """
    draws = F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("draw")
    weight = draw_weight(F.col("draw"), F.lit(seed), F.col("side"), F.col("repo"))
    sizes = repos.select("side", "repo", draws).groupBy("side", "draw").agg(F.sum(weight).alias("size"))
    summed = rates.select("item", "side", "repo", "rate", draws).groupBy("item", "draw", "side").agg(F.sum(F.col("rate") * weight).alias("sum"))
    means = summed.join(F.broadcast(sizes), ["side", "draw"]).select("item", "draw", "side", F.try_divide("sum", "size").alias("mean"))
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("mean"))), F.lit(0.0))
    both = means.groupBy("item", "draw").agg(((of(0) + smooth) / (of(1) + smooth)).alias("ratio"))
    return both.groupBy("item").agg(percentile("ratio", 0.025).alias("low"), percentile("ratio", 0.975).alias("high"))
