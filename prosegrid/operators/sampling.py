"""Samples that are the same on every run: caps, deals, splits, apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.sources.tables import running, stored


def hash_split(key: Column, parts: int = 10, chosen: int = 0) -> Column:
    """Whether the first byte of the key's digest falls to the chosen part."""
    return F.pmod(F.conv(F.substring(F.sha2(F.lower(key), 256), 1, 2), 16, 10).cast("int"), F.lit(parts)) == chosen


def capped(rows: DataFrame, group: Column, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, at most so many; rank says which."""
    ranked = rows.withColumn("_group", group).withColumn("rank", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
    return ranked.where(F.col("rank") <= most).drop("_group")


def dealt(rows: DataFrame, strata: list[str], order: list[str], parts: int) -> DataFrame:
    """Adds part: each stratum is dealt in turn."""
    return rows.withColumn("part", F.pmod(F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1, F.lit(parts)))


def deduplicated(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row for each text that is equal but for case and white space, the first by order."""
    normal = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    least = rows.groupBy(F.sha2(normal, 256).alias("_key")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return rows.join(least.select(order, "copies"), order)


def apportioned(weights: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """key and seats by largest remainder, ties to the smaller key. weights has one row for each key, few of them."""
    total = weights.agg(F.sum(weight).alias("_total"))
    exact = weights.crossJoin(F.broadcast(total)).withColumn("_whole", F.floor(F.col(weight) * seats / F.col("_total")))
    rest = exact.withColumn("_rest", F.col(weight) * seats - F.col("_whole") * F.col("_total"))
    ranked = rest.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_rest"), key)))
    left = F.lit(seats) - F.sum("_whole").over(Window.partitionBy())
    return ranked.withColumn("_left", left).select(key, (F.col("_whole") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).alias("seats"))


def interleaved(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds turn: the first of every group comes before the second of any."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def history_label(commits: DataFrame, key: str, agent: Column) -> DataFrame:
    """key and label: human without commits by agents, llm with nothing else, mixed with both; unknown without commits that tell."""
    told = commits.withColumn("_agent", agent.cast("int")).groupBy(key).agg(F.count("_agent").alias("n"), F.sum("_agent").alias("by_agents"))
    label = F.when(F.col("n") == 0, "unknown").when(F.col("by_agents") == 0, "human").when(F.col("by_agents") == F.col("n"), "llm").otherwise("mixed")
    return told.select(key, label.alias("label"))


def stratified(rows: DataFrame, stratum: str, quotas: dict[str, int], caps: list[tuple[str, int]], order: Column) -> DataFrame:
    """Rows by order within quotas of strata, after at most so many of each group; order must tell rows apart.

    Caps apply one after another, each to what the one before left, so the result is the same on
    every run and needs no driver loop.
    """
    rows = rows.withColumn("_order", order)
    for group, most in caps:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum, group).orderBy("_order"))).where(F.col("_n") <= most)
    quota = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    drawn = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_order")))
    return drawn.where(F.col("_n") <= quota[F.col(stratum)]).drop("_n", "_order")


def quota_draw(rows: DataFrame, caps: dict[str, int | dict[str, int]], order: list[str]) -> DataFrame:
    """The rows that a walk in the order takes, one after another, where a row is taken if none of its groups is full.

    caps: for each grouping column, how many rows each of its groups takes, or how many each named one
    takes, others none. order must tell rows apart.

    Instead of a walk, rounds decide all rows at once that can be: a row goes where a group has as many
    taken rows before it as it may, and is taken where even all undecided rows before it would leave room
    in each group. The first undecided row is always decided. Counts before a row are sums over ranges,
    so a group may be of any size.
    """
    names = [c for c in rows.columns]
    cap = lambda group: F.lit(caps[group]) if isinstance(caps[group], int) else F.coalesce(F.create_map(*(F.lit(x) for pair in caps[group].items() for x in pair))[F.col(group)], F.lit(0))
    open_ = F.lit(True)
    for group in caps:
        open_ = open_ & (cap(group) > 0)
    state = stored(rows.where(open_).withColumn("_taken", F.lit(0)), "draw")
    while True:
        goes, fits = F.lit(False), F.lit(True)
        counted = state
        for n, group in enumerate(caps):
            sums = {f"_t{n}": F.col("_taken").cast("long"), f"_u{n}": (1 - F.col("_taken")).cast("long")}
            counted = running(counted, group, order, sums, "counts")
            goes = goes | (F.col(f"_t{n}") >= cap(group))
            fits = fits & (F.col(f"_t{n}") + F.col(f"_u{n}") < cap(group))
        decided = counted.where((F.col("_taken") == 1) | ~goes).withColumn("_open", (F.col("_taken") == 0) & ~fits)
        state = stored(decided.select(*names, F.when(F.col("_open"), 0).otherwise(1).alias("_taken")), "draw")
        if state.where("_taken = 0").isEmpty():
            return state.select(names)
