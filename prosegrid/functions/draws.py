"""Exact draws of a seeded generator, anywhere in its sequence.

The generator is xorshift64*: its state is a vector of 64 bits, and a step is a linear map over GF(2). A
power of that map's matrix leaps over any number of draws, so a partition begins at its own draw, and no
draw is made ahead of it or on the driver. Within a batch, lanes that begin a fixed leap apart step
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.functions import stats
from prosegrid.sources.tables import numbered

# The generator, the hash of labels, the seed and the number of draws.
MULTIPLIER = 0x2545F4914F6CDD1D
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SEED = 0x9E3779B97F4A7C15
REPLICATES = 1000
# End of the fixed values.
MASK = (1 << 64) - 1


def fnv1a64(text: str) -> int:
    found = FNV_START
    for byte in text.encode():
        found = (found ^ byte) * FNV_PRIME & MASK
    return found


def stepped(states: np.ndarray) -> np.ndarray:
    """The next state of each generator."""
    states = states ^ states >> np.uint64(12)
    states = states ^ states << np.uint64(25)
    return states ^ states >> np.uint64(27)


def times(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), as where it takes each bit, applied to states."""
    found = np.zeros_like(states)
    for bit in range(64):
        found ^= np.where(states >> np.uint64(bit) & np.uint64(1), columns[bit], np.uint64(0))
    return found


def step_powers() -> list[np.ndarray]:
    """The step's matrix and its squares: 1, 2, 4, ... steps at once."""
    found = [stepped(np.uint64(1) << np.arange(64, dtype=np.uint64))]
    while len(found) < 64:
        found.append(times(found[-1], found[-1]))
    return found


POWERS = step_powers()


def leapt(state: int, steps: int) -> int:
    """The state after so many steps."""
    found = np.array([state], np.uint64)
    for bit in range(steps.bit_length()):
        if steps >> bit & 1:
            found = times(POWERS[bit], found)
    return int(found[0])


def draws_from(seed: int, first: int, n: int, lanes: int = 256) -> np.ndarray:
    """The draws numbered first to first + n - 1 of a seed's sequence."""
    width = max(1, -(-n // lanes))
    states = np.empty(lanes, np.uint64)
    states[0] = leapt(max(seed, 1), first)
    # Lane k begins k widths on: the first lane by a leap, then twice as many at once.
    leap = np.array([leapt(1 << bit, width) for bit in range(64)], np.uint64)
    filled = 1
    while filled < lanes:
        more = min(filled, lanes - filled)
        states[filled : filled + more] = times(leap, states[:more])
        leap, filled = times(leap, leap), filled + more
    out = np.empty((width, lanes), np.uint64)
    for k in range(width):
        states = stepped(states)
        out[k] = states * np.uint64(MULTIPLIER)
    return out.T.ravel()[:n]


def sequence(spark: SparkSession, seed: int, first: int, n: int) -> DataFrame:
    """i (from first) and bits, the i-th draw of the seed's sequence, as a long of the same 64 bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("id").to_numpy()
            if len(numbers):
                values = draws_from(seed, int(numbers[0]), len(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(values.view(np.int64))], ["i", "bits"])

    return spark.range(first, first + n).mapInArrow(task, "i long, bits long")


def below(bits: Column, bound: Column | int) -> Column:
    """The draw, unsigned, modulo a bound under 2**31."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    high, low = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(0xFFFFFFFF)
    return ((high % bound) * (F.lit(1 << 32) % bound) + low) % bound


def resampled(spark: SparkSession, sides: dict[int, int], seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """side, replicate, unit and n: how often each replicate draws each of a side's units, with replacement.

    sides: each side's number of units; they draw one after another from one sequence.
    """
    found, first = None, 0
    for side, units in sides.items():
        if not units:
            continue
        drawn = sequence(spark, seed, first, units * replicates)
        rows = drawn.select(F.lit(side).alias("side"), F.floor((F.col("i") - first) / units).cast("int").alias("replicate"), below(F.col("bits"), units).alias("unit"))
        found = rows if found is None else found.unionByName(rows)
        first += units * replicates
    if found is None:
        return spark.createDataFrame([], "side int, replicate int, unit long, n long")
    return found.groupBy("side", "replicate", "unit").agg(F.count("*").alias("n"))


def bootstrap_ratio(rates: DataFrame, repos: DataFrame, smooth: float, seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """item, low and high: the middle 95 % of the smoothed ratio over exact draws of repositories.

    rates: item, side (0 focus, 1 reference), repo, rate. repos: side, repo, all of them; a side's
    repositories are numbered by name. Replicates without a hit on a side have a rate of zero there.
    """
    spark = rates.sparkSession
    listed = numbered(repos.select("side", "repo").distinct(), ["side", "repo"], "repos")
    sizes = {r.side: (r.first, r.n) for r in listed.groupBy("side").agg(F.min("number").alias("first"), F.count("*").alias("n")).collect()}
    first = F.coalesce(*(F.when(F.col("side") == side, F.lit(at)) for side, (at, _) in sizes.items()), F.lit(0))
    drawn = resampled(spark, {side: sizes[side][1] for side in (0, 1) if side in sizes}, seed, replicates)
    known = rates.join(listed.withColumn("unit", F.col("number") - first).select("side", "repo", "unit"), ["side", "repo"])
    size = F.coalesce(*(F.when(F.col("side") == side, F.lit(n)) for side, (_, n) in sizes.items()))
    summed = known.join(drawn, ["side", "unit"]).groupBy("item", "replicate", "side").agg((F.sum(F.col("rate") * F.col("n")) / F.first(size)).alias("mean"))
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("mean"))), F.lit(0.0))
    both = summed.groupBy("item", "replicate").agg(((of(0) + smooth) / (of(1) + smooth)).alias("ratio"))
    every = rates.select("item").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    whole = every.join(both, ["item", "replicate"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return whole.groupBy("item").agg(stats.percentile("ratio", 0.025).alias("low"), stats.percentile("ratio", 0.975).alias("high"))
