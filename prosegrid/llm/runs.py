"""Periodic runs of words: all maximal repetitions of a text, and the text with them collapsed.

A run is a stretch of consecutive words whose smallest period fits into it twice or more and which no
neighbouring word extends at that period. The words of a batch of texts, a mark after each text, become
one array of numbers, ordered by text first, so that nothing is shared across texts and a batch costs
one pass of each step:

1. names of all stretches of 1, 2, 4, ... words by doubling, and from the last the suffix array; two
   positions are compared to the right or to the left by descending through the names;
2. longest common prefixes of neighbours, and from the nearest smaller position before and after each
   suffix the longest previous factor of every position, and where it lies;
3. blocks: the longest previous factor, or one word, from each block's end on;
4. at each block's beginning, Main's extensions: for each period shorter than the block and the one
   before it, how far the words agree with those a period away, to the right and to the left. This
   finds every run that meets a block's border;
5. runs inside of blocks are copies: they are taken from buckets by start, from where the block's words
   were before, block by block.

Steps 1 to 4 are array operations over the batch; step 5 walks only blocks that could hold a run.

Defined results: a null or blank text has no runs and collapses to an empty text; repeated rows have
equal results; an empty table gives an empty result; all other columns are ignored. A text is handled
whole; a text's words, about 8 bytes for each of its names' lengths, must fit a worker's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches

#: Words of texts that are handled at once, about.
WORDS_AT_ONCE = 1 << 17
#: Pairs of positions that are compared at once.
PAIRS_AT_ONCE = 1 << 19
RESULT = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def doubled_names(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 0, 1, ... names of the 2**k symbols at each place, until all differ, and the suffix array.

    Names are in the order of what they name. Every text ends in a symbol of its own; the name after the last is -1.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable").astype(np.int64)
    ranked = keys[order]
    names = np.full(n + 1, -1, np.int32)
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = ranked[1:] != ranked[:-1]
    levels, unsure = [], at
    while True:
        names[order[unsure]] = np.maximum.accumulate(np.where(first, unsure, 0))
        levels.append(names.copy())
        # Those alone under their name are settled.
        alone = first & np.append(first[1:], True)
        unsure = unsure[~alone]
        if not len(unsure):
            return levels, order
        some = order[unsure]
        key = names[some].astype(np.int64) * (n + 1) + names[some + (1 << len(levels) - 1)]
        by = np.argsort(key, kind="stable")
        order[unsure], key = some[by], key[by]
        first = np.ones(len(unsure), bool)
        first[1:] = key[1:] != key[:-1]


def agree_right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal, i < j."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        total += (levels[k][i + total] == levels[k][j + total]).astype(np.int64) << k
    return total


def agree_left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols that end with those at i and at j are equal, i < j."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - total - (1 << k) + 1, j - total - (1 << k) + 1
        total += ((a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
    return total


def nearest_before(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix array the nearest earlier place of a smaller position, and what all between share."""
    to, least = np.arange(len(order)) - 1, common.copy()
    active = np.flatnonzero(least > 0)
    while True:
        active = active[(to[active] >= 0) & (least[active] > 0)]
        active = active[order[to[active]] > order[active]]
        if not len(active):
            return to, least
        over = to[active]
        to[active], least[active] = to[over], np.minimum(least[active], least[over])


def previous_factors(levels: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest factor that also begins at a smaller one, and that one."""
    n = len(order)
    common = np.zeros(n, np.int64)
    first = levels[0]
    pairs = 1 + np.flatnonzero(first[order[1:]] == first[order[:-1]])
    common[pairs] = agree_right(levels, order[pairs - 1], order[pairs])
    before, shared = nearest_before(order, common)
    after, shared_after = (x[::-1] for x in nearest_before(order[::-1], np.append(0, common[:0:-1])))
    shared, shared_after = np.where(before >= 0, shared, 0), np.where(after >= 0, shared_after, 0)
    lengths, sources = np.zeros(n, np.int64), np.zeros(n, np.int64)
    later = shared_after > shared
    lengths[order] = np.where(later, shared_after, shared)
    sources[order] = np.where(later, order[n - 1 - np.maximum(after, 0)], order[before])
    return lengths, sources


def blocks_of(lengths: np.ndarray) -> np.ndarray:
    """Where the blocks begin: each is the longest previous factor, or one symbol."""
    steps, starts, at = np.maximum(lengths, 1).tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return np.array(starts, np.int64)


def border_runs(levels: list[np.ndarray], starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """(start, end, period) of all runs of at least that length that touch the beginning of a block."""
    half = -(-least // 2)
    level = (-(-half // 2)).bit_length() - 1
    if level >= len(levels):
        return np.zeros((0, 3), np.int64)
    # Of what agrees on both sides together, half at least agrees on one.
    name, width = levels[level], 1 << level
    sizes = np.diff(starts, append=n)
    periods = sizes[:-1] + sizes[1:] - 1
    ends = np.cumsum(periods)
    found = []
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        pair = np.arange(low, min(low + PAIRS_AT_ONCE, int(ends[-1])))
        block = np.searchsorted(ends, pair, side="right")
        period = pair - (ends[block] - periods[block]) + 1
        border = starts[block + 1]
        for i, j, inside in ((border, border + period, border + period <= n), (border - period, border, border >= period)):
            i, j = i[inside], j[inside]
            left = i - width
            likely = (name[i] == name[j]) | (left >= 0) & (name[np.maximum(left, 0)] == name[np.maximum(j - width, 0)])
            i, j = i[likely], j[likely]
            right, left = agree_right(levels, i, j), agree_left(levels, i - 1, j - 1)
            run = (right + left >= j - i) & (right + left + j - i >= least)
            found.append(np.stack([i - left, j + right, j - i], axis=1)[run])
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # The smallest period of a stretch comes first.
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def all_runs(keys: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least that length, by start, end and period.

    keys: symbols of texts, ordered by text, each text followed by a symbol of its own.
    """
    if not len(keys):
        return []
    levels, order = doubled_names(keys)
    lengths, sources = previous_factors(levels, order)
    starts = blocks_of(lengths)
    by_start: dict[int, list[tuple[int, int, int]]] = {}
    for run in border_runs(levels, starts, len(keys), least).tolist():
        by_start.setdefault(run[0], []).append(tuple(run))
    if by_start:
        for block in starts[lengths[starts] >= least + 2].tolist():
            source, size = int(sources[block]), int(lengths[block])
            for at in range(source + 1, source + size - least):
                for _, end, period in by_start.get(at, ()):
                    if end < source + size:
                        by_start.setdefault(at + block - source, []).append((at + block - source, end + block - source, period))
    return sorted(run for runs in by_start.values() for run in runs)


def runs_of(texts: list[list[bytes]], least: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text, as words, its runs as (start, length, period), and the words that its runs leave, one space apart."""
    numbers: dict[bytes, int] = {}
    symbols = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words)) for words in texts]
    keys = np.concatenate([np.append(s, 0) + (k << 32) for k, s in enumerate(symbols)] or [np.zeros(0, np.int64)])
    begins = np.cumsum([0, *(len(s) + 1 for s in symbols)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in all_runs(keys, least):
        text = int(np.searchsorted(begins, start, side="right")) - 1
        found[text].append((start - int(begins[text]), end - start, period))
    collapsed = []
    for words, runs in zip(texts, found):
        if runs:
            more = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                more[start + period] += 1
                more[start + length] -= 1
            words = [w for w, dropped in zip(words, np.cumsum(more).tolist()) if not dropped]
        collapsed.append(b" ".join(words))
    return list(zip(found, collapsed))


def find_runs(spark: SparkSession, text: Column, least: int = 12) -> Column:
    """A struct of a text's runs of at least that length, by start, then period, and the collapsed text."""
    bounded_batches(spark)

    @F.arrow_udf(RESULT)
    def read(texts: pa.Array) -> pa.Array:
        rows, held, words = [], [], 0
        for text in texts:
            held.append((text.as_py() or b"").split())
            words += len(held[-1])
            if words > WORDS_AT_ONCE:
                rows += runs_of(held, least)
                held, words = [], 0
        rows += runs_of(held, least)
        kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        runs = [[dict(zip(("start", "length", "period"), r)) for r in sorted(found, key=lambda r: (r[0], r[2]))] for found, _ in rows]
        left = pa.array([c for _, c in rows], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(kind)), left], ["runs", "collapsed"])

    return read(text.cast("binary"))
