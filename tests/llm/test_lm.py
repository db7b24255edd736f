import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrid.llm import lm


def brute(rows, order):
    texts = [[w.decode() for w in (t or "").encode().lower().split()] for _, t in rows]
    tables = [Counter(tuple(ws[i : i + n]) for ws in texts for i in range(len(ws) - n + 1)) for n in range(1, order + 1)]
    total = sum(tables[0].values())
    out = []
    for (i, _), ws in zip(rows, texts):
        score = 0.0
        for k in range(len(ws)):
            n = min(order, k + 1)
            while n > 1 and tables[n - 1][tuple(ws[k - n + 1 : k + 1])] < lm.MIN_COUNT:
                score += math.log(lm.ALPHA)
                n -= 1
            gram = tuple(ws[k - n + 1 : k + 1])
            score += math.log(tables[n - 1][gram] / (tables[n - 2][gram[:-1]] if n > 1 else total))
        out.append((i, len(ws), score))
    return out


@pytest.mark.parametrize("order, block, ranges", [(3, 1 << 21, 4), (1, 50, 1), (4, 300, 64), (2, 1 << 21, 16)])
def test_against_brute_force(spark, monkeypatch, order, block, ranges):
    monkeypatch.setattr(lm, "BLOCK_WORDS", block)
    monkeypatch.setattr(lm, "RANGES", ranges)
    monkeypatch.setattr(lm, "HASHED_WORDS", lm.HASHED_WORDS if order == 3 else 0)
    monkeypatch.setattr(lm, "PACKED_ROWS", lm.PACKED_ROWS if order == 3 else 500)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "one"), (903, "the the the the the"), (903, "the the the the the"), (None, "É the\x0bÉ the"), (904, "the of " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("block", F.lit("clash"))
    found = lm.scores(docs, order).collect()
    expected = brute(rows, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert tuple(a)[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-7)
        assert a.score == (pytest.approx(b[2] / b[1]) if b[1] else None)


def test_ranges_grow_with_the_words(spark, monkeypatch):
    """A range holds a bounded number of n-grams, and many ranges give the same scores."""
    assert [lm.range_bits(8, n) for n in (0, lm.RANGE_GRAMS, lm.RANGE_GRAMS << 10)] == [5, 5, 11]
    rows = [(i, f"the same words {i % 7} again and again the same") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, lm.scores(docs).collect()))
    monkeypatch.setattr(lm, "RANGE_GRAMS", 4)
    assert sorted(map(tuple, lm.scores(docs).collect())) == few


def test_widths():
    for most, width in ((0, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4), ((1 << 32) - 1, 4), (1 << 32, 8), ((1 << 63) - 1, 8)):
        blob, found = lm.narrowed(np.array([0, most], np.int64))
        assert found == width and lm.widened(blob, found).tolist() == [0, most]


@pytest.mark.parametrize("hashed", [True, False])
def test_counts_beyond_32_bits(spark, hashed):
    """Counts of blocks that fit 32 bits each and add up to more."""
    rows = [(b, n, 0, [5 + n, 50 + n, n << 40], [2_000_000_000, 1, 7]) for b in (1, 2, 4) for n in (1, 2)]
    rows.append((3, 1, 0, [51], [1]))
    entries = spark.createDataFrame(rows, "block long, n int, range int, keys array<long>, counts array<int>")
    found = {(r.block, r.n): lm.widened(r.totals, r.width).tolist() for r in lm._totals(entries, 3, hashed).collect()}
    assert found == {(b, n): [6_000_000_000, 4 if n == 1 else 3, 21] for b in (1, 2, 4) for n in (1, 2)} | {(3, 1): [4]}


@pytest.mark.parametrize("hashed", [True, False])
def test_count_table_is_joined_where_its_rows_are(spark, hashed):
    """The n-grams move once, for the grouping and the join; besides them only the count table moves."""
    entries = spark.createDataFrame([(b, 2, 0, [1, 2, 3], [1, 1, 1]) for b in (1, 2)], "block long, n int, range int, keys array<long>, counts array<int>")
    with lm.dealt_by_range(spark):
        totals = lm._totals(entries, 3, hashed)
        totals.collect()
        plan = totals._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ("ShuffledHashJoin" if hashed else "SortMergeJoin") in plan and "ReusedExchange" in plan and "hashpartitioning(key" not in plan and "hashpartitioning(block" not in plan and "FlatMapGroupsInArrow" in plan


def test_empty(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
