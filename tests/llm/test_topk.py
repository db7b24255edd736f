import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrid.llm import topk


def brute(rows, step, k):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints = [int(np.floor(64 * float(np.float32(x)))) for x in v]
            sound[i] = min(sound.get(i, ints), ints)
    out = []
    for q in (i for i in sound if i % step == 0):
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk, block", [(4096, 1024), (37, 11)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, -0.25, 1.0, 0.0, 0.0, 0.1]) for i in range(120)]  # many equal vectors
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(520, [1e5, 1e5]), (540, [-1e9, 3e8]), (541, [1.0, 1.0]), (5, rows[5][1]), (560, []), (561, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    found = topk.top_k(frame, "vec_id % 20 = 0", 20)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20, 20)


def test_only_entries_that_reach_their_share_are_collected(spark):
    """An entry is collected from a list exactly if its local score is half of the query's cutoff at least; others are never resolved."""
    rng = np.random.default_rng(9)
    rows = {i: rng.normal(size=8).round(3).tolist() for i in range(600)}
    ints = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in rows.items()}
    search = topk.Search(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>"), "vec_id % 20 = 0", 20, 64)
    cutoffs = search.cutoffs()
    cutoff = {r.query_id: r.cutoff for r in cutoffs.collect()}
    for q, least in cutoff.items():
        best = sorted((int(ints[q] @ v) for i, v in ints.items() if i != q), reverse=True)
        assert least <= best[19]
    _, collected = search.collected(cutoffs)
    n = sum(len(r.local) for r in collected.collect())
    reached = sum(2 * int(ints[q][a : a + 4] @ v[a : a + 4]) >= least for q, least in cutoff.items() for i, v in ints.items() for a in (0, 4) if i != q)
    assert n == reached < 0.15 * 2 * len(cutoff) * 599


def test_huge_components_take_part(spark):
    rows = [(0, [1.0, 0.5]), (1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0", 20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 3, 2]


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), "vec_id % 20 = 0").collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), "vec_id % 20 = 0").collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], schema), "vec_id % 20 = 0").collect() == []


def test_no_block_is_copied_for_each_chunk(spark, monkeypatch):
    """What is broadcast or shuffled where blocks meet chunks doesn't grow with the number of chunks: a plan without a generator of chunk numbers, and no exchange under a product."""
    monkeypatch.setattr(topk, "CHUNK_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, rng.normal(size=4).round(3).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    search = topk.Search(frame, "vec_id % 20 = 0", 5, 64)
    pairs = search._pairs(search._blocks(search.asking))
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "SortMergeJoin" not in plan
    assert pairs.count() == search.chunks.count() * search.asking.select("block").distinct().count()
