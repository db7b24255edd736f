"""Every query against its SQL, on the smallest tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from prosegrid.functions import stats
from prosegrid.operators import exam
from prosegrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "lineitem", "orders", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    result = duck.sql(catalogue.ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(found.columns)
    expected = [tuple(dict(zip(result.columns, r))[c] for c in columns) for r in result.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(expected, key=str)


def test_entry_without_llm(monkeypatch):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def edits(a, b):
    """Levenshtein's distance, one row at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_closest_quotes(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {}
    for r in catalogue.closest_quotes(spark, SF).collect():
        found.setdefault(r.entry, []).append((r.rank, r.distance, r.sent_id))
    assert set(found) == set(rows)
    for i, text in rows.items():
        near = sorted((edits(text[4:74][:60], line[:60]), n) for n, line in enumerate(text.split("\n")))[:3]
        assert sorted(found[i]) == [(k + 1, d, n) for k, (d, n) in enumerate(near)]


def test_bootstrap(spark):
    """Even rates have a narrow interval around their ratio, uneven ones a wide one; the same on every run."""
    repos = spark.createDataFrame([(side, f"r{n}") for side in (0, 1) for n in range(40)], "side int, repo string")
    rows = [("even", side, f"r{n}", 10.0 if side == 0 else 5.0) for side in (0, 1) for n in range(40)] + [("odd", 0, "r1", 400.0), ("odd", 1, "r2", 200.0)]
    rates = spark.createDataFrame(rows, "item string, side int, repo string, rate double")
    found = {r["item"]: (r.low, r.high) for r in stats.bootstrap_ratio(rates, repos, 1.0).collect()}
    assert found["even"] == pytest.approx((11 / 6, 11 / 6))
    assert found["odd"][0] < 0.5 < 2 < found["odd"][1]
    assert found == {r["item"]: (r.low, r.high) for r in stats.bootstrap_ratio(rates, repos, 1.0).collect()}
    weights = spark.range(20_000).select(stats.draw_weight(F.col("id"), F.lit("x")).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 20_000 for r in weights}
    assert share[0] == pytest.approx(0.368, abs=0.015) and share[1] == pytest.approx(0.368, abs=0.015) and share[2] == pytest.approx(0.184, abs=0.015)


def test_cutoff(spark):
    """Against running sums in order."""
    rng = random.Random(4)
    rows = [(round(rng.random() * 3 - 1, 4), int(rng.random() < 0.8)) for _ in range(3000)]
    for floor in (0.75, 0.8, 0.83, 0.99):
        best, n, right = None, 0, 0
        for s in sorted({s for s, _ in rows}, reverse=True):
            n, right = n + sum(x == s for x, _ in rows), right + sum(r for x, r in rows if x == s)
            best = (s, n, right) if right >= floor * n else best
        found = exam.cutoff(spark.createDataFrame(rows, "score double, right int"), "score", "right", floor).collect()
        assert [tuple(r) for r in found] == ([best] if best else [])
    assert exam.cutoff(spark.createDataFrame([], "score double, right int"), "score", "right", 0.5).collect() == []
