import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrid.llm import shared


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_saved", set())
    monkeypatch.setattr(shared, "run_folder", lambda spark: f"{tmp_path}/run")
    return tmp_path


def test_tables_go_when_asked(spark, folder):
    rows = spark.range(10)
    kept, gone = shared.written(spark, rows, "kept"), shared.written(spark, rows, "gone")
    bucketed = shared.saved(rows, "bucketed", 2, "id")
    assert kept.count() == bucketed.count() == 10
    shared.discard(gone)
    assert not os.path.exists(gone.written_at) and os.path.exists(kept.written_at)
    [name] = shared._saved
    shared.clear(spark)
    assert os.listdir(folder) == [] and not spark.catalog.tableExists(name)


def test_bit_map_never_says_no_to_a_key(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)
    frame = spark.createDataFrame([(int(k),) for k in keys], "k long")
    for bits in (64, 1 << 12, 1 << 20):
        found = shared.bit_map(frame, F.col("k"), bits)
        assert shared.may_hold(found, keys).all()
    assert shared.may_hold(found, keys + 1).mean() < 0.01
    assert not shared.may_hold(shared.bit_map(frame.limit(0), F.col("k"), 64), keys).any()
