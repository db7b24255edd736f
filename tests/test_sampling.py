"""The quota draw against a walk, one row after another."""

import random

from prosegrid.operators import sampling
from prosegrid.sources.tables import running
from pyspark.sql import functions as F


def walk(rows, caps):
    found, counts = [], {}
    for row in rows:
        keys = [(c, row[c]) for c in caps]
        if all(counts.get(k, 0) < (caps[k[0]] if isinstance(caps[k[0]], int) else caps[k[0]].get(k[1], 0)) for k in keys):
            found.append(row["id"])
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
    return found


def test_quota_draw(spark):
    rnd = random.Random(1)
    for caps in ({"tier": {"a": 20, "b": 3}, "repo": 5, "file": 2}, {"tier": 1000, "repo": 7, "file": 3}):
        rows = [{"id": n, "tier": rnd.choice("aaaab") if n % 11 else "c", "repo": rnd.choice([0, 0, 0, 1, 2, 3, 4]), "file": rnd.randrange(30)} for n in range(500)]
        frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, tier string, repo int, file int").repartition(3)
        assert sorted(r.id for r in sampling.quota_draw(frame, caps, ["id"]).collect()) == walk(rows, caps)
    assert sampling.quota_draw(frame.limit(0), caps, ["id"]).collect() == []


def test_running(spark):
    rows = [(n, None if n % 3 == 0 else "hot", n % 5) for n in range(300)]
    found = running(spark.createDataFrame(rows, "id int, g string, v int"), "g", ["id"], {"total": F.col("v")}, "t").collect()
    assert {r.id: r.total for r in found} == {n: sum(v for m, h, v in rows if h == g and m < n) for n, g, _ in rows}
