import pytest
from pyspark.sql import functions as F

from prosegrid.sources import records


def test_lines_and_names(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    assert [r.a for r in records.json_lines(spark, f"{tmp_path}/a.jsonl", "a int").collect()] == [1, 2]
    with pytest.raises(Exception, match="MALFORMED"):
        records.json_lines(spark, f"{tmp_path}/b.jsonl", "a int").collect()
    names = spark.createDataFrame([("2026-01-02-03",), ("2026-1-02-03",), ("x2026-01-02-03",), (None,)], "n string")
    assert [r[0] for r in names.select(records.is_batch_name(F.col("n"))).collect()] == [True, False, False, False]
    cards = spark.createDataFrame([("a", "declared"), ("b", "history"), ("c", None)], "k string, basis string")
    assert [r.k for r in records.history_proven(cards).collect()] == ["b", "c"]


def test_ledger(spark):
    ledger = spark.createDataFrame([("h", "A/x", ["s"], {"human": 2, "llm": 1}), ("h", "b/y", [], {"human": 1}), ("h", "c/z", ["s"], {"human": 1}), ("h", "C/Z", ["s"], {})], "host string, repo string, found_by array<string>, kept map<string,int>")
    entries = spark.createDataFrame([("h", "a/X", "human"), ("h", "a/x", "human"), ("h", "b/y", "human"), ("h", "b/y", "human"), ("h", "d/w", "llm")], "host string, repo string, label string")
    found = {(r.repo, r.label, r.said, r.held, r.fault) for r in records.ledger_faults(ledger, entries).collect()}
    assert found == {("a/x", "llm", 1, None, "not held"), ("b/y", "human", 1, 2, "other count"), ("c/z", "human", 1, None, "not held"), ("d/w", "llm", None, 1, "not in the ledger"), ("c/z", None, None, None, "two lines"), ("b/y", None, None, None, "no source")}


def test_revisions(spark):
    rows = [("p1", "human", "h", "A/b", "f.md", "s1", "c1", None, None), ("p2", "llm", "h", "a/B", "f.md", "s2", "c2", "s1", "c1"), ("p3", "llm", "h", "a/b", "f.md", "s3", "c3", "s1", "c9"), ("p4", "llm", "h", "a/b", "g.md", "s4", "c4", "s1", "c1")]
    live = spark.createDataFrame(rows, "path string, category string, host string, repo string, source_path string, sha256 string, commit string, before_sha256 string, before_commit string")
    assert sorted(r.path for r in records.missing_revisions(live).collect()) == ["p3", "p4"]


def test_disputes(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# note\n\ns1\t3\tNOUN\ta\treason\ns2\t1\tVERB\twhy\r\n")
    assert [tuple(r) for r in records.disputes(spark, f"{tmp_path}/d.tsv").collect()] == [("s1", "3", "NOUN", "a\treason"), ("s2", "1", "VERB", "why")]
    (tmp_path / "e.tsv").write_text("s1\t3\tNOUN\n")
    with pytest.raises(Exception, match="no dispute"):
        records.disputes(spark, f"{tmp_path}/e.tsv").collect()


def test_skeletons_runs_and_tables(spark, tmp_path):
    tokens = spark.createDataFrame([("s", 0, "Bees", "Word", False), ("s", 1, "hum", "Word", True), ("s", 2, ".", "Punctuation", False)], "sent_id string, pos int, text string, kind string, spaced boolean")
    block = records.skeletons(tokens, spark.createDataFrame([("s", "Bees hum.")], "sent_id string, text string")).first().block
    assert block == "# sent_id = s\n# text = Bees hum.\n1\tBees\t_\t_\t_\t_\t_\t_\t_\tKind=Word\n2\thum\t_\t_\t_\t_\t_\t_\t_\tKind=Word|SpaceAfter=No\n3\t.\t_\t_\t_\t_\t_\t_\t_\tKind=Punctuation\n"
    labels = spark.createDataFrame([("s", 0, "Bees", "NOUN"), ("s", 1, "hum", "VERB"), ("s", 2, ".", None)], "sent_id string, pos int, text string, tag string")
    assert sorted((r.pos, r.tag) for r in records.filled(tokens, labels).collect()) == [(0, "NOUN"), (1, "VERB"), (2, None)]
    with pytest.raises(Exception, match="not the skeleton's word"):
        records.filled(tokens, labels.where("pos > 0")).collect()
    tallies = spark.createDataFrame([("s", 3)], "sent_id string, n int")
    records.save_run(tallies, f"{tmp_path}/run", "abc")
    assert records.saved_run(spark, f"{tmp_path}/run", "abc").count() == 1
    with pytest.raises(Exception, match="other gold"):
        records.saved_run(spark, f"{tmp_path}/run", "abd").collect()
    records.write_table(tallies, f"{tmp_path}/table")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/table").columns == ["sent_id", "n"]
