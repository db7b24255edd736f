import pytest
from pyspark.sql import functions as F

from prosegrid.operators import chars, corpus, labelling, lints, tagger
from prosegrid.operators import patterns as P
from prosegrid.plans.check import Settings, check_documents, ordered


def test_intervals_over_units(spark):
    """Units that are all alike give a point, uneven ones an interval around the share; undefined groups none."""
    rows = [("even", f"s{n}", 10, 8) for n in range(50)] + [("odd", f"s{n}", 10, 10 * (n % 2)) for n in range(50)] + [("none", "s", 0, 0)]
    found = {r.group: r for r in labelling.share_intervals(spark.createDataFrame(rows, "group string, unit string, n int, right int"), "group", "unit").collect()}
    assert (found["even"].share, found["even"].low, found["even"].high) == pytest.approx((0.8, 0.8, 0.8))
    assert 0.3 < found["odd"].low < 0.45 < found["odd"].share == 0.5 < 0.55 < found["odd"].high < 0.7
    assert found["none"].share is None and found["none"].low is None


def test_paired_difference(spark):
    rows = [("up", f"s{n}", 10, 5, 7) for n in range(40)] + [("down", f"s{n}", 10, 7, 5) for n in range(40)] + [("mixed", f"s{n}", 10, 5, 5 + (-1) ** n) for n in range(40)]
    found = {r.group: r for r in labelling.paired_difference(spark.createDataFrame(rows, "group string, unit string, n int, before int, after int"), "group", "unit").collect()}
    assert {g: r.verdict for g, r in found.items()} == {"up": "better", "down": "worse", "mixed": "same"}
    assert found["up"].low == pytest.approx(0.2)


def test_added_entries_with_nulls(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "k string, v string")
    base = spark.createDataFrame([("a", None), ("c", None)], "k string, v string")
    assert sorted(map(tuple, labelling.added_entries(rows, base, ["k", "v"]).collect()), key=str) == [("a", "x"), ("b", None)]


def test_ranked_by_interval(spark):
    rates = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 5.0)], "gram string, ratio double")
    intervals = spark.createDataFrame([("x", 1.0, 9.0), ("y", 1.0, 2.0), ("z", 0.5, 9.0)], "item string, low double, high double")
    assert [r.gram for r in corpus.ranked_by_interval(rates, intervals, "gram", 2).collect()] == ["x", "y"]


def test_not_pair(spark):
    blocks = spark.createDataFrame([(1, 0, "The old mill wheel and the old red barn stand here.")], "doc_id long, block_id int, text string")
    hits = P.find(lints.read(blocks), [P.one(P.word("old") & P.not_pair(("old", "barn"))), P.one(F.col("kind") == "Word")])
    assert [r.pos for r in hits.collect()] == [1]


def test_names_origins_and_tags(spark):
    texts = [(1, 0, "Paragraph", "We met Clara near York, Anna and `mill_wheel` said so. The mill has a wheel_pit in main.rs and a -x flag; mill_wheel turns."), (2, 0, "Paragraph", "Every Tall Tower Falls Down")]
    blocks = spark.createDataFrame(texts, "doc_id long, block_id int, kind string, text string")
    seen = tagger.code_words(blocks)
    assert [r.text for r in seen.collect()] == ["mill_wheel"]
    rows = tagger.origins(tagger.tag(lints.read(blocks)), seen)
    found = {(r.doc_id, r.text): r for r in rows.collect()}
    assert all((found[1, w].tag, found[1, w].confidence) == ("ProperNoun", "Likely") for w in ("Clara", "York", "Anna"))
    assert found[2, "Tower"].kept == ["ProperNoun", "Noun"]
    assert found[1, "has"].tag == "Verb"
    assert [found[1, w].origin for w in ("main.rs", "wheel_pit", "x", "mill_wheel", "mill")] == ["Path", "Symbol", "Flag", "Symbol", None]
    hits = P.find(rows, [P.one(P.tagged("ProperNoun")), P.one(P.mark(",")), P.one(P.tagged("ProperNoun"))])
    assert hits.count() == 1 and rows.where(P.origin("Path", "Flag")).count() == 2


def test_fix_and_retain(spark):
    texts = spark.createDataFrame([("a", "wait \u2014 no\u2026"), ("b", "plain")], "path string, text string")
    fixed = chars.fixed_to_fixpoint(texts, "text", list(chars.GROUPS))
    assert {r.path: r._fixed for r in fixed.collect()} == {"a": "wait - no...", "b": "plain"}
    findings = spark.createDataFrame([("a", "dash", "\u2014"), ("a", "word", "wait"), ("b", "size", None)], "path string, lint string, quote string")
    left = chars.retained(findings, fixed.select("path", F.col("_fixed").alias("text"))).collect()
    assert sorted((r.path, r.lint) for r in left) == [("a", "word"), ("b", "size")]


def test_check_by_settings(spark):
    """Every lint on, findings in order, and two exemptions."""
    text = "# Mill\n\nThe mill grinds no barley. DO NOT stop \u2014 **ever** and *never*.\n\n" + "A long line of words. " * 40 + "\n"
    docs = spark.createDataFrame([("b.md", text), ("a.md", "The mill grinds no barley.")], "path string, text string")
    on = Settings(max_size_bytes=100, max_emphasis=(1, 1.0), repo_layout="Layout", char_groups=["dashes"], phrases=["do not"], density=True)
    found = [(r.path, r.lint, r.line) for r in ordered(check_documents(docs, settings=on)).collect()]
    assert found == [
        ("a.md", "repo_layout", None), ("a.md", "verbs_no_nouns", 1), ("b.md", "max_size_bytes", None), ("b.md", "max_emphasis", None), ("b.md", "repo_layout", None),
        ("b.md", "banned_chars", 3), ("b.md", "banned_phrases", 3), ("b.md", "density", 5), ("b.md", "verbs_no_nouns", 3),
    ]
    entries = spark.createDataFrame([(1, "b.md", "verbs_no_nouns", "the mill GRINDS no  barley."), (2, "b.md", "density", "A long line of words. " * 40), (3, "b.md", "banned_phrases", "no such sentence")], "entry int, path string, lint string, quote string")
    kept = {(r.path, r.lint) for r in check_documents(docs, settings=on, allowed=entries).collect()}
    assert kept == {(p, x) for p, x, _ in found} - {("b.md", "verbs_no_nouns"), ("b.md", "density")}
    assert check_documents(docs, ["density"]).collect() == [] and check_documents(docs.limit(0), settings=on).collect() == []


def test_cut_links(spark):
    from prosegrid.operators import candidates

    rows = [("not a [link", "not a link"), ("end](http://x) at all", "end at all"), ("[whole](y) `a]` z]", "[whole](y) `a]` z"), ("plain", "plain"), (None, None), ("a](b", "a(b")]
    frame = spark.createDataFrame(rows, "quote string, expected string")
    found = frame.select("expected", candidates.without_cut_links(F.col("quote")).alias("found")).collect()
    assert [r.found for r in found] == [r.expected for r in found]


def test_codes(spark):
    from prosegrid.functions import codes

    rows = [("VERB", "Tense=Pres", "V.pr"), ("VERB", "Tense=Past|VerbForm=Part", "V.pp"), ("AUX", "VerbForm=Part", "AX.pp"), ("VERB", "Tense=Pres|VerbForm=Part", "V.ing"), ("VERB", "_", "V"), ("NOUN", "Case=Nom|Number=Coll,Plur", "N.p"), ("CCONJ", "_", "C"), ("SYM", "_", "X"), ("ADJ", "Number=Plur", "J"), ("_", "_", None), (None, None, None)]
    found = spark.createDataFrame(rows, "upos string, feats string, code string").withColumn("found", codes.from_treebank(F.col("upos"), F.col("feats"))).collect()
    assert [r.found for r in found] == [r.code for r in found]
