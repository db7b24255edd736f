from prosegrid.functions import stats
from prosegrid.operators import align, lints, sampling, settings, tagger
from pyspark.sql import functions as F
import pytest


def tagged(spark, text, lexicon=None):
    blocks = spark.createDataFrame([(1, 0, text)], "doc_id long, block_id int, text string")
    listed = spark.createDataFrame(lexicon, tagger.LEXICON) if lexicon else None
    return [(r.text, r.tag, r.confidence) for r in tagger.tag(lints.read(blocks), listed).orderBy("pos").collect()]


def test_passes(spark):
    lexicon = [("build", ["Noun", "Verb"], False), ("fast", ["Adjective", "Adverb"], True), ("cache", ["Noun"], False), ("test", ["Noun", "Verb"], True)]
    rows = tagged(spark, "The build must build to cache a quickly fast test of configuration.", lexicon)
    found = {n: r for n, r in enumerate(rows)}
    assert found[0][1:] == ("Determiner", "Sure") and found[1][1:] == ("Noun", "Likely") and found[3][1:] == ("Verb", "Likely")
    assert found[8][1] == "Adjective" and found[9][1] == "Noun"
    assert found[7][1] == "Adverb" and found[11] == ("configuration", "Noun", "Unknown")
    assert found[12] == (".", None, None)


def test_alignment_and_tally(spark):
    gold = spark.createDataFrame([("s", 0, 4, "Noun"), ("s", 5, 7, "Auxiliary"), ("s", 7, 10, "Particle"), ("s", 11, 14, "Verb"), ("s", 15, 25, "Noun"), ("t", 0, 3, "Noun")], "sent_id string, start int, end int, gold string")
    reading = lambda s, a, b, tag, kept, sure: (s, a, b, "Word", tag, kept, sure)
    tokens = spark.createDataFrame(
        [reading("s", 0, 4, "Noun", ["Noun"], "Sure"), reading("s", 5, 10, "Auxiliary", ["Auxiliary", "Verb"], "Unsure"), reading("s", 11, 14, "Noun", ["Noun", "Verb"], "Likely"), reading("s", 15, 20, "Noun", ["Noun"], "Sure"), ("s", 20, 21, "Punctuation", None, None, None), reading("s", 21, 25, "Noun", ["Noun"], "Sure"), reading("t", 0, 3, "Noun", ["Noun"], "Likely")],
        "sent_id string, start int, end int, kind string, tag string, kept array<string>, confidence string",
    )
    rows = {r.sent_id: r for r in align.tallies(align.aligned(gold, tokens)).collect()}
    s = rows["s"]
    assert (s.tokens, s.right, s.committed, s.committed_right, s.retained, s.unsure, s.tagged, s.unalignable, s.sentences, s.clean) == (3, 2, 2, 1, 3, 1, 5, 1, 1, 0)
    assert rows["t"].clean == 1
    total = align.summed(align.tallies(align.aligned(gold, tokens))).first()
    assert total.accuracy == pytest.approx(0.75) and total.clean == 0.5


def test_statistics_vectors(spark):
    """Hand-computed: a mean over all repositories, smoothing, ratios, nearest ranks."""
    hits = spark.createDataFrame([("w", 0, "a", 2), ("w", 0, "b", 1)], "gram string, side int, repo string, n long")
    repos = spark.createDataFrame([(0, "a", 1000), (0, "b", 1_000_000), (0, "c", 5)], "side int, repo string, tokens long")
    assert stats.repo_rates(hits, repos, "gram").first().rate == pytest.approx(667.0)
    row = spark.range(1).select(stats.smoothing(F.lit(2_000_000)).alias("s"), stats.ratio(F.lit(9.75), F.lit(0), F.lit(0.25)).alias("a"), stats.ratio(F.lit(1.75), F.lit(3.75), F.lit(0.25)).alias("b")).first()
    assert (row.s, row.a, row.b) == (0.25, 40.0, 0.5)
    ten = spark.range(1, 11)
    assert [ten.agg(stats.percentile("id", f)).first()[0] for f in (0, 0.1, 0.11, 0.5, 1)] == [1, 1, 2, 5, 10]
    rates = spark.createDataFrame([("x", 0, "r0", 400.0)], "item string, side int, repo string, rate double")
    all_repos = spark.range(43).select(F.when(F.col("id") < 40, 0).otherwise(1).alias("side"), F.concat(F.lit("r"), "id").alias("repo"))
    low = stats.bootstrap_ratio(rates, all_repos, 1.0).first()
    assert low.low == 1.0 and low.high > 20


def test_sections_and_apportionment(spark):
    paths = spark.createDataFrame([("docs/a.md",), ("src/x.rs",), ("gen/b.md",)], "path string")
    md, rs = settings.Section("md", ["*.md"], ["gen/**"]), settings.Section("rust", ["src/**/*.rs"])
    assert {(r.path, r.section) for r in settings.sections_of(paths, [md, rs]).collect()} == {("docs/a.md", "md"), ("src/x.rs", "rust")}
    with pytest.raises(Exception, match="is in sections"):
        settings.sections_of(paths, [md, settings.Section("all", ["docs/**"])]).collect()
    weights = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "k string, w int")
    assert {(r.k, r.seats) for r in sampling.apportioned(weights, "k", "w", 5).collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_tagged_verb_lints(spark):
    """Any form of a verb, but idioms, participles, clause verbs and nouns after an article; a preposition before nothing."""
    from prosegrid.plans.check import check_documents

    lines = [
        "They crossed no river.", "We may cross no river.", "Having no map helps.", "It made no sense.", "The cross no saint made.", "They showed no map.",
        "You bring no food.", "They led to nothing.", "He crossed nothing.", "It crosses no river.", "She has known nothing of it.",
    ]
    docs = spark.createDataFrame([("a.md", "\n\n".join(lines))], "path string, text string")
    lexicon = [("crossed", ["Verb"], True), ("cross", ["Verb", "Noun"], True), ("having", ["Verb"], True), ("made", ["Verb"], True), ("showed", ["Verb"], True), ("bring", ["Verb"], True), ("led", ["Verb"], True), ("known", ["Verb"], True)]
    found = check_documents(docs, ["verbs_no_nouns", "verbs_nothing"], lexicon=spark.createDataFrame(lexicon, tagger.LEXICON)).collect()
    assert sorted((r.line, r.quote) for r in found) == [
        (1, "crossed no river"), (3, "cross no river"), (13, "bring no food"), (15, "led to nothing"), (17, "crossed nothing"), (19, "crosses no river"),
    ]
