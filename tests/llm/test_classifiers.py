import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrid.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    """Fitted on two thirds of the labels, it is right about the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 > 0"))
    scored = docs.withColumn("q", quality.quality(docs, model)).select("doc_id", "q.*").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r.score >= 0.5 for r in scored if r.quality == 1]
    bad = [r.score < 0.5 for r in scored if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.8


def test_views_teach_each_other():
    """Few labels, and two views that are each enough: pseudo-labels make up for the labels."""
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.7).astype(float)
    views = tuple(y[:, None] * 2 + rng.normal(size=(4000, 6)) for _ in range(2))
    labels = y.copy()
    labels[200:] = np.nan
    model = quality.co_train(views, labels, np.arange(4000) % 3 == 0)
    score = model.fused(*views)[2]
    assert ((score >= 0.5) == y)[200:].mean() > 0.97
    assert quality.co_train(views, np.where(labels == 1, 1.0, np.nan), np.arange(4000) % 3 == 0) is None


def plain_score(model, text, source, lang, n_chars):
    """One document's scores, number by number."""

    def margin(line, x):
        weights = line.weights.tolist()
        scaled = [max(-20.0, min(20.0, (v - m) / s)) for v, m, s in zip(x, line.mean.tolist(), line.scale.tolist())]
        return weights[0] + sum(w * v for w, v in zip(weights[1:], scaled))

    odds = []
    for view, x in ((model.text, quality.text_view(text)), (model.metadata, quality.metadata_view(source, lang, n_chars))):
        odds.append(max(-15.0, min(15.0, margin(view.curve, [margin(view.classifier, x.tolist())]))))
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in (*odds, sum(odds) - model.prior)]


def test_quality_one_document_at_a_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hard = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "xx", "s", -5), (-3, "x " * 50_000, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(hard)
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = docs.withColumn("_q", quality.quality(docs, model)).collect()
    assert len(rows) > 100
    for r in rows:
        expected = plain_score(model, r.text.encode() if r.text is not None else None, r.source, r.lang, r.n_chars)
        assert list(r._q) == pytest.approx(expected, abs=1e-9)


def test_pool_of_distinct_documents(spark):
    """An id that is repeated very often takes one place."""
    rows = spark.range(500).unionAll(spark.range(2000).select(F.lit(7).cast("long"))).toDF("doc_id")
    found = [r.doc_id for r in quality._first(rows, 100).collect()]
    assert len(found) == len(set(found)) == 100
    assert found == [r.doc_id for r in quality._first(spark.range(500).toDF("doc_id"), 100).collect()]


HARD = [(1, None, None, None, None), (2, "", "xx", "s", -5), (None, "a b c", "en", "s", 1), (4, "x " * 100_000, "en", "s", 9), (4, "x " * 100_000, "en", "s", 9), (5, "日本", "en", None, 2)]


@pytest.fixture
def hard(spark):
    frame = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({"label": F.lit(1), "score": F.lit("clash"), "x": F.lit(0), "language": F.lit("clash")})


def test_quality_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.fit(hard, some)
        rows = hard.withColumn("_q", quality.quality(hard, model)).select("_q.*").collect()
        assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    empty = hard.limit(0)
    assert empty.withColumn("_q", quality.quality(empty, quality.fit(empty, labels))).collect() == []


def test_language_without_declarations(spark):
    """Texts whose declaration is withheld are told from the others' trigrams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    rows = langid.identify(docs, langid.fit(docs, host="source"), host="source").where("lang is null and length(text) > 60").select("truth", f"{langid.RESULT}.language").collect()
    assert np.mean([r.truth == r.language for r in rows]) > 0.97


EN, FR = "the cat and the dog with this that ", "le chat et la chienne avec les deux "
SPOKEN = [(n, EN * 5, "en", "a.uk", "uk") for n in range(60)] + [(100 + n, FR * 5, "fr", "b.fr", "fr") for n in range(60)]
SPOKEN += [(300, FR * 5, "en", "b.fr", "fr"), (301, "", None, "b.fr", "fr"), (302, None, "en", None, None), (303, "", None, "new.fr", "fr"), (304, "", None, None, None), (305, EN + FR, "qq", "a.uk", None)]


def spoken_rows(spark):
    return spark.createDataFrame(SPOKEN, "doc_id long, text string, lang string, host string, tld string")


@pytest.mark.parametrize("cells", [1_000_000, 0])
def test_language_evidence(spark, monkeypatch, cells):
    """A wrong declaration is outweighed by the text; an empty text goes by declaration, host and suffix. Joined either way."""
    monkeypatch.setattr(langid, "MAX_BROADCAST_CELLS", cells)
    docs = spoken_rows(spark)
    rows = langid.identify(docs, langid.fit(docs, host="host", suffix="tld"), host="host", suffix="tld")
    found = {r.doc_id: r for r in rows.select("doc_id", f"{langid.RESULT}.*").collect()}
    assert [found[n].language for n in (0, 100, 300, 301, 302, 303)] == ["en", "fr", "fr", "fr", "en", "fr"]
    assert len(found) == len(SPOKEN) and found[304].posterior <= found[301].posterior
    assert rows.columns == [*docs.columns, langid.RESULT]


def test_language_fusion_one_document_at_a_time(spark):
    """Each posterior against the product of its evidence, counted anew from the rows."""
    docs = spoken_rows(spark)
    fitted = langid.fit(docs, host="host", suffix="tld")
    languages = ["en", "fr", langid.OUTSIDE]
    assert fitted.model.languages == languages
    grams = {x: np.concatenate([langid.trigrams(t.encode()) for _, t, lang, *_ in SPOKEN if lang == x and t]) for x in languages[:2]}
    likely = {x: np.log((np.bincount(g, minlength=langid.BUCKETS) + langid.TRIGRAM) / (len(g) + langid.TRIGRAM * langid.BUCKETS)) for x, g in grams.items()}
    likely[langid.OUTSIDE] = np.full(langid.BUCKETS, -np.log(langid.BUCKETS))
    text = lambda t: np.array([langid.TEMPER * sum(likely[x][g] for g in langid.trigrams((t or "").encode())) for x in languages])
    heard = [(r, int(text(r[1]).argmax())) for r in SPOKEN if r[1]]
    many = lambda rows: np.bincount([s for _, s in rows], minlength=3).astype(float)
    smooth = lambda n, parent: (n + langid.PARENT * parent) / (n.sum() + langid.PARENT)
    whole = (many(heard) + 1) / (len(heard) + 3)
    value = lambda lang: lang if lang in languages else langid.OUTSIDE
    values = {value(r[2]) for r, _ in heard if r[2]}
    told = {v: many([(r, s) for r, s in heard if r[2] and value(r[2]) == v]) + langid.TOLD for v in values}
    all_told = sum(told.values()) + langid.TOLD
    suffixes = {r[4] for r, _ in heard if r[4]}
    at = {x: many([(r, s) for r, s in heard if r[4] == x]) + langid.TOLD for x in suffixes}
    all_at = sum(at.values()) + langid.TOLD
    parents = {x: smooth(many([(r, s) for r, s in heard if r[4] == x]), whole) for x in {r[4] for r, _ in heard}}
    rows = langid.identify(docs, fitted, host="host", suffix="tld").select("doc_id", f"{langid.RESULT}.*").collect()
    by_id = {r[0]: r for r in SPOKEN}
    for found in rows:
        _, t, lang, host, tld = by_id[found.doc_id]
        mine = [(r, s) for r, s in heard if host and r[3] == host and r[4] == tld]
        prior = smooth(many(mine), parents[tld]) if mine else parents[tld] if tld in suffixes else whole
        odds = text(t) + np.log(prior)
        odds += np.log(told[value(lang)] / all_told) if lang and value(lang) in told else 0
        odds += np.log(at[tld] / all_at) if tld in at else 0
        posterior = np.exp(odds - odds.max()) / np.exp(odds - odds.max()).sum()
        assert found.language == languages[int(odds.argmax())]
        assert found.posterior == pytest.approx(posterior.max(), rel=1e-3)


def test_rare_language_and_outsiders(spark):
    """A language of 0.3 % of the rows is kept apart; noise, an unknown language and a mixture are rejected; clean texts stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = np.random.default_rng(6)
    rare = ["suomen kieli on kaunis ja talvella sataa lunta metsien yli " + " ".join(rng.permutation("talo metsä järvi kala vene lintu aamu ilta tuuli sade kesä talvi".split())) for _ in range(3)]
    letters = np.array(list("bcdfghjklmnpqrstvwxz0123456789#%"))
    noise = ["".join(rng.choice(letters, 900)) for _ in range(5)]
    greek = ["η γλώσσα των ανθρώπων αλλάζει με τον χρόνο και τον τόπο " * 12]
    clean = [r.text for r in docs.where("lang = 'en' and length(text) > 3000").orderBy("doc_id").limit(1).collect()] + [r.text for r in docs.where("lang = 'fr' and length(text) > 3000").orderBy("doc_id").limit(1).collect()]
    mixed = [clean[0][:2600] + clean[1][:2600]]
    planted = [(10_000 + n, t * 5, "fi", "s") for n, t in enumerate(rare)] + [(20_000 + n, t, "en", "src1") for n, t in enumerate(noise + greek + mixed)]
    all_docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string"))
    found = {r.doc_id: r for r in queries.spoken(all_docs).select("doc_id", "lang", F.length("text").alias("size"), f"{langid.RESULT}.*", queries.in_one_language().alias("keep")).collect()}
    assert [found[10_000 + n].language for n in range(3)] == ["fi"] * 3 and all(found[10_000 + n].keep for n in range(3))
    assert not any(found[20_000 + n].keep for n in range(7)), [found[20_000 + n] for n in range(7)]
    kept = [r.keep and r.language == r.lang for i, r in found.items() if i < 10_000]
    assert np.mean(kept) > 0.995


def test_language_hard_rows(spark, hard):
    assert langid.identify(hard, langid.fit(hard, host="source"), host="source").count() == len(HARD)
    for bare in (hard.limit(0), hard.withColumn("lang", F.lit(None).cast("string"))):
        found = langid.identify(bare, langid.fit(bare, host="source"), host="source").select(f"{langid.RESULT}.*").collect()
        assert all(r.language is None and r.posterior == 1 for r in found)


def test_long_text_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 10_000, np.uint8))
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "BLOCK", 512)
    assert np.array_equal(np.concatenate(list(langid.blocks(text))), whole)


def test_pages(spark):
    rows = queries.pages_language(spark, SF).collect()
    assert len(rows) == 250 and {r.suffix for r in rows} >= {"com", "net"}
    assert np.mean([r.language == r.declared for r in rows]) > 0.95


def test_wrong_declarations_are_set_right(spark):
    """One text of ten declares another language: the text overrules it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("lang").alias("truth"), "source")
    other = F.when(F.col("truth") == "en", "de").when(F.col("truth") == "de", "fr").otherwise("en")
    wrong = (F.col("doc_id") % 10 == 3) & (F.length("text") > 200)
    found = queries.spoken(docs.withColumn("wrong", wrong).withColumn("lang", F.when(wrong, other).otherwise(F.col("truth")))).where("wrong").select("truth", f"{langid.RESULT}.language").collect()
    assert len(found) >= 10 and np.mean([r.language == r.truth for r in found]) >= 0.9, found


def test_declared_and_suffix(spark):
    rows = [
        ('<html lang="en-US">', "h.com:8080", "en", "com"), ("<HTML class=x LANG='De'>", "user@x.org.", "de", "org"), ("<html data-lang=fr>", "192.0.2.7", None, None),
        ("<html lang=EN_gb>", "localhost", "en", None), ("<html\n xml:lang='fr' lang = \"pt\" >", "", "pt", None), ("<p lang=en>", None, None, None), (None, "a.b.net", None, "net"),
    ]
    frame = spark.createDataFrame(rows, "html string, host string, lang string, suffix string")
    found = frame.select("lang", "suffix", queries.declared_language(F.col("html")).alias("a"), queries.host_suffix(F.col("host")).alias("b")).collect()
    assert [(r.a, r.b) for r in found] == [(r.lang, r.suffix) for r in found]
