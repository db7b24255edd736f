"""Queries against their SQL on texts that the driver's tables lack."""

import re

import duckdb
import pytest
from pyspark.sql import functions

from prosegrid.operators import corpus, lints, tokens
from prosegrid.plans import catalogue, lint_queries


def agree(spark, folder, name, texts, **tables):
    """The query's rows, which must be its SQL's, on documents of these texts; tables: others that it reads."""
    rows = [(n, t, "en", f"s{n % 3}", len(t)) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for other, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{other}.parquet")
    found = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for table in ("documents", *tables):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = con.sql(catalogue.ORACLES[name])
    columns = sorted(result.columns)
    expected = sorted((tuple(dict(zip(result.columns, r))[c] for c in columns) for r in result.fetchall()), key=str)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert rows == expected
    return [dict(zip(columns, r)) for r in rows]


def test_the_article_is_no_match_of_its_own(spark, tmp_path):
    """in or on, then the and no word: the optional article isn't taken for the word."""
    texts = ["Sit in the 3 boats. Stay on the `deck`", "Live in the the house\nGo on, in the", "We are in the garden, on paper"]
    found = agree(spark, tmp_path, "first_match_per_sentence", texts)
    assert [(r["doc_id"], r["pos"], r["length"]) for r in found] == [(1, 1, 3), (2, 2, 3)]


def test_the_sieve_reads_both_lengths_at_once(spark, tmp_path):
    """A union of two readings, each dealt by document, can't be joined where nothing is broadcast and no partition is merged."""
    texts = ["the old mill pond. The old mill", "old mill pond and the old mill pond", "the old `x` mill, the old mill pond"] * 4
    labels = spark.createDataFrame([(n, n % 2, n % 3 % 2) for n in range(len(texts))], "doc_id long, quality int, toxic int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = agree(spark, tmp_path, "candidate_sieve", texts, labels=labels, benchmark=spark.createDataFrame([(1, "mill pond")], "item_id long, text string"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0]["left"] > 0


ODD = [
    "Nobody likes it AT ALL. ALL the same, I can't at all.\nThey do NOT sleep, not at all so; small ball, tall hall",
    "The mill’s OWN wheel, the town's own. Known, disown, its own gown_own\nthe bakers' very own 3 loaves and the cook's own `pot`",
    "A man waits in the old grey boat all day, NEVER on the far wide shore.\nknot, whatnot - not on the old, old gate of it — nevertheless",
    "He finds NONE. She says nothing; it holds no_thing, nothing-else nonesuch\nhe knows NO rest, sees no.1 and hears nonsense, makes no noise's",
]


@pytest.mark.parametrize("lint", sorted(lints.LINTS))
def test_only_lines_that_hold_the_words_are_taken_apart(spark, tmp_path, lint):
    """The lint's places are SQL's, and its tokens those of lines that hold one of its words."""
    agree(spark, tmp_path, f"lint_{lint}", ODD * 3)
    taken = lint_queries.planted_sentences(spark, str(tmp_path), lint)
    lines = {(n, k): line for n, text in enumerate(ODD * 3) for k, line in enumerate((text + "\n" + lint_queries.PLANTED[n % len(lint_queries.PLANTED)]).split("\n"))}
    read = {(r.doc_id, r.block_id) for r in taken.select("doc_id", "block_id").distinct().collect()}
    words = {"verbs_no_nouns": "no", "verbs_nothing": "nothing|none", "not_at_all": "all", "possessive_own": "own", "denial_tail": "not|never"}[lint]
    held = {k for k, line in lines.items() if re.search(rf"(?i)(?<![^\W\d_])(?:{words})(?![^\W\d_])", line)}
    assert read == held and 0 < len(held) < len(lines)


def test_short_tails_are_found_without_windows(spark, tmp_path):
    """Commas at the bounds of a tail, sentences that closers end, small letters after a full stop, and many commas; no token is sorted or moved."""
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = [f"{words(a)},{' ' if a % 2 else ''}{words(b)}{end} Then {words(3)}, {words(2)}" for a in (1, 3, 13, 14) for b in (1, 2, 3, 12, 13) for end in (".", '?" )', ". small", " …", "")]
    texts += [", , ,,", "a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p", "x y z ,,, 1 2\n" * 3, "", "(a b c, d e.) F g h, `i j`, https://k.l, 4 5!"]
    assert agree(spark, tmp_path, "tail_length_match", texts)
    plan = catalogue.QUERIES["tail_length_match"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_runs_of_documents_are_counted_as_hashes(spark, tmp_path, monkeypatch):
    """gram_documents agrees with SQL on odd texts, and where all runs share one hash; the reading in place has the windows' runs of every length."""
    texts = ["In the, in the `x` in the. In the\nin the", "the in the — in the 3 in", "In the the in … The in the", ""] * 30
    rows = [(n, t, f"s{n % 17}") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for hashed in (functions.xxhash64, lambda c: functions.length(c) * 0):
        monkeypatch.setattr(corpus.F, "xxhash64", hashed)
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = catalogue.QUERIES["gram_documents"](spark, str(tmp_path))
        result = con.sql(catalogue.ORACLES["gram_documents"])
        expected = sorted(tuple(dict(zip(result.columns, r))[c] for c in found.columns) for r in result.fetchall())
        assert sorted(map(tuple, found.collect())) == expected and len({r[0] for r in expected}) > 1
    blocks = tokens.line_blocks(docs)
    for n in (1, 2, 3, 4):
        columns = ["doc_id", "block_id", "pos", "gram"]
        assert sorted(map(tuple, tokens.line_runs(blocks, n).select(columns).collect())) == sorted(map(tuple, tokens.ngrams(tokens.tokens(blocks), n).select(columns).collect()))
