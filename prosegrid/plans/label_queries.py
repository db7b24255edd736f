"""Queries of the label flow, run comparisons and the rest of the corpus report, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.functions import codes, draws
from prosegrid.functions import text as T
from prosegrid.operators import candidates, chars, corpus, labelling, settings
from prosegrid.operators import tokens as K
from prosegrid.plans.fragments import SENTENCES, SIDES, TOKENS, generated, grams, label_seed, quoted
from prosegrid.sources.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Characters per punctuation mark: what a voter who counts them says of a document.
GUESS = "(len(regexp_extract_all(text, '[#$%&*!|]')) < 0.02 * length(text))::INT"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality, toxic, and a rule of thumb's guess at quality."""
    marks = F.regexp_count("text", F.lit("[#$%&*!|]"))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.withColumn("guess", (marks < 0.02 * F.char_length("text")).cast("int"))


JUDGED = f"judged AS (SELECT d.*, l.quality, l.toxic, {GUESS} AS guess FROM documents d JOIN labels l USING (doc_id))"


@query("SELECT doc_id FROM documents ORDER BY sha256('audit:' || doc_id), doc_id LIMIT 100")
def audit_draw(spark, sf_dir):
    return labelling.drawn(table(spark, sf_dir, "documents").select("doc_id"), "audit", "doc_id", 100)


@query("SELECT doc_id, sha256('shuffle:' || doc_id) AS place FROM documents")
def shuffle_places(spark, sf_dir):
    """Each document's place in a seeded shuffle, which no partitioning changes."""
    return table(spark, sf_dir, "documents").select("doc_id", labelling.order_key("shuffle", F.col("doc_id")).alias("place"))


@query("""
    WITH cells AS (SELECT lang, source, quality, least(count(*), 4) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
    sources AS (SELECT lang, source, least(sum(n), 6) AS n FROM cells GROUP BY ALL)
    SELECT lang, sum(n)::BIGINT AS capacity FROM sources GROUP BY lang""")
def draw_capacity(spark, sf_dir):
    """How many documents of a language a draw could give: four of a source's quality class, six of a source."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return labelling.capacity(docs, ["lang"], [("quality", 4), ("source", 6)])


@query(r"SELECT doc_id, round(len(regexp_extract_all(text, '[?!…]')) / (len(regexp_extract_all(text, '[^\s]+')) + 4), 9) AS score FROM documents ORDER BY len(regexp_extract_all(text, '[?!…]')) / (len(regexp_extract_all(text, '[^\s]+')) + 4) DESC, doc_id LIMIT 50")
def unsure_documents(spark, sf_dir):
    """Points over words and four, the highest first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[?!…]")).alias("points"), F.regexp_count("text", F.lit(r"[^\s]+")).alias("words"))
    return labelling.unsure_first(docs, "points", "words", "doc_id", 50).select("doc_id", F.round("score", 9).alias("score"))


@query(f"""
    WITH g AS (SELECT doc_id, {GUESS} AS tag FROM documents)
    SELECT doc_id, coalesce(l.quality, CASE WHEN g.tag = 1 THEN 1 END) AS tag, CASE WHEN l.quality IS NOT NULL THEN 'adjudicated' WHEN g.tag = 1 THEN 'agreed' ELSE 'open' END AS source FROM g FULL JOIN labels l USING (doc_id)""")
def assembled_gold(spark, sf_dir):
    """The labels where there are any, else the guesses that say good."""
    marks = F.regexp_count("text", F.lit("[#$%&*!|]"))
    guess = (marks < 0.02 * F.char_length("text")).cast("int")
    agreed = table(spark, sf_dir, "documents").select("doc_id", F.when(guess == 1, guess).alias("tag"))
    return labelling.assembled(agreed, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("tag")), ["doc_id"], "tag")


@query(f"""
    WITH {JUDGED}, v AS (SELECT 'marks' AS voter, lang, guess = quality AS ok FROM judged UNION ALL SELECT 'toxic', lang, (1 - toxic) = quality FROM judged)
    SELECT voter, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS split, count(*) AS words, sum(ok::INT)::BIGINT AS "right", round(sum(ok::INT) / count(*), 6) AS share FROM v GROUP BY GROUPING SETS ((voter, lang), (voter))""")
def accuracy_table(spark, sf_dir):
    """Two voters on quality by language and over all."""
    rows = judged(spark, sf_dir)
    votes = rows.select(F.lit("marks").alias("voter"), "lang", (F.col("guess") == F.col("quality")).alias("ok")).unionAll(rows.select(F.lit("toxic"), "lang", (1 - F.col("toxic")) == F.col("quality")))
    return labelling.accuracy_table(votes, "voter", "lang", F.col("ok")).withColumn("share", F.round("share", 6))


@query(f"""
    WITH {JUDGED}, m AS (SELECT *, guess = 1 - toxic AS agree, guess = quality AS ok, length(text) >= 500 AS sure FROM judged)
    SELECT lang, CASE WHEN agree AND ok AND sure THEN 'listed' WHEN agree AND NOT ok AND sure THEN 'sure and wrong' WHEN agree AND NOT ok THEN 'wrong' WHEN agree AND NOT sure THEN 'not sure' ELSE 'disputed' END AS verdict, count(*) AS n FROM m GROUP BY ALL""")
def must_pass(spark, sf_dir):
    """Documents on which two voters agree, rightly and surely, and why others aren't listed."""
    rows = labelling.must_pass(judged(spark, sf_dir), F.col("guess") == 1 - F.col("toxic"), F.col("guess") == F.col("quality"), F.char_length("text") >= 500)
    return rows.groupBy("lang", F.when(F.col("listed"), "listed").otherwise(F.col("miss")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""
    WITH {JUDGED}, g AS (SELECT source, count(*) AS n, sum((guess = quality)::INT)::BIGINT AS agreed FROM judged GROUP BY source)
    SELECT source, n, agreed, CASE WHEN n < 10 THEN 'not judged' WHEN agreed >= 0.9 * n THEN 'pass' ELSE 'fail' END AS verdict FROM g""")
def audit_score(spark, sf_dir):
    return labelling.audit(judged(spark, sf_dir), "source", F.col("guess") == F.col("quality"), 0.9, 10)


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def cost_table(spark, sf_dir):
    """Events standing in for calls of models: how many of each, and their summed value."""
    return labelling.cost_table(table(spark, sf_dir, "events"), "event_type", ["value"]).withColumn("value", F.round("value", 4))


@query("SELECT lang, source, n_chars FROM documents WHERE (lang, source, n_chars) NOT IN (SELECT d.lang, d.source, d.n_chars FROM documents d JOIN labels USING (doc_id))")
def added_entries(spark, sf_dir):
    """Rows whose keys no labelled document has."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars", "doc_id")
    base = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelling.added_entries(docs.drop("doc_id"), base, ["lang", "source", "n_chars"])


@query(r"""
    WITH a AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
    b AS (SELECT doc_id, unnest(string_split(lower(replace(text, chr(10), ' ')), ' ')) AS w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) AS pos FROM documents)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) FILTER (a.w IS NOT NULL AND b.w IS NOT NULL) AS pairs, count(*) FILTER (a.w = b.w) AS same, count(*) FILTER (a.w IS NULL OR b.w IS NULL) AS unmatched
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos GROUP BY 1""")
def zipped_words(spark, sf_dir):
    """Two ways to split a text, word by word."""
    docs = table(spark, sf_dir, "documents")
    split = lambda c: docs.select("doc_id", F.posexplode(F.split(c, " ")).alias("pos", "w"))
    return labelling.zipped(split(F.col("text")), split(F.lower(F.replace("text", F.lit("\n"), F.lit(" ")))), "doc_id", "pos", "w")


SPANS = """
    days AS (SELECT l_orderkey AS k, l_linenumber AS n, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT AS e, l_returnflag AS flag, l_tax FROM lineitem)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"), F.col("l_returnflag").alias("flag"), "l_tax")


@query(f"WITH {SPANS}, o AS (SELECT * FROM days WHERE e - s >= 30) SELECT k, n FROM days d WHERE e - s < 30 AND EXISTS (SELECT 1 FROM o WHERE o.k = d.k AND o.s <= d.s AND d.e <= o.e)")
def contained_spans(spark, sf_dir):
    """Short spans within a long one of the same order."""
    days = _days(spark, sf_dir)
    return labelling.contained(days.where(F.col("end") - F.col("start") < 30), days.where(F.col("end") - F.col("start") >= 30), "k").select("k", "n")


@query(f"""
    WITH {SPANS}, a AS (SELECT DISTINCT k, s, e, flag AS kind FROM days WHERE l_tax < 0.06), b AS (SELECT DISTINCT k, s, e + (l_tax > 0.04)::INT AS e, CASE WHEN n % 3 = 0 THEN 'X' ELSE flag END AS kind FROM days WHERE l_tax > 0.01),
    m AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, coalesce(a.e, b.e) AS e, a.kind AS x, b.kind AS y FROM a FULL JOIN b ON a.k = b.k AND a.s = b.s AND a.e = b.e),
    la AS (SELECT DISTINCT k, s, e FROM m WHERE y IS NULL), lb AS (SELECT DISTINCT k, s, e FROM m WHERE x IS NULL),
    buckets AS (
        SELECT CASE WHEN x = y THEN 'equal' ELSE 'kind differs' END AS bucket FROM m WHERE x IS NOT NULL AND y IS NOT NULL
        UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM lb WHERE lb.k = la.k AND la.s < lb.e AND lb.s < la.e) THEN 'overlap' ELSE 'missing' END FROM la
        UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM la WHERE lb.k = la.k AND la.s < lb.e AND lb.s < la.e) THEN 'overlap' ELSE 'extra' END FROM lb)
    SELECT bucket, count(*) AS n FROM buckets GROUP BY bucket""")
def compared_ranges(spark, sf_dir):
    """Two scanners' ranges within orders, by how they agree."""
    days = _days(spark, sf_dir)
    oracle = days.where("l_tax < 0.06").select("k", "start", "end", F.col("flag").alias("kind"))
    scanner = days.where("l_tax > 0.01").select("k", "start", (F.col("end") + (F.col("l_tax") > 0.04).cast("int")).alias("end"), F.when(F.col("n") % 3 == 0, "X").otherwise(F.col("flag")).alias("kind"))
    return labelling.compared_ranges(oracle, scanner, "k").groupBy("bucket").agg(F.count("*").alias("n"))


MARKS = [("secure", "^https:"), ("query", r"\?"), ("anchor", "#"), ("blog", "://blog\\."), ("french", "/fr/")]


@query("SELECT page_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(url, '{p}') THEN '{n}' END" for n, p in MARKS) + "], lambda x: x IS NOT NULL)), ' ') AS marks FROM pages")
def marked_pages(spark, sf_dir):
    """Which of a table of patterns an address has, as commits are searched for agents' marks."""
    return labelling.marked_by(table(spark, sf_dir, "pages"), "url", MARKS).select("page_id", F.array_join("marks", " ").alias("marks"))


def _tally_draws(columns: str) -> str:
    """Each language's tallies by source, drawn again by its own seed and summed: sums(lang, replicate, ...)."""
    names = [c.split(" AS ")[1] for c in columns.split(", ")]
    return f"""
    WITH RECURSIVE {JUDGED}, tallies AS (SELECT lang, source, count(*) AS n, {columns} FROM judged GROUP BY lang, source),
    listed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS unit, count(*) OVER (PARTITION BY lang) AS units FROM tallies),
    seeds AS (SELECT lang AS k, {label_seed("lang")} AS seed, {draws.REPLICATES} * any_value(units) AS most FROM listed GROUP BY lang), {generated("seeds")},
    times AS (SELECT k AS lang, i // units AS replicate, (v % units)::BIGINT AS unit, count(*) AS times FROM drawn JOIN (SELECT DISTINCT lang, units FROM listed) l ON l.lang = k GROUP BY ALL),
    sums AS (SELECT lang, replicate, sum(n * times) AS n, {", ".join(f"sum({x} * times) AS {x}" for x in names)} FROM listed JOIN times USING (lang, unit) GROUP BY ALL),
    whole AS (SELECT lang, sum(n) AS n, {", ".join(f"sum({x}) AS {x}" for x in names)} FROM tallies GROUP BY lang)"""


@query(f"""{_tally_draws("sum((guess = quality)::INT) AS correct")},
    ranged AS (SELECT lang, quantile_disc(correct / n, 0.025) AS low, quantile_disc(correct / n, 0.975) AS high FROM sums GROUP BY lang)
    SELECT lang, round(correct / n, 9) AS share, round(low, 9) AS low, round(high, 9) AS high FROM whole JOIN ranged USING (lang)""")
def accuracy_intervals(spark, sf_dir):
    """Each language's accuracy with its interval over exact draws of sources."""
    tallies = judged(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum((F.col("guess") == F.col("quality")).cast("int")).alias("right"))
    found = labelling.share_intervals(tallies, "lang", "source")
    return found.select("lang", *(F.round(c, 9).alias(c) for c in ("share", "low", "high")))


@query(f"""{_tally_draws("sum((1 - toxic = quality)::INT) AS former, sum((guess = quality)::INT) AS latter")},
    ranged AS (SELECT lang, quantile_disc(latter / n - former / n, 0.025) AS low, quantile_disc(latter / n - former / n, 0.975) AS high FROM sums GROUP BY lang)
    SELECT lang, round(former / n, 9) AS before, round(latter / n, 9) AS after, round(low, 9) AS low, round(high, 9) AS high,
        CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'same' END AS verdict FROM whole JOIN ranged USING (lang)""")
def accuracy_differences(spark, sf_dir):
    """Two voters' accuracy, draw by draw."""
    right = lambda c: F.sum((c == F.col("quality")).cast("int"))
    tallies = judged(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), right(1 - F.col("toxic")).alias("before"), right(F.col("guess")).alias("after"))
    found = labelling.paired_difference(tallies, "lang", "source")
    return found.select("lang", *(F.round(c, 9).alias(c) for c in ("before", "after", "low", "high")), "verdict")


@query(f"""{_tally_draws("sum((guess = quality)::INT) AS correct")},
    gaps AS (SELECT max(correct / n) FILTER (lang = 'de') - max(correct / n) FILTER (lang = 'en') AS gap FROM sums GROUP BY replicate),
    ranged AS (SELECT quantile_disc(gap, 0.025) AS low, quantile_disc(gap, 0.975) AS high FROM gaps WHERE gap IS NOT NULL)
    SELECT (SELECT round(correct / n, 9) FROM whole WHERE lang = 'en') AS before, (SELECT round(correct / n, 9) FROM whole WHERE lang = 'de') AS after,
        round(low, 9) AS low, round(high, 9) AS high, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'same' END AS verdict FROM ranged""")
def accuracy_gap(spark, sf_dir):
    """The accuracy on one language less that on another, each drawn by itself."""
    tallies = judged(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum((F.col("guess") == F.col("quality")).cast("int")).alias("right"))
    found = labelling.unpaired_difference(tallies, "lang", "source", "en", "de")
    return found.select(*(F.round(c, 9).alias(c) for c in ("before", "after", "low", "high")), "verdict")


# N-grams and words


@query(f"""
    WITH {TOKENS}, g AS ({grams(2)}), kept AS (SELECT gram FROM g JOIN documents USING (doc_id) GROUP BY gram HAVING count(DISTINCT source) >= 15)
    SELECT gram, doc_id, count(*) AS n, min(block_id * 1000000 + pos)::BIGINT AS first FROM g SEMI JOIN kept USING (gram) GROUP BY gram, doc_id""")
def gram_documents(spark, sf_dir):
    """The kept bigrams in every document: how often, and where first (line and place in it)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), "text")
    lines = lambda rows, *keys: rows.select(*keys, F.posexplode(F.split("text", "\n")).alias("block_id", "text"))
    # Repositories are counted where the texts lie; where runs of a document meet, its text is dealt, which is less than its runs.
    dealt = docs.select(F.struct("doc_id", "repo").alias("doc_id"), "text").repartition("doc_id")
    found = corpus.gram_documents(K.line_runs(lines(K.spread(docs), "doc_id", "repo"), 2), K.ngrams(K.tokens(lines(dealt, "doc_id")), 2), 15)
    return found.select("gram", "doc_id", "n", (F.col("first.block_id").cast("long") * 1_000_000 + F.col("first.pos")).alias("first"))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS words, count(*) FILTER (folded IN ({quoted(T.ENGLISH)})) AS known, count(DISTINCT folded) FILTER (folded IN ({quoted(T.ENGLISH)})) AS types FROM tokens WHERE kind = 'Word' GROUP BY doc_id")
def known_words(spark, sf_dir):
    """How many words of a document a vocabulary knows."""
    words = K.tokens(K.line_blocks(table(spark, sf_dir, "documents"))).where("kind = 'Word'")
    vocabulary = spark.createDataFrame([(w,) for w in dict.fromkeys(T.ENGLISH)], "folded string").withColumn("known", F.lit(True))
    met = words.join(F.broadcast(vocabulary), "folded", "left")
    return met.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("known").alias("known"), F.count_distinct(F.when(F.col("known"), F.col("folded"))).alias("types"))


@query(f"""
    WITH {TOKENS}, hits AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, folded, lead(folded) OVER (PARTITION BY doc_id, block_id ORDER BY pos) AS f1 FROM tokens) WHERE folded = 'of' AND f1 = 'the' GROUP BY doc_id)
    SELECT quality AS label, count(*) AS files, count(n) AS hit_files, coalesce(sum(n), 0)::BIGINT AS matches FROM documents JOIN labels USING (doc_id) LEFT JOIN hits USING (doc_id) GROUP BY quality""")
def pattern_rates(spark, sf_dir):
    """Documents with a pattern and its matches, by label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"))
    runs = K.ngrams(K.tokens(K.line_blocks(table(spark, sf_dir, "documents"), windowed=True)), 2).where("gram = 'of the'")
    return corpus.pattern_rates(docs, runs.groupBy("doc_id").agg(F.count("*").alias("n")))


DECIDED = ["of the", "in the", "to the"]


@query(rf"""
    WITH {TOKENS}, {SIDES}, g AS (SELECT * FROM ({grams(2)}) UNION ALL SELECT * FROM ({grams(3)})),
    found AS (SELECT gram, doc_id, side, repo, toxic, count(*) AS c FROM g JOIN sides USING (doc_id) JOIN labels USING (doc_id) GROUP BY ALL),
    by_repo AS (SELECT gram, side, repo, count(*) AS files, sum(c) AS c FROM found GROUP BY ALL),
    wide AS (
        SELECT gram, count(*) FILTER (side = 0) AS repos, max(files) FILTER (side = 0) / sum(files) FILTER (side = 0) AS share,
            (coalesce(sum(c) FILTER (side = 0), 0) + 0.5) / (coalesce(sum(c) FILTER (side = 1), 0) + 0.5) AS ratio FROM by_repo GROUP BY gram),
    tools AS (SELECT gram, count(DISTINCT toxic) AS tools FROM found WHERE side = 0 GROUP BY gram),
    elsewhere AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark)),
    s AS (
        SELECT w.*, repos >= 3 AS a, repos >= 3 AND share <= 0.5 AS b, repos >= 3 AND share <= 0.5 AND e.gram IS NULL AS c, repos >= 3 AND share <= 0.5 AND e.gram IS NULL AND ratio >= 0.1 AS d,
            repos >= 3 AND share <= 0.5 AND e.gram IS NULL AND ratio >= 0.1 AND tools >= 2 AS e, repos >= 3 AND share <= 0.5 AND e.gram IS NULL AND ratio >= 0.1 AND tools >= 2 AND w.gram NOT IN ({quoted(DECIDED)}) AS f
        FROM wide w LEFT JOIN tools t ON t.gram = w.gram LEFT JOIN elsewhere e ON e.gram = w.gram),
    kept AS (SELECT gram FROM s WHERE f), held AS (SELECT DISTINCT x.gram FROM kept x, kept y WHERE x.gram <> y.gram AND contains(' ' || x.gram || ' ', ' ' || y.gram || ' '))
    SELECT 0 AS step, 'enough_repos' AS name, count(*) FILTER (a) AS "left" FROM s UNION ALL SELECT 1, 'spread', count(*) FILTER (b) FROM s UNION ALL SELECT 2, 'not_elsewhere', count(*) FILTER (c) FROM s
    UNION ALL SELECT 3, 'ratio', count(*) FILTER (d) FROM s UNION ALL SELECT 4, 'tools', count(*) FILTER (e) FROM s UNION ALL SELECT 5, 'undecided', count(*) FILTER (f) FROM s
    UNION ALL SELECT 6, 'merged', (SELECT count(*) FROM kept) - (SELECT count(*) FROM held)""")
def candidate_sieve(spark, sf_dir):
    """The whole sieve over runs of two and three tokens: repositories, spread, a guard, a ratio, tools, what is decided, and the merge."""
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.col("source").alias("repo")).join(labels.select("doc_id", F.col("quality").alias("side"), "toxic"), "doc_id")
    # Only texts that have a side are taken apart; the join deals them by document.
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(docs.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    tokens = K.tokens(texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_id", "text")))
    # Both lengths from one reading, and all that the steps ask of a run from one grouping.
    found = K.runs(tokens, 2, 3).join(docs, "doc_id").groupBy("gram", "doc_id", "side", "repo", "toxic").agg(F.count("*").alias("c"))
    by_repo = found.groupBy("gram", "side", "repo").agg(F.count("*").alias("files"), F.sum("c").alias("c"), F.collect_set("toxic").alias("tools"))
    focus = lambda c: F.when(F.col("side") == 0, F.col(c))
    total = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("c"))), F.lit(0)) + 0.5
    tools = F.size(F.array_distinct(F.flatten(F.collect_list(focus("tools")))))
    wide = by_repo.groupBy("gram").agg(F.count(focus("files")).alias("repos"), (F.max(focus("files")) / F.sum(focus("files"))).alias("share"), (total(0) / total(1)).alias("ratio"), tools.alias("tools"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.array_join(F.slice("ws", i, F.lit(2)), " "))
    guard = table(spark, sf_dir, "benchmark").select(words.alias("ws")).where(F.size("ws") >= 2).select(F.explode(pairs).alias("gram")).distinct().withColumn("guarded", F.lit(True))
    wide = stored(wide.join(guard, "gram", "left"), "wide")
    steps = [("enough_repos", F.col("repos") >= 3), ("spread", F.col("share") <= 0.5), ("not_elsewhere", F.col("guarded").isNull()), ("ratio", F.col("ratio") >= 0.1), ("tools", F.col("tools") >= 2), ("undecided", ~F.col("gram").isin(DECIDED))]
    return corpus.sieve(wide, steps)[1]


# Texts


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM (SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || chr(10)), chr(13), '') AS text FROM documents)),
    b AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l WHERE regexp_matches(line, '[^\s]'))
    SELECT doc_id, min(n)::INT AS first_line, max(n)::INT AS last_line, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM b GROUP BY doc_id, island""")
def plain_paragraphs(spark, sf_dir):
    """Plain-text paragraphs, of texts in which a blank line follows each sentence."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit("\r"), F.lit(""))
    rows = corpus.plain_blocks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    lines = F.split("text", "\n")
    return rows.select("doc_id", "first_line", "last_line", F.size(lines).cast("long").alias("lines"), (F.char_length("text") - F.size(lines) + 1).cast("long").alias("chars"))


REPLACED = [(chr(a), r) for rules in chars.GROUPS.values() for a, b, _, r in rules if a == b and r is not None and not any(c.isalnum() for c in r)]
_FIXED = "text"
for _c, _r in dict(reversed(REPLACED)).items():
    _FIXED = f"replace({_FIXED}, chr({ord(_c)}), {quoted([_r])})"


@query(f"SELECT doc_id, sha256({_FIXED}) AS fixed, {_FIXED} <> text AS changed FROM documents")
def fixed_texts(spark, sf_dir):
    """Texts with the characters replaced that have one replacement, until nothing changes."""
    found = chars.fixed_to_fixpoint(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", list(chars.GROUPS))
    return found.select("doc_id", F.sha2("_fixed", 256).alias("fixed"), (F.col("_fixed") != F.col("text")).alias("changed"))


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(path, '\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(path, '\.html?$') THEN 'html' WHEN regexp_matches(path, '\.txt$') OR regexp_matches(path, '/[0-9]+$') THEN 'plain' ELSE 'none' END AS reader FROM p""")
def reader_of_page(spark, sf_dir):
    """The reader of each path: the first rule of an ordered table that fits."""
    rules = [("markdown", r"\.(md|markdown)$"), ("html", r"\.html?$"), ("plain", r"\.txt$"), ("plain", "/[0-9]+$")]
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return pages.select("page_id", settings.reader(F.col("path"), rules).alias("reader"))


@query(r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    entries AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'no such line' WHEN doc_id % 4 = 2 THEN '' ELSE replace(string_split(text, chr(10))[-1], ' ', '   ') END AS quote FROM documents),
    m AS (SELECT e.doc_id AS entry, count(l.n) AS n, bool_or(length(l.text) > 100) AS long FROM entries e LEFT JOIN lines l ON l.doc_id = e.doc_id AND lower(trim(regexp_replace(l.text, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(e.quote, '\s+', ' ', 'g'))) GROUP BY 1)
    SELECT entry, CASE WHEN n = 0 THEN 'no such line' WHEN n > 1 THEN 'two lines' WHEN NOT long THEN 'no finding' ELSE 'applied' END AS status FROM m""")
def allow_lines(spark, sf_dir):
    """Exemptions of lines: an entry for each document, some broken by construction, against lines that are too long."""
    docs = table(spark, sf_dir, "documents")
    lines = K.line_blocks(docs).select(F.col("doc_id").alias("path"), F.col("block_id").alias("sent_id"), "text")
    findings = lines.where(F.char_length("text") > 100).select("path", "sent_id", F.lit("banned_chars").alias("lint"))
    quote = F.when(F.col("doc_id") % 4 == 1, "no such line").when(F.col("doc_id") % 4 == 2, "").otherwise(F.replace(F.element_at(F.split("text", "\n"), -1), F.lit(" "), F.lit("   ")))
    entries = docs.select(F.col("doc_id").alias("entry"), F.col("doc_id").alias("path"), F.lit("banned_chars").alias("lint"), quote.alias("quote"))
    return settings.settled(entries, lines, findings, docs.select(F.col("doc_id").alias("path")), unit="line").select("entry", "status")


@query("""
    SELECT section, key, label, count(*) AS files, count(DISTINCT source) AS repos, sum(n_chars)::BIGINT AS chars FROM (
        SELECT 'all' AS section, '' AS key, quality AS label, source, n_chars FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT 'lang', lang, quality, source, n_chars FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT 'toxic', toxic::VARCHAR, quality, source, n_chars FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END, quality, source, n_chars FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def corpus_summary(spark, sf_dir):
    """All of a corpus' facets in one table and one pass: files, sources and characters by label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return corpus.summary(docs.withColumn("size", size), ["lang", "toxic", "size"], "quality", "source", "n_chars")


# Candidates, junk, readings and spelling


@query("""
    WITH c AS (SELECT doc_id AS key, list_distinct([source, lang]) AS sources, doc_id % 3 = 0 AS agent, n_chars % 2 = 0 AS early FROM documents),
    e AS (SELECT key, unnest(sources) AS source FROM c), z AS (SELECT source, count(*) AS size FROM e GROUP BY source),
    r AS (SELECT key, arg_min(source, (size, source)) AS rarest FROM e JOIN z USING (source) GROUP BY key),
    n AS (SELECT c.key, CASE WHEN agent AND early THEN 0 WHEN agent THEN 1 ELSE 2 END AS rank, rarest FROM c JOIN r USING (key))
    SELECT key, rank, row_number() OVER (PARTITION BY rank, rarest ORDER BY sha256('7:' || key), key) - 1 AS turn, rarest FROM n""")
def candidate_order(spark, sf_dir):
    """Documents as candidates found by their source and language: rank, and turn of the rarest of the two."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("key"), F.array("source", "lang").alias("sources"), (F.col("doc_id") % 3 == 0).alias("agent"), (F.col("n_chars") % 2 == 0).alias("early"))
    return candidates.ordered_candidates(rows, "7")


@query(rf"""
    WITH {TOKENS}, {SENTENCES}, known AS (SELECT folded FROM tokens WHERE kind = 'Word' GROUP BY folded HAVING count(DISTINCT doc_id) >= 20),
    facts AS (
        SELECT doc_id, block_id, sent_id, count(*) FILTER (kind = 'Word') AS words, count(*) FILTER (kind = 'Number') AS numbers, count(*) FILTER (kind IN ('Code', 'Url')) AS code_words,
            count(*) FILTER (kind = 'Word' AND regexp_replace(s.folded, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') IN ({quoted(candidates.LOREM)})) AS lorem,
            count(*) FILTER (kind = 'Word' AND known.folded IS NULL) AS unknown
        FROM sents s LEFT JOIN known ON known.folded = s.folded GROUP BY ALL
    )
    SELECT doc_id, block_id::BIGINT AS block_id, sent_id::BIGINT AS sent_id, CASE WHEN lorem >= 2 AND lorem * 2 >= words THEN 'lorem' WHEN numbers >= 3 AND numbers >= words THEN 'versions'
        WHEN words > 0 AND code_words * 2 >= words THEN 'command' WHEN (words >= 5 AND unknown * 2 > words) OR (words >= 10 AND unknown * 100 >= 45 * words) THEN 'not english' END AS junk FROM facts
    WHERE junk IS NOT NULL""")
def junk_sentences(spark, sf_dir):
    """Sentences that are no English prose, where the words of twenty documents are known."""
    rows = K.sentences(K.tokens(K.line_blocks(table(spark, sf_dir, "documents"), windowed=True)))
    known = rows.where("kind = 'Word'").groupBy("folded").agg(F.count_distinct("doc_id").alias("n")).where("n >= 20").select("folded")
    found = candidates.sentence_facts(rows, known).withColumn("junk", candidates.junk()).where("junk is not null")
    return found.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("sent_id").cast("long").alias("sent_id"), "junk")


@query(f"""
    WITH {TOKENS}, told AS (SELECT folded AS form, CASE lang WHEN 'en' THEN 'noun' WHEN 'de' THEN 'verb' ELSE lang END AS tag, count(*) AS met, count(DISTINCT source) AS senses
        FROM tokens t JOIN documents d USING (doc_id) WHERE kind = 'Word' GROUP BY ALL),
    keyed AS (SELECT *, met / CASE tag WHEN 'noun' THEN 2 WHEN 'verb' THEN 4 ELSE 1 END AS weight, CASE tag WHEN 'noun' THEN 1 WHEN 'verb' THEN 2 ELSE 3 END AS fixed FROM told),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY weight DESC, senses DESC, fixed, tag) AS r FROM keyed)
    SELECT form, string_agg(tag, ' ' ORDER BY r) AS tags, CASE WHEN max(met) FILTER (r = 1) >= 5 AND max(met) FILTER (r = 1) >= 0.9::DOUBLE * sum(met) THEN max(tag) FILTER (r = 1) END AS dominant FROM ranked GROUP BY form""")
def ranked_readings(spark, sf_dir):
    """Each word's languages as readings, ranked, and the one that dominates."""
    docs = table(spark, sf_dir, "documents")
    words = K.tokens(K.line_blocks(docs)).where("kind = 'Word'").join(docs.select("doc_id", "lang", "source"), "doc_id")
    tag = F.when(F.col("lang") == "en", "noun").when(F.col("lang") == "de", "verb").otherwise(F.col("lang"))
    told = words.groupBy(F.col("folded").alias("form"), tag.alias("tag")).agg(F.count("*").alias("met"), F.count_distinct("source").alias("senses")).withColumn("place", F.lit(None).cast("int"))
    return candidates.ranked_readings(told, ["noun", "verb"])


@query(f"""
    WITH {TOKENS}, g AS ({grams(2)}), runs AS (
        SELECT doc_id, block_id, pos, text || CASE WHEN lead(spaced) OVER w THEN ' ' ELSE '' END || lead(text) OVER w AS phrase FROM tokens WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY pos)
    )
    SELECT gram, arg_min(phrase, (doc_id, block_id, pos)) AS phrase FROM g JOIN runs USING (doc_id, block_id, pos) GROUP BY gram""")
def gram_spelling(spark, sf_dir):
    """Each bigram with the spacing of its first place."""
    rows = K.tokens(K.line_blocks(table(spark, sf_dir, "documents"), windowed=True))
    return candidates.spelled(K.ngrams(rows, 2).join(candidates.spaced_runs(rows, 2), ["doc_id", "block_id", "pos"]))


#: Codes that words get by their length, what each is in a treebank (and, if it isn't the same, as a code again), or what is wrong with it.
CODED = [
    ("N.s", "NOUN", "Number=Sing", None), ("PN.p", "PROPN", "Number=Plur", None), ("V.pp", "VERB", "Tense=Past|VerbForm=Part", None), ("AX.fi", "AUX", "VerbForm=Fin", None), ("C", None, "_", None), ("PR", "PRON", "_", None), ("X", "X", "_", None),
    ("V", None, None, "needs a form"), ("N", None, None, "needs a number"), ("J.s", None, None, "takes no feature"), ("N.x", None, None, "no number"), ("V.s", None, None, "no form"), ("Q", None, None, "no code"), ("V.ing", "VERB", "VerbForm=Ger", None), ("AX.pr", "AUX", "Tense=Pres|VerbForm=Fin", None),
]
_CODED_ROWS = ", ".join(f"({n}, {', '.join('NULL' if x is None else quoted([x]) for x in row)})" for n, row in enumerate(CODED))


@query(f"""
    WITH {TOKENS}, c(k, code, upos, feats, problem) AS (VALUES {_CODED_ROWS}),
    w AS (SELECT folded, kind FROM tokens WHERE kind = 'Word')
    SELECT code, CASE WHEN code = 'C' THEN CASE WHEN folded IN ({quoted(codes.COORDINATORS)}) THEN 'CCONJ' ELSE 'SCONJ' END ELSE upos END AS upos, feats, problem,
        CASE WHEN problem IS NULL THEN code END AS again, count(*) AS n FROM w JOIN c ON c.k = length(folded) % {len(CODED)} GROUP BY ALL""")
def coded_words(spark, sf_dir):
    """All words with a code by their length: its UPOS and FEATS, the code that these give, or what is wrong with it."""
    words = K.tokens(K.line_blocks(table(spark, sf_dir, "documents"))).where("kind = 'Word'")
    code = F.get(F.array(*(F.lit(c) for c, *_ in CODED)), (F.char_length("folded") % len(CODED)).cast("int"))
    told = words.select("folded", code.alias("code")).withColumn("t", codes.to_treebank(F.col("code"), F.col("folded"))).withColumn("problem", codes.problem(F.col("code")))
    again = codes.from_treebank(F.col("t.upos"), F.col("t.feats"))
    return told.groupBy("code", "t.upos", "t.feats", "problem", again.alias("again")).agg(F.count("*").alias("n"))
