"""The queries on the driver's tables, by name, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrid.functions import draws, globs, stats
from prosegrid.functions import text as T
from prosegrid.operators import chars, corpus, exam, lints, rules, sampling, settings
from prosegrid.operators import patterns as P
from prosegrid.operators import tokens as K
from prosegrid.plans import label_queries, layer_queries, lint_queries
from prosegrid.plans.fragments import RULE_VALUES, SENTENCES, SIDES, TOKENS, generated, grams, quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**lint_queries.QUERIES, **label_queries.QUERIES, **layer_queries.QUERIES}
ORACLES: dict[str, str] = {**lint_queries.ORACLES, **label_queries.ORACLES, **layer_queries.ORACLES}

#: A word list to compare the sides by.
WORDS = ["the", "and", "of", "thnd", "ering", "with", "tion"]


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tokens(spark: SparkSession, sf_dir: str, windowed: bool = False) -> DataFrame:
    return K.tokens(K.line_blocks(table(spark, sf_dir, "documents"), windowed))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, side, repo of labelled English documents."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.col("source").alias("repo"))
    return docs.join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("side")), "doc_id")


# Counts


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS tokens, count(*) FILTER (kind = 'Word') AS words, count(DISTINCT folded) AS types FROM tokens GROUP BY doc_id")
def doc_token_counts(spark, sf_dir):
    return K.document_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {TOKENS}, {SENTENCES} SELECT doc_id, count(DISTINCT (block_id, sent_id)) AS sentences FROM sents GROUP BY doc_id")
def sentence_counts(spark, sf_dir):
    return K.sentences(line_tokens(spark, sf_dir, True)).groupBy("doc_id").agg(F.count_distinct("block_id", "sent_id").alias("sentences"))


@query(f"WITH {TOKENS} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY kind")
def token_kind_histogram(spark, sf_dir):
    return line_tokens(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {TOKENS} SELECT folded, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens WHERE kind = 'Word' GROUP BY folded ORDER BY docs DESC, n DESC, folded LIMIT 200")
def vocab_top_k(spark, sf_dir):
    """The 200 most common words by documents."""
    words = line_tokens(spark, sf_dir).where("kind = 'Word'").groupBy("folded").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    return words.orderBy(F.desc("docs"), F.desc("n"), "folded").limit(200)


@query(r"""
    SELECT doc_id, octet_length(encode(text)) AS bytes, starts_with(text, chr(65279)) AS bom,
        CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' WHEN contains(text, chr(13)) THEN 'cr' WHEN contains(text, chr(10)) THEN 'lf' ELSE 'none' END AS line_endings,
        (len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines,
        len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS words,
        regexp_matches(text, '^\x{FEFF}?(---|\+\+\+)[ \t]*\r?\n') AS frontmatter
    FROM documents""")
def content_facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in T.content_facts(F.col("text")).items()))


@query(r"""
    SELECT lang, sum(len(regexp_extract_all(text, '\p{L}')))::BIGINT AS letters, sum(len(regexp_extract_all(text, '\p{Latin}')))::BIGINT AS latin,
        sum(len(regexp_extract_all(text, '\p{Greek}')))::BIGINT AS greek, sum(len(regexp_extract_all(text, '\p{Cyrillic}')))::BIGINT AS cyrillic, sum(len(regexp_extract_all(text, '\p{Han}')))::BIGINT AS han
    FROM documents GROUP BY lang""")
def script_histogram(spark, sf_dir):
    counts = T.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*(F.sum(c).cast("long").alias(n) for n, c in counts.items()))


@query(rf"""
    WITH counted AS (
        SELECT doc_id, lang, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Latin}}')) AS latin,
            list_filter(string_split_regex(lower(text), '[^\p{{L}}'']+'), lambda w: w <> '') AS words FROM documents
    )
    SELECT doc_id, lang, CASE WHEN letters < 40 THEN NULL WHEN latin > 0.8 * letters AND len(list_filter(words, lambda w: w IN ({quoted(T.ENGLISH)}))) > 0.12 * len(words) THEN 'en' ELSE 'other' END AS guess
    FROM counted""")
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.language_guess(F.col("text")).alias("guess"))


# Summary


@query("""
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(toxic) = 0 THEN 'toxic' END AS facet,
        coalesce(CAST(lang AS VARCHAR), CAST(source AS VARCHAR), CAST(toxic AS VARCHAR)) AS value, quality, count(*) AS files, count(DISTINCT source) AS repos
    FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (source, quality), (toxic, quality))""")
def facet_grouping_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("repo", F.col("source"))
    return corpus.facet_counts(docs.select("lang", "source", "toxic", "quality", "repo"), ["lang", "source", "toxic"], "quality", "repo").withColumnRenamed("label", "quality")


@query("""
    SELECT quality, count(*) AS files, count(DISTINCT source) AS repos, sum(octet_length(encode(text)))::BIGINT AS bytes, quantile_disc(n_chars, 0.25) AS lower,
        quantile_disc(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.75) AS upper
    FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def quality_quartiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return corpus.label_rows(docs, "quality", "source", "n_chars")


@query("SELECT lang, count(*) AS files, count(DISTINCT source) AS repos FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang HAVING count(DISTINCT source) >= 10")
def compared_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.count_distinct("source").alias("repos")).where("repos >= 10")


@query(r"""
    SELECT kind, count(*) AS n FROM (
        SELECT CASE WHEN regexp_matches(url, '\.html($|[?#])') THEN 'page' WHEN regexp_matches(url, '/(docs?|guide|wiki)(/|$)') THEN 'docs'
            WHEN contains(url, 'utm_') THEN 'feed' WHEN regexp_matches(url, '://(blog|news)\.') THEN 'blog' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE 'other' END AS kind FROM pages
    ) GROUP BY kind""")
def kind_of_page(spark, sf_dir):
    """An ordered choice of kinds by path: the first that fits."""
    url = F.col("url")
    kind = F.when(url.rlike(r"\.html($|[?#])"), "page").when(url.rlike("/(docs?|guide|wiki)(/|$)"), "docs").when(F.contains(url, F.lit("utm_")), "feed")
    kind = kind.when(url.rlike(r"://(blog|news)\."), "blog").when(url.rlike("#"), "anchor").otherwise("other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# Rates


RATES = f"""
    {TOKENS}, {SIDES}, prose AS (SELECT t.*, side, repo FROM tokens t JOIN sides USING (doc_id)),
    repos AS (SELECT side, repo, count(*) AS tokens FROM prose GROUP BY side, repo), n_repos AS (SELECT side, count(*) AS n FROM repos GROUP BY side),
    hits AS (SELECT folded AS gram, side, repo, count(*) AS n FROM prose WHERE kind = 'Word' AND folded IN ({quoted(WORDS)}) GROUP BY ALL),
    rates AS (
        SELECT gram, side, sum(h.n)::BIGINT AS occurrences, count(*) AS repos, sum(h.n * 1e6 / tokens) / any_value(n_repos.n) AS rate
        FROM hits h JOIN repos USING (side, repo) JOIN n_repos USING (side) GROUP BY gram, side
    )"""


def _word_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prose = line_tokens(spark, sf_dir).join(sides(spark, sf_dir), "doc_id")
    hits = prose.where((F.col("kind") == "Word") & F.col("folded").isin(WORDS)).groupBy(F.col("folded").alias("gram"), "side", "repo").agg(F.count("*").alias("n"))
    return hits, prose.groupBy("side", "repo").agg(F.count("*").alias("tokens"))


@query(f"WITH {RATES} SELECT gram, side, occurrences, repos, round(rate, 6) AS rate FROM rates")
def word_rate_by_side(spark, sf_dir):
    """Per-million rates of a word list, each repository weighing the same, on both sides."""
    return stats.repo_rates(*_word_hits(spark, sf_dir), "gram").select("gram", "side", "occurrences", "repos", F.round("rate", 6).alias("rate"))


@query(f"""
    WITH {RATES}, wide AS (
        SELECT gram, coalesce(max(occurrences) FILTER (side = 0), 0) AS focus_occurrences, coalesce(max(repos) FILTER (side = 0), 0) AS focus_repos, coalesce(max(rate) FILTER (side = 0), 0) AS focus_rate,
            coalesce(max(occurrences) FILTER (side = 1), 0) AS reference_occurrences, coalesce(max(repos) FILTER (side = 1), 0) AS reference_repos, coalesce(max(rate) FILTER (side = 1), 0) AS reference_rate
        FROM rates GROUP BY gram
    ), smooth AS (SELECT 0.5e6 / sum(tokens) AS s FROM repos WHERE side = 1)
    SELECT gram, focus_occurrences, focus_repos, round(focus_rate, 6) AS focus_rate, reference_occurrences, reference_repos, round(reference_rate, 6) AS reference_rate,
        round((focus_rate + s) / (reference_rate + s), 6) AS ratio FROM wide, smooth""")
def ratio_with_smoothing(spark, sf_dir):
    found = corpus.compared(*_word_hits(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("focus_rate", "reference_rate", "ratio")})


@query(f"""
    WITH RECURSIVE {RATES}, listed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY repo) - 1 AS unit FROM repos),
    seeds AS (SELECT 0 AS k, {draws.SEED}::UBIGINT AS seed, {draws.REPLICATES} * count(*) AS most FROM repos), {generated("seeds")},
    sized AS (SELECT coalesce(max(n) FILTER (side = 0), 0) AS n0, coalesce(max(n) FILTER (side = 1), 0) AS n1 FROM n_repos),
    placed AS (
        SELECT CASE WHEN i < {draws.REPLICATES} * n0 THEN 0 ELSE 1 END AS side, CASE WHEN i < {draws.REPLICATES} * n0 THEN i // n0 ELSE (i - {draws.REPLICATES} * n0) // n1 END AS replicate,
            (v % CASE WHEN i < {draws.REPLICATES} * n0 THEN n0 ELSE n1 END)::BIGINT AS unit FROM drawn, sized
    ), times AS (SELECT side, replicate, unit, count(*) AS times FROM placed GROUP BY ALL),
    means AS (
        SELECT gram, replicate, side, sum(h.n * 1e6 / tokens * times) / any_value(n_repos.n) AS mean
        FROM hits h JOIN listed USING (side, repo) JOIN times USING (side, unit) JOIN n_repos USING (side) GROUP BY ALL
    ), smooth AS (SELECT 0.5e6 / sum(tokens) AS s FROM repos WHERE side = 1),
    every AS (SELECT gram, unnest(range({draws.REPLICATES})) AS replicate FROM (SELECT DISTINCT gram FROM hits)),
    ratios AS (
        SELECT gram, replicate, (coalesce(max(mean) FILTER (side = 0), 0) + any_value(s)) / (coalesce(max(mean) FILTER (side = 1), 0) + any_value(s)) AS ratio
        FROM every LEFT JOIN means USING (gram, replicate), smooth GROUP BY gram, replicate
    )
    SELECT gram AS item, round(quantile_disc(ratio, 0.025), 6) AS low, round(quantile_disc(ratio, 0.975), 6) AS high FROM ratios GROUP BY gram""")
def bootstrap_interval(spark, sf_dir):
    """The middle 95 % of the smoothed ratio of each word over exact draws of repositories."""
    hits, repos = _word_hits(spark, sf_dir)
    rates = hits.join(repos, ["side", "repo"]).select(F.col("gram").alias("item"), "side", "repo", stats.per_million(F.col("n"), F.col("tokens")).alias("rate"))
    words = repos.where("side = 1").agg(F.sum("tokens")).first()[0]
    found = draws.bootstrap_ratio(rates, repos, 0.5e6 / words if words else 0.0)
    return found.select("item", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""
    WITH found AS (SELECT doc_id, max((length(line) > 600)::INT) AS hit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id),
    rated AS (SELECT quality, source, sum(hit) AS failing, count(*) AS checked FROM documents JOIN labels USING (doc_id) JOIN found USING (doc_id) GROUP BY ALL)
    SELECT quality, sum(failing)::BIGINT AS failing, sum(checked)::BIGINT AS checked, round(sum(failing) / sum(checked), 6) AS file_share, round(avg(failing / checked), 6) AS repo_share FROM rated GROUP BY quality""")
def lint_rate_by_quality(spark, sf_dir):
    """The share of documents with a line over the length limit, over files and with each repository weighing the same."""
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.char_length(x)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (longest > lints.PARAGRAPH_CHARS).cast("int").alias("hit"))
    rated = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "source").agg(F.sum("hit").alias("failing"), F.count("*").alias("checked"))
    return rated.groupBy("quality").agg(
        F.sum("failing").alias("failing"),
        F.sum("checked").alias("checked"),
        F.round(F.sum("failing") / F.sum("checked"), 6).alias("file_share"),
        F.round(F.avg(F.col("failing") / F.col("checked")), 6).alias("repo_share"),
    )


# Characters

CHARS = f"""
    rules(group_ord, rule_ord, char_group, first, last) AS (VALUES {RULE_VALUES}),
    seen AS (SELECT unnest(regexp_extract_all(html, '[^\\x00-\\x7F]')) AS ch FROM pages UNION ALL SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS ch FROM documents),
    counted AS (SELECT ch, count(*) AS n FROM seen GROUP BY ch),
    grouped AS (SELECT ch, n, (SELECT arg_min(char_group, group_ord * 1000 + rule_ord) FROM rules WHERE unicode(ch) BETWEEN first AND last) AS char_group FROM counted)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chars.histogram(table(spark, sf_dir, "pages").withColumn("k", F.lit(0)), "k", "html")
    return pages.unionByName(chars.histogram(table(spark, sf_dir, "documents").withColumn("k", F.lit(0)), "k", "text"))


@query(r"SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents) GROUP BY doc_id, ch")
def char_histogram(spark, sf_dir):
    return chars.histogram(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {CHARS} SELECT coalesce(char_group, 'none') AS char_group, sum(n)::BIGINT AS n, count(*) AS chars FROM grouped GROUP BY 1")
def char_group_rates(spark, sf_dir):
    total = _seen(spark, sf_dir).groupBy("ch").agg(F.sum("n").alias("n"))
    grouped = chars.with_group(total, chars.rule_table(spark))
    return grouped.groupBy(F.coalesce("char_group", F.lit("none")).alias("char_group")).agg(F.sum("n").alias("n"), F.count("*").alias("chars"))


@query(f"""
    WITH {CHARS} SELECT printf('U+%04X', unicode(ch)) AS label, n::BIGINT AS n,
        CASE WHEN ch IN ('é', '§') THEN 'allowed' WHEN ch IN ('ß', '§') THEN 'banned' WHEN char_group IS NOT NULL THEN 'group ' || char_group ELSE 'free' END AS verdict FROM grouped""")
def banned_char_verdict(spark, sf_dir):
    found = chars.verdicts(_seen(spark, sf_dir), chars.rule_table(spark), ["é", "§"], {"ß": "ss", "§": "section"})
    return found.select("label", "n", "verdict")


@query("SELECT page_id, len(regexp_extract_all(html, '[^\\x00-\\x7F]'))::BIGINT AS n, len(list_distinct(regexp_extract_all(html, '[^\\x00-\\x7F]')))::BIGINT AS chars FROM pages")
def html_char_scan(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"[^\x00-\x7F]"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.size(F.array_distinct(found)).cast("long").alias("chars"))


# N-grams


def _ngram_query(n: int) -> None:
    def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"))
        runs = K.ngrams(line_tokens(spark, sf_dir, n > 1), n).join(docs, "doc_id")
        return corpus.by_repository(runs, "gram").where("repos >= 3")

    QUERIES[f"ngram_n{n}"] = ngram_counts
    ORACLES[f"ngram_n{n}"] = f"WITH {TOKENS}, g AS ({grams(n)}) SELECT gram, count(*) AS n_total, count(DISTINCT source) AS repos FROM g JOIN documents USING (doc_id) GROUP BY gram HAVING count(DISTINCT source) >= 3"


for _n in (1, 2, 3, 4):
    _ngram_query(_n)


@query(f"WITH {TOKENS}, " + ", ".join(f"g{n} AS (SELECT {n} AS n, * FROM ({grams(n)}))" for n in (1, 2, 3, 4)) + """
    SELECT n, gram, count(*) AS n_total, count(DISTINCT source) AS repos FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4) JOIN documents USING (doc_id)
    GROUP BY n, gram HAVING count(DISTINCT source) >= 8""")
def frequent_ngrams_apriori(spark, sf_dir):
    """Frequent runs of up to four tokens; rare tokens part them before they are counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"))
    return corpus.frequent_ngrams(line_tokens(spark, sf_dir, True), docs, 4, 8)


COMPARED = f"""
    {TOKENS}, {SIDES}, g AS ({grams(2)}), prose AS (SELECT doc_id, side, repo FROM tokens JOIN sides USING (doc_id)),
    repos AS (SELECT side, repo, count(*) AS tokens FROM prose GROUP BY side, repo), hits AS (SELECT gram, side, repo, count(*) AS n FROM g JOIN sides USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {COMPARED} SELECT gram, round(max(n) / sum(n), 6) AS top_share FROM hits WHERE side = 0 GROUP BY gram")
def ngram_top_repo_share(spark, sf_dir):
    hits, _ = corpus.side_rates(line_tokens(spark, sf_dir, True), sides(spark, sf_dir), 2)
    return corpus.top_share(hits).withColumn("top_share", F.round("top_share", 6))


@query(rf"""
    WITH {TOKENS}, g AS ({grams(3)}), counted AS (SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 5),
    elsewhere AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram
        FROM (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark))
    SELECT gram, n FROM counted WHERE gram NOT IN (SELECT gram FROM elsewhere WHERE gram IS NOT NULL)""")
def ngram_guard_antijoin(spark, sf_dir):
    """Frequent trigrams that no benchmark text has."""
    frequent = K.ngrams(line_tokens(spark, sf_dir, True), 3).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 5")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1))), lambda i: F.array_join(F.slice("ws", i, F.lit(3)), " "))
    elsewhere = table(spark, sf_dir, "benchmark").select(words.alias("ws")).where(F.size("ws") >= 3).select(F.explode(runs).alias("gram"))
    return frequent.join(elsewhere, "gram", "left_anti")


@query(f"""
    WITH {COMPARED}, wide AS (SELECT gram, coalesce(count(*) FILTER (side = 0), 0) AS focus_repos, coalesce(count(*) FILTER (side = 1), 0) AS reference_repos, max(n) FILTER (side = 0) / sum(n) FILTER (side = 0) AS share FROM hits GROUP BY gram)
    SELECT count(*) AS all_runs, count(*) FILTER (focus_repos >= 3) AS enough_repos, count(*) FILTER (focus_repos >= 3 AND share <= 0.5) AS spread,
        count(*) FILTER (focus_repos >= 3 AND share <= 0.5 AND reference_repos <= 12) AS rare_elsewhere FROM wide""")
def candidate_funnel(spark, sf_dir):
    """How many bigrams survive each step of the sieve."""
    hits, _ = corpus.side_rates(line_tokens(spark, sf_dir, True), sides(spark, sf_dir), 2)
    wide = hits.groupBy("gram").agg(F.count_if(F.col("side") == 0).alias("focus_repos"), F.count_if(F.col("side") == 1).alias("reference_repos"), (F.max(F.when(F.col("side") == 0, F.col("n"))) / F.sum(F.when(F.col("side") == 0, F.col("n")))).alias("share"))
    steps = [("all_runs", F.lit(True)), ("enough_repos", F.col("focus_repos") >= 3), ("spread", F.col("share") <= 0.5), ("rare_elsewhere", F.col("reference_repos") <= 12)]
    return corpus.funnel(wide, steps)


@query(f"""
    WITH {TOKENS}, g2 AS (SELECT gram FROM ({grams(2)}) GROUP BY gram HAVING count(*) >= 20), g3 AS (SELECT gram FROM ({grams(3)}) GROUP BY gram HAVING count(*) >= 10)
    SELECT g3.gram, g2.gram AS inner FROM g3, g2 WHERE contains(' ' || g3.gram || ' ', ' ' || g2.gram || ' ')""".replace("AS inner", 'AS "inner"'))
def nested_merge(spark, sf_dir):
    """Frequent trigrams beside the frequent bigrams they contain."""
    rows = line_tokens(spark, sf_dir, True)
    shorter = K.ngrams(rows, 2).groupBy("gram").count().where("count >= 20").select("gram")
    longer = K.ngrams(rows, 3).groupBy("gram").count().where("count >= 10").select("gram")
    return corpus.nested_in(longer, shorter)


@query(f"""
    WITH {TOKENS}, hits AS ({grams(3)}), top AS (SELECT gram FROM hits GROUP BY gram ORDER BY count(*) DESC, gram LIMIT 10),
    common AS (SELECT folded FROM tokens WHERE kind = 'Word' GROUP BY folded ORDER BY count(DISTINCT doc_id) DESC, count(*) DESC, folded LIMIT 200),
    first AS (
        SELECT * FROM (SELECT h.*, source AS repo, row_number() OVER (PARTITION BY gram, source ORDER BY doc_id, block_id, pos) AS r FROM hits h SEMI JOIN top USING (gram) JOIN documents USING (doc_id)) WHERE r = 1
    ), chosen AS (SELECT * FROM (SELECT gram, repo, doc_id, block_id, pos AS at, row_number() OVER (PARTITION BY gram ORDER BY repo, doc_id) AS rank FROM first) WHERE rank <= 3)
    SELECT gram, rank::INT AS rank, repo, string_agg(CASE WHEN kind <> 'Word' OR common.folded IS NOT NULL THEN t.folded ELSE '_' END, ' ' ORDER BY t.pos) AS example
    FROM chosen c JOIN tokens t ON t.doc_id = c.doc_id AND t.block_id = c.block_id AND t.pos BETWEEN c.at - 15 AND c.at + 15 LEFT JOIN common ON common.folded = t.folded GROUP BY gram, rank, repo""")
def masked_examples(spark, sf_dir):
    """Up to three places of the ten commonest trigrams, uncommon words masked."""
    rows = line_tokens(spark, sf_dir, True)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"))
    hits = K.ngrams(rows, 3)
    top = hits.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(10)
    return corpus.masked_examples(rows, hits.join(F.broadcast(top), "gram", "left_semi"), docs, vocab_top_k(spark, sf_dir))


# Lints


@query("SELECT doc_id, block_id, length(line)::INT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_id FROM documents) WHERE length(line) > 600")
def density_lines(spark, sf_dir):
    blocks = K.line_blocks(table(spark, sf_dir, "documents")).withColumn("kind", F.lit("Paragraph"))
    return lints.dense_blocks(blocks).select("doc_id", F.col("block_id").cast("long").alias("block_id"), "chars")


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) > 8000")
def max_size_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes > 8000")


@query(f"""
    WITH {TOKENS} SELECT doc_id, block_id, pos, 2 AS length FROM (
        SELECT *, lead(folded) OVER (PARTITION BY doc_id, block_id ORDER BY pos) AS next FROM tokens
    ) WHERE folded = 'of' AND next = 'the' OR folded = 'it' AND next = 'is'""")
def phrase_matches(spark, sf_dir):
    tokens = K.sentences(line_tokens(spark, sf_dir, True))
    hits = lints.banned_phrases(tokens, ["of the", "it is"])
    return hits.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("pos").cast("long").alias("pos"), "length")


@query(f"""
    WITH {TOKENS}, {SENTENCES}, marked AS (
        SELECT doc_id, block_id, sent_id, pos, folded = 'of' AND kind = 'Word' AS hit,
            max(CASE WHEN folded = 'the' AND kind = 'Word' THEN pos END) OVER w AS the_pos, max(CASE WHEN text IN (',', ';') THEN pos END) OVER w AS break_pos
        FROM sents WINDOW w AS (PARTITION BY doc_id, block_id, sent_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)
    )
    SELECT doc_id, block_id, sent_id::BIGINT AS sent_id, pos FROM marked WHERE hit AND the_pos IS NOT NULL AND coalesce(break_pos, -1) < the_pos""")
def pattern_gap_match(spark, sf_dir):
    """`of` with `the` among the nine tokens before it and no comma or semicolon between."""
    rows = K.sentences(line_tokens(spark, sf_dir, True))
    near = K.in_sentence().rowsBetween(-9, -1)
    the = F.max(F.when(P.word("the"), F.col("pos"))).over(near)
    stop = F.max(F.when(F.col("text").isin(",", ";"), F.col("pos"))).over(near)
    marked = rows.withColumns({"_the": the, "_stop": stop}).where(P.word("of") & F.col("_the").isNotNull() & (F.coalesce("_stop", F.lit(-1)) < F.col("_the")))
    return marked.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"))


@query(f"""
    WITH {TOKENS}, {SENTENCES}, counted AS (
        SELECT *, sum((kind IN ('Word', 'Number'))::INT) OVER (PARTITION BY doc_id, block_id, sent_id ORDER BY pos) AS before,
            sum((kind IN ('Word', 'Number'))::INT) OVER (PARTITION BY doc_id, block_id, sent_id) AS whole FROM sents
    )
    SELECT doc_id, block_id, sent_id::BIGINT AS sent_id, min(pos) AS pos FROM counted WHERE text = ',' AND whole - before BETWEEN 2 AND 12 AND whole - before < before GROUP BY doc_id, block_id, sent_id""")
def tail_length_match(spark, sf_dir):
    """The first comma of a sentence whose tail has two to twelve words, fewer than what leads up to it."""
    found = lints.short_tails(K.line_blocks(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"))


@query(f"""
    WITH {TOKENS}, {SENTENCES}, ahead AS (SELECT *, lead(folded) OVER w AS n1, lead(folded, 2) OVER w AS n2, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2 FROM sents WINDOW w AS (PARTITION BY doc_id, block_id, sent_id ORDER BY pos)),
    hits AS (SELECT doc_id, block_id, sent_id, pos, CASE WHEN n1 = 'the' AND k1 = 'Word' AND k2 = 'Word' THEN 3 WHEN k1 = 'Word' AND n1 <> 'the' THEN 2 END AS length FROM ahead WHERE folded IN ('in', 'on') AND kind = 'Word')
    SELECT doc_id, block_id, sent_id::BIGINT AS sent_id, min(pos) AS pos, arg_min(length, pos)::INT AS length FROM hits WHERE length IS NOT NULL GROUP BY doc_id, block_id, sent_id""")
def first_match_per_sentence(spark, sf_dir):
    """in or on, an optional the, and a word: the first match of each sentence."""
    rows = K.sentences(line_tokens(spark, sf_dir, True))
    # "the" is the optional item and never the word itself: "in the 3" is no match.
    last = (F.col("kind") == "Word") & ((F.col("folded") != "the") | F.coalesce(F.lag(P.word("the")).over(K.in_sentence()), F.lit(False)))
    hits = P.find(rows, [P.one(P.word("in", "on")), P.optional(P.word("the")), P.one(last)])
    first = hits.groupBy("doc_id", "block_id", "sent_id").agg(F.min("pos").alias("pos"), F.min_by("length", "pos").alias("length"))
    return first.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "length")


# Settings

OVERRIDES = settings.Section("pages", ["**"], ["*.html"], {"limit": 100, "group": "base"}, [("**/en/*", {"limit": 200}), ("*7*", {"limit": 300, "group": "seven"}), ("**/en/7*", {"group": "en seven"}), ("**/fr/**", {"limit": 50})])


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://(.*)$", 1).alias("path"))


@query(rf"""
    WITH paths AS (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS path FROM pages)
    SELECT page_id, regexp_matches(path, '{globs.glob_regex("**")}') AND NOT regexp_matches(path, '{globs.glob_regex("*.html")}') AS selected,
        coalesce(CASE WHEN regexp_matches(path, '{globs.glob_regex("**/en/*")}') THEN 200 END, CASE WHEN regexp_matches(path, '{globs.glob_regex("**/fr/**")}') THEN 50 END,
            CASE WHEN regexp_matches(path, '{globs.glob_regex("*7*")}') THEN 300 END, 100) AS "limit",
        coalesce(CASE WHEN regexp_matches(path, '{globs.glob_regex("**/en/7*")}') THEN 'en seven' END, CASE WHEN regexp_matches(path, '{globs.glob_regex("*7*")}') THEN 'seven' END, 'base') AS "group" FROM paths""")
def glob_specificity_merge(spark, sf_dir):
    """Settings of each path: overrides laid over the base from the least to the most specific."""
    paths = _paths(spark, sf_dir)
    chosen = settings.resolved(paths.select("path").distinct(), OVERRIDES)
    on = globs.selected(F.col("path"), OVERRIDES.include, OVERRIDES.exclude).alias("selected")
    return paths.join(chosen, "path").select("page_id", on, "limit", "group")


@query("""
    SELECT source, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) FILTER (n_chars > 3000) AS n_chars FROM documents GROUP BY source""")
def override_last_wins(spark, sf_dir):
    """Batches in order: of each source the last value that is set."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.max_by("lang", "doc_id").alias("lang"), F.max_by("n_chars", F.when(F.col("n_chars") > 3000, F.col("doc_id"))).alias("n_chars"))


@query(r"""
    WITH lines AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_id FROM documents),
    folded AS (SELECT path, sent_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded, length(text) > 600 AS found FROM lines),
    entries AS (SELECT doc_id AS entry, CASE WHEN doc_id % 7 = 0 THEN 'gone' ELSE doc_id::VARCHAR END AS path, CASE WHEN doc_id % 5 = 0 THEN 'no such line' ELSE string_split(text, chr(10))[1] END AS quote FROM documents),
    matched AS (SELECT e.entry, e.path, count(f.sent_id) AS n, min(f.sent_id) AS sent_id FROM entries e LEFT JOIN folded f ON f.path = e.path AND f.folded = lower(trim(regexp_replace(e.quote, '\s+', ' ', 'g'))) GROUP BY ALL)
    SELECT entry, CASE WHEN path = 'gone' THEN 'no such file' WHEN n = 0 THEN 'no such sentence' WHEN n > 1 THEN 'two sentences'
        WHEN NOT EXISTS (SELECT 1 FROM folded f WHERE f.path = m.path AND f.sent_id = m.sent_id AND found) THEN 'no finding' ELSE 'applied' END AS status FROM matched m""")
def allow_status(spark, sf_dir):
    """An exemption for each document, some broken by construction, against lines and density findings."""
    docs = table(spark, sf_dir, "documents")
    lines = K.line_blocks(docs).select(F.col("doc_id").cast("string").alias("path"), F.col("block_id").alias("sent_id"), "text")
    findings = lines.where(F.char_length("text") > lints.PARAGRAPH_CHARS).select("path", "sent_id", F.lit("density").alias("lint"))
    quote = F.when(F.col("doc_id") % 5 == 0, "no such line").otherwise(F.get(F.split("text", "\n"), F.lit(0)))
    entries = docs.select(F.col("doc_id").alias("entry"), F.when(F.col("doc_id") % 7 == 0, "gone").otherwise(F.col("doc_id").cast("string")).alias("path"), F.lit("density").alias("lint"), quote.alias("quote"))
    return settings.settled(entries, lines, findings, lines.select("path")).select("entry", "status")


# Joins


@query("""
    WITH spans AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT AS e FROM lineitem),
    flagged AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 0 ELSE 1 END AS fresh FROM spans)
    SELECT l_orderkey, sum(fresh)::BIGINT AS chains FROM flagged GROUP BY l_orderkey""")
def interval_overlap_groups(spark, sf_dir):
    """Spans that chain by overlap are one group: counted for each order."""
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))
    return settings.overlap_groups(spans, "l_orderkey").groupBy("l_orderkey").agg(F.max("group").cast("long").alias("chains"))


@query(f"""
    WITH {TOKENS} SELECT doc_id, pos_in_doc, arg_max(block_id, pos_in_doc) OVER (PARTITION BY doc_id ORDER BY pos_in_doc) AS line
    FROM (SELECT doc_id, block_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_id, pos) AS pos_in_doc FROM tokens) QUALIFY text = ';' OR text = '|'""")
def asof_line_of_token(spark, sf_dir):
    """The line in force at a mark, as of its place in the document."""
    rows = line_tokens(spark, sf_dir, True)
    order = Window.partitionBy("doc_id").orderBy("block_id", "pos")
    first = F.when(F.col("pos") == 0, F.col("block_id"))
    marked = rows.withColumns({"pos_in_doc": F.row_number().over(order).cast("long"), "line": F.last(first, ignorenulls=True).over(order).cast("long")})
    return marked.where(F.col("text").isin(";", "|")).select("doc_id", "pos_in_doc", "line")


@query("""
    WITH found AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    hunks AS (SELECT doc_id, 1 + doc_id % 4 AS s, 1 + doc_id % 4 + doc_id % 3 AS e FROM documents)
    SELECT f.doc_id, f.n AS first_line FROM found f JOIN hunks h USING (doc_id) WHERE length(line) > 300
        AND n <= CASE WHEN s = e THEN s ELSE e - 1 END AND n >= CASE WHEN s = e THEN s - 1 ELSE s END""")
def change_narrowing(spark, sf_dir):
    """Findings on lines that a change touches; an empty added range touches the lines on both sides."""
    docs = table(spark, sf_dir, "documents")
    lines = K.line_blocks(docs).where(F.char_length("text") > 300)
    findings = lines.select(F.col("doc_id").alias("path"), (F.col("block_id") + 1).cast("long").alias("first_line")).withColumn("last_line", F.col("first_line"))
    start = 1 + F.col("doc_id") % 4
    hunks = docs.select(F.col("doc_id").alias("path"), start.alias("added_start"), (start + F.col("doc_id") % 3).alias("added_end"))
    return settings.within_change(findings, hunks).select(F.col("path").alias("doc_id"), "first_line")


# Sampling


@query("SELECT doc_id, (('0x' || substr(sha256(lower(doc_id::VARCHAR)), 1, 2))::INT % 10) = 0 AS tune FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.hash_split(F.col("doc_id").cast("string")).alias("tune"))


@query("SELECT doc_id, source, n_chars, (row_number() OVER (PARTITION BY lower(source) ORDER BY n_chars DESC, doc_id))::INT AS rank FROM documents QUALIFY rank <= 4 ORDER BY n_chars DESC, doc_id LIMIT 50")
def per_source_cap_top_k(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.capped(docs, F.lower("source"), [F.desc("n_chars"), F.col("doc_id")], 4).orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) % 7)::INT AS part FROM documents")
def round_robin_deal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.dealt(docs, ["lang"], ["n_chars", "doc_id"], 7).select("doc_id", "lang", F.col("part").cast("int").alias("part"))


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))")
def dedup_normalised_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.deduplicated(docs, "text", "doc_id").select("doc_id", "copies")


@query("""
    WITH w AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM w),
    x AS (SELECT source, (n * 100 // total)::BIGINT AS whole, n * 100 - (n * 100 // total) * total AS rest FROM w, t),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS rank, 100 - sum(whole) OVER () AS missing FROM x)
    SELECT source, whole + CASE WHEN rank <= missing THEN 1 ELSE 0 END AS seats FROM r""")
def apportion(spark, sf_dir):
    weights = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sampling.apportioned(weights, "source", "n", 100)


# Exam


JUDGED = r"""
    judged AS (SELECT d.doc_id, d.lang, l.quality, (len(regexp_extract_all(text, '[#$%&*!|]')) < 0.02 * length(text))::INT AS guess,
        1 - len(regexp_extract_all(text, '[#$%&*!|]')) / greatest(length(text), 1) AS score FROM documents d JOIN labels l USING (doc_id))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule of thumb's guess at quality."""
    marks = F.regexp_count("text", F.lit("[#$%&*!|]"))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "quality", (marks < 0.02 * F.char_length("text")).cast("int").alias("guess"), (1 - marks / F.greatest(F.char_length("text"), F.lit(1))).alias("score"))


@query(f'WITH {JUDGED} SELECT quality, count(*) FILTER (guess = 0) AS "0", count(*) FILTER (guess = 1) AS "1" FROM judged GROUP BY quality')
def confusion_matrix(spark, sf_dir):
    return exam.confusion(_judged(spark, sf_dir), "quality", "guess", [0, 1])


@query(f"WITH {JUDGED} SELECT least(floor(score * 10 + 1e-6), 9)::INT AS bin, count(*) AS n, sum((guess = quality)::INT)::BIGINT AS \"right\", round(avg(score), 6) AS mean_score FROM judged GROUP BY 1")
def calibration_bins(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("right", (F.col("guess") == F.col("quality")).cast("int"))
    return exam.calibration(rows, "score", "right").withColumn("mean_score", F.round("mean_score", 6))


TALLY = f"""
    {JUDGED}, marked AS (SELECT *, (guess = quality)::INT AS "right", (score > 0.99)::INT AS committed FROM judged),
    tallied AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS stratum, coalesce(lang, '') AS value, count(*) AS n, sum("right")::BIGINT AS r, sum(committed)::BIGINT AS c, sum("right" * committed)::BIGINT AS b
        FROM marked GROUP BY GROUPING SETS ((), (lang)))"""


@query(f"WITH {TALLY} SELECT stratum, value, n, round(r / n, 6) AS accuracy, round(c / n, 6) AS commitment, CASE WHEN c > 0 THEN round(b / c, 6) END AS precision FROM tallied")
def tally_metrics(spark, sf_dir):
    found = exam.metrics(_judged(spark, sf_dir), F.col("guess") == F.col("quality"), F.col("score") > 0.99, ["lang"])
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "commitment", "precision")})


@query(f"""
    WITH {JUDGED}, t AS (SELECT lang AS name, sum((guess = quality)::INT)::BIGINT AS n, count(*) AS d FROM judged GROUP BY lang),
    g(name, floor, least) AS (VALUES ('en', 900, 50), ('de', 990, 50), ('fr', 800, 1000000), ('xx', 1, 1))
    SELECT g.name, n, d, CASE WHEN d IS NULL OR d < least THEN 'not judged' WHEN n * 1000 >= floor * d THEN 'pass' ELSE 'fail' END AS verdict FROM g LEFT JOIN t USING (name)""")
def gate_verdict(spark, sf_dir):
    tallies = _judged(spark, sf_dir).groupBy(F.col("lang").alias("name")).agg(F.sum((F.col("guess") == F.col("quality")).cast("int")).alias("n"), F.count("*").alias("d"))
    gates = spark.createDataFrame([("en", 900, 50), ("de", 990, 50), ("fr", 800, 1000000), ("xx", 1, 1)], "name string, floor long, least long")
    return exam.gates(tallies, gates)


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def most_common_tag(spark, sf_dir):
    return exam.most_common(table(spark, sf_dir, "documents"), "source", "lang")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.col("lang").alias("a"), T.language_guess(F.col("text")).alias("b"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("c"))


VOTES = f"votes AS (SELECT d.doc_id, d.source, d.lang AS a, g.guess AS b, CASE WHEN d.doc_id % 3 > 0 THEN d.lang END AS c FROM documents d JOIN ({ORACLES['language_guess']}) g ON g.doc_id = d.doc_id)"


@query(f"""
    WITH {VOTES}, pairs AS (SELECT source, 'a' AS a, 'b' AS b, a AS x, b AS y FROM votes UNION ALL SELECT source, 'a', 'c', a, c FROM votes UNION ALL SELECT source, 'b', 'c', b, c FROM votes)
    SELECT source AS stratum, a, b, count(*) AS words, count(*) FILTER (x = y) AS agreed FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY source, a, b""")
def voter_agreement(spark, sf_dir):
    return exam.agreement(_votes(spark, sf_dir), ["a", "b", "c"], "source")


@query(f"""
    WITH {VOTES}, given AS (SELECT doc_id, list_distinct(list_filter([a, b, c], lambda v: v IS NOT NULL)) AS g, coalesce(a, b, c) AS first FROM votes)
    SELECT doc_id, CASE len(g) WHEN 0 THEN 'abstained' WHEN 1 THEN 'agreed' ELSE 'disputed' END AS status, CASE WHEN len(g) = 1 THEN first END AS base FROM given""")
def voter_merge(spark, sf_dir):
    return exam.merged(_votes(spark, sf_dir), ["a", "b", "c"]).select("doc_id", "status", "base")


# More of settings, sampling and exams


@query(rf"""
    WITH paths AS (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN NOT regexp_matches(path, '{globs.glob_regex("**/en/**")}') AND NOT regexp_matches(path, '{globs.glob_regex("*9*")}') THEN 'miss'
        WHEN regexp_matches(path, '{globs.glob_regex("*.html")}') THEN 'excluded' ELSE 'hit' END AS choice FROM paths""")
def glob_choice(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", settings.choice(F.col("path"), ["**/en/**", "*9*"], ["*.html"]).alias("choice"))


@query(rf"""
    WITH paths AS (SELECT DISTINCT regexp_extract(url, '://(.*)$', 1) AS path FROM pages), flags AS (
        SELECT regexp_matches(path, '{globs.glob_regex("**/en/*")}') AS en, regexp_matches(path, '{globs.glob_regex("*7*")}') AS seven, regexp_matches(path, '{globs.glob_regex("**/en/7*")}') AS en7, regexp_matches(path, '{globs.glob_regex("**/fr/**")}') AS fr FROM paths
    ), told AS (
        SELECT 'limit' AS setting, CASE WHEN fr THEN '**/fr/**' WHEN en THEN '**/en/*' WHEN seven THEN '*7*' ELSE 'base' END AS source FROM flags
        UNION ALL SELECT 'group', CASE WHEN en7 THEN '**/en/7*' WHEN seven THEN '*7*' ELSE 'base' END FROM flags
    ) SELECT setting, source, count(*) AS paths FROM told GROUP BY setting, source""")
def settings_explained(spark, sf_dir):
    """How many paths take each setting from which override."""
    told = settings.explained(_paths(spark, sf_dir).select("path").distinct(), OVERRIDES)
    return told.groupBy("setting", "source").agg(F.count("*").alias("paths"))


@query()
def closest_quotes(spark, sf_dir):
    """The three lines of each document that are nearest to a quote from its start; rows only, since DuckDB counts edits by byte."""
    docs = table(spark, sf_dir, "documents")
    lines = K.line_blocks(docs).select(F.col("doc_id").alias("path"), F.col("block_id").alias("sent_id"), "text")
    entries = docs.select(F.col("doc_id").alias("entry"), F.col("doc_id").alias("path"), F.substring("text", 5, 70).alias("quote"))
    return settings.closest(entries, lines)


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS turn FROM documents ORDER BY turn, source LIMIT 100")
def interleaved_sources(spark, sf_dir):
    rows = sampling.interleaved(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return rows.orderBy("turn", "source").limit(100)


@query("""
    SELECT o_custkey, CASE WHEN n = 0 THEN 'unknown' WHEN a = 0 THEN 'human' WHEN a = n THEN 'llm' ELSE 'mixed' END AS label FROM (
        SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS n, count(*) FILTER (o_orderstatus = 'O') AS a FROM orders GROUP BY o_custkey)""")
def history_labels(spark, sf_dir):
    """A label for each customer's history of orders: P tells nothing, O is the agent's."""
    agent = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O")
    return sampling.history_label(table(spark, sf_dir, "orders"), "o_custkey", agent)


@query("SELECT strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def quarter_counts(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy(T.quarter_of(day).alias("quarter")).agg(F.count("*").alias("n"))


@query("""
    WITH t AS (SELECT source, sum(quality)::DOUBLE AS r, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, round((r / n + 3.8416 / (2 * n) - 1.96 * sqrt(r / n * (1 - r / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
        round((r / n + 3.8416 / (2 * n) + 1.96 * sqrt(r / n * (1 - r / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM t""")
def wilson_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").cast("double").alias("r"), F.count("*").cast("double").alias("n"))
    low, high = exam.wilson(F.col("r"), F.col("n"))
    return rows.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""
    WITH {JUDGED}, marked AS (SELECT round(score, 3) AS score, (guess = quality)::INT AS r FROM judged), by_score AS (SELECT score, count(*) AS n, sum(r) AS r FROM marked GROUP BY score),
    run AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS n, sum(r) OVER (ORDER BY score DESC) AS r FROM by_score)
    SELECT score AS cutoff, n::BIGINT AS n, r::BIGINT AS "right" FROM run WHERE r >= 0.9 * n ORDER BY score LIMIT 1""")
def margin_cutoff(spark, sf_dir):
    """The lowest score down to which nine of ten guesses are right."""
    rows = _judged(spark, sf_dir).select(F.round("score", 3).alias("score"), (F.col("guess") == F.col("quality")).cast("int").alias("right"))
    return exam.cutoff(rows, "score", "right", 0.9)


@query(f"""
    WITH {VOTES}, pairs AS (SELECT length(a.c) AS p, length(b.b) AS q FROM (SELECT * FROM votes WHERE c IS NOT NULL) a FULL JOIN (SELECT * FROM votes WHERE b IS NOT NULL) b ON a.doc_id = b.doc_id)
    SELECT count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) AS "both", count(*) FILTER (p IS NULL OR q IS NULL) AS alone, count(*) FILTER (q > p) AS up, count(*) FILTER (q < p) AS down FROM pairs""")
def paired_runs(spark, sf_dir):
    """Two voters that abstain from different documents, joined by document."""
    votes = _votes(spark, sf_dir)
    before = votes.where("c is not null").select("doc_id", F.char_length("c").alias("value"))
    after = votes.where("b is not null").select("doc_id", F.char_length("b").alias("value"))
    return exam.paired(before, after, "doc_id", "value")


@query(f"WITH {VOTES} SELECT a, b, count(*) AS n FROM votes WHERE a <> b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 5")
def largest_confusions(spark, sf_dir):
    return exam.largest_confusions(_votes(spark, sf_dir), "a", "b", 5)


# Reports


@query("""
    WITH facts AS (SELECT doc_id, max((length(line) > 600)::INT) AS density FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id),
    labelled AS (SELECT d.doc_id, d.source, l.quality AS label, density, (octet_length(encode(text)) > 8000)::INT AS size, 0 AS absent FROM documents d JOIN labels l USING (doc_id) JOIN facts USING (doc_id)),
    long AS (SELECT 'density' AS lint, label, source, density AS hit FROM labelled UNION ALL SELECT 'max_size_bytes', label, source, size FROM labelled UNION ALL SELECT 'absent', label, source, absent FROM labelled),
    by_repo AS (SELECT lint, label, source, sum(hit) AS failing, count(*) AS checked FROM long GROUP BY ALL)
    SELECT lint, label, sum(failing)::BIGINT AS failing, sum(checked)::BIGINT AS checked, round(sum(failing) / sum(checked), 6) AS file_share, round(avg(failing / checked), 6) AS repo_share FROM by_repo GROUP BY lint, label""")
def lint_rates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    long = K.line_blocks(docs).where(F.char_length("text") > lints.PARAGRAPH_CHARS).select("doc_id", F.lit("density").alias("lint"))
    large = docs.where(F.octet_length("text") > 8000).select("doc_id", F.lit("max_size_bytes").alias("lint"))
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("source").alias("repo"))
    found = corpus.lint_rates(labelled, long.unionByName(large), ["density", "max_size_bytes", "absent"])
    return found.withColumns({c: F.round(c, 6) for c in ("file_share", "repo_share")})


@query(f"""
    WITH {TOKENS}, sides AS (SELECT d.doc_id, l.quality AS side, d.source AS repo FROM documents d JOIN labels l USING (doc_id)),
    repos AS (SELECT side, repo, count(*) AS tokens FROM tokens JOIN sides USING (doc_id) GROUP BY side, repo), n_repos AS (SELECT side, count(*) AS n FROM repos GROUP BY side),
    seen AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS ch FROM documents), hits AS (SELECT ch, side, repo, count(*) AS n FROM seen JOIN sides USING (doc_id) GROUP BY ALL),
    rates AS (SELECT ch, side, sum(h.n)::BIGINT AS occurrences, count(*) AS repos, sum(h.n * 1e6 / tokens) / any_value(n_repos.n) AS rate FROM hits h JOIN repos USING (side, repo) JOIN n_repos USING (side) GROUP BY ch, side),
    smooth AS (SELECT 0.5e6 / sum(tokens) AS s FROM repos WHERE side = 1),
    wide AS (SELECT ch, coalesce(max(repos) FILTER (side = 0), 0) AS focus_repos, coalesce(max(rate) FILTER (side = 0), 0) AS focus_rate, coalesce(max(repos) FILTER (side = 1), 0) AS reference_repos, coalesce(max(rate) FILTER (side = 1), 0) AS reference_rate FROM rates GROUP BY ch)
    SELECT printf('U+%04X', unicode(ch)) AS label, focus_repos, reference_repos, round(focus_rate, 6) AS focus_rate, round((focus_rate + s) / (reference_rate + s), 6) AS ratio
    FROM wide, smooth WHERE greatest(focus_repos, reference_repos) >= 3 ORDER BY wide.focus_rate DESC, ch LIMIT 50""".replace("\\\\", "\\"))
def chars_report(spark, sf_dir):
    """Characters of enough repositories on either side, by focus rate."""
    docs = table(spark, sf_dir, "documents")
    on = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("side"), F.col("source").alias("repo"))
    hits = chars.histogram(docs, "doc_id", "text").join(on, "doc_id").groupBy("ch", "side", "repo").agg(F.sum("n").alias("n"))
    repos = line_tokens(spark, sf_dir).join(on, "doc_id").groupBy("side", "repo").agg(F.count("*").alias("tokens"))
    best = corpus.ranked(corpus.compared(hits, repos, "ch"), "ch", 3, 50)
    return best.select(T.code_point_label(F.col("ch")).alias("label"), "focus_repos", "reference_repos", F.round("focus_rate", 6).alias("focus_rate"), F.round("ratio", 6).alias("ratio"))


@query("""
    WITH t AS (SELECT source, unnest(list_distinct(langs)) AS tool, len(list_distinct(langs)) = 1 AS alone FROM (SELECT source, doc_id // 4 AS k, list(lang) AS langs FROM documents GROUP BY ALL))
    SELECT tool, count(*) FILTER (alone) AS files_alone, count(*) AS files, count(DISTINCT source) FILTER (alone) AS repos_alone, count(DISTINCT source) AS repos FROM t GROUP BY tool""")
def tool_rows(spark, sf_dir):
    """Languages standing in for tools: alone in a group of a source's documents, or in it at all."""
    groups = table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 4").alias("k")).agg(F.collect_list("lang").alias("tools"))
    return corpus.tool_rows(groups, "tools", "source")


@query(f"""
    WITH {TOKENS}, {SENTENCES}, s AS (SELECT doc_id, block_id, sent_id, count(*) FILTER (kind = 'Word') AS words, count(*) AS n_tokens, count(*) FILTER (folded IN ({quoted(T.ENGLISH)})) AS common, count(*) FILTER (kind IN ('Code', 'Url')) AS other FROM sents GROUP BY ALL)
    SELECT doc_id, count(*) AS sentences, sum(words)::BIGINT AS words FROM s WHERE words >= 2 AND n_tokens <= 60 AND other = 0 AND common >= 0.2 * words GROUP BY doc_id""")
def eligible_sentences(spark, sf_dir):
    found = corpus.eligible_sentences(K.sentences(line_tokens(spark, sf_dir, True)), 2, 60, 0.2)
    return found.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"))


@query("""
    WITH a AS (SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) <= 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM a)
    SELECT doc_id, lang, source FROM b WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 ELSE 0 END""")
def stratified_draw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    drawn = sampling.stratified(docs, "lang", {"en": 30, "de": 15, "fr": 15}, [("source", 4)], F.struct("n_chars", "doc_id"))
    return drawn.select("doc_id", "lang", "source")


QUOTAS, PER_SOURCE, PER_LENGTH = {"en": 40, "de": 25, "fr": 9}, 6, 5


@query(f"""
    WITH RECURSIVE ordered AS (
        SELECT row_number() OVER (ORDER BY sha256('quota:' || doc_id), doc_id) AS k, doc_id, lang, source, (n_chars % 40)::INTEGER AS length_class FROM documents WHERE lang IN ({quoted(list(QUOTAS))})
    ), walk(k, taken) AS (
        SELECT 0::BIGINT, []::STRUCT(doc_id BIGINT, lang VARCHAR, source VARCHAR, length_class INTEGER)[]
        UNION ALL
        SELECT o.k, CASE WHEN len(list_filter(taken, lambda x: x.lang = o.lang)) < CASE o.lang {" ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items())} END
            AND len(list_filter(taken, lambda x: x.source = o.source)) < {PER_SOURCE} AND len(list_filter(taken, lambda x: x.length_class = o.length_class)) < {PER_LENGTH}
            THEN list_append(taken, {{'doc_id': o.doc_id, 'lang': o.lang, 'source': o.source, 'length_class': o.length_class}}) ELSE taken END
        FROM walk w JOIN ordered o ON o.k = w.k + 1
    ), whole AS (SELECT unnest(arg_max(taken, k), recursive := true) FROM walk)
    SELECT doc_id, lang, source, length_class FROM whole""")
def quota_draw(spark, sf_dir):
    """Documents in hash order as a walk takes them, within quotas of languages and caps of sources and of lengths at once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 40).cast("int").alias("length_class"))
    key = F.sha2(F.concat(F.lit("quota:"), F.col("doc_id").cast("string")), 256)
    drawn = sampling.quota_draw(docs.withColumn("key", key), {"lang": QUOTAS, "source": PER_SOURCE, "length_class": PER_LENGTH}, ["key", "doc_id"])
    return drawn.select("doc_id", "lang", "source", "length_class")


@query(f"""
    WITH {TOKENS}, told AS (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL),
    words AS (SELECT folded AS word, lang AS tag, t.doc_id % 2 = 0 AS train FROM tokens t JOIN told USING (doc_id) WHERE kind = 'Word'),
    counted AS (SELECT word, tag, count(*) AS n FROM words WHERE train GROUP BY ALL),
    known AS (SELECT word, tag FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS r FROM counted) WHERE r = 1),
    cuts AS (SELECT unnest(range(0, least(length(word), 5) + 1)) AS size, word, tag, n FROM counted),
    grown AS (SELECT CASE WHEN size = 0 THEN '' ELSE right(word, size) END AS suffix, tag, sum(n) AS n FROM cuts GROUP BY ALL),
    often AS (SELECT suffix, tag FROM (SELECT *, sum(n) OVER (PARTITION BY suffix) AS all_n, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, tag) AS r FROM grown) WHERE r = 1 AND (all_n >= 2 OR suffix = '')),
    asked AS (SELECT DISTINCT word FROM words WHERE NOT train),
    tried AS (SELECT word, unnest(range(0, least(length(word), 5) + 1)) AS size FROM asked),
    met AS (SELECT t.word, arg_max(o.suffix, size) AS suffix, arg_max(o.tag, size) AS tag FROM tried t JOIN often o ON o.suffix = CASE WHEN size = 0 THEN '' ELSE right(t.word, size) END GROUP BY t.word)
    SELECT word, coalesce(known.tag, met.tag) AS tag, CASE WHEN known.tag IS NULL THEN suffix ELSE word END AS by FROM asked LEFT JOIN known USING (word) LEFT JOIN met USING (word)""")
def starting_tags(spark, sf_dir):
    """Each word of every second document with the language that its like in the others has most: the word's own, or its longest suffix's."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.col("lang").alias("tag")).distinct()
    words = line_tokens(spark, sf_dir).where("kind = 'Word'").select("doc_id", F.col("folded").alias("word")).join(docs, "doc_id")
    return rules.starting_tags(words.where("doc_id % 2 = 0").select("word", "tag"), words.where("doc_id % 2 <> 0"))
