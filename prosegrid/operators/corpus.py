"""What sets one side of a corpus apart: facets, quartiles, n-grams, candidates, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.functions import stats
from prosegrid.functions.text import ENGLISH, TERMINALS
from prosegrid.operators.tokens import in_block, ngrams
from prosegrid.sources.tables import numbered, stored

#: Frequent tokens or pairs that are broadcast, about 60 bytes each; more are joined by a shuffle.
MAX_BROADCAST_RUNS = 1_000_000


def facet_counts(docs: DataFrame, facets: list[str], label: str, repo: str) -> DataFrame:
    """facet, value, label, files, repos for each facet, in one pass."""
    grouped = docs.groupingSets([[f, label] for f in facets], *facets, label)
    counted = grouped.agg(F.count("*").alias("files"), F.count_distinct(repo).alias("repos"), *(F.grouping(f).alias(f"_all_{f}") for f in facets))
    facet = F.coalesce(*(F.when(F.col(f"_all_{f}") == 0, f) for f in facets))
    value = F.coalesce(*(F.col(f).cast("string") for f in facets))
    return counted.select(facet.alias("facet"), value.alias("value"), F.col(label).alias("label"), "files", "repos")


def label_rows(docs: DataFrame, label: str, repo: str, size: str) -> DataFrame:
    """files, repos, bytes and quartiles of size for each label."""
    return docs.groupBy(label).agg(
        F.count("*").alias("files"),
        F.count_distinct(repo).alias("repos"),
        F.sum(F.octet_length("text")).alias("bytes"),
        stats.percentile(size, 0.25).alias("lower"),
        stats.percentile(size, 0.5).alias("median"),
        stats.percentile(size, 0.75).alias("upper"),
    )


def by_repository(runs: DataFrame, *keys: str) -> DataFrame:
    """n_total and repos of the runs: counted by run and repository before anything moves, so repositories need no distinct count."""
    return runs.groupBy(*keys, "repo").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum("c").alias("n_total"), F.count("*").alias("repos"))


def frequent_ngrams(tokens: DataFrame, docs: DataFrame, longest: int, least_repos: int) -> DataFrame:
    """n, gram, n_total, repos of the runs of up to longest tokens that so many repositories have.

    docs: doc_id, repo. A run's parts are at least as frequent as the run: tokens are counted first, and
    frequent ones get numbers; pairs of numbers are counted next, and a longer run is only built, and
    only moves, where all its pairs are frequent. Tokens are made once, into a table; from then on rows
    are numbers, and only frequent runs become text again. Numbers of tokens and pairs are joined by
    broadcast while they are few.
    """
    prose = F.col("kind").isin("Word", "Number", "Punctuation", "Symbol") & ~F.col("text").isin(TERMINALS)
    edge = F.col("kind").isin("Word", "Number")
    rows = stored(tokens.where(prose).select("doc_id", "block_id", "pos", "folded", edge.alias("edge")).join(docs, "doc_id"), "tokens")
    found = by_repository(rows, "folded", "edge").where(F.col("repos") >= least_repos)
    words = stored(numbered(found, ["folded", "edge"], "words"), "numbers")
    few = lambda frame: F.broadcast(frame) if frame.count() <= MAX_BROADCAST_RUNS else frame
    listed = words.select("folded", "edge", "number")
    grams = words.where("edge").select(F.lit(1).alias("n"), F.array("number").alias("run"), "n_total", "repos")
    if longest > 1:
        order = in_block()
        ahead = lambda c, k=1: F.lead(c, k).over(order)
        kept = rows.join(few(listed), ["folded", "edge"]).select("repo", "doc_id", "block_id", "pos", "number", "edge")
        next_to = lambda c: F.when(ahead("pos") == F.col("pos") + 1, ahead(c))
        paired = stored(kept.withColumns({"next": next_to("number"), "ends": next_to("edge")}).where("next is not null"), "pairs")
        pair = F.shiftleft("number", 32).bitwiseOR(F.col("next"))
        pairs = stored(by_repository(paired.select("repo", pair.alias("pair"), (F.col("edge") & F.col("ends")).alias("whole")), "pair", "whole").where(F.col("repos") >= least_repos), "frequent")
        halves = F.array(F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF))
        grams = grams.unionByName(pairs.where("whole").select(F.lit(2).alias("n"), halves.alias("run"), "n_total", "repos"))
    if longest > 2:
        # Rows whose pair is frequent; a run goes on where the next row begins at the next token.
        tied = paired.withColumn("pair", pair).join(few(pairs.select("pair").distinct()), "pair", "left_semi")
        goes_on, run, runs = F.lit(True), F.array("number", "next"), []
        for n in range(3, longest + 1):
            goes_on = goes_on & (ahead("pos", n - 2) == F.col("pos") + n - 2)
            run = F.array_append(run, ahead("next", n - 2))
            runs.append(F.when(goes_on & ahead("ends", n - 2), run))
        starts = tied.select("repo", "edge", F.array_compact(F.array(*runs)).alias("runs")).where("edge and size(runs) > 0")
        longer = by_repository(starts.select("repo", F.explode("runs").alias("run")), "run").where(F.col("repos") >= least_repos)
        grams = grams.unionByName(longer.select(F.size("run").alias("n"), "run", "n_total", "repos"))
    # Only what is frequent is spelled.
    spelled = grams.select("n", "run", "n_total", "repos", F.posexplode("run").alias("at", "number")).join(few(listed.select("number", "folded")), "number")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "folded"))), lambda x: x["folded"]), " ")
    return spelled.groupBy("run").agg(F.first("n").alias("n"), text.alias("gram"), F.first("n_total").alias("n_total"), F.first("repos").alias("repos")).drop("run")


def side_rates(tokens: DataFrame, docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Hits (gram, side, repo, n) and repositories (side, repo, tokens). docs: doc_id, side, repo."""
    prose = tokens.join(docs, "doc_id")
    repos = prose.groupBy("side", "repo").agg(F.count("*").alias("tokens"))
    hits = ngrams(tokens, n).join(docs, "doc_id").groupBy("gram", "side", "repo").agg(F.count("*").alias("n"))
    return hits, repos


def compared(hits: DataFrame, repos: DataFrame, item: str = "gram") -> DataFrame:
    """item, occurrences, repos and rate on both sides, and their smoothed ratio; side 0 is the focus."""
    rates = stats.repo_rates(hits, repos, item)
    pick = lambda c, side: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    wide = rates.groupBy(item).agg(*(pick(c, s).alias(f"{name}_{c}") for s, name in ((0, "focus"), (1, "reference")) for c in ("occurrences", "repos", "rate")))
    words = repos.where("side = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_words"))
    smooth = stats.smoothing(F.col("_words"))
    return wide.crossJoin(F.broadcast(words)).withColumn("ratio", stats.ratio(F.col("focus_rate"), F.col("reference_rate"), smooth)).drop("_words")


def top_share(hits: DataFrame, item: str = "gram") -> DataFrame:
    """item and the largest repository's share of its focus occurrences."""
    return hits.where("side = 0").groupBy(item).agg((F.max("n") / F.sum("n")).alias("top_share"))


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows pass the steps up to each."""
    passed, counts = F.lit(True), []
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(*counts)


def nested_in(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """gram, inner: each longer run beside every shorter run that it contains."""
    words = F.split("gram", " ")
    size = F.size(words)
    starts = F.sequence(F.lit(1), size)
    parts = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(a, size), lambda b: F.array_join(F.slice(words, a, b - a + 1), " "))))
    exploded = longer.select("gram", F.explode(F.array_distinct(parts)).alias("inner")).where("inner <> gram")
    return exploded.join(shorter.select(F.col("gram").alias("inner")), "inner", "left_semi").select("gram", "inner")


def masked_examples(tokens: DataFrame, hits: DataFrame, docs: DataFrame, common: DataFrame, around: int = 15, most: int = 3) -> DataFrame:
    """gram, rank, repo, example: at most three per gram, of different repositories; words that aren't common are masked.

    hits: doc_id, block_id, pos, gram. common: folded, a list of bounded length.
    """
    first = Window.partitionBy("gram", "repo").orderBy("doc_id", "block_id", "pos")
    chosen = hits.join(docs, "doc_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("gram").orderBy("repo", "doc_id"))).where(F.col("rank") <= most)
    near = chosen.withColumnRenamed("pos", "_at").join(tokens.select("doc_id", "block_id", "pos", "folded", "kind"), ["doc_id", "block_id"]).where(F.col("pos").between(F.col("_at") - around, F.col("_at") + around))
    known = near.join(F.broadcast(common.select("folded", F.lit(True).alias("_common"))), "folded", "left")
    shown = F.when(F.col("_common") | ~F.col("kind").isin("Word"), F.col("folded")).otherwise("_")
    lines = known.groupBy("gram", "rank", "repo").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("word")))).alias("_words"))
    return lines.select("gram", "rank", "repo", F.array_join(F.transform("_words", lambda w: w["word"]), " ").alias("example"))


def lint_rates(docs: DataFrame, findings: DataFrame, lints: list[str], label: str = "label", repo: str = "repo") -> DataFrame:
    """lint, label, failing, checked, file_share, repo_share, zeros included.

    docs: doc_id, label, repo. findings: doc_id, lint. Each repository's share of failing files
    weighs the same in repo_share.
    """
    failing = findings.select("doc_id", "lint").distinct().join(docs, "doc_id").groupBy("lint", label, repo).agg(F.count("*").alias("failing"))
    checked = docs.groupBy(label, repo).agg(F.count("*").alias("checked"))
    every = checked.withColumn("lint", F.explode(F.array(*map(F.lit, lints))))
    rows = every.join(failing, ["lint", label, repo], "left").na.fill(0, ["failing"])
    return rows.groupBy("lint", label).agg(
        F.sum("failing").alias("failing"),
        F.sum("checked").alias("checked"),
        (F.sum("failing") / F.sum("checked")).alias("file_share"),
        F.avg(F.col("failing") / F.col("checked")).alias("repo_share"),
    )


def ranked(rows: DataFrame, item: str, least_repos: int, top: int) -> DataFrame:
    """The items of enough repositories on either side, by focus rate, then ratio, then name."""
    enough = rows.where(F.greatest("focus_repos", "reference_repos") >= least_repos)
    return enough.orderBy(F.desc("focus_rate"), F.desc("ratio"), item).limit(top)


def tool_rows(docs: DataFrame, tools: str, repo: str) -> DataFrame:
    """tool, files and repositories where it stands alone and where it stands at all. tools: an array."""
    rows = docs.select(F.explode(F.array_distinct(tools)).alias("tool"), (F.size(F.array_distinct(tools)) == 1).alias("alone"), F.col(repo).alias("repo"))
    return rows.groupBy("tool").agg(F.count_if("alone").alias("files_alone"), F.count("*").alias("files"), F.count_distinct(F.when(F.col("alone"), F.col("repo"))).alias("repos_alone"), F.count_distinct("repo").alias("repos"))


def eligible_sentences(tokens: DataFrame, least_words: int = 2, most_tokens: int = 60, english: float = 0.0) -> DataFrame:
    """doc_id, block_id, sent_id, words, n_tokens of sentences fit for a sample."""
    found = tokens.groupBy("doc_id", "block_id", "sent_id").agg(
        F.count_if(F.col("kind") == "Word").alias("words"),
        F.count("*").alias("n_tokens"),
        F.count_if(F.col("folded").isin(ENGLISH)).alias("_common"),
        F.count_if(F.col("kind").isin("Code", "Url")).alias("_other"),
    )
    good = found.where((F.col("words") >= least_words) & (F.col("n_tokens") <= most_tokens) & (F.col("_other") == 0) & (F.col("_common") >= english * F.col("words")))
    return good.drop("_common", "_other")


def gram_documents(runs: DataFrame, dealt: DataFrame, least_repos: int) -> DataFrame:
    """gram, doc_id, n and first (block_id, pos) of the runs that so many repositories have, in every document.

    runs: doc_id, repo, block_id, pos, gram; dealt: the same rows dealt by document, with doc_id and repo as the
    struct doc_id. Runs are counted as hashes of 64 bits; where two runs share one, they are counted again as text. The hashes and
    runs that are kept are broadcast while they are few.
    """
    few = lambda frame: F.broadcast(frame) if frame.count() <= MAX_BROADCAST_RUNS else frame
    coded = lambda rows: rows.withColumn("hash", F.xxhash64("gram"))
    counted = coded(runs).where("repo is not null").select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    likely = stored(counted.where(F.col("repos") >= least_repos).select("hash"), "hashes")
    held = coded(dealt).join(few(likely), "hash", "left_semi").groupBy("doc_id", "hash", "gram").agg(F.count("*").alias("n"), F.min(F.struct("block_id", "pos")).alias("first"))
    held = stored(held.select("doc_id.doc_id", "doc_id.repo", "hash", "gram", "n", "first"), "runs")
    named = stored(held.groupBy("hash").agg(F.min("gram").alias("gram"), F.max("gram").alias("last")), "named")
    shared = held.join(few(named.where("gram <> last").select("hash")), "hash", "left_semi").where("repo is not null")
    again = by_repository(shared, "gram").where(F.col("repos") >= least_repos).select("gram")
    kept = stored(named.where("gram = last").select("gram").unionByName(again), "kept")
    met = held.join(few(kept), "gram", "left_semi")
    return met.groupBy("gram", "doc_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def ranked_by_interval(compared_: DataFrame, intervals: DataFrame, item: str, most: int) -> DataFrame:
    """The items whose interval begins highest, ties by ratio, then name. intervals: item, low, high."""
    met = compared_.join(intervals.withColumnRenamed("item", item), item)
    return met.orderBy(F.desc("low"), F.desc("ratio"), item).limit(most)


def pattern_rates(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """label, files, hit_files and matches, zeros included. docs: doc_id, label. hits: doc_id, n."""
    met = docs.join(hits.select("doc_id", "n"), "doc_id", "left")
    return met.groupBy("label").agg(F.count("*").alias("files"), F.count("n").alias("hit_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))


def plain_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_id, first_line, last_line, text of plain texts: runs of lines that aren't blank; lines from 1."""
    rows = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(r"\S"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    found = rows.withColumn("_island", island).groupBy("doc_id", "_island").agg((F.min("n") + 1).alias("first_line"), (F.max("n") + 1).alias("last_line"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).alias("block_id"), "first_line", "last_line", text.alias("text"))


def summary(docs: DataFrame, facets: list[str], label: str, repo: str, size: str) -> DataFrame:
    """section, key, label, files, repos and chars over all documents and by each facet, in one pass."""
    grouped = docs.groupingSets([[label], *([f, label] for f in facets)], *facets, label)
    counted = grouped.agg(F.count("*").alias("files"), F.count_distinct(repo).alias("repos"), F.sum(size).alias("chars"), *(F.grouping(f).alias(f"_all_{f}") for f in facets))
    section = F.coalesce(*(F.when(F.col(f"_all_{f}") == 0, f) for f in facets), F.lit("all"))
    key = F.coalesce(*(F.when(F.col(f"_all_{f}") == 0, F.col(f).cast("string")) for f in facets), F.lit(""))
    return counted.select(section.alias("section"), key.alias("key"), F.col(label).alias("label"), "files", "repos", "chars")


def unmerged(kept: DataFrame) -> DataFrame:
    """The kept runs that hold no other kept run: a longer one merges into a shorter one within it."""
    return kept.join(nested_in(kept, kept).select("gram").distinct(), "gram", "left_anti")


def sieve(wide: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The candidates that pass all steps and hold no other, and (step, name, left): how many are left after each step and after the merge."""
    passed = F.lit(True)
    for _, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
    kept = unmerged(stored(wide.where(passed), "passed"))
    counts = funnel(wide, steps)
    rows = F.array(*(F.struct(F.lit(n).alias("step"), F.lit(name).alias("name"), F.col(name).alias("left")) for n, (name, _) in enumerate(steps)))
    merged = kept.agg(F.count("*").alias("left")).select(F.lit(len(steps)).alias("step"), F.lit("merged").alias("name"), "left")
    return kept, counts.select(F.explode(rows).alias("r")).select("r.*").unionByName(merged)
