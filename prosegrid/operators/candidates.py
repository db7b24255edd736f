"""Which repositories come first, which sentences are junk, which reading of a word leads, how a gram is spelled."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.sources.tables import running

# Words of lorem ipsum that are not English.
LOREM = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse"
).split()
#: How many forms a part of speech has, where it isn't one.
FORMS = {"noun": 2, "verb": 4}


def ordered_candidates(rows: DataFrame, seed: str) -> DataFrame:
    """(key, sources, agent, early) candidates with rank, turn, rarest and place in the order to take them in.

    Rank 0 are keys by agents that began early, 1 other keys by agents, 2 the rest. Within a rank the
    sources take turns, each key standing for the rarest of its sources, in an order by hash.
    """
    found = rows.select("key", F.explode(F.array_distinct("sources")).alias("source")).groupBy("source").agg(F.count("*").alias("size"))
    met = rows.select("key", F.explode(F.array_distinct("sources")).alias("source")).join(found, "source")
    rarest = met.groupBy("key").agg(F.min(F.struct("size", "source"))["source"].alias("rarest"))
    rank = F.when(F.col("agent") & F.col("early"), 0).when(F.col("agent"), 1).otherwise(2)
    named = rows.join(rarest, "key").withColumns({"rank": rank, "hash": F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)})
    queue = named.withColumn("queue", F.concat_ws(":", F.col("rank").cast("string"), "rarest"))
    return running(queue, "queue", ["hash", "key"], {"turn": F.lit(1)}, "turns").select("key", "rank", F.col("turn").cast("long").alias("turn"), "rarest")


def junk() -> Column:
    """Why a sentence is junk, from its counts lorem, numbers, words, code_words, english and unknown_english; the first that applies."""
    words, english, unknown = F.col("words"), F.col("english"), F.col("unknown_english")
    return (
        F.when((F.col("lorem") >= 2) & (F.col("lorem") * 2 >= words), "lorem")
        .when((F.col("numbers") >= 3) & (F.col("numbers") >= words), "versions")
        .when((words > 0) & (F.col("code_words") * 2 >= words), "command")
        .when(((english >= 5) & (unknown * 2 > english)) | ((english >= 10) & (unknown * 100 >= 45 * english)), "not english")
    )


def is_lorem(folded: Column) -> Column:
    return F.regexp_replace(folded, r"^[^\p{L}]+|[^\p{L}]+$", "").isin(LOREM)


def sentence_facts(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """The counts that junk() reads, of each sentence's tokens. known: folded, words that are known, distinct."""
    word = F.col("kind") == "Word"
    met = tokens.join(known.select("folded", F.lit(True).alias("_known")), "folded", "left")
    return met.groupBy("doc_id", "block_id", "sent_id").agg(
        F.count_if(word).alias("words"),
        F.count_if(F.col("kind") == "Number").alias("numbers"),
        F.count_if(F.col("kind").isin("Code", "Url")).alias("code_words"),
        F.count_if(word & is_lorem(F.col("folded"))).alias("lorem"),
        F.count_if(word).alias("english"),
        F.count_if(word & F.col("_known").isNull()).alias("unknown_english"),
    )


def ranked_readings(readings: DataFrame, order: list[str], share: float = 0.9, least: int = 5) -> DataFrame:
    """form, tags (leading first) and dominant (the leading tag where it has that share of the counts, and so many) of a word list's readings.

    readings: form, tag, met (how often its lemma was met as that), place (among a list's, null last),
    senses. A count is spread over the forms that the part of speech has; ties go by place, senses and
    the fixed order.
    """
    divisor = F.lit(1)
    for tag, n in FORMS.items():
        divisor = F.when(F.col("tag") == tag, n).otherwise(divisor)
    fixed = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("tag")), F.lit(0)), F.lit(len(order) + 1))
    best = readings.withColumn("weight", F.col("met") / divisor).groupBy("form", "tag").agg(F.max("weight").alias("weight"), F.min("place").alias("place"), F.max("senses").alias("senses"), F.max("met").alias("met"))
    row = F.struct((-F.col("weight")).alias("weight"), F.coalesce("place", F.lit(1 << 30)).alias("place"), (-F.coalesce("senses", F.lit(0))).alias("senses"), fixed.alias("fixed"), "tag", "met")
    listed = best.groupBy("form").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("met").alias("all"))
    first = F.get("rows", F.lit(0))
    dominant = F.when((first["met"] >= least) & (first["met"] >= share * F.col("all")), first["tag"])
    return listed.select("form", F.array_join("rows.tag", " ").alias("tags"), dominant.alias("dominant"))


def spelled(hits: DataFrame) -> DataFrame:
    """gram and phrase: its tokens with the spacing of its first place. hits: gram, doc_id, block_id, pos, phrase."""
    return hits.groupBy("gram").agg(F.min_by("phrase", F.struct("doc_id", "block_id", "pos")).alias("phrase"))


def spaced_runs(tokens: DataFrame, n: int) -> DataFrame:
    """doc_id, block_id, pos and phrase: each run of n tokens of a block as the text spaces it."""
    order = Window.partitionBy("doc_id", "block_id").orderBy("pos")
    parts = [F.col("text")] + [F.concat(F.when(F.lead("spaced", k).over(order), " ").otherwise(""), F.lead("text", k).over(order)) for k in range(1, n)]
    return tokens.select("doc_id", "block_id", "pos", F.concat(*parts).alias("phrase")).where("phrase is not null")


def _uncut(text: str) -> str:
    """The text without brackets whose other half lies outside of it, and without the target of such a link; code spans stay."""
    cut, open_, code, at = set(), [], False, 0
    while at < len(text):
        c = text[at]
        if c == "`":
            code = not code
        elif c == "[" and not code:
            open_.append(at)
        elif c == "]" and not code and open_:
            open_.pop()
        elif c == "]" and not code:
            close = text.find(")", at) if text[at + 1 : at + 2] == "(" else at
            cut.update(range(at, max(close, at) + 1))
            at = max(close, at)
        at += 1
    return "".join(c for n, c in enumerate(text) if n not in cut and n not in open_)


def without_cut_links(quote: Column) -> Column:
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _uncut(t) for t in texts.to_pylist()], pa.string())

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.when(quote.rlike(r"[\[\]]"), F.arrow_udf(read, "string")(quote)).otherwise(quote)
