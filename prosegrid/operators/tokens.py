"""Blocks, tokens and sentences of documents, as tables.

Where windows or joins on a document's tokens follow, texts are dealt by document before they are
exploded, so that these find them together and never shuffle tokens; counts need no such move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from prosegrid.functions import text as T


def in_block() -> WindowSpec:
    return Window.partitionBy("doc_id", "block_id").orderBy("pos")


def in_sentence() -> WindowSpec:
    return Window.partitionBy("doc_id", "block_id", "sent_id").orderBy("pos")


def spread(docs: DataFrame) -> DataFrame:
    """Texts where they lie, unless they lie in fewer partitions than there are cores: then they are dealt by document."""
    few = docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition("doc_id") if few else docs


def line_blocks(docs: DataFrame, windowed: bool = False) -> DataFrame:
    """doc_id, block_id, text: each line is a block.

    windowed: whether windows over a document's tokens follow. Then texts are dealt by document
    before they are exploded; otherwise they stay where they were read, if that is spread enough.
    """
    rows = docs.select("doc_id", "text")
    rows = rows.repartition("doc_id") if windowed else spread(rows)
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_id", "text"))


def tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, pos, spaced, text, folded, kind."""
    rows = blocks.select("doc_id", "block_id", F.posexplode(T.pieces(F.col("text"))).alias("pos", "piece"))
    text = F.regexp_replace("piece", r"^\s+", "")
    rows = rows.select("doc_id", "block_id", "pos", (F.col("piece") != text).alias("spaced"), text.alias("text"))
    return rows.withColumns({"folded": T.fold(F.col("text")), "kind": T.token_kind(F.col("text"))})


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, words and types of documents that have any token.

    Each text is counted as an array where it lies; what moves is its distinct tokens, once.
    """
    pieces = F.flatten(F.transform(F.split("text", "\n"), T.pieces))
    spelled = F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+", ""))
    rows = spread(docs.select("doc_id", "text")).select("doc_id", spelled.alias("texts")).where(F.size("texts") > 0)
    words = F.size(F.filter("texts", lambda t: T.token_kind(t) == "Word"))
    counted = rows.select("doc_id", F.size("texts").alias("tokens"), words.alias("words"), F.array_distinct(F.transform("texts", T.fold)).alias("types"))
    found = counted.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), F.collect_list("types").alias("types"))
    return found.withColumn("types", F.when(F.size("types") == 1, F.size(F.get("types", F.lit(0)))).otherwise(F.size(F.array_distinct(F.flatten("types")))).cast("long"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Tokens with start and end in code points of the block's text."""
    rows = blocks.select("doc_id", "block_id", F.posexplode(T.pieces(F.col("text"))).alias("pos", "piece"))
    end = F.sum(F.char_length("piece")).over(in_block())
    text = F.regexp_replace("piece", r"^\s+", "")
    rows = rows.select("doc_id", "block_id", "pos", (F.col("piece") != text).alias("spaced"), text.alias("text"), end.alias("end"))
    return rows.withColumns({"folded": T.fold(F.col("text")), "kind": T.token_kind(F.col("text")), "start": F.col("end") - F.char_length("text")})


def sentences(rows: DataFrame) -> DataFrame:
    """Adds sent_id: a sentence ends at . ! ? or an ellipsis and what closes around it, before white space and no small letter."""
    settled = F.when(F.col("text").isin(T.TERMINALS), True).when(F.col("text").isin(T.CLOSERS) & ~F.col("spaced"), None).otherwise(False)
    ended = F.last(settled, ignorenulls=True).over(in_block().rowsBetween(Window.unboundedPreceding, -1))
    begins = ended & F.col("spaced") & ~F.col("text").rlike(r"^\p{Ll}")
    marked = rows.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int"))
    return marked.withColumn("sent_id", F.sum("_begins").over(in_block())).drop("_begins")


def runs(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Runs of so many prose tokens within a block that no . ! ? or ellipsis parts: doc_id, block_id, pos, n, gram; all lengths from one reading.

    Runs are cut by what is no prose token (code, URLs) and by terminal marks, and begin and end
    with a word or number.
    """
    prose = F.col("kind").isin("Word", "Number", "Punctuation", "Symbol") & ~F.col("text").isin(T.TERMINALS)
    edge = F.col("kind").isin("Word", "Number")
    if most == 1:  # no window, so no sort
        return rows.where(edge & prose).select("doc_id", "block_id", "pos", F.lit(1).alias("n"), F.col("folded").alias("gram"))
    ahead = lambda c, k: F.lead(c, k).over(in_block()) if k else (F.col(c) if isinstance(c, str) else c)
    found, good = [], edge & prose
    for n in range(1, most + 1):
        if n > 1:
            good = good & ahead(prose, n - 1)
        if n >= least:
            gram = F.concat_ws(" ", *(ahead("folded", k) for k in range(n)))
            found.append(F.when(good & ahead(edge, n - 1), F.struct(F.lit(n).alias("n"), gram.alias("gram"))))
    if len(found) == 1:
        return rows.select("doc_id", "block_id", "pos", found[0].alias("_run")).where("_run is not null").select("doc_id", "block_id", "pos", "_run.*")
    listed = rows.select("doc_id", "block_id", "pos", F.array_compact(F.array(*found)).alias("_runs"))
    return listed.select("doc_id", "block_id", "pos", F.explode("_runs").alias("_run")).select("doc_id", "block_id", "pos", "_run.*")


def ngrams(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, block_id, pos and gram of the runs of n tokens."""
    return runs(rows, n, n).drop("n")


def line_runs(blocks: DataFrame, n: int) -> DataFrame:
    """The columns of the blocks but their text, with pos and gram of the same runs; a token's row has those after it, so no token moves or is sorted."""
    keys = [c for c in blocks.columns if c != "text"]
    ahead = F.transform("_pieces", lambda p, i: F.struct(p.alias("p0"), *(F.get("_pieces", i + k).alias(f"p{k}") for k in range(1, n))))
    rows = blocks.select(*keys, T.pieces(F.col("text")).alias("_pieces")).select(*keys, F.posexplode(ahead).alias("pos", "_ahead"))
    rows = rows.where(f"_ahead.p{n - 1} is not null").select(*keys, "pos", *(F.regexp_replace(f"_ahead.p{k}", r"^\s+", "").alias(f"_t{k}") for k in range(n)))
    kind = lambda k: T.token_kind(F.col(f"_t{k}"))
    inner = [kind(k).isin("Word", "Number", "Punctuation", "Symbol") & ~F.col(f"_t{k}").isin(T.TERMINALS) for k in range(1, n - 1)]
    for good in [kind(0).isin("Word", "Number"), *([kind(n - 1).isin("Word", "Number")] if n > 1 else []), *inner]:
        rows = rows.where(good)
    return rows.select(*keys, "pos", F.concat_ws(" ", *(T.fold(F.col(f"_t{k}")) for k in range(n))).alias("gram"))
