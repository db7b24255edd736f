"""Records beside texts: line files, batches and their ledgers, disputes, skeletons, saved runs, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines file; a line that doesn't fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def is_batch_name(name: Column) -> Column:
    """YYYY-MM-DD-NN."""
    return F.coalesce(name.rlike(r"^\d{4}-\d{2}-\d{2}-\d{2}$"), F.lit(False))


def history_proven(cards: DataFrame, basis: str = "basis") -> DataFrame:
    """Cards whose label a history proves: those that a publisher only declares are left out."""
    return cards.where(F.coalesce(F.col(basis) != "declared", F.lit(True)))


def ledger_faults(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """host, repo, label, said, held, fault: where a batch's ledger and what it holds disagree.

    ledger: host, repo, found_by (array), kept (map of label to count). entries: host, repo, label.
    Repositories are compared without case.
    """
    key = lambda: (F.col("host"), F.lower("repo").alias("repo"))
    lines = ledger.select(*key(), "found_by", "kept")
    said = lines.select("host", "repo", F.explode("kept").alias("label", "said")).groupBy("host", "repo", "label").agg(F.sum("said").cast("long").alias("said"))
    held = entries.select(*key(), "label").groupBy("host", "repo", "label").agg(F.count("*").alias("held"))
    met = said.join(held, ["host", "repo", "label"], "full_outer")
    counts = met.where(~F.col("said").eqNullSafe(F.col("held"))).withColumn("fault", F.when(F.col("said").isNull(), "not in the ledger").when(F.col("held").isNull(), "not held").otherwise("other count"))
    empty = lambda kind: F.lit(None).cast(kind)
    twice = lines.groupBy("host", "repo").agg(F.count("*").alias("n")).where("n > 1").select("host", "repo", empty("string").alias("label"), empty("long").alias("said"), empty("long").alias("held"), F.lit("two lines").alias("fault"))
    unfound = lines.where(F.coalesce(F.size("found_by"), F.lit(0)) < 1).select("host", "repo", empty("string").alias("label"), empty("long").alias("said"), empty("long").alias("held"), F.lit("no source").alias("fault"))
    return counts.unionByName(twice).unionByName(unfound)


def missing_revisions(live: DataFrame) -> DataFrame:
    """Fixtures that name an earlier revision which isn't a live human fixture of the same file.

    live: path, category, host, repo, source_path, sha256, commit, before_sha256, before_commit.
    """
    humans = live.where("category = 'human'").select(F.col("sha256").alias("_sha"), F.col("host").alias("_host"), F.lower("repo").alias("_repo"), F.col("source_path").alias("_path"), F.col("commit").alias("_commit")).distinct()
    named = live.where("before_sha256 is not null")
    same = (F.col("before_sha256") == F.col("_sha")) & (F.col("host") == F.col("_host")) & (F.lower("repo") == F.col("_repo")) & (F.col("source_path") == F.col("_path")) & (F.col("before_commit") == F.col("_commit"))
    return named.join(humans, same, "left_anti")


def disputes(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, word, proposed, reason of a tab-separated file; blank lines and those that begin with # are no disputes, any other line raises."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^#") & (F.trim("value") != ""))
    fields = F.split(F.regexp_replace("value", r"\r+$", ""), "\t", 4)
    good = (F.size(fields) == 4) & F.forall(fields, lambda x: F.trim(x) != "")
    field = lambda i: F.when(good, F.get(fields, F.lit(i))).otherwise(F.raise_error(F.concat(F.lit("no dispute: "), F.col("value"))).cast("string"))
    return lines.select(field(0).alias("sent_id"), field(1).alias("word"), field(2).alias("proposed"), field(3).alias("reason"))


def skeletons(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """sent_id and block: a sentence in ten columns, a line for each token with its kind, for a labeller to fill.

    tokens: sent_id, pos, text, kind, spaced (white space before it), and tag if readings are to be shown. texts: sent_id, text.
    """
    tag = F.coalesce("tag", F.lit("_")) if "tag" in tokens.columns else F.lit("_")
    misc = F.concat(F.lit("Kind="), F.col("kind"), F.when(~F.coalesce("next_spaced", F.lit(True)), "|SpaceAfter=No").otherwise(""))
    row = F.concat_ws("\t", (F.col("pos") + 1).cast("string"), "text", F.lit("_"), tag, *[F.lit("_")] * 5, misc)
    after = tokens.select("sent_id", (F.col("pos") - 1).alias("pos"), F.col("spaced").alias("next_spaced"))
    lines = tokens.join(after, ["sent_id", "pos"], "left").select("sent_id", "pos", row.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = lines.groupBy("sent_id").agg(body.alias("body")).join(texts.select("sent_id", "text"), "sent_id")
    return blocks.select("sent_id", F.concat(F.lit("# sent_id = "), "sent_id", F.lit("\n# text = "), "text", F.lit("\n"), "body", F.lit("\n")).alias("block"))


def filled(skeleton: DataFrame, labels: DataFrame) -> DataFrame:
    """A skeleton's words (sent_id, pos, text) with their labels (and tag); a word that is gone, new or another raises."""
    met = skeleton.select("sent_id", "pos", "text").join(labels.select("sent_id", "pos", F.col("text").alias("_text"), "tag"), ["sent_id", "pos"], "full_outer")
    drift = ~F.col("text").eqNullSafe(F.col("_text"))
    text = F.when(drift, F.raise_error(F.concat_ws(" ", F.lit("not the skeleton's word:"), "sent_id", F.col("pos").cast("string"))).cast("string")).otherwise(F.col("text"))
    return met.select("sent_id", "pos", text.alias("text"), "tag")


def save_run(tallies: DataFrame, path: str, gold_sha256: str) -> None:
    """Tallies as a table, each row with the digest of the gold that it was graded on."""
    tallies.withColumn("gold_sha256", F.lit(gold_sha256)).write.mode("errorifexists").parquet(path)


def saved_run(spark: SparkSession, path: str, gold_sha256: str) -> DataFrame:
    """A saved run; one that was graded on other gold raises."""
    rows = spark.read.parquet(path)
    wrong = F.when(F.col("gold_sha256") != gold_sha256, F.raise_error(F.lit("the run was graded on other gold")).cast("string")).otherwise(F.col("gold_sha256"))
    return rows.withColumn("gold_sha256", wrong)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header, as rankings, worklists and score tables are kept."""
    rows.write.option("sep", "\t").option("header", True).mode("errorifexists").csv(path)
