"""Connected components of a link table, by label propagation with pointer jumping, and what ties them to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, label): the smallest node reachable, for each node that has a link.

    Each round takes the smallest label of the neighbours, then jumps to the label's label. Rounds
    are written to the shared folder; only the number of changed labels comes to the driver. An
    empty link table gives an empty result; repeated links and links to oneself do no harm.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = written(spark, both.where("a <> b").distinct(), "arcs")
    labels = written(spark, arcs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = arcs.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        lower = labels.select("node", "label", F.col("label").alias("old")).unionAll(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        lower = written(spark, lower, "labels")
        further = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = written(spark, lower.join(further, "label", "left").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        discard(labels, lower)
        labels = jumped
        if not labels.where("label <> old").limit(1).count():
            discard(arcs)
            return labels.select("node", "label")


def same_document(rows: DataFrame, node: str) -> DataFrame:
    """Links (a, b) between the nodes of rows that repeat a doc_id; a null doc_id ties nothing."""
    pairs = rows.where("doc_id is not null").select("doc_id", node).distinct()
    first = pairs.groupBy("doc_id").agg(F.min(node).alias("a"), F.max(node).alias("last")).where("a <> last").select("doc_id", "a")
    return pairs.join(first, "doc_id").where(F.col(node) != F.col("a")).select("a", F.col(node).alias("b"))


def smallest_documents(nodes: DataFrame, node: str, labels: DataFrame) -> DataFrame:
    """node and component_id, the smallest doc_id of its component, null if no row of it has one. nodes: node and doc, its smallest doc_id."""
    known = nodes.select(node, "doc").join(labels.select(F.col("node").alias(node), "label"), node, "left").select(node, "doc", F.coalesce("label", node).alias("label"))
    whole = known.groupBy("label").agg(F.min("doc").alias("component_id"))
    return known.join(whole, "label").select(node, "component_id")
