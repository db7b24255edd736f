"""Findings of documents as they arrive; beyond what the reference does, which checks on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosegrid.plans.check import check_documents


def watch(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, names: list[str] | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Checks each new text once: copies that arrive within the delay are dropped by digest. docs: path, text, ts."""
    fresh = docs.withColumn("sha256", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"])

    def batch(rows: DataFrame, number: int) -> None:
        sink(check_documents(rows.select("path", "text"), names), number)

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
