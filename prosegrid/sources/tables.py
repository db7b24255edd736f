"""Tables between rounds, in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, as in tests, a fresh temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="prosegrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later rounds don't plan it again, and lost executors cost no recomputation."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/prosegrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that stored() has made in this application; results that weren't written can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/prosegrid-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """The frame with number, each row's place in a global order, from 0: ranges of the order are numbered apart, and begin where those before them end."""
    ranged = frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    laid = stored(ranged, name)
    # A row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return laid.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def running(frame: DataFrame, group: str, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """The frame with, for each sum's name, the sum over the rows of its group that are before it in the order, which must tell rows apart.

    Rows are laid out in ranges of group and order, so a large group is many ranges, and no group is one task.
    """
    ranged = frame.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    laid = stored(ranged, name)
    inside = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("_range", group).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    # A row for each range that a group has.
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.col(group).alias("_group"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    placed = laid.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()})
    met = placed.join(starts, (placed["_range"] == starts["_range"]) & placed[group].eqNullSafe(starts["_group"])).drop(starts["_range"])
    return met.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_range", "_group", *(f"_before_{n}" for n in sums))
