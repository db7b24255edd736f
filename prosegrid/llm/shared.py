"""Folders and tables that the driver and the executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once, and so about what it holds of them.
BATCH_BYTES = 4 << 20

#: Bits of a map of keys: 8 MB.
MAP_BITS = 1 << 26

_saved: set[str] = set()


def bounded_batches(spark: SparkSession) -> None:
    """Makes Spark hand rows to Python workers in batches of bounded size, however long the texts are.

    The session keeps the setting, since results are lazy and read it when they run.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trim() -> None:
    """Hands freed memory back, so that a Python worker that idles between stages doesn't hold it."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, which hands memory back when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, as in tests, a fresh temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="prosegrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where all intermediate tables of this application lie; clear() removes it."""
    return f"{shared_folder(spark)}/prosegrid-{spark.sparkContext.applicationId}"


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage is cut, and lost executors cost no recomputation."""
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.written_at = path
    return table


def saved(frame: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """Like written, but bucketed, so that joins and groups by that column don't move its rows."""
    spark = frame.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    frame.write.bucketBy(buckets, by).option("compression", "zstd").option("path", f"{run_folder(spark)}/{name}").saveAsTable(name)
    _saved.add(name)
    return spark.table(name)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.written_at)


def clear(spark: SparkSession) -> None:
    """Deletes what the operators have written in this application; results that weren't stored can't be read afterwards."""
    while _saved:
        spark.sql(f"DROP TABLE IF EXISTS {_saved.pop()}")
    _delete(spark, run_folder(spark))


def bit_map(keys: DataFrame, key: Column, bits: int = MAP_BITS) -> np.ndarray:
    """A map that says no only to keys that aren't there, whatever their number; its 64-bit words come to the driver, bits / 64 of them at most."""
    at = keys.select(F.pmod(key.cast("long"), F.lit(bits)).alias("at")).groupBy(F.expr("at div 64").alias("word"))
    words = at.agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()
    found = np.zeros(max(bits // 64, 1), np.int64)
    found[words.word] = words.bits
    return found


def may_hold(bit_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys, as 64-bit integers, the map doesn't say no to."""
    at = keys.astype(np.int64) % (len(bit_words) * 64)
    return (bit_words[at >> 6] >> (at & 63) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
