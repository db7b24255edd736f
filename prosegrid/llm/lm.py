"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

A word's score is count(n-gram) / count(its context) for the longest n-gram that the tables hold,
times ALPHA for each word of context given up; a single word's is its share of all words. The
tables hold n-grams that occur MIN_COUNT times at least, and every word. A document's total is the
sum of the logarithms over its words, its score their mean.

The texts are read once, into blocks of about BLOCK_WORDS words: which words a block has, and its
documents as sequences of their numbers. The n-grams of a block are exploded, each of them once,
and dealt by ranges of their 64-bit hash keys. They travel as arrays, a row for each block and range.
Grouped by range, they give the count table, rows of (key, total) of 64 bits each, and exploded to
rows they are joined by key to it, where they lie. The join holds a partition's part of the table in memory while
partitions are as small as they should be, and otherwise sorts and can spill. The counts return packed to the
blocks, which are a table bucketed by block, and the logarithms are summed by document. From three
words on, only n-grams go out whose two shorter parts are both in the tables, since no other can be.

An n-gram however frequent is one row of a block, so no range of keys gets more than its share.

Defined results: words are what lies between ASCII white space, A-Z lower-cased; a null or blank
text has no words, total 0 and a null score; repeated rows count and are scored each; an empty
table gives an empty result. N-grams don't reach over documents. Other columns are ignored. Keys
of 64 bits are taken as equal only by equal n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches, saved, trimmed, written

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
BLOCK_WORDS = 1 << 20
#: Ranges of keys for each partition, at least, so that partitions get about as many.
RANGES = 4
#: N-grams that one range holds, about, at most: what a task counts at once, whatever the input.
RANGE_GRAMS = 1 << 22
#: Words of the corpus for each partition up to which its part of the count table is held in memory: a few million n-grams.
HASHED_WORDS = 1 << 22
#: Rows that a task packs at once.
PACKED_ROWS = 1 << 21


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte, all first bytes before all second ones: what they share compresses well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(blob: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of the n-gram whose context has key a and whose last word has key b."""
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, sizes, stream (numbers of words), words (their keys, sorted)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = {}
        stream: list[np.ndarray] = []
        ids: list[int | None] = []
        sizes: list[int] = []
        held = 0

        def block() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            order = np.argsort(keys)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            text = place[np.concatenate(stream)] if held else np.empty(0, np.uint32)
            columns = [pa.array([part << 32 | made]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([text.tobytes()]), pa.array([packed(keys[order])])]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "stream", "words"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or b"").lower().split()
                stream.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint32))
                ids.append(doc_id)
                sizes.append(len(words))
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield block()
                    made += 1
                    numbers, stream, ids, sizes, held = {}, [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(read), "block long, doc_ids array<long>, sizes array<int>, stream binary, words binary")


class Block:
    """A block's n-grams: for each length, the key at each word (the n-gram that ends there) and the sorted keys."""

    def __init__(self, sizes: np.ndarray, stream: bytes, words: memoryview):
        self.sizes = sizes
        self.numbers = np.frombuffer(stream, np.uint32)
        self.words = unpacked(words)
        starts = np.cumsum(sizes) - sizes
        self.place = (np.arange(len(self.numbers)) - np.repeat(starts, sizes)).astype(np.int32)
        self.keys = {1: self.words[self.numbers]}
        self.sorted: dict[int, np.ndarray] = {1: self.words}
        self.found: dict[int, np.ndarray] = {}  # the total of the n-gram that ends at each word, 0 if not in the tables

    def lengthen(self, n: int) -> np.ndarray:
        """Makes the n-grams of n words; returns how often each of the sorted ones occurs here."""
        if n == 1:
            return np.bincount(self.numbers, minlength=len(self.words))
        keys = np.zeros(len(self.numbers), np.uint64)
        keys[1:] = _mixed(self.keys[n - 1][:-1], self.keys[1][1:])
        self.keys[n] = keys
        asked = self.place >= n - 1
        if n > 2:  # both parts must be in the tables
            asked[1:] &= (self.found[n - 1][1:] > 0) & (self.found[n - 1][:-1] > 0)
        self.at = np.flatnonzero(asked)
        keys = keys[self.at]
        self.order = np.argsort(keys)
        keys = keys[self.order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.sorted[n], self.counts = keys[first], np.diff(first, append=len(keys))
        if n > 2:
            del self.keys[n - 1]
        return self.counts

    def told(self, n: int, totals: np.ndarray) -> None:
        """Takes the totals of the sorted n-grams, those made last."""
        if n == 1:
            self.found[1] = totals[self.numbers]
            return
        self.found[n] = np.zeros(len(self.numbers), np.int64)
        self.found[n][self.at[self.order]] = np.repeat(totals, self.counts)
        del self.sorted[n]

    def scores(self, order: int, corpus_words: int) -> np.ndarray:
        """The logarithm of each word's score."""
        score = np.zeros(len(self.numbers))
        open_ = np.ones(len(self.numbers), bool)
        for n in range(order, 0, -1):
            here = open_ & (self.place >= n - 1)
            hit = np.flatnonzero(here & (self.found[n] > 0))
            context = np.log(self.found[n - 1][hit - 1]) if n > 1 else math.log(corpus_words)
            score[hit] += np.log(self.found[n][hit]) - context
            open_[hit] = False
            score[here & open_] += math.log(ALPHA)
        return score


def narrowed(counts: np.ndarray) -> tuple[bytes, int]:
    """Counts in as few bytes each as the largest needs, 1 to 8."""
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << 8 * w - (w == 8))
    return counts.astype(f"<u{width}").tobytes(), width


def widened(blob: memoryview, width: int) -> np.ndarray:
    """What narrowed() wrote, as 64-bit numbers."""
    return np.frombuffer(blob, f"<u{width}").astype(np.int64)


def _rebuilt(sizes: pa.ListScalar, stream: pa.BinaryScalar, words: pa.BinaryScalar, told: pa.ListScalar | None, order: int, bits: int) -> Block:
    """The block with what it was told about its n-grams of up to order words."""
    block = Block(sizes.values.to_numpy(zero_copy_only=False), stream.as_buffer(), words.as_buffer())
    by: dict[int, list[pa.StructScalar]] = {}
    for answer in told.values if told is not None and told.is_valid else ():
        by.setdefault(answer["n"].as_py(), []).append(answer)
    for n in range(1, order + 1):
        block.lengthen(n)
        totals = np.zeros(len(block.sorted[n]), np.int64)
        for answer in by.get(n, []):
            low = np.searchsorted(block.sorted[n], np.uint64(answer["range"].as_py()) << np.uint64(64 - bits))
            found = widened(answer["totals"].as_buffer(), answer["width"].as_py())
            totals[low : low + len(found)] += found  # zero where another answer has it
        block.told(n, totals)
    return block


def _entries(blocks: DataFrame, lengths: list[int], known: int, bits: int) -> DataFrame:
    """block, n, range, keys, counts: a row for each range of keys that a block has n-grams in."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("told") if known else [None] * len(batch)
            for number, sizes, stream, words, answers in zip(batch.column("block"), batch.column("sizes"), batch.column("stream"), batch.column("words"), told):
                block = _rebuilt(sizes, stream, words, answers, known, bits)
                for n in lengths:
                    counts = block.lengthen(n).astype(np.int32)  # of one block
                    keys = block.sorted[n]
                    some, starts = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                    columns = [pa.array([number.as_py()] * len(some), pa.int64()), pa.array([n] * len(some), pa.int32()), pa.array(some.astype(np.int32))]
                    ends = pa.array([*starts.tolist(), len(keys)], pa.int32())
                    columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys.view(np.int64), counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "n", "range", "keys", "counts"])

    return blocks.mapInArrow(trimmed(explode), "block long, n int, range int, keys array<long>, counts array<int>")


def packed_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block, n, range, at and total to block, n, range, totals (by place, 0 where there is no row) and their width.

    At most PACKED_ROWS rows are held at once; a block's answer for a range may come in several parts.
    """
    names = ["block", "n", "range", "at", "total"]
    held: list[list[np.ndarray]] = []
    size = 0

    def answers() -> pa.RecordBatch:
        block, n, range_, at, total = map(np.concatenate, zip(*held)) if held else [np.empty(0, np.int64)] * 5
        order = np.lexsort((range_, n, block))
        block, n, range_, at, total = (x[order] for x in (block, n, range_, at, total))
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (n[1:] != n[:-1]) | (range_[1:] != range_[:-1])])) if len(order) else np.empty(0, np.int64)
        blobs, widths = [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            whole = np.zeros(at[a:b].max() + 1, np.int64)
            whole[at[a:b]] = total[a:b]
            blob, width = narrowed(whole)
            blobs.append(blob)
            widths.append(width)
        return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int64()), pa.array(n[first], pa.int32()), pa.array(range_[first], pa.int32()), pa.array(blobs, pa.binary()), pa.array(widths, pa.int32())], ["block", "n", "range", "totals", "width"])

    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        size += len(batch)
        if size >= PACKED_ROWS:
            yield answers()
            held, size = [], 0
    yield answers()


def counted(rows: pa.Table) -> pa.Table:
    """A range's part of the count table, from all rows that have n-grams of it: range, and its keys and totals as arrays."""
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    keys, counts = flat("keys"), flat("counts").astype(np.int64)
    words = np.repeat(rows.column("n").to_numpy(), [len(x) for x in rows.column("keys")])
    order = np.argsort(keys)
    keys, counts, words = keys[order], counts[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    totals = np.add.reduceat(counts, first)
    held = (words[first] == 1) | (totals >= MIN_COUNT)
    return pa.table({"range": rows.column("range").slice(0, 1), "keys": pa.array([keys[first][held]], pa.list_(pa.int64())), "totals": pa.array([totals[held]], pa.list_(pa.int64()))})


def _totals(entries: DataFrame, parts: int, hashed: bool) -> DataFrame:
    """block, n, range, totals, width: the corpus counts of a block's keys in their order, up to the last that the tables hold.

    hashed: whether a partition's part of the count table may be held in memory; else the join sorts and can spill.
    """
    # The conditions are those that the join and the explosion ask of their side; with them here, and counts read on both sides
    # by an expression that stays where it is written, the dealt rows are the same on both and move once.
    dealt = entries.where(F.col("range").isNotNull() & (F.size("keys") > 0) & F.col("keys").isNotNull()).repartition(parts, "range")
    table = dealt.groupBy("range").applyInArrow(counted, "range int, keys array<long>, totals array<long>").repartition(parts, "range")
    table = table.select("range", F.explode(F.arrays_zip("keys", "totals")).alias("gram")).select("range", F.col("gram.keys").alias("key"), F.col("gram.totals").alias("total"))
    sized = dealt.select("range", "n", "block", "keys", F.when(F.spark_partition_id() >= 0, F.size("counts")).alias("size"))
    grams = sized.select("range", "n", "block", "size", F.posexplode("keys").alias("at", "key")).where("at < size")
    met = grams.join(table.hint("shuffle_hash" if hashed else "merge"), ["key", "range"])
    return met.select("block", "n", "range", "at", "total").mapInArrow(trimmed(packed_totals), "block long, n int, range int, totals binary, width int")


@contextmanager
def dealt_by_range(spark: SparkSession) -> Iterator[None]:
    """Lets a join by key, n and range use rows that are dealt by range as they are; the session's setting comes back afterwards."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def range_bits(parts: int, n_words: int) -> int:
    """Bits of a key that name its range: enough for RANGES to a partition, and for RANGE_GRAMS to a range.

    Two lengths of n-grams, of each as many as there are words, are dealt at once. Keys are hashes, so ranges are even.
    """
    return math.ceil(math.log2(max(RANGES * parts, 2 * n_words / RANGE_GRAMS)))


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, total (sum of natural logarithms) and score, their mean, of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = saved(_blocks(docs), "blocks", parts, "block")
    n_words = blocks.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()[0]

    bits = range_bits(parts, n_words)

    def with_told(totals: DataFrame) -> DataFrame:
        told = totals.groupBy("block").agg(F.collect_list(F.struct("n", "range", "totals", "width")).alias("told"))
        return blocks.join(told.hint("merge"), "block", "left")

    totals = None
    for lengths in [list(range(1, min(order, 2) + 1))] + [[n] for n in range(3, order + 1)]:
        asked = with_told(totals) if totals is not None else blocks
        with dealt_by_range(spark):
            found = written(spark, _totals(_entries(asked, lengths, lengths[0] - 1, bits), parts, n_words <= HASHED_WORDS * parts), "totals")
        totals = found if totals is None else totals.unionAll(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, stream, words, told in zip(*(batch.column(c) for c in ("doc_ids", "sizes", "stream", "words", "told"))):
                block = _rebuilt(sizes, stream, words, told, order, bits)
                ends = np.concatenate([[0.0], np.cumsum(block.scores(order, n_words))])
                at = np.cumsum(block.sizes)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(block.sizes.astype(np.int64)), pa.array(ends[at] - ends[at - block.sizes])], ["doc_id", "n_words", "total"])

    found = with_told(totals).mapInArrow(trimmed(score), "doc_id long, n_words long, total double")
    return found.withColumn("score", F.try_divide("total", "n_words"))
