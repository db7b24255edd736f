"""Exact top-k inner products in three phases with a uniform threshold.

A score is a sum over slices of the dimensions. For each query there are as many lists as slices,
each with a local score for every vector; the lists are cut into chunks of vectors, and each phase
meets them in blocks of queries.

1. Gather: every list gives its k best entries. Their full scores are looked up, and the k-th best
   of them is a cutoff that the answer cannot fall below.
2. Collect: the cutoffs are broadcast, one number for each query, or joined if there are too many.
   With m lists, an entry of the answer has a local score of an m-th of the cutoff at least in one
   of them; the lists return such entries and no others.
3. Resolve: the local scores that a collected entry still lacks are computed from its vectors, the
   sums are compared with the cutoff, and the best k remain. The full score of an entry that no
   list returned is never computed.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id; rows that repeat an id count once, with the smallest vector; vectors are only
compared with those of as many components. Components are held at 2^62 at most and local scores at
2^61, so only scores that large lose digits. An empty table, or a query alone, gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches, trimmed, written

CHUNK_ROWS, BLOCK_ROWS = 4096, 1024
SLICES = 2
#: Cutoffs that are broadcast, 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST_CUTOFFS = 1_000_000
#: Queries' lists whose best a task holds before it gives them away, of 16 * k bytes each.
MAX_HELD = 131_072
#: Below any score, for entries that don't exist or are the query itself.
NONE = np.iinfo(np.int64).min
LARGEST = 1 << 61


def integer_vectors(frame: DataFrame, scale: int) -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors that take part."""
    value = lambda x: x.cast("double")
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(value(x)) < float("inf"), F.lit(False)))
    vectors = frame.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    held = lambda x: F.greatest(F.least(F.lit(scale) * value(x), F.lit(2.0**62)), F.lit(-(2.0**62)))
    floors = F.transform("embedding", lambda x: F.floor(held(x)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The inner products of two matrices' rows, each with each, exactly."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    if most < LARGEST:
        return q @ v.T
    return np.clip(q.astype(object) @ v.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def pair_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The inner product of each row of q with the row of v at the same place."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    if most < LARGEST:
        return np.einsum("ij,ij->i", q, v)
    return np.clip((q.astype(object) * v.astype(object)).sum(axis=1), -LARGEST, LARGEST).astype(np.int64)


def slice_edges(dim: int) -> list[int]:
    return [dim * n // SLICES for n in range(SLICES + 1)]


def _matrix(rows: pa.StructScalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of a list of (vec_id, v) structs."""
    values = rows.values
    ids, v = values.field("vec_id"), values.field("v").flatten()
    return ids.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False).reshape(len(ids), dim)


def _own(query_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a query meets itself."""
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, query_ids, sorter=order), len(order) - 1)]
    own = np.flatnonzero(ids[at] == query_ids)
    return own, at[own]


def list_scores(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """The scores of a block's queries and a chunk's entries in each list, one list after another; a query's own entry has none."""
    own, edges = _own(query_ids, ids), slice_edges(q.shape[1])
    for a, b in zip(edges, edges[1:]):
        scores = products(q[:, a:b], v[:, a:b])
        scores[own] = NONE
        yield scores


def reaching(scores: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in a list of the entries that it returns: those with an even share of the query's cutoff at least."""
    return np.nonzero((scores >= -(-cutoffs // SLICES)[:, None]) & (scores != NONE))  # rounded up


def _cutoffs(queries: pa.StructScalar) -> np.ndarray:
    return queries.values.field("cutoff").to_numpy(zero_copy_only=False)


class Search:
    """The three phases over one table of vectors.

    Each phase meets blocks of queries with chunks of vectors as a plain product of two stored tables, which
    moves neither: a block is read beside the chunks, and no copy of it for each chunk is ever shuffled or broadcast.
    """

    def __init__(self, frame: DataFrame, queries: str, k: int, scale: int):
        spark = frame.sparkSession
        bounded_batches(spark)
        self.k = k
        self.vectors = written(spark, integer_vectors(frame, scale).withColumn("dim", F.size("v")), "vectors")
        n, self.n_queries = self.vectors.agg(F.count("*"), F.count_if(F.expr(queries))).first()
        self.n_chunks, n_blocks = max(1, math.ceil(n / CHUNK_ROWS)), max(1, math.ceil(self.n_queries / BLOCK_ROWS))
        place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
        chunks = self.vectors.groupBy("dim", place(self.n_chunks).alias("chunk")).agg(F.collect_list(F.struct("vec_id", "v")).alias("vectors"))
        self.chunks = written(spark, chunks, "chunks")
        self.asking = self.vectors.where(queries).withColumn("block", place(n_blocks))

    def _blocks(self, asking: DataFrame, *more: str) -> DataFrame:
        blocks = asking.groupBy(F.col("dim").alias("of"), "block").agg(F.collect_list(F.struct("vec_id", "v", *more)).alias("queries"))
        return written(self.vectors.sparkSession, blocks, "blocks")

    def _pairs(self, blocks: DataFrame) -> DataFrame:
        """dim, chunk, block, queries and vectors: each block beside each chunk of as many components."""
        # Not an equality of two columns, for which Spark would move or broadcast both sides.
        met = self.chunks.join(blocks, F.col("dim") - F.col("of") == 0)
        return met.select("dim", "chunk", "block", "queries", "vectors")

    def cutoffs(self) -> DataFrame:
        """query_id and cutoff: the k-th best full score among the leaders of the query's lists, null if there are fewer."""
        k = self.k

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The best of all chunks that the task has met, for each list of a block.
            held: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}

            def given() -> Iterator[pa.RecordBatch]:
                kind = pa.list_(pa.struct([("local", pa.int64()), ("vec_id", pa.int64())]))
                for (_, _, number), (query_ids, locals_, names, chunk) in held.items():
                    best = [[{"local": s, "vec_id": i} for s, i in zip(row, own) if s != NONE] for row, own in zip(locals_.tolist(), names.tolist())]
                    fixed = lambda x: pa.array(np.full(len(best), x, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids), fixed(number), fixed(chunk), pa.array(best, kind)], ["query_id", "slice", "chunk", "best"])
                held.clear()

            for batch in batches:
                for dim, chunk, block, queries, vectors in zip(*batch.columns):
                    query_ids, q = _matrix(queries, dim.as_py())
                    ids, v = _matrix(vectors, dim.as_py())
                    for number, scores in enumerate(list_scores(query_ids, q, ids, v)):
                        key, some = (dim.as_py(), block.as_py(), number), min(k, len(ids))
                        lead = np.argpartition(~scores, some - 1, axis=1)[:, :some]
                        locals_, names = np.take_along_axis(scores, lead, axis=1), ids[lead]
                        if key in held:
                            locals_, names = np.hstack([held[key][1], locals_]), np.hstack([held[key][2], names])
                            if locals_.shape[1] > k:
                                lead = np.argpartition(~locals_, k - 1, axis=1)[:, :k]
                                locals_, names = np.take_along_axis(locals_, lead, axis=1), np.take_along_axis(names, lead, axis=1)
                        held[key] = (query_ids, locals_, names, chunk.as_py())
                    if sum(len(x[0]) for x in held.values()) > MAX_HELD:
                        yield from given()
            yield from given()

        gathered = self._pairs(self._blocks(self.asking)).mapInArrow(trimmed(gather), "query_id long, slice int, chunk int, best array<struct<local: long, vec_id: long>>")
        best = lambda: F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
        some = gathered.groupBy("query_id", "slice", F.pmod("chunk", F.lit(math.isqrt(self.n_chunks) + 1)).alias("chunk")).agg(best())
        leaders = some.groupBy("query_id", "slice").agg(best()).select("query_id", F.explode("best.vec_id").alias("vec_id")).distinct()

        @F.arrow_udf("long")
        def score(queries: pa.Array, entries: pa.Array) -> pa.Array:
            sizes = {len(x) for x in queries}
            if len(sizes) == 1:
                shape = (len(queries), sizes.pop())
                return pa.array(pair_products(*(x.flatten().to_numpy(zero_copy_only=False).reshape(shape) for x in (queries, entries))))
            whole = [np.array([x.as_py()], np.int64).reshape(1, -1) for x in (*queries, *entries)]
            return pa.array([int(pair_products(q, v)[0]) for q, v in zip(whole[: len(queries)], whole[len(queries) :])], pa.int64())

        met = leaders.join(self.vectors.select("vec_id", "v"), "vec_id").join(self.asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        scored = met.select("query_id", score("q", "v").alias("score"))
        ranked = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))  # of SLICES * k scores at most
        return scored.groupBy("query_id").agg(ranked.alias("cutoff"))

    def told(self, cutoffs: DataFrame) -> DataFrame:
        """The blocks with their cutoffs."""
        known = cutoffs.select(F.col("query_id").alias("vec_id"), "cutoff")
        known = F.broadcast(known) if self.n_queries <= MAX_BROADCAST_CUTOFFS else known
        return self._blocks(self.asking.join(known, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-(1 << 62)))), "cutoff")

    def collected(self, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The blocks with their cutoffs, and what the lists return: dim, block, chunk, slice and the places of queries and entries with their local scores."""

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, chunk, block, queries, vectors in zip(*batch.columns):
                    cutoff, asked, held = _cutoffs(queries), _matrix(queries, dim.as_py()), _matrix(vectors, dim.as_py())
                    for number, scores in enumerate(list_scores(*asked, *held)):
                        at, found = reaching(scores, cutoff)
                        lists = [pa.array([x], pa.list_(t)) for x, t in ((at.astype(np.int32), pa.int32()), (found.astype(np.int32), pa.int32()), (scores[at, found], pa.int64()))]
                        fixed = [pa.array([x], pa.int32()) for x in (dim.as_py(), block.as_py(), chunk.as_py(), number)]
                        yield pa.RecordBatch.from_arrays(fixed + lists, ["dim", "block", "chunk", "slice", "queries", "entries", "local"])

        blocks = self.told(cutoffs)
        kind = "dim int, block int, chunk int, slice int, queries array<int>, entries array<int>, local array<long>"
        return blocks, self._pairs(blocks).mapInArrow(trimmed(collect), kind)

    def resolved(self, blocks: DataFrame) -> DataFrame:
        """query_id, vec_id and score of the entries that a list returns and that reach the cutoff, k of a chunk for a query at most.

        A pair's lists are collected and resolved in one place, so neither entries nor vectors move in between.
        """
        k = self.k

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, _, _, queries, vectors in zip(*batch.columns):
                    query_ids, q = _matrix(queries, dim.as_py())
                    ids, v = _matrix(vectors, dim.as_py())
                    cutoff, edges = _cutoffs(queries), slice_edges(dim.as_py())
                    returned = []
                    for scores in list_scores(query_ids, q, ids, v):
                        at, found = reaching(scores, cutoff)
                        returned.append((at.astype(np.int64) * len(ids) + found, scores[at, found]))
                    pairs = np.unique(np.concatenate([p for p, _ in returned]))
                    at, found = pairs // len(ids), pairs % len(ids)
                    scores = np.zeros(len(pairs), np.int64)
                    for (own, local), a, b in zip(returned, edges, edges[1:]):
                        place = np.searchsorted(pairs, own)
                        rest = np.ones(len(pairs), bool)
                        rest[place] = False
                        scores[place] += local
                        scores[rest] += pair_products(q[at[rest], a:b], v[found[rest], a:b])
                    enough = scores >= cutoff[at]
                    at, found, scores = at[enough], found[enough], scores[enough]
                    order = np.lexsort((ids[found], -scores, at))
                    at, found, scores = at[order], found[order], scores[order]
                    best = np.arange(len(at)) - np.searchsorted(at, np.arange(len(query_ids)))[at] < k
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[at[best]]), pa.array(ids[found[best]]), pa.array(scores[best])], ["query_id", "vec_id", "score"])

        return self._pairs(blocks).mapInArrow(trimmed(resolve), "query_id long, vec_id long, score long")


def top_k(frame: DataFrame, queries: str, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank from 1, vec_id and score; queries is a condition on vec_id, such as ``vec_id % 20 = 0``."""
    search = Search(frame, queries, k, scale)
    entries = search.resolved(search.told(search.cutoffs()))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
