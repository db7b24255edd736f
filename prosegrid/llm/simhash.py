"""Near duplicates by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

A text is lower-cased (A-Z), cut into words at ASCII white space and hashed by shingles of three
words. The 64 bits are split into five blocks. Of fingerprints that differ in three bits or fewer,
two blocks at least agree, so links are sought among fingerprints that share a pair of blocks.

Only distinct fingerprints are joined: copies share theirs. A pair of blocks that many
fingerprints share is dealt into lanes of bounded size, every two parts of it meeting in one lane.
A lane compares its fingerprints in memory and returns a spanning forest of its links, never all
pairs, so no link between components is lost and none is repeated.

Defined results: a null or blank text has the fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows and rows that repeat a doc_id are linked
through it; an empty table gives an empty result. A row with a null doc_id links others like any
row; its component_id is null where no row that it reaches has a doc_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.components import components, same_document, smallest_documents
from prosegrid.llm.shared import bounded_batches, trimmed, written

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Where the blocks begin, and the end of the last.
EDGES = (0, 13, 26, 39, 52, 64)
#: Fingerprints of one bucket that a part of a lane holds, about.
PART = 1024


def simhash(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        shingle = xxhash.xxh64_intdigest
        hashes = np.fromiter((shingle(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())), "<u8", len(starts))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and its fingerprint as a long of the same bits."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), words) for t in texts], "<u8").view("<i8"))

    return docs.select("doc_id", prints(F.col("text").cast("binary")).alias("fingerprint"))


def _bucket(number: int, first: int, second: int) -> Column:
    def block(k: int) -> Column:
        width = EDGES[k + 1] - EDGES[k]
        return F.shiftrightunsigned("fingerprint", EDGES[k]).bitwiseAND((1 << width) - 1)

    return F.lit(number << 32).bitwiseOR(F.shiftleft(block(first), 16)).bitwiseOR(block(second))


def _forest(near: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The components of a boolean adjacency matrix, as the smallest member's place; label is where to begin."""
    label = label.copy()
    while True:
        low = np.where(near, label[None, :], len(label)).min(axis=1, initial=len(label))
        low = np.minimum(low, label)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def lane_links(prints: np.ndarray, nodes: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a lane: those within the one part it has, or those that tie its two parts' components."""
    order = np.argsort(nodes, kind="stable")
    prints, nodes, second = prints[order], nodes[order], second[order]
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= MAX_DISTANCE
    alone = np.arange(len(nodes))
    if not second.any():
        label = _forest(near, alone)
        return [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(label) if r != i]
    within = _forest(near & (second[:, None] == second[None, :]), alone)
    across = _forest(near, within)
    # A component of one part that joins a smaller one: one link says so, whichever of its members are near.
    return [(int(nodes[across[i]]), int(nodes[i])) for i in np.unique(within) if across[i] != i]


def links(nodes: DataFrame) -> DataFrame:
    """(fingerprint, node) rows, fingerprints distinct, to spanning links (a, b) between nodes."""
    keys = [_bucket(n, i, j) for n, (i, j) in enumerate(combinations(range(len(EDGES) - 1), 2))]
    keyed = nodes.select("fingerprint", "node", F.explode(F.array(*keys)).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    met = keyed.join(shared, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lanes = dealt.groupBy("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(
        F.collect_list("fingerprint").alias("prints"), F.collect_list("node").alias("nodes"), F.collect_list(F.col("part") > F.col("other")).alias("second")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for prints, members, second in zip(batch.column("prints"), batch.column("nodes"), batch.column("second")):
                values = prints.values.to_numpy(zero_copy_only=False).view("<u8")
                ids = members.values.to_numpy(zero_copy_only=False)
                if len(values) == 2:
                    if int(values[0] ^ values[1]).bit_count() <= MAX_DISTANCE:
                        found.add((int(ids.min()), int(ids.max())))
                elif len(values) > 2:
                    found.update(lane_links(values, ids, second.values.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return lanes.select("prints", "nodes", "second").mapInArrow(trimmed(compare), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links."""
    spark = docs.sparkSession
    bounded_batches(spark)
    prints = written(spark, fingerprints(docs, words), "fingerprints")
    nodes = written(spark, prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc")), "nodes")
    labels = components(links(nodes.withColumn("node", F.col("fingerprint"))).unionAll(same_document(prints, "fingerprint")))
    known = smallest_documents(nodes, "fingerprint", labels)
    return prints.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")
