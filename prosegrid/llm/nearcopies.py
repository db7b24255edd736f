"""Near copies by the similarity of their sets of five-word shingles: SimHash, pigeonhole blocks, each link verified exactly.

A text is lower-cased (A-Z), cut into words at ASCII white space and hashed by shingles of five
words. Texts are near copies where the Jaccard similarity of their sets is ``LEAST`` or more.

A set's fingerprint is a SimHash: a bit is 1 if it is set in over half of the shingles' hashes. It
is cut into blocks, and candidates are texts that agree in a block. With 99 blocks of 16 bits, two
texts whose fingerprints differ in fewer than 99 bits agree in one for certain (pigeonhole). At a
similarity of 0.8 fingerprints differ in 0.1515 of their bits at most, (0.8485)^16 = 0.072 of the
blocks agree, and one does with a probability of 0.9994; more similar pairs have a higher one.

Only distinct sets are compared: equal texts share theirs. The members of a block's bucket are
compared by 192 bits that no block holds and tied where these differ in ``CHECK_APART`` at most; ties
are spanning forests. Blocks are taken in three passes, few first, and a pass ties only texts that the
passes before haven't brought into one family, so a large family has about as many ties as texts, not
as many for each block. A bucket of more than ``LANE`` texts is dealt into lanes that share its smallest text, and
what these ties don't bring into the bucket's largest family then meets all of the bucket. Ties,
verified or not, make families. In a family that verified ties don't join into one, all pairs are
compared by fingerprint and verified, in lanes of bounded size where every two parts of the family
meet; a lane returns a spanning forest of its links.

Defined results: null and blank texts have the empty set and are copies of each other; a text of
fewer words than a shingle is one shingle; rows that repeat a doc_id are linked through it; a row
with a null doc_id links others like any row, and its component_id is null where no row that it
reaches has a doc_id; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.components import components, same_document, smallest_documents
from prosegrid.llm.shared import bit_map, bounded_batches, discard, may_hold, trimmed, written

SHINGLE_WORDS = 5
LEAST = 0.8
#: Share of bits in which the fingerprints of two texts at LEAST differ, acos(2 LEAST / (1 + LEAST)) / pi, and of such pairs that may agree in no block.
DIFFER, MISSED = math.acos(2 * LEAST / (1 + LEAST)) / math.pi, 0.0006
#: Bits of a block at least; where more than 2^24 texts would fill the buckets, blocks get wider and more.
WIDTH = 16
#: Words of a fingerprint behind its blocks. Two texts of a tie differ in no more of their bits; at 0.8 a pair does once in 10^6, unrelated texts nearly always.
CHECK_WORDS, CHECK_APART = 3, 54
CHECKS = tuple(f"check{n}" for n in range(CHECK_WORDS))
#: Pairs of a family whose fingerprints differ in a larger share of bits aren't verified: at 0.8 it is so once in 10^6 or less.
APART = 0.2
#: Blocks that the first passes end at; the last pass takes the others.
PASSES = (2, 16)
#: Texts of a bucket that a lane holds, about, and rows of a task that compares buckets.
LANE, TASK_ROWS = 2048, 1 << 20
#: Texts that a lane's first ties bring to one text.
FAN = 32
#: A hash gives each shingle two signs for a bit, so that sets of few shingles differ in no more bits than large ones.
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 1 << 10, np.uint64) * np.uint64(2) + np.uint64(1)
MIX, AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Texts and shingles that a part of a lane holds, about.
PART, PART_SHINGLES = 512, 1 << 19
#: Large buckets whose numbers are broadcast, 16 MB; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Stands for a null doc_id where texts are looked up.
NO_ID = -1


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(len(parts) - SHINGLE_WORDS + 1, 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    shingle = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((shingle(joined[a:b], 42) for a, b in zip(starts, ends[-n:].tolist())), np.uint64, n))


def shape(texts: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for so many texts."""
    width = max(WIDTH, texts.bit_length() - 8)
    return width, math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** width)))


def fingerprint(found: np.ndarray, bits: int) -> np.ndarray:
    """The set's SimHash, as 64-bit words that hold so many bits."""
    factors, ones = FACTORS[: -(-bits // 64)], np.zeros(-(-bits // 64) * 64, np.int64)
    both = np.concatenate([found, found * MIX ^ AGAIN])
    for at in range(0, len(both), 255):
        hashes = both[at : at + 255, None] * factors
        hashes ^= hashes >> np.uint64(32)
        hashes *= MIX
        hashes ^= hashes >> np.uint64(29)
        ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(both), bitorder="little").view(np.uint64)


def blocks(prints: np.ndarray, width: int, number: int, first: int = 0) -> np.ndarray:
    """Rows of fingerprints to rows of bucket numbers, which hold the block's number, from the first on, and its bits."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, width * first : width * number].reshape(-1, number - first, width)
    packed = np.packbits(bits, axis=2, bitorder="little")
    values = np.zeros((len(prints), number - first, 8), np.uint8)
    values[:, :, : packed.shape[2]] = packed
    return values.view(np.int64)[:, :, 0] | np.arange(first, number, dtype=np.int64) << 32


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of LEAST or more; two empty ones have."""
    small, large = sorted((len(a), len(b)))
    if small < LEAST * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= LEAST * (small + large - both)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((np.concatenate(rows) if rows else np.empty(0, np.uint64)).view(np.int64)))


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def _digest(found: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 1)).astype(np.int64)


def _words(column: pa.Array) -> np.ndarray:
    """A column of fingerprints as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _prints(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            found = pa.array([fingerprint(s, bits).tobytes() for s in sets], pa.binary())
            columns = [batch.column("doc_id"), pa.array([_digest(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()), found]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "size", "print"])

    return prints


def _buckets(width: int, number: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bucket numbers alone, to be counted."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(blocks(_words(batch.column("print").slice(at, 1024)), width, number, first).ravel())], ["bucket"])

    return buckets


def _keyed(width: int, number: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text and its label in each of its buckets, with the bits behind the blocks."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                prints = _words(some.column("print"))
                check = prints[:, -CHECK_WORDS:].view(np.int64).T
                columns = [blocks(prints, width, number, first).ravel(), *(np.repeat(x, number - first) for x in (some.column("digest").to_numpy(), some.column("label").to_numpy(), *check))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "digest", "label", *CHECKS])

    return keyed


def _roots(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = root[at]
    while (root[found] != found).any():
        found = root[found]
    root[at] = found
    return found


def bucket_ties(lane: np.ndarray, digest: np.ndarray, label: np.ndarray, second: np.ndarray, check: list[np.ndarray]) -> list[np.ndarray]:
    """Ties (low, high digest and their labels) that join all labels with texts near each other in one lane and on different sides of it, if it has two; labels joined by other ties get none."""
    order = np.argsort(lane, kind="stable")
    lane, digest, second, check = lane[order], digest[order], second[order], [c[order] for c in check]
    labels, label = np.unique(label[order], return_inverse=True)
    split = np.isin(lane, lane[second])
    root, found = np.arange(len(labels)), [np.empty((2, 0), np.int64)]

    def tie(i: np.ndarray, j: np.ndarray) -> None:
        near = sum(np.bitwise_count(c[i] ^ c[j]) for c in check) <= CHECK_APART
        near &= (second[i] != second[j]) | ~split[i]
        i, j = i[near], j[near]
        while len(i):
            a, b = _roots(root, label[i]), _roots(root, label[j])
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            # One tie for each label that goes; the others are tried again.
            high, first = np.unique(np.maximum(a, b), return_index=True)
            root[high] = np.minimum(a, b)[first]
            found.append(np.array([i[first], j[first]]))

    # First a wide tree over each lane, so that no chain of ties is long; then all pairs of lanes that it leaves in parts.
    starts, of = np.unique(lane, return_index=True, return_inverse=True)[1:]
    place = np.arange(len(lane)) - starts[of]
    tie(child := np.flatnonzero(place), starts[of[child]] + (place[child] - 1) // FAN)
    now = _roots(root, label)
    whole = np.minimum.reduceat(now, starts) == np.maximum.reduceat(now, starts)
    at, step = np.flatnonzero(~whole[of]), 1
    while len(at := at[at + step < len(lane)]) and len(at := at[lane[at] == lane[at + step]]):
        tie(at, at + step)
        step += 1
    i, j = np.concatenate(found, axis=1)
    i, j = np.where(digest[i] < digest[j], [i, j], [j, i])
    return [digest[i], digest[j], labels[label[i]], labels[label[j]]]


def _bucket_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = [b for b in batches if len(b)]
    if some:
        rows = {name: column.to_numpy() for name, column in zip(some[0].schema.names, pa.Table.from_batches(some).columns)}
        second = rows.get("second", np.zeros(len(rows["lane"]), bool))
        hub, digest, a, b = bucket_ties(rows["lane"], rows["digest"], rows["label"], second, [rows[c].view(np.uint64) for c in CHECKS])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (digest, hub, a, b)], ["digest", "hub", "a", "b"])


def lane_links(sets: list[np.ndarray], prints: np.ndarray, nodes: list[int], labels: list[int], second: list[bool]) -> list[tuple[int, int]]:
    """Links between texts of different labels, of the lane's one part or across its two parts, until no more pairs are alike."""
    label, part = np.array(labels), np.array(second)
    across, found, most = part.any(), [], APART * 64 * prints.shape[1]
    for i in range(len(sets) - 1):
        apart = (label[i + 1 :] != label[i]) & ((part[i + 1 :] != part[i]) | (not across))
        rest = np.flatnonzero(apart) + i + 1
        rest = rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int64) <= most]
        for j in rest.tolist():
            if label[i] != label[j] and alike(sets[i], sets[j]):
                found.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return found


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links: list[tuple[int, int]] = []
        for sets, prints, nodes, labels, second in zip(*(batch.column(c) for c in ("sets", "prints", "nodes", "labels", "second"))):
            links += lane_links(_sets(sets.values), _words(prints.values), nodes.as_py(), labels.as_py(), second.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _compared(rows: DataFrame, n: int) -> DataFrame:
    """Ties of about n rows, with the labels a and b that they join: lane, digest, label and bits; second where there is any."""
    return rows.repartition(n // TASK_ROWS + 2, "lane").mapInArrow(trimmed(_bucket_ties), "digest long, hub long, a long, b long").distinct()


def _lane(part: Column) -> Column:
    """A part of a bucket. Parts that share a number, beyond 2^20 of them, are one lane, which loses nothing."""
    return F.col("bucket").bitwiseXOR(F.shiftleft(part, 44)).alias("lane")


def _labelled(rows: DataFrame, families: DataFrame | None) -> DataFrame:
    """Rows with their digest's family; a text of none is its own."""
    if families is None:
        return rows.withColumn("label", F.col("digest"))
    return rows.join(families.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _families(ties: DataFrame, families: DataFrame | None) -> DataFrame:
    """Families (node, label) that more ties make of those there are, whose labels are all that the search sees."""
    merged = components(ties.select("a", "b"))
    if families is None:
        return merged
    moved = families.withColumnRenamed("label", "was").join(merged.select(F.col("node").alias("was"), "label"), "was", "left").select("node", F.coalesce("label", "was").alias("label"))
    return written(ties.sparkSession, moved.unionAll(merged.join(families, "node", "left_anti")), "families-so-far")


def candidates(nodes: DataFrame, width: int, number: int) -> tuple[DataFrame, DataFrame]:
    """Ties (digest, hub) that join all texts near each other in a bucket, and the families (node, label) that ties make. nodes: digest and print."""
    texts, found, families = nodes.count(), [], None
    ends = [*(end for end in PASSES if end < number), number]
    for first, end in zip([0, *ends], ends):
        ties, families = _pass(nodes.select("digest", "print"), texts, families, width, first, end)
        found += ties
    return written(nodes.sparkSession, functools.reduce(DataFrame.unionAll, found).select("digest", "hub"), "ties"), families


def _pass(nodes: DataFrame, texts: int, families: DataFrame | None, width: int, first: int, end: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ties between families in the blocks from first to end, and the families that they make."""
    spark = nodes.sparkSession
    keyed = _labelled(nodes, families).mapInArrow(trimmed(_keyed(width, end, first)), "bucket long, digest long, label long, " + ", ".join(f"{c} long" for c in CHECKS))
    n_large = 0
    if texts > LANE:
        counts = nodes.select("print").mapInArrow(trimmed(_buckets(width, end, first)), "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
        large = written(spark, counts.where(F.col("n") > LANE), "large-buckets")
        n_large, n_rows = large.agg(F.count("*"), F.sum("n")).first()
    n = texts * (end - first)
    if not n_large:
        ties = written(spark, _compared(keyed.withColumnRenamed("bucket", "lane"), n), "ties")
        return [ties], _families(ties, families)

    large = F.broadcast(large) if n_large <= MAX_BROADCAST else large
    rows = written(spark, keyed.join(large, "bucket"), "large-rows")
    parts, bits = F.ceil(F.col("n") / LANE).cast("long"), ("digest", "label", *CHECKS)
    part, every = F.pmod("digest", parts), F.sequence(F.lit(0).cast("long"), parts - 1)
    dealt = rows.join(rows.groupBy("bucket").agg(F.min("digest").alias("hub")), "bucket")
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("digest") == F.col("hub"), every).otherwise(F.array(part))))
    small = keyed.join(large, "bucket", "left_anti").select(F.col("bucket").alias("lane"), *bits)
    ties = written(spark, _compared(small.unionAll(dealt.select(_lane(F.col("part")), *bits)), n), "ties")
    families = _families(ties, families)

    named = _labelled(rows.drop("label"), families)
    main = named.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("m"))
    named = named.join(main, "bucket").where("n > m")
    others = F.ceil((F.col("n") - F.col("m")) / LANE).cast("long")
    all_rows = named.withColumn("second", F.lit(False)).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), others - 1), lambda x: part * others + x)))
    rest = named.where("label <> main").withColumn("second", F.lit(True)).withColumn("part", F.explode(F.transform(every, lambda x: x * others + F.pmod("digest", others))))
    more = all_rows.unionAll(rest).select(_lane(F.col("part")), *bits, "second")
    more = written(spark, _compared(more, n_rows), "more-ties")
    discard(rows)
    return [ties, more], _families(more, families)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over near copies."""
    spark = docs.sparkSession
    bounded_batches(spark)

    @F.arrow_udf("boolean")
    def verified(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([alike(x, y) for x, y in zip(_sets(a), _sets(b))], pa.bool_())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    width, number = shape(docs.count())
    prints = written(spark, texts.mapInArrow(trimmed(_prints(width * number + 64 * CHECK_WORDS)), "doc_id long, digest long, size int, print binary"), "prints")
    nodes = written(spark, prints.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("print").alias("print")), "nodes")
    prints = prints.select("doc_id", "digest")
    ties, families = candidates(nodes.where("size > 0"), width, number)
    tied = ties.select("digest").unionAll(ties.select("hub")).distinct()
    sent = spark.sparkContext.broadcast(bit_map(nodes.join(tied, "digest"), F.coalesce("doc", F.lit(NO_ID))))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the tied texts, and of a few more: texts stay where they are, and what is too much goes by digest."""
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(may_hold(sent.value, ids)))
            sets = [shingles(t.as_py()) for t in some.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), _lists(sets)], ["digest", "shingles"])

    sets = texts.mapInArrow(trimmed(shingled), "digest long, shingles array<long>")
    sets = written(spark, sets.join(tied, "digest", "left_semi").dropDuplicates(["digest"]), "sets")

    met = ties.join(sets, "digest").join(sets.select(F.col("digest").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    links = met.where(verified("shingles", "hub_shingles")).select(F.col("hub").alias("a"), F.col("digest").alias("b"))
    links = written(spark, links.unionAll(same_document(prints, "digest")), "links")
    labels = components(links)

    of = tied.join(families.select(F.col("node").alias("digest"), F.col("label").alias("family")), "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    of = written(spark, of.withColumn("label", F.coalesce("label", "digest")).join(nodes.select("digest", "size", "print"), "digest"), "families")
    loose = of.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("total"), (F.min("label") < F.max("label")).alias("open")).where("open")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("total") / PART_SHINGLES)).cast("int")
    dealt = of.join(loose.select("family", parts.alias("parts")), "family").withColumn("part", F.pmod("digest", "parts").cast("int"))
    dealt = dealt.join(sets, "digest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lanes = dealt.groupBy("family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(
        F.collect_list("shingles").alias("sets"), F.collect_list("print").alias("prints"), F.collect_list("digest").alias("nodes"), F.collect_list("label").alias("labels"), F.collect_list(F.col("part") > F.col("other")).alias("second")
    )
    more = written(spark, lanes.select("sets", "prints", "nodes", "labels", "second").mapInArrow(trimmed(_lanes), "a long, b long"), "more-links")
    if more.limit(1).count():
        labels = components(links.unionAll(more))

    discard(ties, sets, of)
    return prints.join(smallest_documents(nodes, "digest", labels), "digest").select("doc_id", "component_id")
