"""The trie of conversations' prefixes, compressed while it is built and expanded at the end.

A turn is a digest of its role and text and the length of its text; a conversation is the bytes of its
turns' digests, one after another, so that sorted conversations stand in the trie's order. Conversations
that are equal are one sequence with a list of ids. Sequences are laid out in ranges of about equal
size. Each range builds its part of the trie after Patricia: in sorted order, only where a sequence
ends or two neighbours part is there a point; points are summed up along their edges, and the nodes
between two points follow from the lower one and the sums of text lengths from it up the edge.

What a range knows of a node adds up: members, leaves, and members times length, less the length once,
in the range where the node is new. So the few nodes that lie on a border between two ranges, prefixes
of the neighbouring sequences on both sides, are merged by their prefix's digest; all others are whole.

Defined results: turns are ordered by turn, null first, those with equal numbers by digest; a null role
or text is empty; repeated rows are turns of their own; a row without a conversation id takes no part;
a conversation without turns is a member of the root alone; an empty table has no node, not even a
root; other columns are ignored. A conversation is a row, so it must fit one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of different sequences that a range holds, about.
TURNS_A_RANGE = 200_000
#: Nodes on borders that are broadcast, about 60 bytes each; more are joined by a shuffle.
MAX_BROADCAST_NODES = 200_000
#: Conversations whose ids differ in the last so many bits are listed together.
LISTED_BITS = 16
NO_IDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = "seq binary, sizes array<long>, conv_id long, n long, ends string"
NODE = "conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string, key binary, parent_key binary"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to conv_id and turns, an array of digests (hexadecimal) and text sizes."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    said = F.concat(F.octet_length(filled("role")).cast("string"), F.lit(":"), filled("role"), filled("text"))
    digest = F.substring(F.sha2(said, 256), 1, 2 * WIDTH)
    row = F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(filled("text")).cast("long").alias("size"))
    some = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row"))
    listed = some.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda r: F.struct(r["digest"], r["size"])).alias("turns"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) rows, ids distinct, to different sequences with their smallest id, number and digest of ids."""
    whole = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.unhex(F.array_join(F.col("turns.digest"), "")).alias("seq"),
        F.col("turns.size").alias("sizes"),
    )
    keyed = whole.withColumns({"key": F.sha2("seq", 256), "bucket": F.shiftright("conv_id", LISTED_BITS)})
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = keyed.groupBy("key", "bucket").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("key").sortWithinPartitions("key", "bucket")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sequence's pieces follow each other; its ids run through one digest and are never held."""
        names = ["seq", "sizes", "conv_id", "n", "ends"]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        key, row, digest = None, [], None
        for batch in batches:
            rows = []
            for k, _, seq, sizes, conv, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k == key:
                    row[3] += n
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    rows.append([*row, digest.hexdigest()])
                key, row, digest = k, [seq, sizes, conv, n], hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*row, digest.hexdigest()], kinds)], names)

    return dealt.mapInArrow(joined, SEQUENCE)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_digests(sequence: bytes, depth: int) -> list[bytes]:
    """The digests of the first 0 to depth turns."""
    digest, found = hashlib.sha256(), [hashlib.sha256().digest()]
    for d in range(depth):
        digest.update(sequence[d * WIDTH : (d + 1) * WIDTH])
        found.append(digest.digest())
    return found


@dataclass
class Point:
    """A point of the compressed trie, with what the points below have added so far."""

    depth: int
    #: The first sequence below.
    first: int
    end: int | None = None
    last: bool = False
    conv: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0


@dataclass
class Part:
    """The part of the trie that a range of sorted, different sequences builds."""

    rows: list[tuple[bytes, list[int], int, int, str]]
    #: Turns that the first sequence shares with the one before the range, and the last with the one after it.
    before: int
    after: int
    #: Whether the sequence after the range goes on from the last one.
    continued: bool
    nodes: list[list] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.first_keys = prefix_digests(self.rows[0][0], self.before)
        self.last_keys = prefix_digests(self.rows[-1][0], self.after)
        self.tops: list[tuple[list, Point]] = []

    def key(self, point: Point, depth: int) -> bytes | None:
        """The digest of a node that other ranges may have too."""
        if point.first == 0 and depth <= self.before:
            return self.first_keys[depth]
        return self.last_keys[depth] if point.last and depth <= self.after else None

    def new(self, point: Point, depth: int) -> bool:
        return point.first > 0 or depth > self.before

    def close(self, point: Point, parent: Point | None) -> None:
        """Gives a finished point to its parent, and a row to each node of the edge between them."""
        if point.end is not None:
            _, _, conv, n, _ = self.rows[point.end]
            point.conv = conv if point.conv is None else min(conv, point.conv)
            point.n += n
            going_on = self.continued and point.end == len(self.rows) - 1
            point.leaves += not point.children and not going_on
        sizes = self.rows[point.first][1]
        children, saved, row = point.children, point.saved, None
        for depth in range(point.depth, parent.depth if parent else -1, -1):
            new = self.new(point, depth)
            saved += (point.n - new) * sizes[depth - 1] if depth else 0
            ends = self.rows[point.end][4] if depth == point.depth and point.end is not None else None
            key = self.key(point, depth)
            if row is not None:
                row[9] = key
                row[2] = point.conv if key is None else None
            row = [point.conv, depth, None, point.n, children, point.leaves, saved, ends, key, None]
            self.nodes.append(row)
            children = int(new)
        if parent is not None:
            self.tops.append((row, parent))
            parent.conv = point.conv if parent.conv is None else min(point.conv, parent.conv)
            parent.n += point.n
            parent.children += children
            parent.leaves += point.leaves
            parent.saved += saved

    def build(self) -> list[list]:
        """Rows of NODE: whole where key is null, else this range's share; parent or parent_key says what is above."""
        stack = [Point(0, 0)]
        for at, (seq, *_) in enumerate(self.rows):
            common = shared_turns(self.rows[at - 1][0], seq) if at else 0
            while stack[-1].depth > common:
                point = stack.pop()
                if stack[-1].depth < common:
                    stack.append(Point(common, point.first))
                self.close(point, stack[-1])
            if len(seq) // WIDTH > common:
                stack.append(Point(len(seq) // WIDTH, at))
            stack[-1].end = at
        for point in stack:
            point.last = True
        while stack:
            self.close(stack.pop(), stack[-1] if stack else None)
        for row, parent in self.tops:
            row[9] = self.key(parent, parent.depth)
            row[2] = parent.conv if row[9] is None else None
        return self.nodes


def _range_nodes(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table.column(n).to_pylist() for n in ("seq", "sizes", "conv_id", "n", "ends", "side"))))
    own = sorted(r[:5] for r in rows if r[5] == 0)
    before, after = (next((r[0] for r in rows if r[5] == side), None) for side in (-1, 1))
    last = own[-1][0]
    part = Part(own, shared_turns(before, own[0][0]) if before is not None else 0, shared_turns(last, after) if after is not None else 0, after is not None and after.startswith(last))
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*part.build()), kinds)], names=["conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends", "key", "parent_key"])


def prefix_trie(conversations: DataFrame, turns_a_range: int = TURNS_A_RANGE) -> DataFrame:
    """(conv_id, turns) rows, as of sequences(), to the trie's nodes: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    distinct = written(spark, distinct_sequences(conversations), "sequences")
    size = distinct.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranges = distinct.repartitionByRange(-(-size // turns_a_range) or 1, "seq").withColumn("part", F.spark_partition_id())
    laid = written(spark, ranges, "ranges")
    # A row for each range.
    by_range = Window.orderBy("part")
    edges = laid.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    met = edges.select("part", F.lag("high").over(by_range).alias("before"), F.lead("low").over(by_range).alias("after"))
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("seq")), F.struct(F.lit(1).alias("side"), F.col("after").alias("seq"))))
    borders = met.select("part", sides.alias("b")).select("part", "b.side", "b.seq").where("seq IS NOT NULL")
    rows = laid.withColumn("side", F.lit(0)).unionByName(borders, allowMissingColumns=True)
    nodes = written(spark, rows.groupBy("part").applyInArrow(_range_nodes, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = nodes.where("key IS NOT NULL").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.first("parent_key").alias("parent_key"))
    common = written(spark, merged, "common")
    few = common.count() <= MAX_BROADCAST_NODES
    above = common.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    below = common.drop("key").unionByName(nodes.where("key IS NULL AND parent_key IS NOT NULL").drop("key", "parent"))
    found = below.join(F.broadcast(above) if few else above, "parent_key", "left").drop("parent_key")
    return found.unionByName(nodes.where("key IS NULL AND parent_key IS NULL").drop("key", "parent_key")).select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def grafted(conversations: DataFrame, every: int, n: Column, most: int) -> DataFrame:
    """Conversations whose first n turns, most at most, are those of the conversation with the next lower id, or their own, that every divides; none if it is absent."""
    heads = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, most).alias("_turns"))
    met = conversations.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("_head"), "left")
    own = F.slice("turns", n + 1, F.size("turns"))
    turns = F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_turns", F.lit(1), n), own))
    return met.select("conv_id", turns.alias("turns"))
