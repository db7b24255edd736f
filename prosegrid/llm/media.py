"""Media columns stored as content-defined chunks.

A payload becomes a sound file of 8-bit samples. A rolling gear hash over the file's bytes cuts it
into chunks, wherever the hash of the last WINDOW bytes falls into the cutting range, within a
least and a greatest length; equal stretches of different files so give equal chunks.

The store has three parts: each file's ordered list of chunk digests; the chunks that occur once in
all files, bucketed by their file; and the chunks that occur more often, each once, by digest. No
bytes are held anywhere else. A first pass over the texts makes the lists; grouping the digests
tells which occur more than once. A second pass cuts the files again and writes the chunks. It asks
a bit map of bounded size whether a chunk may be one of several: those that it says no to are
written where they are, the others, once a task, are deduplicated by digest. A full map sends more
chunks that way and loses none.

Files are rebuilt by joins alone: the list, with the chunks of its own bucket and those that a join
on the digest brings. A chunk that very many files share is dealt into lanes of bounded size. A
missing or altered chunk raises an error, as does a file that doesn't match its digest.

Defined results: a null text is an empty one; empty and short payloads are padded with zeros to
the unit, so that none is empty; equal files are one file; repeated rows get a row each; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.shared import MAP_BITS, bit_map, bounded_batches, discard, may_hold, saved, trimmed, written

#: Bytes of a chunk: at least, on average beyond that, and at most.
LEAST, MEAN, MOST = 512, 2048, 16384
#: Bytes that the rolling hash sees: its 16 bits shift one out with each byte.
WINDOW = 16
RATE = 8000
#: Rows of a batch whose files are held at once.
SLICE = 512
#: Digests that a task remembers to have written.
REMEMBERED = 1 << 20
#: Occurrences of a shared chunk that one lane of a join serves.
LANE = 20_000
#: Payload bytes are a positive multiple of this.
UNIT = 64

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2).digest(), "little") for b in range(256)], np.uint16)


def payload(text: bytes | None) -> bytes:
    """The text with zeros up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes((-len(text)) % UNIT or (0 if text else UNIT))


def sound_file(samples: bytes) -> bytes:
    """RIFF: one channel of unsigned 8-bit samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(samples)) + samples + bytes(len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def samples_of(media: bytes) -> bytes:
    """What sound_file stored, by the sizes that the file states."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a sound file")
    at = 12
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a sound file without samples")


def cuts(media: bytes) -> list[int]:
    """Where the chunks end."""
    n = len(media)
    if n <= LEAST:
        return [n]
    rolled = _GEAR[np.frombuffer(media, np.uint8)]
    step = 1
    while step < WINDOW:  # sums over 2, 4, 8, 16 bytes, each older byte shifted once more
        rolled[step:] += rolled[:-step] << np.uint16(step)
        step *= 2
    marks = np.flatnonzero(rolled < (1 << 16) // MEAN) + 1
    ends, start, k = [], 0, 0
    marks = marks.tolist()
    while n - start > LEAST:
        while k < len(marks) and marks[k] - start < LEAST:
            k += 1
        end = min(marks[k] if k < len(marks) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """The file's chunks, each with its digest, in order."""
    ends = cuts(media)
    return [(_digest(chunk), chunk) for chunk in (media[a:b] for a, b in zip([0, *ends], ends))]


def _key(digest: Column) -> Column:
    """The digest's first four bytes as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


class MediaStore:
    """Files as lists of digests, and each distinct chunk once, in tables of the shared folder."""

    def __init__(self, docs: DataFrame):
        """Stores the text column's payloads as sound files."""

        def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    text = text.as_py() or b""
                    media = sound_file(payload(text))
                    rows.append((doc_id, len(text), hashlib.sha256(media).digest(), [digest for digest, _ in _chunks(media)]))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["doc_id", "n_bytes", "media_sha", "digests"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            written_here: set[bytes] = set()
            for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
                rows = []
                for text in batch.column("text"):
                    media = sound_file(payload(text.as_py()))
                    sha = hashlib.sha256(media).digest()
                    chunks = _chunks(media)
                    maybe = may_hold(sent.value, np.array([int.from_bytes(digest[:4], "big") for digest, _ in chunks])).tolist()
                    for (digest, chunk), several in zip(chunks, maybe):
                        if several and digest in written_here:
                            continue
                        if several and len(written_here) < REMEMBERED:
                            written_here.add(digest)
                        rows.append((sha, digest, chunk, several))
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["home", "digest", "chunk", "several"])

        spark = docs.sparkSession
        bounded_batches(spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        self.lists = written(spark, rows.mapInArrow(trimmed(list_), "doc_id long, n_bytes long, media_sha binary, digests array<binary>"), "lists")
        counted = self.lists.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
        several = written(spark, counted.where("n > 1"), "several")
        sent = spark.sparkContext.broadcast(bit_map(several, _key(F.col("digest")), MAP_BITS))
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        chunks = saved(rows.mapInArrow(trimmed(cut), "home binary, digest binary, chunk binary, several boolean"), "chunks", buckets, "home")
        self.own = chunks.where("not several")
        shared = chunks.where("several").dropDuplicates(["digest"]).join(several, "digest", "left")
        lanes = F.ceil(F.coalesce("n", F.lit(1)) / LANE).cast("int")
        self.shared = written(spark, shared.select("digest", "chunk", lanes.alias("lanes")), "shared-chunks")
        discard(several)

    def documents(self) -> DataFrame:
        """doc_id, n_bytes and the file's digest, media_sha."""
        return self.lists.select("doc_id", "n_bytes", "media_sha")

    def read_back(self) -> DataFrame:
        """media_sha and media: every file, rebuilt from its ordered chunks and verified."""

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
                files = []
                for sha, digests, *held in zip(batch.column("media_sha").to_pylist(), batch.column("digests").to_pylist(), batch.column("own"), batch.column("fetched")):
                    chunks = {x["digest"].as_py(): x["chunk"].as_py() for kept in held if kept.is_valid for x in kept.values}
                    if any(chunks.get(d) is None for d in digests):
                        raise ValueError("a chunk is missing")
                    if any(_digest(chunk) != digest for digest, chunk in chunks.items()):
                        raise ValueError("a chunk doesn't match its digest")
                    file = b"".join(map(chunks.__getitem__, digests))
                    if hashlib.sha256(file).digest() != sha:
                        raise ValueError("a file doesn't match its digest")
                    files.append(file)
                yield pa.RecordBatch.from_arrays([batch.column("media_sha"), pa.array(files, pa.binary())], ["media_sha", "media"])

        files = self.lists.groupBy("media_sha").agg(F.first("digests").alias("digests"))
        held = lambda name: F.collect_list(F.struct("digest", "chunk")).alias(name)
        own = self.own.groupBy(F.col("home").alias("media_sha")).agg(held("own"))
        asked = files.select("media_sha", F.explode(F.array_distinct("digests")).alias("digest"))
        places = self.shared.select("digest", "lanes").withColumnRenamed("digest", "shared")
        asked = asked.join(places, F.col("digest") == F.col("shared")).select("media_sha", "digest", F.pmod(F.xxhash64("media_sha"), "lanes").cast("int").alias("lane"))
        served = self.shared.select("digest", "chunk", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
        fetched = asked.join(served, ["digest", "lane"]).groupBy("media_sha").agg(held("fetched"))
        met = files.join(own, "media_sha", "left").join(fetched, "media_sha", "left")
        return met.select("media_sha", "digests", "own", "fetched").mapInArrow(trimmed(rebuild), "media_sha binary, media binary")


def decoded(media: Column) -> Column:
    """A struct of a file's samples and a feature string: mean and root mean square level, zero crossings."""
    kinds = pa.struct([("samples", pa.binary()), ("feature", pa.string())])

    @F.arrow_udf("samples binary, feature string")
    def decode(files: pa.Array) -> pa.Array:
        samples = [samples_of(f.as_py()) for f in files]
        features = []
        for x in samples:
            level = np.frombuffer(x, np.uint8).astype(np.int64) - 128
            crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
            features.append(f"mean={level.mean():.4f};rms={np.sqrt((level * level).mean()):.4f};crossings={crossings}")
        return pa.StructArray.from_arrays([pa.array(samples, pa.binary()), pa.array(features, pa.string())], fields=list(kinds))

    return decode(media)
