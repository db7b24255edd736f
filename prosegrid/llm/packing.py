"""Packing by concatenate and cut.

Documents are laid end to end, in the order in which the partitions hold them. The first pass
turns texts into ids and keeps each document's offset within its partition; prefix sums over the
partitions' totals, of which there is one row each, then give offsets in the whole. The second
pass cuts at the multiples of the window: a document that crosses one gets a boundary record on
either side. All sequences but the last are full.

Ids are those of the tokenizers library. White-space-free pieces of a text are independent of each
other, with the single space before them, so their ids are kept and only new pieces are encoded,
by the rank table that the same file holds; a text with other runs of white space is encoded whole.

Defined results: a null or empty text is its end id alone; special tokens written in a text are
read as such; repeated rows are packed each; an empty table gives an empty result. Long texts go
over as many sequences as they need. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.bpe import SPACES, byte_letters
from prosegrid.llm.shared import bounded_batches, trimmed, written

WINDOW = 2048
#: Partitions whose totals are broadcast, 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST_PARTS = 1_000_000
#: Pieces of text whose ids a Python worker keeps, each short.
KEPT_PIECES, KEPT_LENGTH = 200_000, 40
#: Fixed value: how byte-level BPE files of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteCodec:
    """A byte-level BPE tokenizer file whose ids are the ranks of its merges."""

    def __init__(self, text: str):
        spec = json.loads(text)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4"
        self.kept: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.packed(self.fast.encode_ordinary(" " + piece))
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            parts = self.specials.split(text)
            return b"".join(self.packed([self.special[p]]) if k % 2 else self.encode(p) for k, p in enumerate(parts))
        if any(space + " " in text for space in (SPACES if not text.isascii() else SPACES[:6])) or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.packed(self.fast.encode_ordinary(text))
        first, *rest = text.split(" ")
        get = self.kept.get
        return self.packed(self.fast.encode_ordinary(first)) + b"".join([found if (found := get(p)) is not None else self._piece(p) for p in rest])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, at, doc_id, n_tokens and ids (packed) of each document; at is its offset in its part."""
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One codec a task: an idle worker that kept its own would hold memory from the stages that follow.
        codec, part, at = ByteCodec(sent.value), TaskContext.get().partitionId(), 0
        end, width = codec.packed([end_id]), np.dtype(codec.kind).itemsize
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") + end for t in batch.column("text")]
            counts = np.array([len(x) // width for x in ids], np.int64)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            columns = [pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), batch.column("doc_id"), pa.array(counts), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), width, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "doc_id", "n_tokens", "ids", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(encode), "part long, at long, doc_id long, n_tokens long, ids binary, width int")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit numbers. tokenizer is the path of its file on the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = written(spark, tokenized(docs, tokenizer, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, at = batch.column("n_tokens").to_numpy(), batch.column("first").to_numpy()
            pieces = (at + counts - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // window + nth
            low = np.maximum(at[row], sequence * window)
            high = np.minimum(at[row] + counts[row], (sequence + 1) * window)
            start = low - at[row]
            widths, ids = batch.column("width").to_pylist(), batch.column("ids")
            texts = [np.frombuffer(ids[i].as_buffer(), f"<u{widths[i]}") for i in range(len(counts))]
            cuts = [texts[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(row, start, high - low)]
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, high - low, counts[row], sequence, low - sequence * window)), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    few = tokens.select("part").distinct().count() <= MAX_BROADCAST_PARTS
    placed = tokens.join(F.broadcast(bases) if few else bases, "part").select("doc_id", "n_tokens", (F.col("base") + F.col("at")).alias("first"), "ids", "width")
    return placed.mapInArrow(trimmed(cut), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
