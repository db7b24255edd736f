import hashlib
import io
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrid.llm import media, queries


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(2)
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 9000))
    found = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    found += [None, "", "x", "y" * 64, "é" * 33, "\0\0", found[0], found[0], passage, passage + "tail", "head" + passage, "mid" + passage + found[1], "a" * 200_000]
    return found


def test_gear_cuts_bytewise():
    """The vectorised hash against one byte at a time."""
    rng = np.random.default_rng(1)
    for n in (1, 511, 512, 513, 5000, 60_000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        ends, start, rolled = [], 0, 0
        for i, b in enumerate(data, 1):
            rolled = (int(rolled << 1) + int(media._GEAR[b])) & 0xFFFF
            if n - start > media.LEAST and (i - start >= media.LEAST and rolled < (1 << 16) // media.MEAN or i - start == media.MOST):
                ends.append(i)
                start = i
        if start < n:
            ends.append(n)
        assert media.cuts(data) == ends


def test_round_trip(spark, texts, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash")).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op5_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = io.BytesIO()
        with wave.open(stored, "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(1)
            out.setframerate(media.RATE)
            out.writeframes(padded)
        file = stored.getvalue()
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(file), hashlib.sha256(file).hexdigest())
        assert r.feature.startswith("mean=")


def test_each_chunk_is_kept_once(spark, texts):
    store = media.MediaStore(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    files = {media.sound_file(media.payload((t or "").encode())) for t in texts}
    distinct = set()
    for file in files:
        ends = media.cuts(file)
        distinct |= {file[a:b] for a, b in zip([0, *ends], ends)}
    held = [bytes(r.chunk) for part in (store.own, store.shared) for r in part.collect()]
    assert len(held) == len(distinct) and set(held) == distinct
    assert store.shared.count() > 2
    assert {bytes(r.media) for r in store.read_back().collect()} == files


@pytest.mark.parametrize("part", ["own", "shared"])
def test_missing_or_altered_chunks_fail(spark, texts, part):
    store = media.MediaStore(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    whole = getattr(store, part)
    victim = whole.agg(F.min("digest")).first()[0]
    setattr(store, part, whole.where(F.col("digest") != F.lit(bytes(victim))))
    with pytest.raises(Exception, match="a chunk is missing"):
        store.read_back().collect()
    setattr(store, part, whole.withColumn("chunk", F.when(F.col("digest") == F.lit(bytes(victim)), F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("chunk"))))
    with pytest.raises(Exception, match="a chunk doesn't match its digest"):
        store.read_back().collect()


@pytest.mark.parametrize("bits, lane", [(64, 20_000), (1 << 26, 2)])
def test_full_map_and_many_lanes(spark, texts, monkeypatch, bits, lane):
    """A map that says maybe to every chunk, and chunks that are dealt into lanes."""
    monkeypatch.setattr(media, "MAP_BITS", bits)
    monkeypatch.setattr(media, "LANE", lane)
    store = media.MediaStore(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert {bytes(r.media) for r in store.read_back().collect()} == {media.sound_file(media.payload((t or "").encode())) for t in texts}
    assert store.shared.count() == store.shared.select("digest").distinct().count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op5_media(spark, str(tmp_path)).collect() == []
