"""Quality classification by co-training on two views of a document.

The text view sees shapes of the whole text: shares of character classes, their densest stretches,
repeated words and lines, lengths. The metadata view sees source, declared language and length.
A logistic classifier for each view learns from the labelled rows; then, over rounds, each gives
the rows of an unlabelled pool that it is sure of to the other as pseudo-labels. Both are
calibrated on labelled rows kept apart, and a document's score fuses the calibrated views, taking
the prior once.

Fitting uses a bounded sample, ``max_labelled`` labelled documents and ``max_pool`` others for the
pool, chosen by the hash of doc_id from all of them; every document is scored, on its whole text, in one pass without a shuffle.

Defined results: a null text is an empty one; null metadata is a value of its own; without labels
of both classes every score is 0.5, and documents at 0.5 or above are kept; of repeated labels of
a document the largest counts; an empty table gives an empty result. Columns other than those
read pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches, trim

#: Documents to fit on, at most; fit() takes other bounds.
MAX_LABELLED, MAX_POOL = 20_000, 20_000
ROUNDS = 4
#: How sure a view must be of a pseudo-label, and the share of the pool it may pass on in a round.
SURE, SHARE = 0.97, 0.05
#: Bytes of a stretch of text whose densities are looked at.
STRETCH = 256
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16

_CLASS = np.zeros(256, np.uint8)
for _n, _letters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"()?-", b"!", b"|", b"#$%&*+=<>@^_~/\\[]{}`"), 1):
    _CLASS[list(_letters)] = _n
_N_CLASSES = 10


def text_view(text: bytes | None) -> np.ndarray:
    """The features of one text."""
    text = text or b""
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    counts = np.bincount(kinds, minlength=_N_CLASSES) / max(len(kinds), 1)
    peaks = []
    whole = len(kinds) // STRETCH * STRETCH
    for kind in (2, 3, 6, 7, 8):
        if whole:
            dense = (kinds[:whole].reshape(-1, STRETCH) == kind).mean(axis=1)
            peaks += [dense.max(), (dense > 0.08).mean()]
        else:
            peaks += [counts[kind], float(counts[kind] > 0.08)]
    words = text.split()
    lines = text.split(b"\n")
    n = max(len(words), 1)
    distinct = len(set(words)) / n
    twice = sum(a == b for a, b in zip(words, words[1:])) / n
    after_five = sum(a == b for a, b in zip(words, words[5:])) / n
    shape = [np.log1p(len(words)), len(kinds) / n, distinct, distinct * np.log1p(n), twice, after_five, len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines))]
    return np.array([*counts, *np.sqrt(counts), *peaks, *shape])


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    found = np.zeros(SOURCE_BUCKETS + LANG_BUCKETS + 2)
    found[zlib.crc32(repr(source).encode()) % SOURCE_BUCKETS] = 1
    found[SOURCE_BUCKETS + zlib.crc32(repr(lang).encode()) % LANG_BUCKETS] = 1
    found[-2:] = np.log1p(max(n_chars or 0, 0)), n_chars is None
    return found


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(p) - np.log1p(-p)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        self.weights = np.zeros(z.shape[1])
        for _ in range(steps):
            p = _sigmoid(z @ self.weights)
            gradient = z.T @ (p - y) + penalty @ self.weights
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, gradient)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -20, 20)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights


class View:
    """A classifier and its calibration: a logistic curve over its margins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray):
        self.classifier = Logistic(x, y)
        self.curve = Logistic(self.classifier.margin(held_x)[:, None], held_y, ridge=1e-2)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality."""
        return np.clip(self.curve.margin(self.classifier.margin(x)[:, None]), -15, 15)


@dataclass
class CoTrained:
    text: View
    metadata: View
    prior: float

    def fused(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.calibrated(text), self.metadata.calibrated(metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, held: np.ndarray) -> CoTrained | None:
    """views: a row for each document in either view; labels: 1, 0, or nan in the pool; held: rows kept for calibration."""
    known = ~np.isnan(labels)
    train, held = known & ~held, known & held
    if any(set(labels[rows]) != {0.0, 1.0} for rows in (train, held)):
        return None
    pool = np.flatnonzero(~known)
    given = [labels.copy(), labels.copy()]  # what each view learns from
    for _ in range(ROUNDS + 1):
        fitted = []
        for x, y in zip(views, given):
            rows = ~np.isnan(y) & ~held
            fitted.append(View(x[rows], y[rows], x[held], labels[held]))
        if _ == ROUNDS or not len(pool):
            break
        for me, other in ((0, 1), (1, 0)):
            odds = fitted[me].calibrated(views[me][pool])
            for label, sure in ((1.0, odds), (0.0, -odds)):
                best = np.argsort(-sure, kind="stable")[: max(1, int(SHARE * len(pool)))]
                best = best[sure[best] >= _logit(SURE)]
                fresh = pool[best][np.isnan(given[other][pool[best]])]
                given[other][fresh] = label
    return CoTrained(*fitted, float(_logit(np.clip(labels[train | held].mean(), 1e-6, 1 - 1e-6))))


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first doc_ids by their hash, each once. Of many, only those whose hash is low enough to be among them are sorted."""
    by_hash = F.xxhash64("doc_id", F.lit(17))
    n = rows.agg(F.approx_count_distinct("doc_id")).first()[0]
    if n > 2 * most:  # hashes are even, so two fifths more than needed leave enough, for a count that is off by a twentieth
        rows = rows.where(by_hash < int(-(2**63) + 2**64 * 1.4 * most / n))
    return rows.dropDuplicates(["doc_id"]).orderBy(by_hash, "doc_id").limit(most)


def _sample(docs: DataFrame, labels: DataFrame, quality: str, max_labelled: int, max_pool: int) -> DataFrame:
    """doc_id and label of the rows to fit on; the label of pool rows is null."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col(quality).isNotNull()).groupBy("doc_id").agg(F.max(quality).cast("double").alias("label"))
    graded = _first(graded, max_labelled)
    pool = _first(docs.where("doc_id is not null").select("doc_id"), max_pool)
    return graded.unionByName(pool.select("doc_id", F.lit(None).cast("double").alias("label"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, quality: str = "quality", max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> CoTrained | None:
    """A model from the bounded sample, or None without labels of both classes.

    The bounds are parameters of the fit alone: about 800 bytes of the driver's memory for each row.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def both(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(texts, sources, langs, sizes)
        return pa.array([np.concatenate([text_view(t.as_py()), metadata_view(s.as_py(), g.as_py(), n.as_py())]).tobytes() for t, s, g, n in rows], pa.binary())

    chosen = docs.select("doc_id", *_inputs()).join(F.broadcast(_sample(docs, labels, quality, max_labelled, max_pool)), "doc_id")
    rows = chosen.select("doc_id", "label", both("_text", "_source", "_lang", "_chars").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    if rows.empty:
        return None
    x = np.frombuffer(b"".join(rows.pop("x")), float).reshape(len(rows), -1)
    width = len(text_view(b""))
    held = np.array([zlib.crc32(str(i).encode()) % 10 < 3 for i in rows.doc_id])
    return co_train((x[:, :width], x[:, width:]), rows.label.to_numpy(float), held)


def _inputs() -> list[Column]:
    return [F.col("text").cast("binary").alias("_text"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"), F.col("n_chars").cast("long").alias("_chars")]


def quality(docs: DataFrame, model: CoTrained | None) -> Column:
    """A struct of p_text, p_metadata and score, the probability of good quality by either view and by both."""
    kinds = pa.struct([("p_text", pa.float64()), ("p_metadata", pa.float64()), ("score", pa.float64())])

    @F.arrow_udf("p_text double, p_metadata double, score double")
    def score(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        n = len(texts)
        if model is None or not n:
            parts = [np.full(n, 0.5)] * 3
        else:
            text = np.vstack([text_view(t.as_py()) for t in texts])
            metadata = np.vstack([metadata_view(s.as_py(), g.as_py(), c.as_py()) for s, g, c in zip(sources, langs, sizes)])
            parts = model.fused(text, metadata)
        trim()
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=list(kinds))

    return score(*_inputs())
