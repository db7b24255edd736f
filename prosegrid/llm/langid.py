"""Language identification by fusing evidence as a Bayesian would.

Four kinds of evidence about a document's language are multiplied:

* the likelihood of its text, by trigrams of bytes, tempered since trigrams depend on each other;
* the language that its markup declares, by how often texts of a language declare it;
* the suffix of its address, by how often texts of a language have it;
* the prior of its host, smoothed towards that of the host's suffix, which is smoothed towards
  that of the whole table.

A language is a declared value with ``MIN_DOCUMENTS`` documents and ``MIN_TRIGRAMS`` trigrams at
least, whatever its share of the table. One more, OUTSIDE, stands for all others: any trigram is as
likely in it as any other, so noise and languages that no model was learned from fit it best. A
declared value without enough text is no language; its documents get whichever fits. Of more than
``MAX_LANGUAGES`` the ones with the most text are modelled and the rest fall to OUTSIDE.

Trigram counts, declarations, suffixes and priors are grouped aggregations over all documents; what
comes back to the driver is bounded by the number of languages, not of documents, hosts or
suffixes. Priors are joined by host and suffix, broadcast while there are few enough and by a
shuffle beyond.

A document's share is the part of its text, by stretches of STRETCH trigrams, that is in its
language on its own; texts of mixed languages have a low one.

Defined results: a null text is an empty one and says nothing; a null declaration or address says
nothing, and an unheard-of host has its suffix's prior; a text of one stretch or less has share 1;
where no language is declared often enough, language is null and posterior and share are 1; ties
go to the first language by name; an empty table gives an empty result. Columns other than those
read pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches, trim, trimmed, written

BUCKETS = 1 << 15
MIN_DOCUMENTS, MIN_TRIGRAMS = 3, 1000
MAX_LANGUAGES = 256
#: The language of texts that no language was learned from.
OUTSIDE = "und"
#: Power to which the likelihood of a trigram is raised.
TEMPER = 0.15
#: Pseudo-counts: of a trigram, of a declaration or suffix, of a parent's prior.
TRIGRAM, TOLD, PARENT = 0.5, 1.0, 20.0
#: Hosts or suffixes whose priors are broadcast, about 60 bytes each and 8 for each language; beyond, they are joined by a shuffle.
MAX_BROADCAST_CELLS = 1_000_000
#: Trigrams of a stretch, and bytes of a text that are looked at in one go.
STRETCH, BLOCK = 512, 1 << 18
#: The column of results; it and its working columns have names that no table has.
RESULT = "_langid_result"
#: Languages whose counts a task holds before it hands them on.
HELD = 64


def trigrams(text: bytes | None) -> np.ndarray:
    """The buckets of the trigrams of bytes, A-Z lower-cased."""
    b = np.frombuffer((text or b"").lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * 2654435761 & 0xFFFFFFFF) >> 17).astype(np.int64)


def blocks(text: bytes | None) -> Iterator[np.ndarray]:
    """The trigrams block by block; none is lost between blocks."""
    text = text or b""
    for at in range(0, max(len(text) - 2, 0), BLOCK):
        yield trigrams(text[at : at + BLOCK + 2])


@dataclass
class Model:
    languages: list[str]  # OUTSIDE is the last
    trigram: np.ndarray  # log likelihoods, a row for each bucket
    declared: dict[str, np.ndarray]

    def heard(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of the text by language, and for each of its stretches its best language and its size."""
        likely, best, sizes = np.zeros(len(self.languages)), [], []
        for found in blocks(text):
            starts = np.arange(0, len(found), STRETCH)
            if len(starts) > 1 and len(found) - starts[-1] < STRETCH // 2:
                starts = starts[:-1]  # a short rest belongs to the stretch before it
            by = np.add.reduceat(self.trigram[found], starts, axis=0)
            likely += by.sum(axis=0)
            best.append(by.argmax(axis=1))
            sizes.append(np.diff(starts, append=len(found)))
        none = np.empty(0, np.int64)
        return TEMPER * likely, np.concatenate(best or [none]), np.concatenate(sizes or [none])

    def fused(self, text: bytes | None, declared: str | None, suffix: np.ndarray | None, prior: np.ndarray) -> tuple[str, float, str | None, float]:
        """Language, posterior, the language by the text alone, and the share of the text in the language."""
        heard, best, sizes = self.heard(text)
        odds = heard + prior
        if declared is not None:
            odds = odds + self.declared.get(declared if declared in self.languages else OUTSIDE, 0.0)
        if suffix is not None:
            odds = odds + suffix
        first = int(odds.argmax())
        share = float(sizes[best == first].sum() / sizes.sum()) if len(sizes) > 1 else 1.0
        return self.languages[first], float(1 / np.exp(odds - odds[first]).sum()), self.languages[int(heard.argmax())] if len(sizes) else None, share


@dataclass
class Fitted:
    """The model, and what tables tell: log priors of hosts; evidence and log priors of suffixes; the log prior of the whole."""

    model: Model
    hosts: DataFrame
    suffixes: DataFrame
    whole: np.ndarray


def _trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket and n over all documents that declare a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in held and len(held) >= HELD:
                    yield from handed()
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                for found in blocks(text.as_py()):
                    if len(found) > 4096:
                        held[lang] += np.bincount(found, minlength=BUCKETS)
                    else:
                        np.add.at(held[lang], found, 1)
        yield from handed()

    return docs.mapInArrow(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def told_by(counts: dict[tuple[str, str], int], languages: list[str]) -> dict[str, np.ndarray]:
    """For each told value, the log of how likely each language is to tell it."""
    values = sorted({v for v, _ in counts})
    table = np.full((len(values), len(languages)), TOLD)
    for (value, language), n in counts.items():
        table[values.index(value), languages.index(language)] += n
    return dict(zip(values, np.log(table / (table.sum(axis=0) + TOLD))))


def _evidence(declared: str, host: str | None, suffix: str | None) -> list[Column]:
    name = lambda column: (F.col(column) if column else F.lit(None)).cast("string")
    told = F.nullif(name(declared), F.lit(OUTSIDE))
    return [F.col("text").cast("binary").alias("_text"), told.alias("_declared"), name(host).alias("_host"), name(suffix).alias("_suffix")]


def fit(docs: DataFrame, declared: str = "lang", host: str | None = None, suffix: str | None = None) -> Fitted | None:
    """The model and its tables, or None where no language is declared often enough."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(*_evidence(declared, host, suffix))
    told = rows.where("_declared is not null").groupBy("_declared").agg(F.count_if(F.octet_length("_text") > 2).alias("docs"), F.sum(F.greatest(F.octet_length("_text") - 2, F.lit(0))).alias("size"))
    enough = told.where((F.col("docs") >= MIN_DOCUMENTS) & (F.col("size") >= MIN_TRIGRAMS)).orderBy(F.desc("size"), "_declared").limit(MAX_LANGUAGES)
    known = sorted(r["_declared"] for r in enough.collect())
    if not known:
        return None
    languages = [*known, OUTSIDE]
    spoken = rows.where(F.col("_declared").isin(known)).select(F.col("_declared").alias("lang"), F.col("_text").alias("text"))
    counts = np.full((BUCKETS, len(known)), TRIGRAM)
    grams = _trigram_counts(spoken).toPandas()  # BUCKETS rows for each language at most
    counts[grams.bucket, grams.lang.map({x: n for n, x in enumerate(known)})] += grams.n
    likely = np.column_stack([np.log(counts / counts.sum(axis=0)), np.full(BUCKETS, -np.log(BUCKETS))])
    model = Model(languages, likely.astype(np.float32), {})

    @F.arrow_udf("string")
    def spoken_by(texts: pa.Array) -> pa.Array:
        found = [model.heard(t.as_py()) for t in texts]
        trim()
        return pa.array([languages[int(heard.argmax())] if len(sizes) else None for heard, _, sizes in found], pa.string())

    seen = rows.select("_declared", "_host", "_suffix", spoken_by("_text").alias("_spoken")).where("_spoken is not null").groupBy("_declared", "_host", "_suffix", "_spoken").agg(F.count("*").alias("n"))
    seen = written(spark, seen, "seen")
    value = F.when(F.col("_declared").isin(known), F.col("_declared")).otherwise(OUTSIDE)
    pairs = seen.where("_declared is not null").groupBy(value.alias("value"), "_spoken").agg(F.sum("n").alias("n")).collect()  # languages squared at most
    model.declared = told_by({(r["value"], r["_spoken"]): r["n"] for r in pairs}, languages)

    by_language = F.array(*(F.coalesce(F.sum(F.when(F.col("_spoken") == x, F.col("n"))), F.lit(0)).cast("double") for x in languages))
    logs = lambda c: F.transform(c, lambda p: F.log(p))
    smoothed = lambda own, parent: F.transform(F.arrays_zip(own.alias("n"), parent.alias("p")), lambda x: (x["n"] + PARENT * x["p"]) / (F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + PARENT))
    numbers = lambda a: F.array(*map(F.lit, a.tolist()))
    whole = np.array(seen.agg(by_language.alias("n")).first()["n"])
    share = (whole + 1) / (whole.sum() + len(languages))
    of_suffix = seen.groupBy("_suffix").agg(by_language.alias("n")).withColumn("parent", smoothed(F.col("n"), numbers(share)))
    named = of_suffix.where("_suffix is not null")
    n_suffixes, *totals = named.agg(F.count("*"), *(F.coalesce(F.sum(F.get("n", F.lit(i))), F.lit(0.0)) for i in range(len(languages)))).first()
    told = F.transform(F.arrays_zip(F.col("n").alias("n"), numbers(np.array(totals) + TOLD * (n_suffixes + 1)).alias("all")), lambda x: F.log((x["n"] + TOLD) / x["all"]))
    suffixes = written(spark, named.select("_suffix", told.alias("_told"), logs("parent").alias("_parent")), "suffixes")
    of_host = seen.where("_host is not null").groupBy("_host", "_suffix").agg(by_language.alias("own"))
    hosts = of_host.join(of_suffix, of_host["_suffix"].eqNullSafe(of_suffix["_suffix"])).select("_host", of_host["_suffix"], logs(smoothed(F.col("own"), F.col("parent"))).alias("_prior"))
    return Fitted(model, written(spark, hosts, "hosts"), suffixes, np.log(share))


def identify(docs: DataFrame, fitted: Fitted | None, declared: str = "lang", host: str | None = None, suffix: str | None = None) -> DataFrame:
    """The documents with a struct RESULT: language, posterior, text_language and share."""
    if fitted is None:
        nothing = F.struct(F.lit(None).cast("string").alias("language"), F.lit(1.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(1.0).alias("share"))
        return docs.withColumn(RESULT, nothing)
    model, whole = fitted.model, fitted.whole
    kinds = pa.struct([("language", pa.string()), ("posterior", pa.float64()), ("text_language", pa.string()), ("share", pa.float64())])

    @F.arrow_udf("language string, posterior double, text_language string, share double")
    def fuse(texts: pa.Array, declarations: pa.Array, suffixes: pa.Array, priors: pa.Array) -> pa.Array:
        array = lambda x, other: np.array(x) if x is not None else other
        rows = [model.fused(t.as_py(), d, array(s, None), array(p, whole)) for t, d, s, p in zip(texts, declarations.to_pylist(), suffixes.to_pylist(), priors.to_pylist())]
        parts = zip(*rows) if rows else ((),) * len(kinds)
        trim()
        return pa.StructArray.from_arrays([pa.array(p, k.type) for p, k in zip(parts, kinds)], fields=list(kinds))

    text, told, name, at = _evidence(declared, host, suffix)
    work = {c: f"{RESULT}_{c}" for c in ("host", "suffix", "prior", "prior_host", "prior_suffix", "told", "parent", "of")}
    met = docs.withColumns({work["host"]: name, work["suffix"]: at})

    def joined(met: DataFrame, table: DataFrame, on: Column, by: str) -> DataFrame:
        if table.count() * len(model.languages) <= MAX_BROADCAST_CELLS:
            return met.join(F.broadcast(table), on, "left")
        # Rows that have no key are spread, since no row of the table has theirs.
        spread = F.coalesce(F.col(by), F.concat(F.lit("\0"), F.pmod(F.xxhash64(text), F.lit(4096)).cast("string")))
        whole_key = met.withColumn(by, spread).join(table, on, "left")
        return whole_key.withColumn(by, F.when(~F.startswith(F.col(by), F.lit("\0")), F.col(by)))

    if host:
        hosts = fitted.hosts.select(F.col("_host").alias(work["prior_host"]), F.col("_suffix").alias(work["prior_suffix"]), F.col("_prior").alias(work["prior"]))
        same = (F.col(work["host"]) == F.col(work["prior_host"])) & F.col(work["suffix"]).eqNullSafe(F.col(work["prior_suffix"]))
        met = joined(met, hosts, same, work["host"])
    if suffix:
        suffixes = fitted.suffixes.select(F.col("_suffix").alias(work["of"]), F.col("_told").alias(work["told"]), F.col("_parent").alias(work["parent"]))
        met = joined(met, suffixes, F.col(work["suffix"]) == F.col(work["of"]), work["suffix"])
    nothing = F.lit(None).cast("array<double>")
    prior = F.coalesce(F.col(work["prior"]) if host else nothing, F.col(work["parent"]) if suffix else nothing)
    return met.withColumn(RESULT, fuse(text, told, F.col(work["told"]) if suffix else nothing, prior)).drop(*work.values())
