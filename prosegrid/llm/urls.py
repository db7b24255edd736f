"""URL filters on a sorted digest array.

Rules are strings HOST/PATH. Their 64-bit xxhash keys form a sorted array in a file that each
executor fetches once and memory-maps; a url probes it with the keys of its host suffixes, of as
many labels as some rule's host has, and path prefixes of the rules' lengths by vectorised binary
search, and every hit is confirmed against the stored rule, so colliding keys do no harm. A list
too long for every executor is a table of its own: distinct urls' probes are joined to it.

Defined results: a null url or one without ``://`` has an empty host and path; an empty rule list
matches nothing; where rules of equal length fit, the one with the longer host wins; of repeated
rules the first counts, in a table the one that blocks. Results are host, path, rule and verdict;
columns of the frame with these names are replaced, all others pass through untouched.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every executor holds the rule list: a longer one is refused here (about 1 GB of mapped file).
MAX_RULE_BYTES = 1 << 30

#: Working columns, whose names no table has.
WORK, VERDICT = "_urls_parts", "_urls_verdict"

_mapped: dict = {}


def host_suffixes(host: str, most: int) -> list[str]:
    """The host and its parents, of so many labels at most: long hosts have no more to try than short ones."""
    labels = host.rsplit(".", most)[-most:] if most else []
    if most and host.count(".") < most:
        labels = host.split(".")
    return [".".join(labels[k:]) for k in range(len(labels))]


class RuleArray:
    """Sorted keys and, in the same order, the rules themselves, mapped from a file."""

    def __init__(self, path: str):
        head = np.fromfile(path, "<i8", 1)
        n = int(head[0])
        self.keys = np.memmap(path, "<u8", "r", 8, (n,)) if n else np.empty(0, "<u8")
        self.at = np.memmap(path, "<i8", "r", 8 + 8 * n, (n + 1,))
        self.blob = np.memmap(path, "u1", "r", 8 + 8 * n + 8 * (n + 1)) if n else np.empty(0, "u1")
        rules = [self.rule(i) for i in range(n)]
        self.lengths = sorted({len(rule.partition("/")[2]) + 1 for rule in rules}, reverse=True)
        self.labels = max((rule.partition("/")[0].count(".") + 1 for rule in rules), default=0)

    def rule(self, i: int) -> str:
        """VERDICT and rule are stored as one text: its first letter is a or b."""
        return bytes(self.blob[self.at[i] : self.at[i + 1]]).decode()[1:]

    def verdict(self, i: int) -> str:
        return "allow" if self.blob[self.at[i]] == ord("a") else "block"

    def lookup(self, probes: list[str]) -> list[int]:
        """The place of each probe, or -1."""
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), "<u8", len(probes))
        at = np.searchsorted(self.keys, keys)
        found = [-1] * len(probes)
        for j in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else []):
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == keys[j]:  # a collision leaves neighbours with one key
                if self.rule(i) == probes[j]:
                    found[j] = i
                    break
                i += 1
        return found


def rule_file(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Sends the sorted array of (verdict, rule) to all executors; its name is what they look for."""
    first: dict[str, str] = {}
    for verdict, rule in rules:
        first.setdefault(rule, verdict)
    rows = sorted((xxhash.xxh64_intdigest(rule), ("a" if verdict == "allow" else "b") + rule) for rule, verdict in first.items())
    texts = [text.encode() for _, text in rows]
    if sum(map(len, texts)) + 16 * len(texts) > MAX_RULE_BYTES:
        raise ValueError("the rule list is too long for an array that every executor maps; pass it to judge_urls_by_join as a table")
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as out:
        out.write(np.array([len(rows)], "<i8").tobytes())
        out.write(np.array([key for key, _ in rows], "<u8").tobytes())
        out.write(np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes())
        out.write(b"".join(texts))
    spark.sparkContext.addFile(path)
    return name


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(frame: DataFrame, url: str, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict; default is the verdict where no rule fits."""
    name = rule_file(frame.sparkSession, rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if name not in _mapped:
            _mapped.clear()
            _mapped[name] = RuleArray(SparkFiles.get(name))
        array = _mapped[name]
        for hosts, paths in batches:
            suffixes = {host: host_suffixes(host, array.labels) for host in hosts.unique() if host}
            probes: list[str] = []
            counts: list[int] = []
            for host, path in zip(hosts, paths):
                before = len(probes)
                for suffix in suffixes.get(host, ()):
                    probes += [f"{suffix}{path[:n]}" for n in array.lengths if len(path) >= n]
                counts.append(len(probes) - before)
            found = array.lookup(probes)
            chosen, at = [], 0
            for n in counts:
                fits = [i for i in found[at : at + n] if i >= 0]
                at += n
                chosen.append(max(fits, key=lambda i: (len(array.rule(i)), array.rule(i).index("/")), default=-1))
            yield pd.DataFrame({"rule": [array.rule(i) if i >= 0 else None for i in chosen], "verdict": [array.verdict(i) if i >= 0 else default for i in chosen]})

    host, path = host_and_path(F.col(url))
    judged = frame.withColumn(WORK, F.struct(host.alias("host"), path.alias("path")))
    judged = judged.withColumn(VERDICT, judge(F.col(WORK)["host"], F.col(WORK)["path"]))
    return _with_results(judged)


def _with_results(judged: DataFrame) -> DataFrame:
    """host and path from WORK, rule and verdict from VERDICT, in place of columns of these names."""
    known, found = F.col(WORK), F.col(VERDICT)
    return judged.withColumns({"host": known["host"], "path": known["path"], "rule": found["rule"], "verdict": found["verdict"]}).drop(WORK, VERDICT)


def judge_urls_by_join(frame: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same by a table of rules (verdict, rule) of any length. Lengths of paths and numbers of labels, each once, come to the driver."""
    rules = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    at = F.instr("rule", "/")
    lengths = sorted(r[0] for r in rules.select((F.char_length("rule") - at + 1).alias("n")).distinct().collect())
    labels = sorted(r[0] for r in rules.select((F.regexp_count(F.left("rule", at - 1), F.lit(r"\.")) + 1).alias("n")).distinct().collect())
    numbers = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    host, path = host_and_path(F.col("url"))
    urls = frame.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    parts = F.regexp_count("host", F.lit(r"\.")) + 1
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= parts), lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), "."))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = urls.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "suffix", F.explode("prefixes").alias("prefix")).select("url", F.concat("suffix", "prefix").alias("rule"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), F.instr("rule", "/")))
    chosen = probes.join(rules, "rule").groupBy(F.col("url").alias(f"{WORK}_url")).agg(best.alias(VERDICT))
    host, path = host_and_path(F.col(url))
    judged = frame.withColumn(WORK, F.struct(host.alias("host"), path.alias("path"))).join(chosen, F.col(url) == F.col(f"{WORK}_url"), "left").drop(f"{WORK}_url")
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return _with_results(judged.withColumn(VERDICT, F.coalesce(VERDICT, nothing)))
