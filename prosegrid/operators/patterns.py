"""Patterns over the tokens of a sentence, compiled to window expressions.

A pattern is a list of items, each a condition on one token, or such a condition made optional,
repeated or zero-width. It is expanded into alternatives of fixed length, the longest first; each
is a conjunction of look-aheads. Matches are leftmost, longest, not overlapping, and stay within a
sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.operators.tokens import in_sentence


@dataclass(frozen=True)
class Item:
    test: Column
    least: int = 1
    most: int = 1
    look: int = 0  # 1: not followed by, -1: not preceded by


def one(test: Column) -> Item:
    return Item(test)


def optional(test: Column) -> Item:
    return Item(test, 0, 1)


def run(most: int, test: Column) -> Item:
    return Item(test, 0, most)


def not_followed_by(test: Column) -> Item:
    return Item(test, look=1)


def not_preceded_by(test: Column) -> Item:
    return Item(test, look=-1)


def word(*words: str) -> Column:
    return F.col("folded").isin(list(words)) & (F.col("kind") == "Word")


def mark(*marks: str) -> Column:
    return F.col("text").isin(list(marks)) & F.col("kind").isin("Punctuation", "Symbol")


def not_pair(*pairs: tuple[str, str]) -> Column:
    """Not the first word of one of these pairs with its second two tokens on in the sentence."""
    after = F.lead("folded", 2).over(in_sentence())
    pair = F.lit(False)
    for first, second in pairs:
        pair = pair | ((F.col("folded") == first) & F.coalesce(after == second, F.lit(False)))
    return ~pair


#: How sure a reading can be, from the least on.
CONFIDENCE = ["Unknown", "Unsure", "Likely", "Sure"]


def tagged(*tags: str, least: str = "Likely") -> Column:
    """A word whose tag is one of these, as sure as least at least; for tokens that the tagger has read."""
    enough = CONFIDENCE[CONFIDENCE.index(least) :]
    return F.coalesce(F.col("tag").isin(list(tags)) & F.col("confidence").isin(enough), F.lit(False))


def origin(*origins: str) -> Column:
    """A word whose origin, as the tagger tells it, is one of these."""
    return F.coalesce(F.col("origin").isin(list(origins)), F.lit(False))


def alternatives(items: list[Item]) -> list[list[tuple[int, int, bool]]]:
    """Lists of (item, offset, wanted), longest first; the last entry's offset tells the length."""
    found: list[tuple[int, list[tuple[int, int, bool]]]] = [(0, [])]
    for number, item in enumerate(items):
        grown = []
        for length, tests in found:
            if item.look:
                grown.append((length, [*tests, (number, length if item.look > 0 else length - 1, False)]))
                continue
            for times in range(item.most, item.least - 1, -1):
                grown.append((length + times, [*tests, *((number, length + k, True) for k in range(times))]))
        found = grown
    return [[(-1, length, True), *tests] for length, tests in sorted(found, key=lambda x: -x[0])]


def find(tokens: DataFrame, items: list[Item]) -> DataFrame:
    """doc_id, block_id, sent_id, pos and length of each match."""
    named = tokens
    for number, item in enumerate(items):
        named = named.withColumn(f"_item{number}", F.coalesce(item.test, F.lit(False)))

    def at(number: int, offset: int) -> Column:
        name = f"_item{number}"
        if not offset:
            return F.col(name)
        return F.lead(name, offset).over(in_sentence()) if offset > 0 else F.lag(name, -offset).over(in_sentence())

    lengths = []
    for tests in alternatives(items):
        (_, length, _), *tests = tests
        good = F.lit(True)
        for number, offset, wanted in tests:
            good = good & (F.coalesce(at(number, offset), F.lit(False)) if wanted else ~F.coalesce(at(number, offset), F.lit(False)))
        lengths.append(F.when(good, length))
    hits = named.select("doc_id", "block_id", "sent_id", "pos", F.coalesce(*lengths).alias("length")).where("length > 0")
    return leftmost(hits)


def leftmost(hits: DataFrame) -> DataFrame:
    """Of a sentence's matches, those that begin at or after the end of the last one taken."""
    kind = "array<struct<pos:int,length:int>>"
    ordered = hits.groupBy("doc_id", "block_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("hits"))
    start = F.struct(F.lit(-1).alias("until"), F.array().cast(kind).alias("taken"))

    def step(state: Column, hit: Column) -> Column:
        fits = hit["pos"] >= state["until"]
        grown = F.array_append(state["taken"], F.struct(hit["pos"].alias("pos"), hit["length"].alias("length")))
        return F.struct(F.when(fits, hit["pos"] + hit["length"]).otherwise(state["until"]).alias("until"), F.when(fits, grown).otherwise(state["taken"]).alias("taken"))

    taken = F.aggregate("hits", start, step, lambda state: state["taken"])
    return ordered.select("doc_id", "block_id", "sent_id", F.explode(taken).alias("hit")).select("doc_id", "block_id", "sent_id", "hit.pos", "hit.length")
