"""Learned tagging: a start by word and by longest suffix, and transformation rules over it.

A rule turns one tag into another where a condition holds: a template's features, each a word or a tag
at one of some places around, with their values. Rules are learned one at a time: of all conditions that
a wrong token offers, the one whose rule mends most more tokens than it breaks. Counts of what each
condition would mend and break are tables; when a rule is kept, only the sentences that it changes are
counted again, and their old counts taken off. A rule changes all its tokens of a sentence at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.operators.exam import most_common
from prosegrid.sources.tables import stored

#: Features: word or tag, and the places, any of which may have the value.
Feature = tuple[str, tuple[int, ...]]
TEMPLATES: list[list[Feature]] = [
    [("tag", (-1,))], [("tag", (1,))], [("word", (0,))], [("word", (-1,))], [("word", (1,))],
    [("tag", (-2, -1))], [("tag", (1, 2))], [("tag", (-1,)), ("tag", (1,))], [("tag", (-1,)), ("word", (0,))], [("word", (0,)), ("tag", (1,))],
]


@dataclass(frozen=True)
class Rule:
    before: str
    after: str
    template: int
    values: tuple[str, ...]
    gain: int


def starting_tags(train: DataFrame, words: DataFrame, longest: int = 5, least: int = 2) -> DataFrame:
    """The words (word) with tag and by: the most common tag of the word, else of its longest suffix that train has often enough, else of all.

    train: word, tag. by: word, the suffix, or empty.
    """
    known = most_common(train, "word", "tag").select("word", F.col("tag").alias("_own"))
    size = F.char_length("word")
    cuts = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(longest))), lambda n: F.when(n == 0, "").otherwise(F.right("word", n)))
    grown = train.select(F.explode(cuts).alias("suffix"), "tag")
    often = most_common(grown, "suffix", "tag").join(grown.groupBy("suffix").agg(F.count("*").alias("_n")), "suffix").where((F.col("_n") >= least) | (F.col("suffix") == "")).select("suffix", F.col("tag").alias("_cut"))
    asked = words.select("word").distinct()
    met = asked.select("word", F.explode(cuts).alias("suffix")).join(often, "suffix")
    best = met.groupBy("word").agg(F.max_by(F.struct("suffix", "_cut"), F.char_length("suffix")).alias("_best"))
    found = asked.join(best, "word", "left").join(known, "word", "left")
    by = F.when(F.col("_own").isNotNull(), F.col("word")).otherwise(F.col("_best.suffix"))
    return found.select("word", F.coalesce("_own", F.col("_best._cut")).alias("tag"), by.alias("by"))


def _extended(ways: Column, values: Column) -> Column:
    """Each way with each value at its end."""
    return F.flatten(F.transform(ways, lambda way: F.transform(values, lambda v: F.array_append(way, v))))


def _told(ways: Column, template: int) -> Column:
    return F.transform(ways, lambda way: F.struct(F.lit(template).alias("template"), way.alias("values")))


def with_conditions(tokens: DataFrame) -> DataFrame:
    """(sent_id, pos, word, tag, gold) tokens with conditions: (template, values) of all that holds there."""
    order = Window.partitionBy("sent_id").orderBy("pos")
    places = sorted({(kind, at) for template in TEMPLATES for kind, offsets in template for at in offsets})
    near = {p: F.col(p[0]) if p[1] == 0 else F.lead(p[0], p[1]).over(order) if p[1] > 0 else F.lag(p[0], -p[1]).over(order) for p in places}
    rows = tokens.withColumns({f"_{kind}{at}": c for (kind, at), c in near.items()})
    found = []
    for number, template in enumerate(TEMPLATES):
        ways = F.array(F.array().cast("array<string>"))
        for kind, offsets in template:
            values = F.array_distinct(F.array_compact(F.array(*(F.col(f"_{kind}{at}") for at in offsets))))
            ways = _extended(ways, values)
        found.append(_told(ways, number))
    return rows.withColumn("conditions", F.flatten(F.array(*found))).drop(*(f"_{kind}{at}" for kind, at in places))


def _counts(rows: DataFrame, sign: int) -> DataFrame:
    """before, template, values, after and n: how many tokens a rule would mend; where after is null, how many any would break."""
    told = rows.where("gold is not null").select("tag", F.when(F.col("tag") != F.col("gold"), F.col("gold")).alias("after"), F.explode("conditions").alias("c"))
    return told.groupBy(F.col("tag").alias("before"), "c.template", "c.values", "after").agg((F.count("*") * sign).alias("n"))


def _best(counts: DataFrame) -> Rule | None:
    """The rule of the greatest gain; of equal ones the first by template, values and tags."""
    key = ["before", "template", "values"]
    mends = counts.where("after is not null")
    breaks = counts.where("after is null").select(*key, F.col("n").alias("_breaks"))
    gains = mends.join(breaks, key, "left").withColumn("gain", F.col("n") - F.coalesce("_breaks", F.lit(0)))
    first = gains.orderBy(F.desc("gain"), "template", "values", "before", "after").limit(1).collect()
    return Rule(first[0].before, first[0].after, first[0].template, tuple(first[0]["values"]), first[0].gain) if first else None


def applied(rows: DataFrame, rule: Rule) -> DataFrame:
    """Tokens (with conditions) after a rule."""
    holds = F.exists("conditions", lambda c: (c["template"] == rule.template) & (c["values"] == F.array(*map(F.lit, rule.values))))
    return rows.withColumn("tag", F.when((F.col("tag") == rule.before) & holds, rule.after).otherwise(F.col("tag")))


def learn(tokens: DataFrame, most: int = 50, least: int = 1) -> tuple[list[Rule], DataFrame]:
    """At most so many rules of at least that gain, in the order in which they were kept, and the tokens as they leave them.

    tokens: sent_id, pos, word, tag (the start's), gold (null: counted by no rule).
    """
    names = ["sent_id", "pos", "word", "tag", "gold"]
    state = stored(with_conditions(tokens.select(names)), "tokens")
    counts = stored(_counts(state, 1), "counts")
    rules: list[Rule] = []
    while len(rules) < most:
        rule = _best(counts)
        if rule is None or rule.gain < least:
            break
        rules.append(rule)
        after = applied(state, rule)
        hit = stored(after.join(state.select("sent_id", "pos", F.col("tag").alias("_was")), ["sent_id", "pos"]).where("tag <> _was").select("sent_id").distinct(), "hit")
        old = state.join(hit, "sent_id", "left_semi")
        new = stored(with_conditions(after.join(hit, "sent_id", "left_semi").select(names)), "retagged")
        key = ["before", "template", "values", "after"]
        changed = reduce(DataFrame.unionByName, [counts, _counts(old, -1), _counts(new, 1)])
        counts = stored(changed.groupBy(key).agg(F.sum("n").alias("n")).where("n <> 0"), "counts")
        state = stored(state.join(hit, "sent_id", "left_anti").unionByName(new), "tokens")
    return rules, state.select(names)


def retagged(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """Tokens (sent_id, pos, word, tag) after all rules, one after another."""
    for rule in rules:
        rows = with_conditions(tokens)
        tokens = applied(rows, rule).select(tokens.columns)
    return tokens
