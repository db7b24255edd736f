"""Fixes by place, to a fixpoint.

An edit is a row: path, line, start and end (columns from 1, end exclusive) and what is written instead.
Edits of a round that overlap are told apart, the leftmost first; the others are proposed again by the
next round, in the text that there is by then. A round reads only documents that the one before changed.
Its edits are proven: where a document's blocks are not what they were, line by line, its edits are
undone, and the lines that changed are held, so that the next round leaves them alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.operators import chars, layers, maps, tree
from prosegrid.operators.regions import LANGUAGES
from prosegrid.sources.tables import stored

EDIT = ["path", "line", "start", "end", "replacement"]


def written_instead(groups: list[str], ban: dict[str, str | None] | None = None, allow: list[str] | None = None) -> dict[str, str]:
    """The characters that a fix may replace, and by what: those whose rule names one replacement that isn't a word; ban adds to the groups, allow takes away."""
    found: dict[str, str | None] = {}
    for name in groups:
        for first, last, _, replacement in chars.GROUPS[name]:
            for code in range(first, last + 1) if last - first < 4096 else ():
                found.setdefault(chr(code), replacement if first == last else None)
    found |= ban or {}
    return {c: r for c, r in found.items() if r is not None and not any(x.isalnum() for x in r) and c not in (allow or [])}


def char_edits(instead: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Proposes an edit for each place of each character."""

    def propose(texts: DataFrame) -> DataFrame:
        listed = F.array(*map(F.lit, instead)) if instead else F.array().cast("array<string>")
        lines = texts.select("path", F.posexplode(maps.line_parts(F.col("text"))).alias("n", "part")).where(F.exists(listed, lambda c: F.contains("part", c)))
        places = lines.select("path", (F.col("n") + 1).alias("line"), F.posexplode(F.split("part", "")).alias("at", "ch")).where(F.col("ch").isin(list(instead)))
        replaced = F.create_map(*(F.lit(x) for pair in instead.items() for x in pair))[F.col("ch")] if instead else F.lit(None).cast("string")
        return places.select("path", "line", (F.col("at") + 1).alias("start"), (F.col("at") + 2).alias("end"), replaced.alias("replacement"))

    return propose


def by_line(edits: DataFrame) -> DataFrame:
    """path, line and its edits in order, the leftmost and then longest first, without those that overlap one that is taken."""
    row = F.struct("start", (-F.col("end")).alias("last"), "replacement")
    listed = edits.groupBy("path", "line").agg(F.array_sort(F.collect_set(row)).alias("all"))
    kind = "array<struct<start:int,last:int,replacement:string>>"
    begin = F.struct(F.lit(0).alias("until"), F.array().cast(kind).alias("taken"))

    def step(state: Column, edit: Column) -> Column:
        fits = edit["start"] >= state["until"]
        return F.struct(F.when(fits, -edit["last"]).otherwise(state["until"]).alias("until"), F.when(fits, F.array_append(state["taken"], edit)).otherwise(state["taken"]).alias("taken"))

    return listed.select("path", "line", F.aggregate("all", begin, step, lambda s: s["taken"]).alias("edits"))


def applied(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """path and text after the edits of by_line()'s rows; only texts that have any."""
    own = texts.join(lines.select("path").distinct(), "path", "left_semi")
    parts = own.select("path", F.posexplode(maps.line_parts(F.col("text"))).alias("n", "part"))
    met = parts.withColumn("line", F.col("n") + 1).join(lines, ["path", "line"], "left")
    after = lambda i: F.when(i == 0, 1).otherwise(-F.get("edits", i - 1)["last"])
    kept = F.transform("edits", lambda e, i: F.concat(F.substr("part", after(i), e["start"] - after(i)), e["replacement"]))
    rest = F.substr("part", -F.element_at("edits", -1)["last"])
    whole = met.select("path", "n", F.when(F.col("edits").isNull(), F.col("part")).otherwise(F.concat(F.array_join(kept, ""), rest)).alias("part"))
    return whole.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("text"))


def shapes(texts: DataFrame) -> DataFrame:
    """path, line, kind and depth of all blocks at each of their lines: what an edit must not change."""
    reader = F.when(layers.reader_of(F.col("path")).isin(list(LANGUAGES)), "plain").otherwise("markdown")
    blocks = tree.blocks(texts.select("path", reader.alias("reader"), "text"), ["path"])
    at = F.array_union(F.array("first_line"), F.col("pieces.line"))
    return blocks.select("path", F.explode(at).alias("line"), "kind", "depth")


def fix(texts: DataFrame, propose: Callable[[DataFrame], DataFrame], held: DataFrame | None = None, most: int = 16) -> tuple[DataFrame, DataFrame, list[int]]:
    """(path, text) texts to path, text, fixed (whether it changed), the lines that are held (path, line), and how many texts each round read.

    held: lines that no edit may touch, such as those that an exemption quotes. Raises if texts still
    change after so many rounds.
    """
    first = stored(texts.select("path", "text"), "texts")
    held = stored((held.select("path", "line") if held is not None else first.select("path", F.lit(0).alias("line")).limit(0)).distinct(), "held")
    now, settled, reads = first, None, []
    for _ in range(most):
        reads.append(now.count())
        if not reads[-1]:
            break
        lines = stored(by_line(propose(now).join(held, ["path", "line"], "left_anti")), "edits")
        quiet = now.join(lines.select("path").distinct(), "path", "left_anti")
        settled = quiet if settled is None else settled.unionByName(quiet)
        after = stored(applied(now, lines), "applied")
        before = now.join(after.select("path"), "path", "left_semi")
        a, b = shapes(before).distinct(), shapes(after).distinct()
        changed = stored(a.exceptAll(b).unionByName(b.exceptAll(a)).select("path", "line").distinct(), "changed")
        touched = lines.select("path", "line")
        own = changed.join(touched, ["path", "line"], "left_semi")
        # Where no edited line is itself another kind of block, all edited lines of the text are held.
        spread = changed.select("path").distinct().join(own.select("path").distinct(), "path", "left_anti")
        held = stored(held.unionByName(own).unionByName(touched.join(spread, "path", "left_semi")).distinct(), "held")
        undone = changed.select("path").distinct()
        now = stored(after.join(undone, "path", "left_anti").unionByName(before.join(undone, "path", "left_semi")), "texts")
    else:
        if now.count():
            raise ValueError(f"texts still change after {most} rounds")
    settled = stored(settled if settled is not None else first, "fixed")
    found = settled.join(first.withColumnRenamed("text", "_before"), "path").select("path", "text", (F.col("text") != F.col("_before")).alias("fixed"))
    return found, held, reads


def retained(findings: DataFrame, before: DataFrame, after: DataFrame, instead: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings (path, lint, line, column and more, of the texts before) that a fix left: those on a whole document, and those at whose place no edit was made.

    A place is edited where a proposed edit of the text before lies within it and its line isn't the same after.
    """
    lines = lambda texts, name: texts.select("path", F.posexplode(maps.line_parts(F.col("text"))).alias("line", name)).withColumn("line", F.col("line") + 1)
    changed = lines(before, "a").join(lines(after, "b"), ["path", "line"]).where("a <> b").select("path", "line")
    edits = instead(before).join(changed, ["path", "line"], "left_semi").select("path", "line", F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col("column") <= F.col("_start")) & (F.col("_end") <= F.col("end_column"))
    placed = findings.join(edits.withColumnRenamed("path", "_path").withColumnRenamed("line", "_line"), (F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line")) & inside, "left_anti")
    return placed
