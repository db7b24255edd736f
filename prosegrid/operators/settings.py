"""Settings by path: sections, overrides, exemptions, and narrowing to a change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.functions import globs


@dataclass
class Section:
    """Globs that select paths, globs that exclude them, base settings, and overrides: (glob, settings)."""

    name: str
    include: list[str]
    exclude: list[str] = field(default_factory=list)
    settings: dict[str, int | float | str] = field(default_factory=dict)
    overrides: list[tuple[str, dict]] = field(default_factory=list)


def sections_of(paths: DataFrame, sections: list[Section]) -> DataFrame:
    """path and section; a path that two sections select raises."""
    hits = F.array_compact(F.array(*(F.when(globs.selected(F.col("path"), s.include, s.exclude), F.lit(s.name)) for s in sections)))
    found = paths.select("path", hits.alias("_hits")).where(F.size("_hits") > 0)
    twice = F.when(F.size("_hits") > 1, F.raise_error(F.concat(F.col("path"), F.lit(" is in sections "), F.array_join("_hits", ", "))))
    return found.select("path", F.coalesce(twice.cast("string"), F.get("_hits", F.lit(0))).alias("section"))


def resolved(paths: DataFrame, section: Section) -> DataFrame:
    """path and each setting: overrides that match are laid over the base from the least to the most specific, later ones over earlier."""
    names = sorted({*section.settings, *(k for _, s in section.overrides for k in s)})
    order = sorted(range(len(section.overrides)), key=lambda i: (*globs.specificity(section.overrides[i][0]), i), reverse=True)
    columns = []
    for name in names:
        layers = [F.when(globs.matches(F.col("path"), section.overrides[i][0]), F.lit(section.overrides[i][1][name])) for i in order if name in section.overrides[i][1]]
        columns.append(F.coalesce(*layers, F.lit(section.settings.get(name))).alias(name))
    return paths.select("path", *columns)


def settled(allowed: DataFrame, sentences: DataFrame, findings: DataFrame, paths: DataFrame, unit: str = "sentence") -> DataFrame:
    """Each exemption with one status, in the order of the settings.

    allowed: entry, path, lint, quote. sentences: path, sent_id, text. findings: path, lint, sent_id.
    Quotes and sentences agree if they are equal but for case and white space, and only one
    sentence of the file may. unit names what the quotes quote, sentences or lines.
    """
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    entries = allowed.withColumn("_folded", folded("quote"))
    there = sentences.select("path", "sent_id", folded("text").alias("_folded"))
    matched = entries.join(there, ["path", "_folded"], "left").groupBy("entry").agg(F.count("sent_id").alias("_sentences"), F.min("sent_id").alias("sent_id"))
    known = entries.join(matched, "entry").join(paths.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    hit = findings.select("path", "lint", "sent_id", F.lit(True).alias("_found")).distinct()
    known = known.join(hit, ["path", "lint", "sent_id"], "left")
    status = (
        F.when(F.col("_there").isNull(), "no such file")
        .when(F.col("_sentences") == 0, f"no such {unit}")
        .when(F.col("_sentences") > 1, f"two {unit}s")
        .when(F.col("_found").isNull(), "no finding")
        .otherwise("applied")
    )
    return known.select("entry", "path", "lint", "sent_id", status.alias("status"))


def kept(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Findings that no applied exemption drops."""
    return findings.join(statuses.where("status = 'applied'").select("path", "lint", "sent_id"), ["path", "lint", "sent_id"], "left_anti")


def within_change(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings (path, first_line, last_line) that touch added lines; an empty added range touches the lines on both its sides.

    hunks: path, added_start, added_end (exclusive).
    """
    low = F.when(F.col("added_start") == F.col("added_end"), F.col("added_start") - 1).otherwise(F.col("added_start"))
    high = F.when(F.col("added_start") == F.col("added_end"), F.col("added_start")).otherwise(F.col("added_end") - 1)
    ranges = hunks.select(F.col("path").alias("_path"), low.alias("_low"), high.alias("_high"))
    return findings.join(ranges, (F.col("path") == F.col("_path")) & (F.col("first_line") <= F.col("_high")) & (F.col("last_line") >= F.col("_low")), "left_semi")


def overlap_groups(spans: DataFrame, key: str) -> DataFrame:
    """Adds group: spans (start, end) of a key that chain by overlap are one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", F.when(reach > F.col("start"), 0).otherwise(1)).withColumn("group", F.sum("_new").over(order)).drop("_new")


def explained(paths: DataFrame, section: Section) -> DataFrame:
    """path, setting, value, source: every setting of a path and the glob it comes from, base where no override sets it."""
    names = sorted({*section.settings, *(k for _, s in section.overrides for k in s)})
    order = sorted(range(len(section.overrides)), key=lambda i: (*globs.specificity(section.overrides[i][0]), i), reverse=True)
    rows = []
    for name in names:
        layers = [(glob, settings[name]) for glob, settings in (section.overrides[i] for i in order) if name in settings]
        found = [F.when(globs.matches(F.col("path"), glob), F.struct(F.lit(str(value)).alias("value"), F.lit(glob).alias("source"))) for glob, value in layers]
        base = F.struct(F.lit(None if section.settings.get(name) is None else str(section.settings[name])).alias("value"), F.lit("base").alias("source"))
        rows.append(F.struct(F.lit(name).alias("setting"), F.coalesce(*found, base).alias("_")))
    told = paths.select("path", F.explode(F.array(*rows)).alias("row"))
    return told.select("path", "row.setting", "row._.value", "row._.source")


def choice(path: Column, globs_: list[str], excludes: list[str]) -> Column:
    """hit, excluded or miss."""
    hit, barred = F.lit(False), F.lit(False)
    for glob in globs_:
        hit = hit | globs.matches(path, glob)
    for glob in excludes:
        barred = barred | globs.matches(path, glob)
    return F.when(~hit, "miss").when(barred, "excluded").otherwise("hit")


def closest(entries: DataFrame, sentences: DataFrame, most: int = 3, width: int = 60) -> DataFrame:
    """entry, rank, sent_id, distance: the nearest sentences of an entry's own file, by the edits between their first characters.

    entries: entry, path, quote. sentences: path, sent_id, text.
    """
    start = lambda c: F.left(F.col(c), F.lit(width))
    near = entries.join(sentences, "path").select("entry", "sent_id", F.levenshtein(start("quote"), start("text")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("entry").orderBy("distance", "sent_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("entry", "rank", "sent_id", "distance")


def release(version: Column) -> Column:
    """A struct that orders releases: 0.10.1 after 0.9."""
    parts = F.split(version, r"\.")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))


def news(rows: DataFrame, stamp: str, running: str) -> DataFrame:
    """Rows (since) that are newer than the stamp and not newer than what runs."""
    since = release(F.col("since"))
    return rows.where((since > release(F.lit(stamp))) & (since <= release(F.lit(running))))


def reader(path: Column, rules: list[tuple[str, str]], default: str = "none") -> Column:
    """The reader that the first fitting rule (reader, regular expression) of an ordered list names."""
    return F.coalesce(*(F.when(path.rlike(pattern), name) for name, pattern in rules), F.lit(default))
