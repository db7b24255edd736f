"""Source maps: tables of segments that say where a text lies in the text it was made from.

A segment is a row: its keys, start and length in the inner text, outer_start and outer_length in the
outer text, and kind. A verbatim one ("V") has the same characters outside; an escaped one ("E") is
written some other way there, as an entity is; a synthetic one ("S") isn't written at all and stands at
a point. The segments of a text tile it, in the same order inside and outside. Offsets count code points.

Places are mapped, and maps are composed, by sweeps: what asks and what answers are rows of one table,
and a window over each text carries the last answer forward. So the cost is that of a sort, however
many segments a text has, and no place meets every segment of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = ["start", "length", "outer_start", "outer_length", "kind"]


def _segment() -> Column:
    return F.struct(*SEGMENT)


def as_of(points: DataFrame, at: str, segments: DataFrame, keys: list[str], name: str, value: Column | None = None) -> DataFrame:
    """Points with, as a struct of that name, the last segment of their keys that starts at or before them."""
    row = F.struct(*(F.col(c) for c in points.columns)).alias("_row")
    asked = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_asks"), row)
    held = segments.select(*keys, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_asks"), (value if value is not None else _segment()).alias("_held"))
    order = Window.partitionBy(*keys).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(held, allowMissingColumns=True).withColumn(name, F.last("_held", ignorenulls=True).over(order))
    return both.where("_asks = 1").select("_row.*", name)


def to_outer(spans: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start, end) with outer_start, outer_end and editable.

    Within one verbatim segment the answer is exact, and editable. A span that begins or ends in another
    kind takes all of that segment; one across segments takes all from the first to the last. An empty
    span is the point of its start.
    """
    first = as_of(spans, "start", segments, keys, "_first")
    ends = first.withColumn("_final", F.greatest(F.col("end") - 1, F.col("start")))
    both = as_of(ends, "_final", segments, keys, "_last")
    a, b, empty = F.col("_first"), F.col("_last"), F.col("end") <= F.col("start")
    begin = F.when(a["kind"] == "V", a["outer_start"] + F.col("start") - a["start"]).when(F.col("start") >= a["start"] + a["length"], a["outer_start"] + a["outer_length"]).otherwise(a["outer_start"])
    end = F.when(empty, begin).when(b["kind"] == "V", b["outer_start"] + F.col("end") - b["start"]).otherwise(b["outer_start"] + b["outer_length"])
    found = both.withColumns({"outer_start": begin, "outer_end": end, "editable": (a["kind"] == "V") & (a["start"] == b["start"])})
    return found.drop("_first", "_last", "_final")


def joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (keys, start and the rest of a segment) as segments: verbatim ones that go on become one, and so do those that share outer text, as one escaped segment."""
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.lag(_segment()).over(order)
    kind, outer = F.col("kind"), F.col("outer_start")
    until = F.max(F.col("outer_start") + F.col("outer_length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = (kind == "V") & (before["kind"] == "V") & (before["outer_start"] + before["outer_length"] == outer)
    overlaps = (until > outer) | ((kind == "E") & (before["kind"] == "E") & (before["outer_start"] == outer))
    begins = ~F.coalesce(goes_on | overlaps, F.lit(False))
    marked = pieces.withColumns({"_overlaps": F.coalesce(overlaps, F.lit(False)), "_group": F.sum(begins.cast("int")).over(order)})
    ends = F.max(F.col("outer_start") + F.col("outer_length"))
    merged = F.when(F.count("*") == 1, F.first("kind")).when(F.max("_overlaps"), "E").otherwise(F.first("kind"))
    grouped = marked.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min("outer_start").alias("outer_start"), ends.alias("_end"), merged.alias("kind"))
    return grouped.select(*keys, "start", "length", "outer_start", (F.col("_end") - F.col("outer_start")).alias("outer_length"), "kind")


def compose(inner: DataFrame, outer: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """The map from inner's inner text to outer's outer text.

    outer has the keys; inner has the keys and more, which tell apart texts that were taken from
    different stretches of one middle text. Verbatim segments are cut at the borders of outer's.
    """
    whole = [*keys, *more]
    verbatim = inner.where("kind = 'V'")
    # A sweep over the middle text: every segment of either map begins a piece of what lies over what.
    own = F.struct(*(F.col(c) for c in more), F.col("start"), F.col("outer_start"), F.col("outer_length"))
    cuts = verbatim.select(*keys, F.col("outer_start").cast("long").alias("at"), F.lit(1).alias("_order"), own.alias("_inner"))
    borders = outer.select(*keys, F.col("start").cast("long").alias("at"), F.lit(0).alias("_order"), _segment().alias("_outer"))
    order = Window.partitionBy(*keys).orderBy("at", "_order")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = cuts.unionByName(borders, allowMissingColumns=True).withColumns({"_inner": F.last("_inner", ignorenulls=True).over(upto), "_outer": F.last("_outer", ignorenulls=True).over(upto), "_next": F.lead("at").over(order)})
    i, o = F.col("_inner"), F.col("_outer")
    swept = swept.withColumn("to", F.least(F.coalesce("_next", F.lit(1 << 62)), i["outer_start"] + i["outer_length"], o["start"] + o["length"])).where((F.col("to") > F.col("at")) & i.isNotNull() & o.isNotNull())
    exact = o["kind"] == "V"
    pieces = swept.select(
        *keys,
        *(i[c].alias(c) for c in more),
        (i["start"] + F.col("at") - i["outer_start"]).alias("start"),
        (F.col("to") - F.col("at")).alias("length"),
        F.when(exact, o["outer_start"] + F.col("at") - o["start"]).otherwise(o["outer_start"]).alias("outer_start"),
        F.when(exact, F.col("to") - F.col("at")).otherwise(o["outer_length"]).alias("outer_length"),
        o["kind"].alias("kind"),
    )
    # The others are places of the middle text; a point inside of an escaped segment is that segment.
    rest = inner.where("kind <> 'V'").select(*whole, F.col("start").alias("_start"), "length", F.col("outer_start").alias("start"), (F.col("outer_start") + F.col("outer_length")).alias("end"))
    placed = as_of(to_outer(rest, outer, keys), "start", outer, keys, "_at")
    at = F.col("_at")
    held = (F.col("end") == F.col("start")) & (at["kind"] == "E") & (at["start"] < F.col("start")) & (F.col("start") < at["start"] + at["length"])
    begin = F.when(held, at["outer_start"]).otherwise(F.col("outer_start"))
    size = F.when(held, at["outer_length"]).otherwise(F.col("outer_end") - F.col("outer_start"))
    others = placed.select(*whole, F.col("_start").alias("start"), "length", begin.alias("outer_start"), size.alias("outer_length"), F.when(size > 0, "E").otherwise("S").alias("kind"))
    return joined(pieces.unionByName(others), whole)


def line_parts(text: Column) -> Column:
    """The lines of a text, each with its end; the last is what follows the last end, and may be empty."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\r|\n|\z)"), F.lit(0))
    # The pattern matches once more, and nothing, after a last line that isn't empty.
    more = (F.size(parts) > 1) & ~F.get(parts, F.size(parts) - 2).rlike(r"[\r\n]\z")
    return F.when(more, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_starts(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1) and start of each line; LF, CRLF and lone CR end lines, and a byte order mark belongs to no column."""
    bare = F.regexp_replace("text", r"^\x{FEFF}", "")
    first = (F.char_length("text") - F.char_length(bare)).cast("long")
    rows = docs.select("doc_id", first.alias("first"), F.posexplode(line_parts(bare)).alias("n", "part"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", (F.col("n") + 1).alias("line"), (F.col("first") + F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0))).alias("start"))


def with_lines(places: DataFrame, lines: DataFrame, key: list[str], ends: dict[str, tuple[str, str]]) -> DataFrame:
    """Places (doc_id and offsets; the key tells them apart) with the line that each offset lies on and its column there, both from 1.

    ends: for the name of each offset, the names of its line and column.
    """
    points = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("long").alias("at")) for name in ends)))
    asked = places.select("doc_id", *[c for c in key if c != "doc_id"], points.alias("p")).select("doc_id", *[c for c in key if c != "doc_id"], "p.*")
    found = as_of(asked, "at", lines, ["doc_id"], "_line", F.struct("line", "start"))
    at = lambda name, value: F.max(F.when(F.col("name") == name, value)).cast("int")
    columns = [c for name, (line, column) in ends.items() for c in (at(name, F.col("_line.line")).alias(line), at(name, F.col("at") - F.col("_line.start") + 1).alias(column))]
    return places.join(found.groupBy(*key).agg(*columns), key)
