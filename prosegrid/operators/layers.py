"""Files as layers of texts: code in fences, Markdown in comments, comments in that code, and so on.

A unit is a text with a reader. Each round reads all units of one depth: Markdown into its tree, code
into the regions of its comments, plain text into paragraphs. A block that has a reader itself, a fence
of a language that is read, or a comment, is a unit of the next round; every other leaf is prose or code.
Each round's source maps are composed with those of the units that it read, so whatever the depth, one
map leads from a block's text to the file. Rounds end when no block has a reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.operators import maps, regions, tree
from prosegrid.sources.tables import stored

#: What reads a file, by its last suffix.
READERS = {"md": "markdown", "markdown": "markdown", "rs": "rust", "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "toml": "toml", "txt": "plain"}
#: The first word of a fence's info string, and what reads the fence.
FENCES = {"rust": "rust", "rs": "rust", "c": "cpp", "cpp": "cpp", "c++": "cpp", "toml": "toml"}
KEYS = ["doc_id", "unit"]
BLOCK = ["doc_id", "unit", "block_id", "layer", "kind", "level", "task", "info", "heading", "first_line", "last_line", "text"]


def _chosen(value: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, reader in table.items():
        found = F.when(value == name, reader).otherwise(found)
    return found


def reader_of(path: Column) -> Column:
    """The reader of a path, by its last suffix; null for a file that isn't read."""
    return _chosen(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), READERS)


PART = [*KEYS, "n", "kind", "level", "task", "info", "heading", "pieces", "text"]


def _tree_round(units: DataFrame) -> DataFrame:
    found = tree.blocks(units, KEYS).where("kind not in ('Item', 'Quote')")
    kind = F.when((F.col("kind") == "Paragraph") & F.col("within").isNotNull(), F.col("within")).otherwise(F.col("kind"))
    return found.withColumns({"kind": kind, "n": F.col("pre"), "pieces": F.expr("transform(pieces, p -> struct(p.at, p.text))")}).select(PART)


def _code_round(units: DataFrame) -> DataFrame:
    found = regions.regions(units.select(*KEYS, F.col("reader").alias("language"), "text"), KEYS).join(units.select(*KEYS, "reader"), KEYS)
    # Markdown in doc comments is a convention of Rust.
    kind = F.when(F.col("doc") & (F.col("reader") == "rust"), "DocComment").otherwise("Comment")
    nothing = {name: F.lit(None).cast(t) for name, t in (("level", "int"), ("task", "boolean"), ("info", "string"), ("heading", "string"))}
    return found.withColumns({"kind": kind, "n": F.col("region"), **nothing}).select(PART)


def read(files: DataFrame, readers: dict[str, str] | None = None, fences: dict[str, str] | None = None, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, reader) files, the reader by the path where there is no such column, to blocks and their source map.

    blocks: BLOCK, where unit says what the block lies in, block_id is unique within its document, and
    lines are the file's. The map's keys are doc_id and block_id. fences: which info words are read.
    most bounds the depth: what lies deeper stays code or a comment's text.
    """
    fences = FENCES if fences is None else fences
    reader = F.col("reader") if "reader" in files.columns else reader_of(F.col("doc_id").cast("string")) if readers is None else _chosen(F.lower(F.regexp_extract(F.col("doc_id").cast("string"), r"\.([^./]+)$", 1)), readers)
    units = files.select("doc_id", F.lit("").alias("unit"), reader.alias("reader"), "text").where("reader is not null and text <> ''").repartition("doc_id")
    blocks = segments = None
    for layer in range(most + 1):
        # At most as many as there are readers.
        present = {r.reader for r in units.select("reader").distinct().collect()}
        rounds = [f(units.where(F.col("reader").isin(names))) for f, names in ((_tree_round, list(tree.READERS)), (_code_round, list(regions.LANGUAGES))) if present & set(names)]
        if not rounds:
            break
        parts = rounds[0] if len(rounds) == 1 else rounds[0].unionByName(rounds[1])
        info = F.lower(F.regexp_extract("info", r"^([^\s,{]*)", 1))
        inner = F.when(F.col("kind") == "DocComment", "markdown").when(F.col("kind") == "Comment", "plain").when(F.col("kind") == "Code", _chosen(info, fences))
        own = F.concat_ws("/", "unit", F.format_string("%08d", "n"))
        found = stored(parts.select(*KEYS, own.alias("block_id"), F.lit(layer).alias("layer"), inner.alias("reader"), *[c for c in PART if c not in (*KEYS, "n")]), "layer")
        # Places of this round's blocks in their units, then in the file; a file is its own unit.
        within = tree.pieces_map(found, [*KEYS, "block_id"])
        composed = stored(maps.compose(within, map_, KEYS, ["block_id"]) if layer else within, "map")
        # Where a unit's text is read, its own block is none of the result.
        leaf = F.col("reader").isNull() | F.lit(layer == most)
        blocks = found.where(leaf) if blocks is None else blocks.unionByName(found.where(leaf))
        segments = composed if segments is None else segments.unionByName(composed)
        units = found.where(~leaf).select("doc_id", F.col("block_id").alias("unit"), "reader", "text")
        map_ = composed.select("doc_id", F.col("block_id").alias("unit"), *maps.SEGMENT)
    if blocks is None:
        nothing = files.sparkSession.createDataFrame([], "unit string, block_id string, layer int, kind string, level int, task boolean, info string, heading string, first_line int, last_line int, text string")
        bare = nothing.join(files.select("doc_id").limit(0))
        return bare.select(BLOCK), bare.select("doc_id", "block_id", *(F.lit(None).cast(t).alias(c) for c, t in zip(maps.SEGMENT, ("long", "long", "long", "long", "string"))))
    segments = segments.select("doc_id", "block_id", *maps.SEGMENT)
    return with_file_lines(blocks, segments, files.select("doc_id", "text")), segments


def with_file_lines(blocks: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks with the file's first and last line of their text; blocks without any text have neither."""
    key = ["doc_id", "block_id"]
    ends = F.max(F.col("outer_start") + F.greatest(F.col("outer_length") - 1, F.lit(0)))
    spans = segments.groupBy(key).agg(F.min("outer_start").alias("_from"), ends.alias("_to"))
    lines = maps.with_lines(spans, maps.line_starts(files), key, {"_from": ("first_line", "_a"), "_to": ("last_line", "_b")})
    return blocks.join(lines.select(*key, "first_line", "last_line"), key, "left").select(BLOCK)


def file_places(places: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """Places (doc_id, block_id, start, end in the block's text) with line, column, end_line, end_column of the file, and editable."""
    key = ["doc_id", "block_id", "start", "end"]
    outer = maps.to_outer(places.select(key).distinct(), segments, ["doc_id", "block_id"])
    lines = maps.line_starts(files.join(places.select("doc_id").distinct(), "doc_id", "left_semi"))
    return places.join(maps.with_lines(outer, lines, key, {"outer_start": ("line", "column"), "outer_end": ("end_line", "end_column")}), key)
