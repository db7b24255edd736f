"""From documents to findings: read blocks once, run the lints by their settings, drop what is allowed, narrow to a change."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions import text as T
from prosegrid.operators import chars, layers, lints, markdown, tagger
from prosegrid.operators import settings as S
from prosegrid.sources.tables import stored

PROSE = ["Paragraph", "Item", "Quote", "Heading", "Table"]
#: All lints, in the order in which a report lists them.
ORDER = ["max_size_bytes", "max_emphasis", "repo_layout", "banned_chars", "banned_phrases", "density", *("verbs_no_nouns", "not_at_all", "verbs_nothing", "possessive_own", "denial_tail")]
PLACE = ["path", "lint", "line", "end_line", "column", "end_column", "quote"]


@dataclass
class Settings:
    """What each lint may find too much of; a lint whose setting is None or empty is off, the sentence lints are on unless named in off."""

    max_size_bytes: int | None = None
    #: Spans of emphasis that are free, and the greatest share of the text, in percent, that more of them may take.
    max_emphasis: tuple[int, float] | None = None
    #: The heading of the layout index.
    repo_layout: str | None = None
    char_groups: list[str] = field(default_factory=list)
    allowed_chars: list[str] = field(default_factory=list)
    banned_chars: dict[str, str] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)
    allowed_phrases: list[str] = field(default_factory=list)
    density: bool = False
    off: list[str] = field(default_factory=list)

    def lints(self) -> list[str]:
        configured = {
            "max_size_bytes": self.max_size_bytes is not None, "max_emphasis": self.max_emphasis is not None, "repo_layout": self.repo_layout is not None,
            "banned_chars": bool(self.char_groups or self.banned_chars), "banned_phrases": bool(self.phrases), "density": self.density,
        }
        return [name for name in ORDER if configured.get(name, True) and name not in self.off]


def ordered(findings: DataFrame) -> DataFrame:
    """Findings as a report lists them: by path, then in the order of the lints, then by place."""
    rank = F.coalesce(*(F.when(F.col("lint") == name, n) for n, name in enumerate(ORDER)), F.lit(len(ORDER)))
    return findings.orderBy("path", rank, F.asc_nulls_first("line"), F.asc_nulls_first("column"))


def _whole(found: DataFrame, lint: str, quote: Column, line: Column | None = None) -> DataFrame:
    """Findings that have no columns, and perhaps no line."""
    line = (line if line is not None else F.lit(None)).cast("int")
    nothing = F.lit(None).cast("int")
    return found.select(F.col("doc_id").alias("path"), F.lit(lint).alias("lint"), line.alias("line"), line.alias("end_line"), nothing.alias("column"), nothing.alias("end_column"), quote.alias("quote"))


def _banned_chars(docs: DataFrame, settings: Settings) -> DataFrame:
    """A finding for each place of a banned character; only lines with characters outside ASCII or banned ones are taken apart."""
    rules = chars.rule_table(docs.sparkSession, settings.char_groups)
    source = markdown.lines(docs).where(F.col("source").rlike(r"[^\x00-\x7F]") | F.exists(F.array(*map(F.lit, [*settings.banned_chars, "\0"])), lambda c: F.contains(F.col("source"), c)))
    places = source.select("doc_id", (F.col("line") + 1).alias("line"), F.posexplode(F.split("source", "")).alias("at", "ch")).where(F.col("ch").rlike(r"[^\x00-\x7F]") | F.col("ch").isin(list(settings.banned_chars)))
    seen = places.select("ch").distinct().withColumn("n", F.lit(1))
    judged = chars.with_group(seen, rules).where(~F.col("ch").isin(settings.allowed_chars) & (F.col("ch").isin(list(settings.banned_chars)) | F.col("char_group").isNotNull())).select("ch")
    found = places.join(judged, "ch", "left_semi")
    return found.select(F.col("doc_id").alias("path"), F.lit("banned_chars").alias("lint"), "line", F.col("line").alias("end_line"), (F.col("at") + 1).alias("column"), (F.col("at") + 2).alias("end_column"), F.col("ch").alias("quote"))


def _tokens(blocks: DataFrame) -> DataFrame:
    """Tokens with sentences; texts are dealt by block before they are taken apart, so a long document is many tasks."""
    return lints.read(blocks.select("doc_id", "block_id", "text").repartition("doc_id", "block_id"))


def sentence_texts(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """path, sent_id (block and sentence) and text of each sentence."""
    spans = tokens.groupBy(*lints.KEY).agg(F.min("start").alias("start"), F.max("end").alias("end")).join(blocks.select("doc_id", "block_id", F.col("text").alias("block_text")), ["doc_id", "block_id"])
    return spans.select(F.col("doc_id").alias("path"), _unit(), F.substring(F.col("block_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def _unit() -> Column:
    return F.concat_ws(":", F.col("block_id").cast("string"), F.col("sent_id").cast("string")).alias("sent_id")


def _spelled(phrases: list[str]) -> str:
    """A pattern that every folded text with one of the phrases matches, whatever white space is between their tokens."""
    parts = [re.findall(r"\w+|[^\w\s]", p.lower().replace("’", "'")) for p in phrases]
    return "|".join(r"\s*".join(re.escape(t) for t in tokens) for tokens in parts)


def _exempt(found: DataFrame, lint: str, exempt: DataFrame, units: DataFrame, paths: DataFrame, unit: str = "sentence") -> DataFrame:
    """Findings (path, sent_id and more) of a lint without those that an entry allows."""
    statuses = S.settled(exempt.where(F.col("lint") == lint), units, found.select("path", F.lit(lint).alias("lint"), "sent_id").distinct(), paths, unit)
    return found.join(statuses.where("status = 'applied'").select("path", "sent_id"), ["path", "sent_id"], "left_anti")


def check_documents(docs: DataFrame, names: list[str] | None = None, hunks: DataFrame | None = None, settings: Settings | None = None, allowed: DataFrame | None = None, files: DataFrame | None = None, blocks: DataFrame | None = None, segments: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """path, lint, line, end_line, column, end_column, quote. docs: path, text.

    Files are read by their suffix, Markdown if it is none that layers reads, and in layers: comments in
    fences, Markdown in comments. Lines and columns are the file's and count from 1, columns in code
    points; findings on a whole document have neither. names: the lints to run, all that the settings
    turn on by default. With hunks (path, added_start, added_end) only findings on touched lines stay.
    allowed (entry, path, lint, quote) exempts sentences, or blocks where the lint is density, or lines
    where it is banned_chars, whose text is the quote but for case and white space. files (path) are
    what a layout may list, docs by default. blocks and segments replace the reading of docs: doc_id,
    block_id, kind, heading, first_line, text, and their source map; without a map, columns are those
    of the block's lines. With a lexicon, as the tagger takes it, the verb lints read parts of speech.
    """
    settings = settings or Settings()
    on = [name for name in names or settings.lints() if name in settings.lints()]
    texts = docs.select(F.col("path").alias("doc_id"), "text")
    paths = docs.select("path")
    if blocks is None:
        read = texts.withColumn("reader", F.coalesce(layers.reader_of(F.col("doc_id").cast("string")), F.lit("markdown")))
        blocks, segments = layers.read(read)
    # Read once: every lint scans this table for the blocks that hold its words.
    blocks = stored(blocks.select("doc_id", "block_id", "kind", "heading", "first_line", "text"), "blocks")
    prose = blocks.where(F.col("kind").isin(PROSE))
    parts: list[DataFrame] = []
    if "max_size_bytes" in on:
        size = F.octet_length("text")
        parts.append(_whole(texts.where(size > settings.max_size_bytes), "max_size_bytes", F.concat(size.cast("string"), F.lit(" bytes"))))
    if "max_emphasis" in on:
        caps = lints.caps_runs(_tokens(prose.where(F.col("text").rlike(lints.NEEDED["caps_runs"])))).withColumnRenamed("letters", "chars")
        marked = markdown.over_emphasised(blocks, caps, *settings.max_emphasis)
        parts.append(_whole(marked, "max_emphasis", F.format_string("%d spans, %.2f %%", "spans", "percent")))
    if "repo_layout" in on:
        known = (files if files is not None else docs).select("path")
        problems = markdown.layout_problems(blocks.withColumn("text_line", F.col("first_line")), known, settings.repo_layout)
        parts.append(_whole(problems, "repo_layout", F.col("problem"), F.col("line")))
    if "banned_chars" in on:
        found = _banned_chars(texts, settings)
        if allowed is not None:
            lines = markdown.lines(texts.join(allowed.where("lint = 'banned_chars'").select(F.col("path").alias("doc_id")).distinct(), "doc_id", "left_semi"))
            units = lines.where("trim(source) <> ''").select(F.col("doc_id").alias("path"), (F.col("line") + 1).alias("sent_id"), F.col("source").alias("text"))
            found = _exempt(found.withColumn("sent_id", F.col("line")), "banned_chars", allowed, units, paths, "line").select(PLACE)
        parts.append(found)

    hits, wanted = None, F.lit(False)
    for name in [n for n in on if n in lints.LINTS or n == "banned_phrases"]:
        if name in lints.LINTS:
            holds = F.col("text").rlike(lints.NEEDED[name])
            tokens = _tokens(prose.where(holds))
            if lexicon is not None and name in lints.TAGGED:
                found = lints.TAGGED[name](tagger.tag(tokens, lexicon))
            else:
                found = lints.LINTS[name](tokens)
        else:
            holds = T.fold(F.col("text")).rlike(_spelled(settings.phrases))
            found = lints.banned_phrases(_tokens(prose.where(holds)), settings.phrases, settings.allowed_phrases)
        wanted = wanted | holds
        found = found.select(*lints.KEY, "pos", "length", F.lit(name).alias("lint"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is not None:
        held = prose.where(wanted)
        if allowed is not None:
            # Only the files that have exemptions are read for their sentences.
            entries = allowed.where(~F.col("lint").isin("density", "banned_chars"))
            sentences = sentence_texts(prose, _tokens(prose.join(entries.select(F.col("path").alias("doc_id")).distinct(), "doc_id", "left_semi")))
            units = hits.select(F.col("doc_id").alias("path"), "lint", _unit()).distinct()
            applied = S.settled(entries, sentences, units, paths).where("status = 'applied'").select(F.col("path").alias("doc_id"), "lint", F.col("sent_id").alias("unit"))
            hits = hits.withColumn("unit", _unit().cast("string")).join(applied, ["doc_id", "lint", "unit"], "left_anti").drop("unit")
        placed = lints.located(held, hits)
        if segments is not None:
            placed = layers.file_places(placed, segments, texts)
        else:
            placed = placed.join(held.select("doc_id", "block_id", "first_line", "text"), ["doc_id", "block_id"])
            upto = lambda c: F.substring(F.col("text"), F.lit(1), F.col(c))
            line = lambda c: F.col("first_line") + F.regexp_count(upto(c), F.lit("\n"))
            column = lambda c: F.char_length(F.substring_index(upto(c), "\n", -1)) + 1
            placed = placed.select("doc_id", "lint", line("start").alias("line"), line("end").alias("end_line"), column("start").alias("column"), column("end").alias("end_column"), "quote")
        parts.append(placed.select(F.col("doc_id").alias("path"), *PLACE[1:]))
    if "density" in on:
        dense = lints.dense_blocks(prose.where(F.col("kind").isin("Paragraph", "Item", "Quote"))).select(F.col("doc_id").alias("path"), F.col("block_id").alias("sent_id"), "chars", "first_line")
        if allowed is not None:
            units = prose.select(F.col("doc_id").alias("path"), F.col("block_id").alias("sent_id"), "text")
            dense = _exempt(dense, "density", allowed, units, paths)
        parts.append(_whole(dense.withColumnRenamed("path", "doc_id"), "density", F.concat(F.col("chars").cast("string"), F.lit(" characters")), F.col("first_line")))

    rows = docs.select("path", *(F.lit(None).cast(t).alias(c) for c, t in zip(PLACE[1:], ("string", "int", "int", "int", "int", "string")))).limit(0)
    for part in parts:
        rows = rows.unionByName(part)
    if hunks is not None:
        touched = S.within_change(rows.withColumns({"first_line": F.coalesce("line", F.lit(1)), "last_line": F.coalesce("end_line", F.lit(1 << 30))}), hunks)
        rows = touched.select(PLACE)
    return rows


def check_sections(docs: DataFrame, sections: list[tuple[S.Section, Settings]], **more) -> DataFrame:
    """The check where each path is checked by its own section's settings, as check_documents' path, lint and places, with section; a path in no section isn't checked."""
    chosen = S.sections_of(docs.select("path"), [s for s, _ in sections])
    found = None
    for section, settings in sections:
        own = docs.join(chosen.where(F.col("section") == section.name).select("path"), "path", "left_semi")
        rows = check_documents(own, settings=settings, files=docs.select("path"), **more).withColumn("section", F.lit(section.name))
        found = rows if found is None else found.unionByName(rows)
    return found
