"""Column functions on texts and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token with the white space before it: a code span, a bare URL, a word or number with inner
#: apostrophes and full stops, or any other visible character.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
PIECE = r"\s*(?:`+[^`]+`+|https?://[^\s<]*[^\s<.,;:!?)\]]|" + WORD + r"|[^\s])"

#: ASCII punctuation that counts as a symbol.
SYMBOLS = ["$", "+", "<", "=", ">", "^", "~", "`", "|"]
#: Marks that end a sentence, and marks that close around its end.
TERMINALS = [".", "!", "?", "…"]
CLOSERS = [")", "]", '"', "'", "’", "”", "»"]
#: Frequent English words for the language guess.
ENGLISH = (
    "the of and to in is that it for on with as are this be by or from an at not you can if we "
    "use your will which have has was but all when one more also these there their they it's "
    "should must how what each other into than then only any may so do does make"
).split()


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case, curly apostrophes straight."""
    return F.lower(F.replace(text, F.lit("’"), F.lit("'")))


def token_kind(text: Column) -> Column:
    return (
        F.when(text.rlike("^`.*`$") & (F.char_length(text) > 1), "Code")
        .when(text.rlike("^https?://"), "Url")
        .when(text.rlike(r"\p{L}"), "Word")
        .when(text.rlike(r"\p{N}"), "Number")
        .when(text.isin(SYMBOLS), "Symbol")
        .when(text.rlike(r"^[\p{P}_]+$"), "Punctuation")
        .otherwise("Symbol")
    )


def code_point_label(char: Column) -> Column:
    """U+2014 for an em dash."""
    return F.format_string("U+%04X", F.ascii(char))


def quote(text: Column, width: int = 60) -> Column:
    """White space collapsed, and a long text cut short."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > width, F.concat(F.rtrim(F.left(flat, F.lit(width - 3))), F.lit("..."))).otherwise(flat)


def quarter_of(day: Column) -> Column:
    """2026Q3 from an ISO date."""
    return F.concat(F.left(day, F.lit(4)), F.lit("Q"), F.ceil(F.substring(day, 6, 2).cast("int") / 3).cast("string"))


def script_counts(text: Column) -> dict[str, Column]:
    letters = {"letters": r"\p{L}", "latin": r"\p{Latin}", "greek": r"\p{Greek}", "cyrillic": r"\p{Cyrillic}", "han": r"\p{Han}"}
    java = {name: p.replace("Latin", "IsLatin").replace("Greek", "IsGreek").replace("Cyrillic", "IsCyrillic").replace("Han", "IsHan") for name, p in letters.items()}
    return {name: F.regexp_count(text, F.lit(p)) for name, p in java.items()}


def language_guess(text: Column) -> Column:
    """en, other, or null where there are few letters: Latin script and enough frequent English words."""
    counts = script_counts(text)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}']+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(ENGLISH)))
    english = (counts["latin"] > 0.8 * counts["letters"]) & (hits > 0.12 * F.size(words))
    return F.when(counts["letters"] < 40, None).when(english, "en").otherwise("other")


def content_facts(text: Column) -> dict[str, Column]:
    return {
        "bytes": F.octet_length(text).cast("long"),
        "bom": F.startswith(text, F.lit("﻿")),
        "line_endings": F.when(F.contains(text, F.lit("\r\n")), "crlf").when(F.contains(text, F.lit("\r")), "cr").when(F.contains(text, F.lit("\n")), "lf").otherwise("none"),
        "lines": (F.size(F.split(text, "\n")) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long"),
        "words": F.regexp_count(text, F.lit(r"[^\s]+")).cast("long"),
        "frontmatter": text.rlike(r"^\x{FEFF}?(---|\+\+\+)[ \t]*\r?\n"),
    }


def filled(message: str, values: dict[str, Column]) -> Column:
    """A message with its {name} placeholders replaced."""
    out = F.lit(message)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def line_list(lines: Column) -> Column:
    """line 3, or lines 3, 5: distinct and in order."""
    found = F.array_sort(F.array_distinct(lines))
    return F.concat(F.when(F.size(found) == 1, "line ").otherwise("lines "), F.array_join(F.transform(found, lambda n: n.cast("string")), ", "))
