"""The guide's tag codes (N.s, V.pp, PR) and a treebank's UPOS and FEATS, each read from the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases and what they are in a treebank, verb forms, and the words that coordinate.
BASES = {
    "N": "NOUN", "PN": "PROPN", "V": "VERB", "AX": "AUX", "J": "ADJ", "R": "ADV", "PR": "PRON", "D": "DET", "P": "ADP", "C": "SCONJ", "T": "PART",
    "NM": "NUM", "I": "INTJ", "X": "X",
}
NUMBERS = {"s": "Number=Sing", "p": "Number=Plur"}
FORMS = {"pr": "Tense=Pres|VerbForm=Fin", "pa": "Tense=Past|VerbForm=Fin", "fi": "VerbForm=Fin", "in": "VerbForm=Inf", "ing": "VerbForm=Ger", "pp": "Tense=Past|VerbForm=Part"}
COORDINATORS = "and or but nor yet plus both either neither".split()
NUMBERED, INFLECTED = ["N", "PN", "PR"], ["V", "AX"]
OTHER_UPOS = {"CCONJ": "C", "PUNCT": "X", "SYM": "X"}
# End of the fixed values.


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def problem(code: Column) -> Column:
    """What is wrong with a code, null where nothing is: nouns need a number, verbs a form, pronouns may have a number, the rest has neither."""
    base, feature = F.substring_index(code, ".", 1), F.when(F.contains(code, F.lit(".")), F.regexp_replace(code, r"^[^.]*\.", ""))
    return (
        F.when(~base.isin(list(BASES)), "no code")
        .when(feature.isNull() & base.isin("N", "PN"), "needs a number")
        .when(feature.isNull() & base.isin(INFLECTED), "needs a form")
        .when(feature.isNull(), None)
        .when(base.isin(NUMBERED), F.when(~feature.isin(list(NUMBERS)), "no number"))
        .when(base.isin(INFLECTED), F.when(~feature.isin(list(FORMS)), "no form"))
        .otherwise("takes no feature")
    )


def to_treebank(code: Column, form: Column) -> Column:
    """A struct of upos and feats (an underscore for none) of a word tagged with a sound code; null for any other."""
    base, feature = F.substring_index(code, ".", 1), F.regexp_extract(code, r"\.(.*)$", 1)
    upos = F.when((base == "C") & F.lower(form).isin(COORDINATORS), "CCONJ").otherwise(_map(BASES)[base])
    feats = F.when(base.isin(NUMBERED), _map(NUMBERS)[feature]).when(base.isin(INFLECTED), _map(FORMS)[feature])
    return F.when(code.isNotNull() & problem(code).isNull(), F.struct(upos.alias("upos"), F.coalesce(feats, F.lit("_")).alias("feats")))


def from_treebank(upos: Column, feats: Column) -> Column:
    """The code of UPOS and FEATS; a feature that isn't told is left out. Null for what is no UPOS."""
    bases = {tag: code for code, tag in BASES.items()} | OTHER_UPOS
    base = _map(bases)[upos]
    pairs = F.split(feats, r"\|")
    has = lambda key, value: F.exists(pairs, lambda p: (F.substring_index(p, "=", 1) == key) & F.array_contains(F.split(F.regexp_replace(p, "^[^=]*=", ""), ","), value))
    number = F.when(has("Number", "Sing"), ".s").when(has("Number", "Plur"), ".p")
    tense = F.when(has("Tense", "Pres"), ".pr").when(has("Tense", "Past"), ".pa")
    untold = ~F.exists(pairs, lambda p: F.substring_index(p, "=", 1) == "VerbForm")
    form = F.when(has("VerbForm", "Fin"), F.coalesce(tense, F.lit(".fi"))).when(has("VerbForm", "Inf"), ".in").when(has("VerbForm", "Ger"), ".ing")
    form = form.when(has("VerbForm", "Part"), F.when(has("Tense", "Pres"), ".ing").otherwise(".pp")).when(untold, tense)
    feature = F.when(base.isin(NUMBERED), number).when(base.isin(INFLECTED), form)
    return F.concat(base, F.coalesce(feature, F.lit("")))
