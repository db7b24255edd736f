"""Part-of-speech readings of words: table look-up, shape guesses, and passes over neighbours.

A reading is the set of tags still possible, the best of them first, and how sure it is: Sure,
Likely, Unsure or Unknown. A pass only takes tags away, never the last. Passes are window steps that
read the sentence as the pass before left it, so a word never sees what its own pass did to its
neighbour. The open-class lexicon is a table of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrid.operators.lints import AUXILIARIES, CONJUNCTIONS, DETERMINERS, PREPOSITIONS
from prosegrid.operators.tokens import in_sentence

# Word sets of the passes, and endings in the order they are tried with the tags they leave possible.
MODALS = "can could will would shall should may might must".split()
SUBJECTS = "i we they he she".split()
POSSESSIVES = "my your his her its our their".split()
OBJECT_WORDS = "this that these those each every all both".split()
ENDINGS = [
    ("ly", ["Adverb", "Adjective"]), ("ing", ["Verb", "Noun", "Adjective"]), ("ed", ["Verb", "Adjective"]), ("ize", ["Verb", "Noun"]), ("ise", ["Verb", "Noun"]),
    ("ify", ["Verb", "Noun"]), ("tion", ["Noun"]), ("sion", ["Noun"]), ("ment", ["Noun", "Verb"]), ("ness", ["Noun"]), ("ity", ["Noun"]), ("ism", ["Noun"]),
    ("ship", ["Noun"]), ("hood", ["Noun"]), ("ous", ["Adjective"]), ("ible", ["Adjective"]), ("able", ["Adjective"]), ("less", ["Adjective"]),
    ("ful", ["Adjective", "Noun"]), ("ive", ["Adjective", "Noun"]), ("al", ["Adjective", "Noun"]),
]
# Cues of the dominant-word pass: the tag, the settled tags before it, the settled tags after it.
PRIOR_CUES = [
    ("Noun", ["Determiner", "Possessive", "Adjective", "Adposition"], ["Verb", "Auxiliary", "Adposition"]),
    ("Verb", ["Adverb", "Verb", "Auxiliary"], ["Determiner", "Pronoun"]),
    ("Adjective", ["Auxiliary"], ["Noun"]),
    ("Adverb", ["Verb", "Auxiliary"], ["Adjective", "Adverb", "Verb", "Auxiliary"]),
]
# Cues of the one-tag pass; "none" stands for no word.
SINGLE_CUES = [
    ("Noun", ["Adjective", "Adposition", "Noun", "Conjunction", "Numeral"], ["Verb", "Auxiliary", "Adposition", "Conjunction", "none"]),
    ("Verb", ["Pronoun"], ["Determiner", "Pronoun"]),
    ("Adjective", ["Auxiliary", "Adverb", "Determiner"], ["Noun"]),
    ("Adverb", ["Verb", "Auxiliary"], ["Adjective", "Adverb", "Verb", "Auxiliary", "none"]),
]
# End of the fixed values.

LEXICON = "folded string, tags array<string>, dominant boolean"


def closed_classes(spark: SparkSession) -> DataFrame:
    """folded, tags: the words of closed classes that the lints' lists already name."""
    tags: dict[str, list[str]] = {}
    for words, tag in ((AUXILIARIES, "Auxiliary"), (DETERMINERS, "Determiner"), (PREPOSITIONS, "Adposition"), (CONJUNCTIONS, "Conjunction"), (SUBJECTS + ["it", "you"], "Pronoun"), (POSSESSIVES, "Possessive")):
        for word in words:
            tags.setdefault(word, []).append(tag)
    for word in ("have", "has", "had", "do", "does", "did"):
        tags[word].append("Verb")
    return spark.createDataFrame([(w, t) for w, t in tags.items()], "folded string, tags array<string>")


def shape(text: Column, folded: Column, pos: Column) -> Column:
    """Tags that a word's look leaves possible, or null."""
    guess = F.when(text.rlike(r"^v?\d+(\.\d+)+$"), F.array(F.lit("Numeral"))).when(text.rlike(r"[a-z0-9][A-Z]|_|\."), F.array(F.lit("ProperNoun"), F.lit("Noun")))
    guess = guess.when(text.rlike(r"^\p{Lu}") & (pos > 0), F.array(F.lit("ProperNoun"), F.lit("Noun")))
    for ending, tags in ENDINGS:
        guess = guess.when(F.endswith(folded, F.lit(ending)) & (F.char_length(folded) > len(ending) + 2), F.array(*map(F.lit, tags)))
    return guess.when(F.endswith(folded, F.lit("s")) & (F.char_length(folded) > 3), F.array(F.lit("Noun"), F.lit("Verb")))


def readings(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds kept (tags, best first), confidence and dominant to words; other tokens have none.

    Both tables are of bounded size, whatever the corpus: a language's words.
    """
    spark = tokens.sparkSession
    closed = closed_classes(spark).withColumnRenamed("tags", "_closed")
    open_ = (lexicon if lexicon is not None else spark.createDataFrame([], LEXICON)).select("folded", F.col("tags").alias("_open"), F.col("dominant").alias("_dominant"))
    rows = tokens.join(F.broadcast(closed), "folded", "left").join(open_, "folded", "left")
    guessed = shape(F.col("text"), F.col("folded"), F.col("pos"))
    kept = F.when(F.col("kind") == "Word", F.coalesce("_closed", "_open", guessed, F.array(F.lit("Noun"), F.lit("Verb"), F.lit("Adjective"))))
    sure = F.when(F.col("_closed").isNotNull(), F.when(F.size("_closed") == 1, "Sure").otherwise("Unsure")).when(F.col("_open").isNotNull(), "Unsure").otherwise("Unknown")
    return rows.withColumns({"kept": kept, "confidence": F.when(F.col("kind") == "Word", sure), "dominant": F.coalesce("_dominant", F.lit(False)), "listed": F.col("_open").isNotNull()}).drop("_closed", "_open", "_dominant")


def settled() -> Column:
    """The one tag that a word can have, none for other tokens, null while several are possible."""
    return F.when(F.col("kept").isNull(), "none").when((F.size("kept") == 1) & F.col("confidence").isin("Sure", "Likely"), F.get("kept", F.lit(0)))


def _narrowed(rows: DataFrame, narrow: Column, tags: Column) -> DataFrame:
    """Keeps only the given tags where that leaves any; one that is left alone is Likely at least."""
    left = F.array_intersect("kept", tags)
    takes = narrow & (F.size(left) > 0) & (F.size(left) < F.size("kept"))
    rows = rows.withColumn("_takes", F.coalesce(takes, F.lit(False)))
    confidence = F.when(F.col("_takes") & (F.size(left) == 1) & (F.col("confidence") != "Sure"), "Likely").otherwise(F.col("confidence"))
    return rows.withColumn("confidence", confidence).withColumn("kept", F.when(F.col("_takes"), left).otherwise(F.col("kept"))).drop("_takes")


def _neighbours(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_settled", settled())
    w = in_sentence()
    return rows.withColumns({"_before": F.coalesce(F.lag("_settled").over(w), F.when(F.lag("pos").over(w).isNull(), "none")), "_after": F.coalesce(F.lead("_settled").over(w), F.when(F.lead("pos").over(w).isNull(), "none")), "_last": F.lag("folded").over(w), "_next": F.lead("folded").over(w)})


def _dropped(rows: DataFrame) -> DataFrame:
    return rows.drop("_settled", "_before", "_after", "_last", "_next")


def code_words(blocks: DataFrame) -> DataFrame:
    """doc_id and text: the runs of two letters, digits or underscores at least that a document writes in code."""
    inline = F.array_join(F.regexp_extract_all("text", F.lit(r"`+[^`]+`+"), F.lit(0)), " ")
    code = F.when(F.col("kind") == "Code", F.col("text")).otherwise(inline)
    return blocks.select("doc_id", F.explode(F.regexp_extract_all(code, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("text")).distinct()


def origins(tokens: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Adds origin to words: Path, Symbol, Flag, or Seen where the document's code has the word (seen: doc_id, text); null for others."""
    before = F.lag("text").over(in_sentence())
    text = F.col("text")
    cue = F.when(text.rlike(r"\.[A-Za-z]\w{0,4}$") & ~text.rlike(r"^\d"), "Path").when(text.rlike(r"[a-z0-9][A-Z]|\w_\w|::"), "Symbol")
    cue = cue.when((before == "-") & ~F.col("spaced"), "Flag")
    known = tokens
    if seen is not None:
        known = tokens.join(seen.select("doc_id", "text", F.lit(True).alias("_seen")), ["doc_id", "text"], "left")
        cue = cue.when(F.col("_seen"), "Seen")
    return known.withColumn("origin", F.when(F.col("kind") == "Word", cue)).drop("_seen")


def proper(rows: DataFrame) -> DataFrame:
    """A capital after a word or comma within a sentence is a name's, unless the sentence is a title: three long words at least, all with capitals."""
    capital = F.col("text").rlike(r"^\p{Lu}\p{Ll}")
    long = (F.col("kind") == "Word") & (F.char_length("text") >= 4)
    sentence = in_sentence().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = (F.count_if(long).over(sentence) >= 3) & (F.count_if(long & ~F.col("text").rlike(r"^\p{Lu}")).over(sentence) == 0)
    after = (F.lag("kind").over(in_sentence()) == "Word") | (F.lag("text").over(in_sentence()) == ",")
    rows = rows.withColumn("_named", F.coalesce(capital & after & ~title, F.lit(False)))
    return _narrowed(rows, F.col("_named") & F.array_contains("kept", "ProperNoun"), F.array(F.lit("ProperNoun"))).drop("_named")


def function_words(rows: DataFrame) -> DataFrame:
    """have, has, had, do, does and did before a settled verb or adverb are auxiliaries, before a determiner, possessive or pronoun verbs; determiners before a settled auxiliary or verb are pronouns where they can be."""
    rows = _neighbours(rows)
    both = F.array_contains("kept", "Auxiliary") & F.array_contains("kept", "Verb")
    rows = _narrowed(rows, both & F.col("_after").isin("Verb", "Adverb"), F.array(F.lit("Auxiliary")))
    return _dropped(_narrowed(rows, both & F.col("_after").isin("Determiner", "Possessive", "Pronoun", "Numeral"), F.array(F.lit("Verb"))))


def infinitive(rows: DataFrame) -> DataFrame:
    """A word after to: a verb unless it can only be an object; before a determiner to is an adposition."""
    rows = _neighbours(rows)
    after_to = (F.col("_last") == "to") & ~F.col("folded").isin(OBJECT_WORDS)
    return _dropped(_narrowed(rows, after_to & F.array_contains("kept", "Verb"), F.array(F.lit("Verb"), F.lit("Auxiliary"))))


def noun_or_verb(rows: DataFrame) -> DataFrame:
    """Of words that may be either: after a determiner or possessive no verb, after a modal or subject a verb."""
    rows = _neighbours(rows)
    either = F.array_contains("kept", "Noun") & F.array_contains("kept", "Verb")
    rows = _narrowed(rows, either & F.col("_before").isin("Determiner", "Possessive"), F.array(F.lit("Noun"), F.lit("Adjective"), F.lit("ProperNoun")))
    return _dropped(_narrowed(rows, either & F.col("_last").isin(MODALS + SUBJECTS), F.array(F.lit("Verb"), F.lit("Auxiliary"), F.lit("Adverb"))))


def _cued(rows: DataFrame, cues: list[tuple[str, list[str], list[str]]], among: Column) -> DataFrame:
    rows = _neighbours(rows)
    best = F.get("kept", F.lit(0))
    cue = F.lit(False)
    for tag, before, after in cues:
        cue = cue | ((best == tag) & (F.coalesce(F.col("_before").isin(before), F.lit(False)) | F.coalesce(F.col("_after").isin(after), F.lit(False))))
    takes = F.coalesce(among & cue & F.col("confidence").isin("Unsure", "Unknown"), F.lit(False))
    rows = rows.withColumn("_takes", takes)
    rows = rows.withColumn("kept", F.when(F.col("_takes"), F.array(best)).otherwise(F.col("kept"))).withColumn("confidence", F.when(F.col("_takes"), "Likely").otherwise(F.col("confidence")))
    return _dropped(rows.drop("_takes"))


def prior(rows: DataFrame) -> DataFrame:
    """Words that the lexicon reads mostly one way take it where a neighbour agrees."""
    return _cued(rows, PRIOR_CUES, F.col("dominant"))


def single(rows: DataFrame) -> DataFrame:
    """Words of one listed tag are confirmed by a neighbour."""
    return _cued(rows, SINGLE_CUES, F.col("listed") & (F.size("kept") == 1))


def tag(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Tokens of sentences with tag, kept and confidence."""
    rows = readings(tokens, lexicon)
    for step in (proper, infinitive, function_words, noun_or_verb, prior, single):
        rows = step(rows)
    return rows.withColumn("tag", F.get("kept", F.lit(0))).drop("dominant", "listed")
