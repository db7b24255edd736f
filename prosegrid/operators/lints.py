"""The prose lints, each a table of places: doc_id, block_id, sent_id, start, end, quote.

The verb lints take forms that end in s, and any further verb forms that the caller lists; over tokens
that the tagger has read, they take all forms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from prosegrid.functions import text as T
from prosegrid.operators import patterns as P
from prosegrid.operators.tokens import in_block, in_sentence, sentences, with_offsets

# The words and limits of the lints.
FUNCTION_WORDS = "is was does as this its his us thus plus unless whereas yes always perhaps besides".split()
CLAUSE_VERBS = "means ensures guarantees implies shows says assumes proves indicates suggests confirms verifies expects".split()
NO_STOP_WORDS = "longer more less one matter doubt way".split()
NOTHING_OBJECTS = "nothing none".split()
NOTHING_STOP_WORDS = "to but about like else more less too the".split()
READ_AS_VERBS = "have had do did done".split()
RETURN = "return returns returned".split()
NEGATORS = "not never no nothing none cannot".split()
AT_ALL_GAP = 8
PRONOUNS_IN_S = (
    "it's that's there's what's who's let's here's where's how's he's she's one's everyone's everybody's someone's somebody's anyone's "
    "anybody's nobody's"
).split()
PREPOSITIONS = (
    "about above across after against among around as at before between by during for from in inside into of on onto outside over per "
    "through to toward towards under until upon via with within without"
).split()
CONJUNCTIONS = (
    "although and because but if nor once or since so than though unless when whenever where wherever whereas whether while yet"
).split()
DETERMINERS = "a all an any both each either every neither no some that the these this those".split()
AUXILIARIES = (
    "am are be been can could did do does had has have is may might must shall should was were will would"
).split()
NOT_THEN = [
    "only", "necessarily", "to mention", "all", "every", "even", "yet", "by much", "that", "sure", "because", "including", "counting",
    "really", "quite", "exactly", "the best", "a good", "a great", "ideal", "great", "bad", "too", "so",
]
DENIALS = "not never no neither nor".split()
TAIL_COMMA_THEN = "not never or nor".split()
TAIL_CLOSING = [".", "!", "?", ",", ";", ":", "…", ")", "]", '"', "'", "”", "’", "»", "*", "_", "`"]
LEAST_TAIL, MOST_TAIL = 2, 12
SHOUTED_WORDS = (
    "AFTER ALL ALWAYS ANY ARE AT BE BEFORE BUT CAN CAN'T CANNOT DO DOES DON'T EVER EVERY FOR FROM HAVE IF IN IS IT MAKE MUST NEVER NO NOT "
    "NOW OF ON ONLY SHOULD SURE THAT THE THESE THIS TO WE WILL WITH WON'T YOU YOUR"
).split()
PARAGRAPH_CHARS, ITEM_CHARS = 600, 300
BE_DO = "am are were be been do did done".split()
CLAUSE_FORMS = (
    "mean meant ensure ensured guarantee guaranteed imply implied show showed shown assume assumed prove proved proven indicate indicated "
    "suggest suggested confirm confirmed verify verified expect expected"
).split()
SAY = "say said".split()
NO_IDIOMS = [("make", "sense"), ("made", "sense"), ("look", "further"), ("read", "further"), ("pay", "attention"), ("paid", "attention")]
# End of the fixed values.

KEY = ["doc_id", "block_id", "sent_id"]


def whole_sentence() -> WindowSpec:
    return in_sentence().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def read(blocks: DataFrame) -> DataFrame:
    """Tokens with offsets and sentences, dealt by document."""
    return sentences(with_offsets(blocks))


def places(blocks: DataFrame, tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (pos, length, and what else they carry) with their offsets in the block's text and their quote."""
    first = tokens.select(*KEY, "pos", "start")
    last = tokens.select(*KEY, (F.col("pos") + 1).alias("until"), "end")
    spans = hits.withColumn("until", F.col("pos") + F.col("length")).join(first, [*KEY, "pos"]).join(last, [*KEY, "until"])
    text = blocks.select("doc_id", "block_id", F.col("text").alias("block_text"))
    found = spans.join(text, ["doc_id", "block_id"])
    more = [c for c in hits.columns if c not in (*KEY, "pos", "length")]
    return found.select(*KEY, *more, "start", "end", T.quote(F.substring(F.col("block_text"), F.col("start") + 1, F.col("end") - F.col("start"))).alias("quote"))


def _holds(words: list[str]) -> str:
    """A pattern for texts that hold one of the words on its own, in any case and with either apostrophe."""
    listed = "|".join(re.escape(w).replace("'", "['’]") for w in words)
    return rf"(?i)(?<!\p{{L}})(?:{listed})(?!\p{{L}})"


#: No text without one of these words has a place of the lint, so only texts that have one are taken apart.
NEEDED = {
    "verbs_no_nouns": _holds(["no"]),
    "verbs_nothing": _holds(NOTHING_OBJECTS),
    "not_at_all": _holds(["all"]),
    "possessive_own": _holds(["own"]),
    "denial_tail": _holds(["not", "never"]),
    "caps_runs": _holds(SHOUTED_WORDS).replace("(?i)", ""),
}


def located(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with start and end in their block's text, and their quote, from the block's own tokens; only the hits' blocks are taken apart."""
    texts = blocks.select("doc_id", "block_id", F.col("text").alias("_text"))
    met = hits.join(texts, ["doc_id", "block_id"])
    pieces, pos, until = T.pieces(F.col("_text")), F.col("pos"), F.col("pos") + F.col("length")
    before = lambda n: F.aggregate(F.slice("_pieces", F.lit(1), n.cast("int")), F.lit(0), lambda a, p: a + F.char_length(p))
    met = met.withColumn("_pieces", pieces)
    first = F.get("_pieces", pos.cast("int"))
    space = F.char_length(first) - F.char_length(F.regexp_replace(first, r"^\s+", ""))
    placed = met.withColumns({"start": before(pos) + space, "end": before(until)})
    quote = T.quote(F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return placed.select(*hits.columns, "start", "end", quote.alias("quote"))


def _ends(suffix: str) -> Column:
    return (F.col("kind") == "Word") & F.endswith("folded", F.lit(suffix))


def _verb(excluded: list[str], more: list[str]) -> Column:
    ends = _ends("s") & ~F.contains(F.col("folded"), F.lit("'")) & ~F.col("folded").isin(excluded)
    return ends | P.word(*more) if more else ends


def verbs_no_nouns(tokens: DataFrame, verbs: list[str] | None = None) -> DataFrame:
    """A verb, no, and a noun: "crosses no river"."""
    noun = (F.col("kind") == "Word") & ~F.col("folded").isin(NO_STOP_WORDS)
    return P.find(tokens, [P.one(_verb(FUNCTION_WORDS + CLAUSE_VERBS, verbs or [])), P.one(P.word("no")), P.one(noun)])


def verbs_nothing(tokens: DataFrame, verbs: list[str] | None = None) -> DataFrame:
    """A verb and nothing or none: "catches nothing"."""
    barred = [w for w in FUNCTION_WORDS + CLAUSE_VERBS if w != "does"] + RETURN
    object_ = P.word(*NOTHING_OBJECTS) & ~F.col("text").isin("None", "Nothing", "NONE", "NOTHING")
    pattern = [P.one(_verb(barred, READ_AS_VERBS + (verbs or []))), P.one(object_), P.not_followed_by(P.word(*NOTHING_STOP_WORDS, "of", "wrong"))]
    return P.find(tokens, pattern)


def _form(barred: list[str]) -> Column:
    """A verb in a form other than -s and -ing, as sure as Likely; base forms that end in -ing count."""
    folded = F.col("folded")
    participle = F.endswith(folded, F.lit("ing")) & F.regexp_replace(folded, "ing$", "").rlike("[aeiouy]")
    return P.tagged("Verb") & ~F.contains(folded, F.lit("'")) & ~F.endswith(folded, F.lit("s")) & ~participle & ~folded.isin(barred)


def _heads_a_noun(tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits but those whose first word an article or whose stands right before."""
    before = F.lag("folded").over(in_sentence())
    led = tokens.select(*KEY, "pos", before.alias("_before")).where(F.col("_before").isin("a", "an", "the", "whose")).select(*KEY, "pos")
    return hits.join(led, [*KEY, "pos"], "left_anti").select(*KEY, "pos", "length")


def verbs_no_nouns_tagged(tokens: DataFrame) -> DataFrame:
    """The same of tagged tokens, in any form of the verb: "crossed no river", "may cross no river"."""
    noun = (F.col("kind") == "Word") & ~F.col("folded").isin(NO_STOP_WORDS)
    forms = P.find(tokens, [P.one(_form([*BE_DO, "have", *CLAUSE_FORMS, *SAY]) & P.not_pair(*NO_IDIOMS)), P.one(P.word("no")), P.one(noun)])
    return P.leftmost(_heads_a_noun(tokens, verbs_no_nouns(tokens).unionByName(forms)))


def verbs_nothing_tagged(tokens: DataFrame) -> DataFrame:
    """The same of tagged tokens, in any form of the verb, and with a preposition before the object: "led to nothing"."""
    object_ = P.word(*NOTHING_OBJECTS) & ~F.col("text").isin("None", "Nothing", "NONE", "NOTHING")
    verb = (_form([*BE_DO[:5], *CLAUSE_FORMS, *SAY, *RETURN])) | P.word(*READ_AS_VERBS)
    slot = P.optional(P.tagged("Adposition") | P.word("to"))
    forms = P.find(tokens, [P.one(verb), slot, P.one(object_), P.not_followed_by(P.word(*NOTHING_STOP_WORDS, "of", "wrong"))])
    return P.leftmost(_heads_a_noun(tokens, verbs_nothing(tokens).unionByName(forms)))


def not_at_all(tokens: DataFrame) -> DataFrame:
    """A negation padded with "at all", except in questions and in bare answers."""
    negator = P.word(*NEGATORS) | _ends("n't")
    between = ~negator & ~P.mark(",", ";", ":")
    pattern = [P.not_preceded_by(P.word("or")), P.one(negator), P.run(AT_ALL_GAP, between), P.one(P.word("at")), P.one(P.word("all")), P.not_followed_by(F.col("kind") == "Word")]
    hits = P.find(tokens, pattern)
    sentence = tokens.groupBy(*KEY).agg(
        F.max_by("text", F.when(F.col("text").isin(T.TERMINALS), F.col("pos"))).alias("closing"),
        F.count_if(~F.col("kind").isin("Punctuation", "Symbol")).alias("words"),
        F.max(F.when(F.col("text") == ":", F.col("pos"))).alias("colon"),
    )
    bare = (F.col("length") == 3) & (F.col("words") - F.when(F.col("colon") < F.col("pos"), F.least(F.col("words") - 3, F.lit(3))).otherwise(0) == 3)
    kept = hits.join(sentence, KEY).where((F.coalesce("closing", F.lit("")) != "?") & ~bare)
    return kept.select(*KEY, "pos", "length")


def possessive_own(tokens: DataFrame) -> DataFrame:
    """A possessive padded with own: "the island's own harbour"."""
    possessive = _ends("'s") & ~F.col("folded").isin(PRONOUNS_IN_S)
    after = ((F.col("kind") == "Word") & ~F.col("folded").isin(PREPOSITIONS + CONJUNCTIONS + DETERMINERS + AUXILIARIES)) | (F.col("kind") == "Code") | (F.col("kind") == "Number")
    apostrophe = F.col("text").isin("'", "’") & ~F.col("spaced")
    single = P.find(tokens, [P.one(possessive), P.optional(P.word("very")), P.one(P.word("own")), P.one(after)])
    plural = P.find(tokens, [P.one(_ends("s")), P.one(apostrophe), P.optional(P.word("very")), P.one(P.word("own")), P.one(after)])
    connects = P.word("and", "or") | P.mark(",")
    ends = possessive | (apostrophe & F.lag(_ends("s")).over(in_sentence()))
    marked = tokens.withColumns({"_connects": F.coalesce(connects, F.lit(False)), "_ends": F.coalesce(ends, F.lit(False))})
    settled = F.last(F.when(~F.col("_connects"), F.col("_ends")), ignorenulls=True).over(in_sentence())
    marked = marked.withColumn("_joined", F.col("_connects") & F.coalesce(settled, F.lit(False)))
    before = F.lag("_joined").over(in_sentence()) | (F.lag(P.word(*DETERMINERS)).over(in_sentence()) & F.lag("_joined", 2).over(in_sentence()))
    coordinated = marked.select(*KEY, "pos", F.coalesce(before, F.lit(False)).alias("coordinated")).where("coordinated")
    return single.unionByName(plural).join(coordinated, [*KEY, "pos"], "left_anti").select(*KEY, "pos", "length")


def denial_tail(tokens: DataFrame) -> DataFrame:
    """A sentence that ends in a denial: ", not on the old gate". The first one of each sentence."""
    lead = lambda c, k=1: F.lead(c, k).over(in_sentence())
    lag = lambda c, k=1: F.lag(c, k).over(in_sentence())
    text, folded, kind, spaced = F.col("text"), F.col("folded"), F.col("kind"), F.col("spaced")
    no = lambda c: F.coalesce(c, F.lit(False))
    # A dash with white space on both sides; the two tokens of -- are one dash.
    double = (text == "-") & no((lead("text") == "-") & ~lead("spaced"))
    width = F.when(double, 2).otherwise(1)
    spaced_dash = spaced & ((text.isin("–", "-") & ~double & no(lead("spaced"))) | (double & no(lead("spaced", 2))))
    em = text == "—"
    counts = kind.isin("Word", "Number", "Code", "Url")
    joined = no(lag("text").isin("-", "/") & ~spaced & ~lag("spaced") & lag(counts, 2))
    size = F.when(kind == "Code", F.greatest(F.lit(1), F.size(F.split(F.trim(F.translate("text", "`", "")), r"\s+")))).when(counts & ~joined, 1).otherwise(0)
    splits = text.isin(",", ";", ":", "(") | spaced_dash | (em & spaced & no(lead("spaced")))
    parts = splits & ~((text == ",") & no(lead("folded").isin(TAIL_COMMA_THEN)))
    arrow = text.isin("→", "=") | ((text == ">") & ~spaced & no(lag("text").isin("-", "=")))
    rows = tokens.withColumns({"_dash": spaced_dash | em, "_width": width, "_size": size, "_splits": splits, "_parts": parts, "_arrow": arrow, "_last": F.max(F.when(~text.isin(TAIL_CLOSING), F.col("pos"))).over(whole_sentence())})
    total = lambda c: F.sum(F.col(c).cast("int")).over(in_sentence())
    inside = lambda c: F.sum(F.when(F.col("pos") <= F.col("_last"), F.col(c).cast("int")).otherwise(0)).over(whole_sentence())
    rows = rows.withColumns({"_words": total("_size"), "_all_words": inside("_size"), "_all_parts": inside("_parts"), "_parts_here": total("_parts"), "_all_arrows": inside("_arrow"), "_arrows_here": total("_arrow"), "_clause": total("_splits")})
    clause = Window.partitionBy(*KEY, "_clause").orderBy("pos")
    opener = F.first(F.when(kind != "Punctuation", F.struct("kind", "folded")), ignorenulls=True).over(clause.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_opener", opener)
    # The mark's own clause began before it, so the opener is that of the token before it.
    denied = no((lag("_opener")["kind"] == "Word") & lag("_opener")["folded"].isin(DENIALS))
    at = lambda c: F.when(F.col("_width") == 2, lead(c, 2)).otherwise(lead(c))
    after = lambda c, k: F.when(F.col("_width") == 2, lead(c, 2 + k)).otherwise(lead(c, 1 + k))
    phrases = [p.split() for p in NOT_THEN]
    set_phrase = no(after("folded", 1).isin([p[0] for p in phrases if len(p) == 1]))
    for first, second in (p for p in phrases if len(p) == 2):
        set_phrase = set_phrase | no((after("folded", 1) == first) & (after("folded", 2) == second))
    hyphenated = no((after("text", 1) == "-") & ~after("spaced", 1))
    titled = F.col("_dash") & no(at("text").rlike(r"^\p{Lu}\p{Ll}*$"))
    tail = F.col("_all_words") - at("_words")
    whole = (F.col("_all_parts") == at("_parts_here")) & (F.col("_all_arrows") == at("_arrows_here"))
    opens = text.isin(",", ";") | F.col("_dash")
    good = opens & (F.col("pos") > F.min("pos").over(whole_sentence())) & no(at("folded").isin("not", "never")) & ~hyphenated & ~titled & ~set_phrase & ~denied
    good = good & no(tail.between(LEAST_TAIL, MOST_TAIL) & (tail < F.col("_words") - F.col("_size")) & whole)
    hits = rows.withColumn("_good", good).where("_good").groupBy(*KEY).agg(F.min("pos").alias("pos"), F.max("_last").alias("last"))
    return hits.select(*KEY, "pos", (F.col("last") + 1 - F.col("pos")).alias("length"))


def banned_phrases(tokens: DataFrame, phrases: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Folded phrases as rows of tokens within a block; what lies within an allowed phrase is dropped; the longest wins.

    The phrases are settings, a list of bounded length, and are joined on their first token.
    """
    spark = tokens.sparkSession
    rows = [(p, p in (allowed or [])) for p in dict.fromkeys([*phrases, *(allowed or [])])]
    listed = spark.createDataFrame(rows, "phrase string, allowed boolean") if rows else spark.createDataFrame([], "phrase string, allowed boolean")
    words = F.transform(T.pieces(T.fold(F.col("phrase"))), lambda p: F.regexp_replace(p, r"^\s+", ""))
    listed = F.broadcast(listed.select("phrase", "allowed", words.alias("words"), F.get(words, F.lit(0)).alias("folded")))
    longest = max((len(p.split()) * 2 + 4 for p, _ in rows), default=1)
    prose = F.col("kind").isin("Word", "Number", "Punctuation", "Symbol")
    ahead = F.collect_list(F.when(prose, F.col("folded")).otherwise(F.lit("\0"))).over(in_block().rowsBetween(0, longest))
    starts = tokens.withColumn("_ahead", ahead).join(listed, "folded")
    hits = starts.where(F.slice("_ahead", F.lit(1), F.size("words")) == F.col("words")).select(*KEY, "pos", F.size("words").alias("length"), "allowed", "phrase")
    own, held = hits.where("not allowed"), hits.where("allowed").select("doc_id", "block_id", F.col("pos").alias("from"), (F.col("pos") + F.col("length")).alias("to"))
    free = own.join(held, (own.doc_id == held.doc_id) & (own.block_id == held.block_id) & (F.col("pos") >= F.col("from")) & (F.col("pos") + F.col("length") <= F.col("to")), "left_anti")
    longest_first = free.groupBy(*KEY, "pos").agg(F.max("length").alias("length"))
    return P.leftmost(longest_first)


def is_caps(text: Column) -> Column:
    """A word of two letters at least, all capital."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (F.char_length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]")


def caps_runs(tokens: DataFrame) -> DataFrame:
    """Runs of two words in capitals at least, one of them an everyday word: doc_id, block_id, pos, words, letters (with a space between words)."""
    caps = (F.col("kind") == "Word") & is_caps(F.col("text"))
    marked = tokens.withColumn("_island", F.sum(F.when(caps, 0).otherwise(1)).over(in_block())).where(caps)
    shouted = F.replace("text", F.lit("’"), F.lit("'")).isin(SHOUTED_WORDS)
    runs = marked.groupBy("doc_id", "block_id", "_island").agg(F.min("pos").alias("pos"), F.count("*").alias("words"), (F.sum(F.char_length("text")) + F.count("*") - 1).alias("letters"), F.count_if(shouted).alias("everyday"))
    return runs.where("words >= 2 and everyday >= 1").select("doc_id", "block_id", "pos", "words", "letters")


def short_tails(blocks: DataFrame, least: int = LEAST_TAIL, most: int = MOST_TAIL) -> DataFrame:
    """doc_id, block_id, sent_id and pos of the first comma of each sentence whose tail has least to most words or numbers, fewer than what leads up to it.

    A block is read once, token by token, where it lies; only the commas that may still have a short tail are kept.
    """
    token = lambda t, p: F.struct(t.isin(T.TERMINALS).alias("ends"), (t.isin(T.CLOSERS) & (p == t)).alias("closes"), ((p != t) & ~t.rlike(r"^\p{Ll}")).alias("opens"), (t == ",").alias("comma"), T.token_kind(t).isin("Word", "Number").alias("word"))
    held = F.transform(T.pieces(F.col("text")), lambda p: F.struct(p.alias("p"), F.regexp_replace(p, r"^\s+", "").alias("t")))
    marks = F.transform(held, lambda x: token(x["t"], x["p"]))
    comma, tail = "struct<pos: int, before: int>", "struct<sent_id: int, pos: int>"
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("sent"), F.lit(False).alias("ended"), F.lit(0).alias("words"), F.array().cast(f"array<{comma}>").alias("commas"), F.array().cast(f"array<{tail}>").alias("tails"))

    def closed(s: Column) -> Column:
        """The tails found so far, with that of the sentence that ends here."""
        short = F.filter(s["commas"], lambda c: (s["words"] - c["before"]).between(least, most) & (s["words"] - c["before"] < c["before"]))
        return F.when(F.size(short) > 0, F.array_append(s["tails"], F.struct(s["sent"].alias("sent_id"), F.get(short, F.lit(0))["pos"].alias("pos")))).otherwise(s["tails"])

    def step(s: Column, t: Column) -> Column:
        begins = s["ended"] & t["opens"]
        words = F.when(begins, 0).otherwise(s["words"]) + t["word"].cast("int")
        kept = F.when(begins, F.array().cast(f"array<{comma}>")).otherwise(s["commas"])
        near = F.filter(kept, lambda c: words - c["before"] <= most)
        fresh = t["comma"] & ~F.exists(near, lambda c: c["before"] == words)
        commas = F.when(fresh, F.array_append(near, F.struct(s["pos"].alias("pos"), words.alias("before")))).when(t["comma"], near).otherwise(kept)
        ended = t["ends"] | (t["closes"] & s["ended"])
        return F.struct((s["pos"] + 1).alias("pos"), (s["sent"] + begins.cast("int")).alias("sent"), ended.alias("ended"), words.alias("words"), commas.alias("commas"), F.when(begins, closed(s)).otherwise(s["tails"]).alias("tails"))

    found = F.aggregate(marks, start, step, closed)
    return blocks.where(F.contains("text", F.lit(","))).select("doc_id", "block_id", F.explode(found).alias("tail")).select("doc_id", "block_id", "tail.*")


def dense_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of more visible characters than their kind may have; kind is Item or anything else."""
    limit = F.when(F.col("kind") == "Item", ITEM_CHARS).otherwise(PARAGRAPH_CHARS)
    return blocks.withColumns({"chars": F.char_length("text"), "limit": limit}).where("chars > limit")


#: What takes tagged tokens instead.
TAGGED = {"verbs_no_nouns": verbs_no_nouns_tagged, "verbs_nothing": verbs_nothing_tagged}
LINTS = {"verbs_no_nouns": verbs_no_nouns, "verbs_nothing": verbs_nothing, "not_at_all": not_at_all, "possessive_own": possessive_own, "denial_tail": denial_tail}


def check(blocks: DataFrame, lints: list[str] | None = None) -> DataFrame:
    """All places of the sentence lints over one reading of the blocks."""
    tokens = read(blocks)
    found = None
    for name in lints or list(LINTS):
        rows = LINTS[name](tokens).select(*KEY, "pos", "length", F.lit(name).alias("lint"))
        found = rows if found is None else found.unionByName(rows)
    return places(blocks, tokens, found)
