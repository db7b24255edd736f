"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton over tokens that
accepts exactly the token sequences that merging can give. It begins as one state with an arc for
each base symbol. The gadget of a merge (u, v): the state s that u leads to gets a copy without
the arc v, u leads to the copy from then on, and wherever u may be read, the new token uv may be
read as well and leads where v leads from s.

A state keeps its arcs for good, and all arcs of one label lead to one state. So a state is known
by its label and the number of gadgets applied, and a gadget is stored as the arc that it takes
away: whether a later token may be read is whether its left part may, and before u's own gadgets
it led where its right part led. Transitions asked for once are kept in a table.

Every prefix of a word has one accepted sequence, so a word is read by taking the longest token
that has an arc here and stepping back where no arc leads on. Words come from the tokenizer
file's normalizer and pre-tokenizer. To decode is to emit the labels of the arcs.

Defined results: a null or blank text has no tokens; special tokens written in a text are read as
such; equal texts give equal ids, so repeated rows do, and an empty table gives an empty result.
Texts are encoded whole, whatever their length. Other columns are untouched.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm.shared import bounded_batches

#: What \s means in the tokenizer files.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space to str.split() alone.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: White-space-free pieces of text whose ids a Python worker keeps, each short.
KEPT_PIECES, KEPT_WORDS, KEPT_LENGTH = 400_000, 300_000, 40
KEPT_ARCS = 1_000_000
#: What a tokenizer file writes after the last letter of a word, and the one character that stands for it here.
WORD_END, END = "</w>", "\0"
#: Letters of a label by which its greatest length is looked up.
START = 3

_built: dict = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is visible in Latin-1, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


#: Two tokens are one number of 40 bits.
MOST_TOKENS = 1 << 20


class Automaton:
    """Labels end in END where a word does. born: the merge that made a token, -1 for a base symbol."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        if len(base) + len(merges) > MOST_TOKENS:
            raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens")
        self.label = [x.replace(WORD_END, END) for x in base]
        self.number = {symbol: n for n, symbol in enumerate(self.label)}
        self.left, self.right, self.born = [-1] * len(base), [-1] * len(base), [-1] * len(base)
        self.lacks: dict[int, int] = {}  # of u << 20 | v: the merge whose gadget took the arc v from where u leads
        self.unread: set[int] = set()
        self.kept: dict[int, bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, self.number[u.replace(WORD_END, END)], self.number[v.replace(WORD_END, END)])
        for token in self.unread:
            self.number.pop(self.label[token], None)
        self.reach: dict[str, int] = {}  # the longest label that begins with these letters
        for text in self.number:
            start = text[:START]
            self.reach[start] = max(self.reach.get(start, 0), len(text))

    def _gadget(self, rank: int, u: int, v: int) -> None:
        token = len(self.label)
        self.label.append(self.label[u] + self.label[v])
        self.left.append(u)
        self.right.append(v)
        self.born.append(rank)
        self.number.setdefault(self.label[token], token)
        if u in self.unread or v in self.unread or not self.has_arc(u, v):
            self.unread.add(token)  # an earlier merge always takes one of the parts away
        else:
            self.lacks[u << 20 | v] = rank

    def has_arc(self, before: int, token: int) -> bool:
        """Whether the state that before leads to has an arc for token."""
        lacks, born = self.lacks, self.born
        age = len(self.label)  # the state as the gadgets below this number left it
        while True:
            if lacks.get(before << 20 | token, age) < age:
                return False
            if born[token] > born[before]:  # an arc of a later token is there if its left part's is
                age, token = min(age, born[token] + 1), self.left[token]  # and its own gadget took its right part's arc away
            elif born[before] >= 0:  # when before was made, it led where its right part led
                age, before = born[before], self.right[before]
            else:
                return True

    def may_follow(self, before: int, token: int) -> bool:
        """has_arc, from the table of transitions."""
        key = before << 20 | token
        known = self.kept.get(key)
        if known is None:
            if len(self.kept) >= KEPT_ARCS:
                self.kept.clear()
            known = self.kept[key] = self.has_arc(before, token)
        return known

    def read(self, word: str) -> list[int]:
        """The accepted sequence of tokens whose labels make up the word, whose last letter is followed by END.

        A place has one accepted sequence that leads to it, so a place that leads no further is
        never tried again.
        """
        number, kept = self.number.get, self.kept.get
        whole = number(word)
        if whole is not None:
            return [whole]
        n, at, path, ends, dead = len(word), 0, [], [], set()
        end = min(n, self.reach.get(word[:START], START - 1))
        while at < n:
            while end > at:
                if end != n - 1:  # END belongs to the letter before it
                    token = number(word[at:end])
                    if token is not None and end not in dead:
                        if not path:
                            break
                        good = kept(path[-1] << 20 | token)
                        if good or (good is None and self.may_follow(path[-1], token)):
                            break
                end -= 1
            else:
                dead.add(at)
                path.pop()
                end = ends.pop() - 1
                at = ends[-1] if ends else 0
                continue
            path.append(token)
            ends.append(end)
            at = end
            end = min(n, at + self.reach.get(word[at : at + START], START - 1))
        return path


class Codec:
    """A word-end BPE tokenizer file: normalizer, pre-tokenizer, automaton and labels."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.automaton = Automaton([*letters, *(x + WORD_END for x in letters)], merges)
        self.ids = [vocabulary[label.replace(END, WORD_END)] for label in self.automaton.label]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = {i: label for label, i in vocabulary.items()} | {i: label for label, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", regex.escape(SPACES, special_only=False)))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.kept: dict[str, bytes] = {}
        self.kept_words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        symbols = word.encode().decode("latin-1").translate(self.letters) + END
        found = array("i", [self.ids[token] for token in self.automaton.read(symbols)]).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self.kept_words) >= KEPT_WORDS:
                self.kept_words.clear()
            self.kept_words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        get = self.kept_words.get
        found = b"".join([ids if (ids := get(w)) is not None else self._word(w) for w in self.words.findall(piece)])
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if any(special in text for special in self.special):
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[p]], "<i4").tobytes() if k % 2 else self.encode(p) for k, p in enumerate(parts))
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        pieces = self.spaces.split(text) if any(c in text for c in ODD_SPACES) else text.split()
        get = self.kept.get
        return b"".join([found if (found := get(p)) is not None else self._piece(p) for p in pieces])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def _codec(text) -> Codec:
    if text.id not in _built:
        _built.clear()
        _built[text.id] = Codec(text.value)
    return _built[text.id]


class _Shipped:
    """The tokenizer file's text, sent to each executor once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.sent = spark.sparkContext.broadcast(text)
        self.id = f"{path}:{len(text)}:{hash(text)}"

    @property
    def value(self) -> str:
        return self.sent.value


def bpe_encode(spark: SparkSession, text: Column, tokenizer: str) -> Column:
    """The ids of a text column, array<int>; tokenizer is the path of its file on the driver."""
    bounded_batches(spark)
    shipped = _Shipped(spark, tokenizer)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(shipped)
        found = [codec.encode(t.as_py()) for t in texts]
        offsets = np.cumsum([0, *(len(f) // 4 for f in found)]).astype("<i4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return encode(text)


def bpe_decode(spark: SparkSession, ids: Column, tokenizer: str) -> Column:
    """The text of an array<int> column of ids."""
    shipped = _Shipped(spark, tokenizer)

    @F.arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        codec = _codec(shipped)
        values, offsets = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
        return pa.array([codec.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())

    return decode(ids)
