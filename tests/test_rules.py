"""The rule learner against a plain one, and starts by suffix."""

import random
from collections import Counter

from prosegrid.operators import rules


def conditions(words, tags, i):
    found = set()
    for number, template in enumerate(rules.TEMPLATES):
        ways = [()]
        for kind, offsets in template:
            row = words if kind == "word" else tags
            ways = [w + (v,) for w in ways for v in {row[i + o] for o in offsets if 0 <= i + o < len(row)}]
        found |= {(number, w) for w in ways}
    return found


def plain_learn(sentences, most, least):
    """sentences: (words, tags, gold); tags are changed. All is counted anew for each rule."""
    kept = []
    while len(kept) < most:
        mends, breaks = Counter(), Counter()
        for words, tags, gold in sentences:
            for i, (tag, truth) in enumerate(zip(tags, gold)):
                for template, values in conditions(words, tags, i) if truth else ():
                    if tag == truth:
                        breaks[tag, template, values] += 1
                    else:
                        mends[tag, template, values, truth] += 1
        gains = [(-(n - breaks[b, t, v]), t, v, b, a) for (b, t, v, a), n in mends.items()]
        if not gains or -min(gains)[0] < least:
            break
        gain, template, values, before, after = min(gains)
        kept.append(rules.Rule(before, after, template, values, -gain))
        for words, tags, _ in sentences:
            held = [i for i, tag in enumerate(tags) if tag == before and (template, values) in conditions(words, tags, i)]
            for i in held:
                tags[i] = after
    return kept


def test_learn(spark):
    rnd = random.Random(9)
    sentences = []
    for _ in range(40):
        words = [rnd.choice("the to a run walk mill grain old".split()) for _ in range(rnd.randint(1, 9))]
        gold = ["D" if w in ("the", "a") else "P" if w == "to" else "V" if i and words[i - 1] == "to" else "A" if w == "old" and i + 1 < len(words) else "N" for i, w in enumerate(words)]
        sentences.append((words, ["D" if w in ("the", "a") else "P" if w == "to" else "N" for w in words], [None if rnd.random() < 0.1 else g for g in gold]))
    rows = [(s, i, w, t, g) for s, (words, tags, gold) in enumerate(sentences) for i, (w, t, g) in enumerate(zip(words, tags, gold))]
    tokens = spark.createDataFrame(rows, "sent_id int, pos int, word string, tag string, gold string")
    found, left = rules.learn(tokens, most=4)
    expected = plain_learn(sentences, 4, 1)
    assert found == expected and len(found) >= 2
    after = {(r.sent_id, r.pos): r.tag for r in left.collect()}
    assert after == {(s, i): t for s, (_, tags, _) in enumerate(sentences) for i, t in enumerate(tags)}
    again = rules.retagged(tokens.drop("gold"), found)
    assert {(r.sent_id, r.pos): r.tag for r in again.collect()} == after
    assert rules.learn(tokens.limit(0))[0] == []


def test_starting_tags(spark):
    train = spark.createDataFrame([("running", "V"), ("walking", "V"), ("king", "N"), ("king", "V"), ("king", "N"), ("sling", "N"), ("ox", "N"), ("by", "P")], "word string, tag string")
    asked = spark.createDataFrame([("king",), ("talking",), ("ding",), ("zzz",), ("y",), ("",)], "word string")
    found = {r.word: (r.tag, r.by) for r in rules.starting_tags(train, asked).collect()}
    assert found == {"king": ("N", "king"), "talking": ("N", "king"), "ding": ("N", "ing"), "zzz": ("N", ""), "y": ("N", ""), "": ("N", "")}
