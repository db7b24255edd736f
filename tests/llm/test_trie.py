"""The trie against one of dictionaries, in one range and in many, and hard rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prosegrid.llm import trie


def plain_trie(conversations):
    """{(conv_id, depth): rest of the row} of a trie of dictionaries."""
    members, below = {}, {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members.setdefault(turns[:depth], []).append(conv)
            if depth:
                below.setdefault(turns[: depth - 1], set()).add(turns[:depth])
    found, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        children = below.get(node, ())
        leaves[node] = sum(leaves[c] for c in children) or 1
        saved[node] = sum(saved[c] for c in children) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        found[min(members[node]), len(node)] = (parent, len(members[node]), len(children), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return found


def ordered(rows):
    """(conv_id, turn, role, text) rows to sequences of (role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for *_, r, t in sorted(turns)) for c, turns in found.items()}


def nodes(frame):
    rows = frame.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


SCHEMA = "conv_id long, turn long, role string, text string, turns string, seq string, key int"


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("size", [7, 40, 10**6])
def test_random(spark, seed, size):
    rnd = random.Random(seed)
    rows = []
    for conv in range(120):
        shape = rnd.random()
        texts = ["same"] * rnd.randint(0, 12) if shape < 0.3 else [rnd.choice(["a", "é", "long text"]) for _ in range(rnd.randint(1, 6))]
        rows += [(conv * 40000, turn, "user", text, "x", "y", 1) for turn, text in enumerate(texts)]
    said = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    assert nodes(trie.prefix_trie(said, turns_a_range=size)) == plain_trie(ordered(r[:4] for r in rows))


def test_shuffled_common_nodes(spark, monkeypatch):
    monkeypatch.setattr(trie, "MAX_BROADCAST_NODES", 0)
    rows = [(c, t, "user", f"t{(c >> t) % 3}", None, None, None) for c in range(90) for t in range(c % 7)]
    said = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    assert nodes(trie.prefix_trie(said, turns_a_range=20)) == plain_trie(ordered(r[:4] for r in rows))


def test_hard_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", "x" * 100000), (2, None, "user", "first"), (2, 0, None, None), (None, 0, "user", "lost"), (None, 0, "user", "lost")]
    rows += [(3, 5, "user", "again"), (3, 6, "user", "again")] + [(10 + c, t, "user", "hot") for c in range(200) for t in range(3)] + [(-7, 0, "", ""), (-8, 0, None, "")]
    rows += [(400, t, "a" * (t % 3), "deep") for t in range(3000)] + [(401, t, "a" * (t % 3), "deep") for t in range(2999)]
    turns = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    expected = plain_trie(ordered(rows))
    assert nodes(trie.prefix_trie(trie.sequences(turns))) == expected
    assert nodes(trie.prefix_trie(trie.sequences(turns), turns_a_range=1500)) == expected
    assert trie.prefix_trie(trie.sequences(turns.limit(0))).collect() == []


def test_ties_are_ordered_by_digest(spark):
    turns = spark.createDataFrame([(c, 0, "user", t, None, None, None) for c, ts in ((1, "ab"), (2, "ba")) for t in ts], SCHEMA)
    assert trie.prefix_trie(trie.sequences(turns)).where("depth = 2 AND n_convs = 2").count() == 1


def test_turnless_and_grafted(spark):
    rows = [(c, t, "user", f"{c}-{t}", None, None, None) for c, n in ((0, 3), (1, 5), (2, 1), (4, 2), (6, 4), (7, 1)) for t in range(n)]
    said = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    built = trie.grafted(said, every=5, n=(F.col("conv_id") % 9).cast("int"), most=8)
    plain = ordered(r[:4] for r in rows)
    expected = {c: (plain.get(c - c % 5, ())[: c % 9] if c - c % 5 in plain else ()) + plain[c][c % 9 :] for c in plain}
    assert expected[7] == ()
    assert nodes(trie.prefix_trie(built)) == plain_trie(expected)
