"""The stage's candidates come from SimHash fingerprints and pigeonhole blocks, against plain versions."""

import numpy as np
import pytest

from prosegrid.llm import nearcopies


def apart(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def test_fingerprint_is_a_majority():
    """A bit is that of over half of the hashes, in sets of few shingles and of more than a round holds."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 127, 128, 700):
        found = rng.integers(0, 1 << 63, n, np.uint64)
        signs = []
        for s in [*found.tolist(), *((int(s) * int(nearcopies.MIX)) % (1 << 64) ^ int(nearcopies.AGAIN) for s in found)]:
            for factor in nearcopies.FACTORS[:2].tolist():
                h = s * factor % (1 << 64)
                h = (h ^ h >> 32) * int(nearcopies.MIX) % (1 << 64)
                signs.append([(h ^ h >> 29) >> k & 1 for k in range(64)])
        ones = np.array(signs, int).reshape(2 * n, 128).sum(axis=0)
        expected = [sum(1 << k for k in range(64) if ones[64 * w + k] > n) for w in range(2)]
        assert nearcopies.fingerprint(found, 128).tolist() == expected


@pytest.mark.parametrize("width, number", [(16, 99), (17, 118)])
def test_blocks_hold_every_bit(width, number):
    prints = np.random.default_rng(2).integers(0, 1 << 63, (3, -(-width * number // 64)), np.uint64)
    for row, found in zip(prints, nearcopies.blocks(prints, width, number)):
        whole = sum(int(x) << 64 * n for n, x in enumerate(row))
        assert found.tolist() == [n << 32 | whole >> width * n & (1 << width) - 1 for n in range(number)]


@pytest.mark.parametrize("alike, size", [(4, 5), (8, 10), (40, 50), (240, 300)])
def test_recall_at_the_limit(alike, size):
    """Of 1,000 pairs at 0.8, nearly all agree in a block and none is lost by a later comparison of fingerprints."""
    rng = np.random.default_rng(4)
    width, number = nearcopies.shape(1000)
    pairs = []
    for _ in range(1000):
        found = rng.integers(0, 1 << 63, size, np.uint64)
        pairs.append([nearcopies.fingerprint(s, width * number + 192) for s in (found, found[:alike])])
    met = sum((np.diff(nearcopies.blocks(np.array(p), width, number), axis=0) == 0).any() for p in pairs)
    assert met >= 997
    assert all(apart(a, b) <= nearcopies.APART * 64 * len(a) and apart(a[-3:], b[-3:]) <= nearcopies.CHECK_APART for a, b in pairs)


def classes(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("lane", [8, 2048])
def test_ties_span_the_buckets(spark, monkeypatch, lane):
    """Texts that share a block and are near by the last 192 bits are one family, in small buckets and in those dealt into lanes."""
    monkeypatch.setattr(nearcopies, "LANE", lane)
    rng = np.random.default_rng(6)
    base, other = rng.integers(0, 1 << 63, (2, 100), np.uint64)
    sets = [np.concatenate([base[k % 9 :], rng.integers(0, 1 << 63, 5, np.uint64)]) for k in range(40)]
    # A chain that leads away from the group, its end far from the group's texts; a second group; loners.
    sets += [np.concatenate([base[15 * k :], other[: 15 * k]]) for k in range(4)]
    sets += [np.concatenate([other[k:], rng.integers(0, 1 << 63, 10, np.uint64)]) for k in range(12)]
    sets += list(rng.integers(0, 1 << 63, (20, 50), np.uint64))
    prints = np.array([nearcopies.fingerprint(s, 16 * 99 + 192) for s in sets])
    # Blocks that very many different texts share.
    prints[:, 10] = prints[0, 10]
    keys = nearcopies.blocks(prints, 16, 99)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if (keys[i] == keys[j]).any() and apart(prints[i, -3:], prints[j, -3:]) <= nearcopies.CHECK_APART]
    nodes = spark.createDataFrame([(n, bytearray(p.tobytes())) for n, p in enumerate(prints)], "digest long, print binary")
    ties, families = nearcopies.candidates(nodes, 16, 99)
    ties = [(r.digest, r.hub) for r in ties.collect()]
    assert {tuple(sorted(t, reverse=True)) for t in ties} <= set(near)
    expected = classes(len(sets), near)
    assert classes(len(sets), ties) == expected
    found = {r.node: r.label for r in families.collect()}
    assert [found.get(n, n) for n in range(len(sets))] == expected and len(set(expected)) > 10


@pytest.mark.parametrize("texts", [150, 300])
def test_a_large_family_has_few_ties(spark, monkeypatch, texts):
    """However many tasks compare the buckets, near copies of one text have about one tie each, not one for each block."""
    monkeypatch.setattr(nearcopies, "TASK_ROWS", 300)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    prints = [nearcopies.fingerprint(np.concatenate([base[10:], rng.integers(0, 1 << 63, 10, np.uint64)]), 16 * 99 + 192) for _ in range(texts)]
    nodes = spark.createDataFrame([(n, bytearray(p.tobytes())) for n, p in enumerate(prints)], "digest long, print binary")
    ties, families = nearcopies.candidates(nodes, 16, 99)
    assert {(r.node, r.label) for r in families.collect()} == {(n, 0) for n in range(texts)}
    assert texts - 1 <= ties.count() <= 2 * texts
