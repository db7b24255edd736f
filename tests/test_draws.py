"""Draws against the generator stepped one by one, and intervals against a plain bootstrap."""

import pytest

from prosegrid.functions import draws


def plain(seed, n):
    state, found = max(seed, 1), []
    for _ in range(n):
        state ^= state >> 12
        state ^= state << 25 & draws.MASK
        state ^= state >> 27
        found.append(state * draws.MULTIPLIER & draws.MASK)
    return found


def test_generator():
    assert draws.fnv1a64("") == 0xCBF29CE484222325 and draws.fnv1a64("a") == 0xAF63DC4C8601EC8C
    for seed in (0, 1, draws.SEED, draws.MASK):
        expected = plain(seed, 3000)
        for first, n, lanes in ((0, 3000, 256), (1, 1, 8), (517, 1000, 7), (2990, 10, 64)):
            assert draws.draws_from(seed, first, n, lanes).tolist() == expected[first : first + n]
    far = draws.leapt(draws.SEED, 10**15)
    assert draws.leapt(far, 5) == draws.leapt(draws.leapt(draws.SEED, 5), 10**15)


def test_sequence(spark):
    expected = plain(draws.SEED, 25000)
    rows = draws.sequence(spark, draws.SEED, 3, 24000).select("i", "bits", draws.below(draws.F.col("bits"), 7).alias("small"), draws.below(draws.F.col("bits"), 2147483647).alias("large")).collect()
    assert {r.i: r.bits & draws.MASK for r in rows} == dict(enumerate(expected[3:24003], 3))
    assert all(r.small == expected[r.i] % 7 and r.large == expected[r.i] % 2147483647 for r in rows)


def plain_interval(repos, hits, smooth, replicates):
    """hits: for each side, {repo: rate}."""
    numbers, at, sums = plain(draws.SEED, sum(map(len, repos)) * replicates), 0, []
    for names, rates in zip(repos, hits):
        names = sorted(names)
        of_side = []
        for _ in range(replicates):
            of_side.append(sum(rates.get(names[numbers[at + k] % len(names)], 0.0) for k in range(len(names))) / len(names))
            at += len(names)
        sums.append(of_side)
    ratios = sorted((a + smooth) / (b + smooth) for a, b in zip(*sums))
    rank = lambda f: ratios[max(1, -(-int(f * 1000) * len(ratios) // 1000)) - 1]
    return rank(0.025), rank(0.975)


def test_bootstrap(spark):
    repos = [[f"r{i}" for i in range(40)], [f"s{i}" for i in range(37)]]
    items = {"one": [{"r7": 400.0}, {}], "both": [{f"r{i}": 3.0 * i for i in range(20)}, {f"s{i}": 10.0 + i for i in range(30)}], "even": [{r: 30.0 for r in repos[0]}, {s: 10.0 for s in repos[1]}]}
    rates = spark.createDataFrame([(item, side, repo, rate) for item, sides in items.items() for side, hits in enumerate(sides) for repo, rate in hits.items()], "item string, side int, repo string, rate double")
    listed = spark.createDataFrame([(side, repo) for side, names in enumerate(repos) for repo in names], "side int, repo string")
    found = {r.item: (r.low, r.high) for r in draws.bootstrap_ratio(rates, listed, 1.0, replicates=200).collect()}
    assert found == {item: pytest.approx(plain_interval(repos, hits, 1.0, 200)) for item, hits in items.items()}
    assert found["one"][0] == 1.0 and found["even"] == pytest.approx((31 / 11, 31 / 11))
    counts = {(r.side, r.replicate): r.n for r in draws.resampled(spark, {0: 3, 1: 5}).groupBy("side", "replicate").agg(draws.F.sum("n").alias("n")).collect()}
    assert counts == {(side, k): n for side, n in ((0, 3), (1, 5)) for k in range(draws.REPLICATES)}
