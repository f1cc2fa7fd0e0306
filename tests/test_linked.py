"""Components and first-come groups against plain definitions."""

import random

import numpy as np
import pytest

from cratewise.operators import duplicates as du, linked


def sequential(edges):
    near = {}
    for i, j, s in edges:
        near.setdefault(i, []).append((j, s))
    claimed, out = set(), set()
    for i in sorted(near):
        if i not in claimed:
            for j, s in near[i]:
                if j not in claimed:
                    claimed.add(j)
                    out.add((i, j, s))
    return out


def graph(seed, n=150, m=260):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    pairs |= {(200, 200 + k) for k in range(1, 60)} | {(300 + k, 301 + k) for k in range(6)}  # a star and a chain
    return [(i, j, rng.choice([0.75, 0.8, 0.9])) for i, j in sorted(pairs)]


@pytest.mark.parametrize("seed,most,n", [(1, 500_000, 150), (2, 500_000, 80), (3, 40, 260)])
def test_groups_equal_the_sequential_rule(spark, seed, most, n):
    """All links in one task; components in several; and the larger ones in rounds."""
    edges = graph(seed, n, 150)
    df = spark.createDataFrame(edges, "i bigint, j bigint, score double").repartition(5)
    assert {tuple(r) for r in linked.greedy_groups(df, most).collect()} == sequential(edges)


def test_components(spark):
    edges = graph(7)
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for i, j, _ in edges:
        lead[find(j)] = find(i)
    got = {}
    for r in linked.components(spark.createDataFrame(edges, "i bigint, j bigint, score double")).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    want = {}
    for x in {x for e in edges for x in e[:2]}:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    write = linked.written
    monkeypatch.setattr(linked, "written", lambda df: rounds.append(1) or write(df))
    edges = [(k, k + 1, 0.8) for k in range(10_000)]
    df = spark.createDataFrame(edges, "i bigint, j bigint, score double")
    assert linked.components(df).groupBy("component").count().collect()[0]["count"] == 10_001
    assert len(rounds) <= 3 * 25  # three tables a round; half of the links would be 5 000 rounds
    assert {tuple(r) for r in linked.greedy_groups(df).collect()} == sequential(edges)


def test_empty_links(spark):
    none = spark.createDataFrame([], "i bigint, j bigint, score double")
    assert linked.greedy_groups(none).count() == 0 and linked.components(none).count() == 0


def test_listed_pairs_equal_a_loop_over_offsets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 24, 400)
    sides = [(base, base), (base, base[6:]), (base[7:], base), (base, rng.integers(0, 1 << 24, 300)), (base[:39], base), (base, base ^ (1 << 3)),
             (base[:41], base[:45])]
    rows = [([int(x) for x in a], [int(x) for x in b]) for a, b in sides] * 12
    got = [r["score"] for r in du.fingerprint_similarity(spark.createDataFrame(rows, "a_words array<int>, b_words array<int>")).collect()]
    for (a, b), score in zip(rows, got):
        a, b, best = np.array(a), np.array(b), 0.0
        for o in range(-200, 201, 2):
            lo, hi = max(0, o), min(len(a), len(b) + o)
            if hi - lo >= 40:
                best = max(best, 1 - int(np.bitwise_count((a[lo:hi] ^ b[lo - o:hi - o]).astype(np.uint32)).sum()) / ((hi - lo) * 24))
        assert abs(score - best) < 1e-9
