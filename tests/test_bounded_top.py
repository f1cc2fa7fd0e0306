"""The bounded scan of dense cells against scoring every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.operators import bounded_top, ranking as rk
from tests.test_library import brute_force


def targets(rng, n, span):
    return {"log": np.log2(124.0) + rng.random(n) * span, "energy": rng.integers(1, 11, n).astype(float), "vocal": np.round(rng.random(n), 3),
            "section": rng.choice([1.0, 0.85, 0.6, 0.5, 0.25], n), "recent": (rng.random(n) < 0.02).astype(float),
            "artist": rng.integers(-1, 400, n), "name": rng.permutation(n)}


def sources(rng, n, span):
    return {"log": np.log2(124.0) + rng.random(n) * span, "energy": rng.integers(1, 11, n).astype(float), "vocal": np.round(rng.random(n), 3),
            "artist": rng.integers(-1, 400, n), "h": rng.choice([1.0, 0.85, 0.1], n), "floor": np.full(n, -1.0)}


def every_pair(s, t, i, k):
    gap = np.abs(t["log"] - s["log"][i])
    total = (np.maximum(0, 1 - gap / 0.06) * 0.34 + s["h"][i] * 0.3 + np.maximum(0, 1 - np.abs(t["energy"] - s["energy"][i] - 1) / 4) * 0.16
             + t["section"] * 0.12 + np.maximum(0, 1 - 1.6 * s["vocal"][i] * t["vocal"]) * 0.08
             - ((t["artist"] == s["artist"][i]) & (s["artist"][i] >= 0)) * 0.12 - t["recent"] * 0.25)
    points = np.floor(np.clip(total, 0, 1) * 100 + 0.5)
    return set(np.lexsort((t["name"], -points))[:k])


@pytest.mark.parametrize("span", [0.0, 1 / 64, 0.5])
def test_scored_pairs_do_not_follow_the_size_of_a_cell(span):
    read = []
    for n in (2_000, 20_000, 200_000):
        rng = np.random.default_rng(n)
        t, s = targets(rng, n, span), sources(rng, 60, span)
        rows, cols, scored = bounded_top.best_pairs(s, bounded_top.Cell(t), 9, rk.WEIGHTS, 0.06, 0.12, 0.25)
        for i in range(60):
            assert every_pair(s, t, i, 9) <= set(cols[rows == i])
        read.append(scored / 60)
    print(f"pairs scored per source, cells of 2 000, 20 000, 200 000 tracks over {span:.3f} octaves: {[round(x) for x in read]}")
    assert read[2] <= 1500  # under a hundredth of the largest cell


def test_floor_and_small_cells():
    rng = np.random.default_rng(5)
    t, s = targets(rng, 5, 0.01), sources(rng, 20, 0.01)
    rows, cols, _ = bounded_top.best_pairs(s, bounded_top.Cell(t), 9, rk.WEIGHTS, 0.06, 0.12, 0.25)
    assert len(rows) == 100
    s["floor"] = np.full(20, 2.0)
    assert not len(bounded_top.best_pairs(s, bounded_top.Cell(t), 9, rk.WEIGHTS, 0.06, 0.12, 0.25)[0])


@pytest.mark.parametrize("n", [200, 1_000, 6_000])
def test_a_source_looks_at_few_buckets_and_keeps_few_pairs(n):
    rng = np.random.default_rng(n)
    t, s = targets(rng, n, 1 / 64), sources(rng, 60, 1 / 64)
    cell = bounded_top.Cell(t)
    assert len(cell.starts) <= max(128, n // 64)  # kinds of energy, section and recency: up to 100
    rows, cols, _ = bounded_top.best_pairs(s, cell, 9, rk.WEIGHTS, 0.06, 0.12, 0.25)
    for i in range(60):
        assert every_pair(s, t, i, 9) <= set(cols[rows == i])
    assert len(rows) <= 60 * 10  # the best 9 and what rounding leaves open


def test_scores_of_nothing_tie_whatever_lies_under_them(spark):
    """Penalties take totals below zero; all of them count as 0 points, in the order of names."""
    rows = [(999, "source", "x", 100.0, 1, "A", 5, 1.0, 0.25, True, True)]
    rows += [(i, f"z{i}", "x", 120.0, 2, "A", 4, 1.0, 0.25, True, True) for i in range(8)]
    rows += [(20 + i, f"a{i}", "x", 120.0, 6, "A", 4, 1.0, 0.25, True, True) for i in range(8)]
    df = spark.createDataFrame(rows, "id bigint, name string, artist string, bpm double, wheel int, letter string, energy int, "
                                     "vocal double, section_score double, recent boolean, analysed boolean")
    got = {}
    for r in rk.recommend_all(df.withColumn("section", F.lit(None).cast("string")), 5).orderBy("from_id", "rank").collect():
        got.setdefault(r["from_id"], []).append(r["to_id"])
    assert got == brute_force([r.asDict() for r in df.collect()], 5)


def test_most_of_a_library_in_one_cell(spark, monkeypatch):
    """Six of ten tracks share key and tempo; cells are dense from 20 tracks on, and cut into parts."""
    monkeypatch.setattr(rk, "CELL_ROWS", 20)
    monkeypatch.setattr(rk, "DENSE_CANDIDATES", 150)
    monkeypatch.setattr(rk, "DENSE_SOURCES", 100)
    rng = random.Random(9)
    rows = []
    for i in range(600):
        hot = i % 10 < 6
        rows.append((i, f"t{rng.randrange(300):03d}", rng.choice(["x", "y", "z", None]), 128.0 if hot else rng.uniform(70, 190), 5 if hot else rng.randint(1, 12),
                     "A" if hot else rng.choice("AB"), rng.randint(1, 10), round(rng.random(), 2), rng.choice([1.0, 0.85, 0.6, 0.5, 0.25]),
                     rng.random() < 0.05, rng.random() < 0.97))
    df = spark.createDataFrame(rows, "id bigint, name string, artist string, bpm double, wheel int, letter string, energy int, "
                                     "vocal double, section_score double, recent boolean, analysed boolean")
    got = {}
    for r in rk.recommend_all(df.withColumn("section", F.lit(None).cast("string")), 8).orderBy("from_id", "rank").collect():
        got.setdefault(r["from_id"], []).append(r["to_id"])
    assert got == brute_force([r.asDict() for r in df.collect()], 8)
