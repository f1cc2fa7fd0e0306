import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.llm import queries
from cratewise.llm.whitening import fit_whitening, identity_error, usable, whiten

from .common import clashing

SCHEMA = "vec_id bigint, embedding array<double>"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, k=8):
    """n, deviations, whitened rows up to sign, explained shares: by the eigenvectors of the covariance, all rows in memory."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    y = (n * np.array(x, float) - np.array(sums, float)) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviation, y @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(spark, vectors, df, tolerance=1e-6):
    n, deviation, z, explained = plain(vectors)
    model = fit_whitening(df)
    rows = {}
    for r in whiten(df, model).collect():
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for i, key in enumerate(sorted(rows)):
        mine = np.array([rows[key][c]["whitened"] for c in range(1, z.shape[1] + 1)])
        assert {r["n"] for r in rows[key].values()} == {n} and {int(r["deviation"]) for r in rows[key].values()} == {deviation[i]}
        assert np.allclose([rows[key][c]["explained"] for c in range(1, z.shape[1] + 1)], explained, rtol=1e-6)
        if signs is None:
            signs = np.sign(mine * z[i])
        assert np.allclose(mine * signs, z[i], atol=tolerance)
    assert len(rows) == n and identity_error(df, model) < 1e-9


def test_random_rows_agree_with_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12))
    compare(spark, vectors, table(spark, vectors).repartition(5))


def test_ill_conditioned_rows_keep_their_least_component(spark):
    """Variances from 1e9 to below 1: the Gram matrix alone would lose the small ones."""
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    vectors = rng.normal(size=(400, 4)) * [1e6, 1e3, 1.0, 1e-2] @ turn
    df = table(spark, vectors).repartition(3)
    model = fit_whitening(df)
    x = np.floor(np.array(vectors) * 1024)
    true = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert model.rank == 4 and np.allclose(model.variances, true, rtol=1e-6) and identity_error(df, model) < 1e-6


def test_rows_that_do_not_count(spark):
    good = np.random.default_rng(3).normal(size=(40, 3))
    bad = [None, [], [1, None, 2], [1, float("nan"), 2], [float("inf"), 0, 0], [1, 2], [1e300, 0, 0]]
    df = clashing(table(spark, [*good, *bad]))
    compare(spark, good, df)
    assert usable(df).count() == 40


def test_repeated_rows_null_ids_and_floats(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 9)).astype(np.float32)
    df = table(spark, vectors).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    both = df.unionByName(df).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("bigint")))
    model = fit_whitening(both)
    out = whiten(both, model)
    assert model.n == 61 and out.count() == 61 * 8 and out.where("vec_id is null").count() == 8


def test_empty_single_and_constant_tables(spark):
    empty = table(spark, []).limit(0)
    assert whiten(empty, fit_whitening(empty)).count() == 0 and identity_error(empty, fit_whitening(empty)) is None
    for vectors in ([[1.5, 2.5]], [[1.5, 2.5]] * 5):
        df = table(spark, vectors)
        model = fit_whitening(df)
        rows = whiten(df, model).collect()
        assert len(rows) == 2 * len(vectors) and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in rows)


def test_directions_without_variance(spark):
    """One dimension is constant and one the sum of two others."""
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(200, 2)) * 1024) / 1024
    vectors = np.column_stack([a, a.sum(axis=1), np.full(200, 7.0)])
    df = table(spark, vectors).repartition(4)
    model = fit_whitening(df)
    assert model.rank == 2 and identity_error(df, model) < 1e-9
    rows = whiten(df, model).collect()
    assert {r["component"] for r in rows if r["whitened"] is None} == {3, 4}
    assert {r["explained"] for r in rows if r["component"] > 2} == {0.0}


def test_large_values_stay_exact(spark):
    vectors = [[2.0 ** 50, 1.0], [2.0 ** 50 + 4, -1.0], [-2.0 ** 50, 0.5]]
    df = table(spark, vectors)
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * c - s) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}
    got = {r["vec_id"]: int(r["deviation"]) for r in whiten(df, fit_whitening(df)).collect()}
    assert got == want


@pytest.mark.parametrize("scale", ["0.001"])
def test_query_matches_eigenvectors(spark, scale):
    sf_dir = f"/root/testdata/sf{scale}"
    rows = queries.op13_whitening(spark, sf_dir).collect()
    vectors = {r["vec_id"]: [float(c) for c in r["embedding"]] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, deviation, z, explained = plain([vectors[i] for i in ids])
    assert len(rows) == 8 * n and max(r["identity_error"] for r in rows) < 1e-9
    mine = np.zeros_like(z)
    for r in rows:
        i = ids.index(r["vec_id"])
        mine[i, r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[i] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-6
    assert np.allclose(np.abs(mine), np.abs(z), atol=1e-6)
