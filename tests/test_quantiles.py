"""Exact grouped quantiles against Spark's percentile, with one hot group."""

import random

from pyspark.sql import functions as F

from cratewise.operators import ordered


def test_quantiles_equal_percentile(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), round(rng.gauss(1, 0.4), rng.choice([1, 2, 6])) if rng.random() < 0.95 else None) for k in range(6000)]
    rows += [("one", 0.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"p10": 0.1, "median": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0}
    got = {r["g"]: r for r in ordered.grouped_quantiles(df, ["g"], "x", shares).collect()}
    want = df.where("x is not null").groupBy("g").agg(F.count("x").alias("n"), *[F.percentile("x", F.lit(p)).alias(n) for n, p in shares.items()]).collect()
    assert len(got) == len(want) and "none" not in got
    for r in want:
        assert got[r["g"]]["n"] == r["n"] and all(abs(got[r["g"]][k] - r[k]) < 1e-12 for k in shares), r["g"]


def test_a_hot_group_is_spread(spark, monkeypatch):
    """Ranks of one group of 200 000 distinct values come from many partitions, none with most of it."""
    seen = []
    cut = ordered.cut_lineage

    def watched(df):
        out = cut(df)
        seen.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out

    monkeypatch.setattr(ordered, "cut_lineage", watched)
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    row = ordered.grouped_quantiles(df, ["g"], "x", {"median": 0.5}).first()
    assert row["n"] == 200_000 and row["median"] == df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert len(seen) == 1 and len(seen[0]) == 4 and max(seen[0]) < 100_000
