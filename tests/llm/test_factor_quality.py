import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cratewise.llm import queries
from cratewise.llm.factor_quality import (FactorModel, KNOTS, STATISTICS, document_entries, entries, fit_factors, linear_time_scores, logistic,
                                          score_quality)

from .common import clashing, documents, prose, sample_texts, words

SF = "/root/testdata/sf0.01"
FAST = {"bits": 10, "rank": 4, "learners": 2, "rounds": 4}


def random_model(bits=10, rank=4, seed=3):
    rng = np.random.default_rng(seed)
    m = entries(bits)
    return FactorModel(bits, 0.3, rng.normal(size=m), rng.normal(size=(m, rank)) * 0.3)


def test_sum_of_squares_equals_all_pairs():
    texts = ["", "one", "a b c a", prose(1, 40), "x " * 50]
    index, value, offsets = document_entries(pa.array(texts), np.array([0.0, 3, 7, np.nan, 100]), 10)
    model = random_model()
    z, _ = linear_time_scores(index, value, offsets, model)
    for row in range(len(texts)):
        own = list(zip(index[offsets[row]:offsets[row + 1]], value[offsets[row]:offsets[row + 1]]))
        want = 0.3 + sum(model.weights[i] * x for i, x in own)
        want += sum(float(model.factors[i] @ model.factors[j]) * x * y for (i, x), (j, y) in itertools.combinations(own, 2))
        assert abs(z[row] - want) < 1e-4


def test_statistics_of_a_text():
    text = "Aa bb 12 aa\nAa bb 12 aa\n\nzz#"
    index, value, offsets = document_entries(pa.array([text, None]), np.array([float(len(text)), np.nan]), 10)
    first = {}
    for i, x in zip(index[:offsets[1]], value[:offsets[1]]):
        if i >= 1 << 10:
            name, knot = divmod(int(i) - (1 << 10), KNOTS + 1)
            first[STATISTICS[name]] = first.get(STATISTICS[name], 0) + knot * x / (KNOTS - 1)
    w = words(text)
    runs = [tuple(x.lower() for x in w[k:k + 3]) for k in range(len(w) - 2)]
    solid = "".join(w)
    assert first["words"] == pytest.approx(np.log10(1 + len(w)) / 6, abs=1e-5)
    assert first["distinct words"] == pytest.approx(4 / 9, abs=1e-5) and first["top word"] == pytest.approx(4 / 9, abs=1e-5)
    assert first["repeated runs"] == pytest.approx(1 - len(set(runs)) / len(runs), abs=1e-5)
    assert first["equal lines"] == pytest.approx(1 / 3, abs=1e-5) and first["line length"] == pytest.approx(np.log10(4) / 4, abs=1e-5)
    assert first["digits"] == pytest.approx(np.sqrt(4 / len(solid)), abs=1e-5) and first["symbols"] == pytest.approx(np.sqrt(1 / len(solid)), abs=1e-5)
    assert first["longest word"] == pytest.approx(np.log10(4) / 4, abs=1e-5) and first["length as stated"] == 1
    second = [int(i) for i in index[offsets[1]:]]
    assert all((i - (1 << 10)) % (KNOTS + 1) == KNOTS or STATISTICS[(i - (1 << 10)) // (KNOTS + 1)] == "words" for i in second if i)


def labelled(spark, n=240):
    """Neither word tells alone: good texts have both of a pair or none of it."""
    texts, rows = [], []
    for i in range(n):
        a, b = i % 2, (i // 2) % 2
        texts.append(" ".join(["alpha"] * a * 8 + ["beta"] * b * 8 + prose(i, 20).split()))
        rows.append((i, int(a == b)))
    return documents(spark, texts), spark.createDataFrame(rows, "doc_id bigint, quality int")


def test_interactions_are_learned(spark):
    docs, labels = labelled(spark)
    fitted = fit_factors(docs, labels.where("doc_id < 200"), **FAST | {"rounds": 12})
    rows = score_quality(docs.where("doc_id >= 200"), fitted).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] > 0.5) == r["quality"] for r in rows]) >= 0.9


def test_awkward_rows_keep_their_places(spark):
    docs, labels = labelled(spark, 40)
    odd = documents(spark).unionByName(documents(spark).limit(3)).unionByName(documents(spark).limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    labels = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    model = fit_factors(clashing(docs.unionByName(docs)), clashing(labels.withColumnRenamed("quality", "q")).withColumnRenamed("q", "quality"), **FAST)
    rows = score_quality(clashing(odd), model).collect()
    assert len(rows) == len(sample_texts()) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    again = {}
    for r in rows:
        assert abs(again.setdefault(r["doc_id"], r["score"]) - r["score"]) < 1e-9
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert score_quality(odd.drop("n_chars"), model).count() == len(rows)


def test_empty_tables(spark):
    docs, labels = labelled(spark, 8)
    model = fit_factors(docs, labels.limit(0), **FAST)
    assert all(abs(r["score"] - 0.5) < 0.2 for r in score_quality(docs, model).collect())
    assert score_quality(docs.limit(0), model).count() == 0
    assert fit_factors(docs.limit(0), labels, **FAST).bias == 0


def test_the_bound_takes_the_least_hashes(spark):
    docs, labels = labelled(spark, 60)
    few = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).limit(20).collect()]
    one = fit_factors(docs, labels, limit=20, **FAST)
    two = fit_factors(docs, labels.where(F.col("doc_id").isin(few)), **FAST)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.factors, two.factors)


def test_query_scores_held_out_documents_well(spark):
    rows = {r["doc_id"]: r for r in queries.op11_factor_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.98  # area under the curve
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.7


def test_only_text_and_stated_length_count_and_only_training_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    training = labels.where(~queries.held_out())
    one = fit_factors(docs, training, **FAST)
    two = fit_factors(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("none")}), training.withColumn("toxic", F.lit(1)), **FAST)
    assert np.allclose(one.weights, two.weights)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    a = {r["doc_id"]: r["score"] for r in score_quality(docs, one).collect()}
    b = {r["doc_id"] - 1_000_000: r["score"] for r in score_quality(moved, one).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and logistic(np.array([0.0]))[0] == 0.5
