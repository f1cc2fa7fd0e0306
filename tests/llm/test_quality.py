from collections import Counter

import pytest
from pyspark.sql import functions as F

from cratewise.llm import quality
from tests.llm.common import clashing, documents, sample_texts, words


def plain(text):
    w, text = words(text), text or ""
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if runs[(w[k], w[k + 1], w[k + 2])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_signals_equal_their_definition(spark, shape):
    docs = shape(documents(spark))
    model = quality.fit_quality(docs, labels(spark, [(i, 1, 0) for i in range(20)]), buckets=512)
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs, model).collect()}
    for i, text in enumerate(sample_texts()):
        assert tuple(rows[i][c] for c in SIGNALS) == plain(text), i
        assert not (rows[i]["base_failed"] and rows[i]["kept"])
    assert rows[0]["llr"] is None and rows[1]["llr"] is None


def test_untrusted_words_lower_the_score(spark):
    good = [f"{' '.join(f'plain{(i * 7 + k) % 40}' for k in range(80))}" for i in range(60)]
    bad = [f"{' '.join(f'junk{(i * 5 + k) % 40}%%' for k in range(80))}" for i in range(20)]
    docs = documents(spark, good + bad)
    model = quality.fit_quality(docs, labels(spark, [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(60, 80)]), buckets=4096)
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs, model).collect()}
    assert max(rows[i]["llr"] for i in range(60, 80)) < min(rows[i]["llr"] for i in range(60))
    assert sum(rows[i]["kept"] or rows[i]["base_failed"] for i in range(60)) >= 58
    assert not any(rows[i]["kept"] for i in range(60, 80))


def test_sample_is_bounded_and_takes_the_worst_label(spark):
    marks = labels(spark, [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0), (3, 1, 1), (None, 1, 0), (4, None, None), (5, 1, 0)])
    assert {r["doc_id"] for r in quality.trusted_sample(marks, 10).collect()} == {2, 5}
    assert quality.trusted_sample(marks, 1).count() == 1


def test_empty_tables(spark):
    docs, none = documents(spark), labels(spark, [])
    kept = quality.judge_quality(docs, quality.fit_quality(docs, none, buckets=64)).collect()
    assert all(r["kept"] != r["base_failed"] for r in kept)  # no verdict but that of the base rules
    empty = documents(spark, [])
    assert quality.judge_quality(empty, quality.fit_quality(empty, none, buckets=64)).count() == 0


def test_pairs_of_words_tell_orders_apart(spark):
    names = [f"plain{k}" for k in range(40)]
    good = [" ".join(names[(i + k) % 40] for k in range(80)) for i in range(60)]
    bad = [" ".join(names[(i - 7 * k) % 40] for k in range(80)) for i in range(20)]  # the same words, each twice
    docs = documents(spark, good + bad)
    marks = labels(spark, [(i, 1, 0) for i in range(60)])
    for orders, apart in (((1,), False), ((1, 2), True)):
        model = quality.fit_quality(docs, marks, buckets=4096, orders=orders)
        llr = {r["doc_id"]: r["llr"] for r in quality.judge_quality(docs, model).collect()}
        assert (max(llr[i] for i in range(60, 80)) < min(llr[i] for i in range(60)) - 0.01) == apart


def test_every_trusted_document_counts(spark):
    # More trusted labels than any bound of before; the one text belongs to the last of them in the order of hashes.
    marks = spark.range(41_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    last = marks.select("doc_id", F.xxhash64("doc_id").alias("h")).where("h % 2 = 0").orderBy(F.desc("h")).first()["doc_id"]
    docs = spark.createDataFrame([(last, "only trusted words"), (50_000, "other text")], "doc_id bigint, text string")
    model = quality.fit_quality(docs, marks, buckets=64)
    assert max(model.weights.first()["weights"]) > 0
