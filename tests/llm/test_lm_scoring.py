import math
from collections import Counter

import numpy as np
import pytest

from cratewise.llm import lm_scoring
from tests.llm.common import LOWER, clashing, documents, sample_texts, words


def plain(texts, backoff=0.4, order=2, leave_out=True):
    """Word by word from whole counters."""
    docs = [words((t or "").translate(LOWER)) for t in texts]

    def grams(d, k):
        return Counter(tuple(d[i:i + k]) for i in range(len(d) - k + 1))

    every = [Counter() for _ in range(order + 1)]
    for d in docs:
        for k in range(1, order + 1):
            every[k].update(grams(d, k))
    total = sum(every[1].values())
    for d in docs:
        own = [grams(d, k) if leave_out else Counter() for k in range(order + 1)]
        score, seen = 0.0, 0
        for i in range(len(d)):
            down = 0.0
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - k + 1:i + 1])
                count = every[k][gram] - own[k][gram]
                if k == 1:
                    score += down + math.log(max(count, 1) / max(total - (len(d) if leave_out else 0), 1))
                elif count > 0:
                    score += down + math.log(count / (every[k - 1][gram[:-1]] - own[k - 1][gram[:-1]]))
                    seen += 1
                    break
                else:
                    down += math.log(backoff)
        yield len(d), seen, score


@pytest.mark.parametrize("shape,options", [
    (lambda d: d, {}), (clashing, {"order": 3}), (lambda d: d, {"order": 1}), (lambda d: d, {"leave_out": False}),
    (lambda d: d, {"order": 4, "backoff": 0.3})])
def test_equals_scoring_word_by_word(spark, monkeypatch, shape, options):
    """Over awkward texts, with several batches and buckets."""
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 5000)
    texts = sample_texts()
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(shape(documents(spark, texts)).repartition(3), **options).collect()}
    assert len(rows) == len(texts)
    for i, (n, seen, score) in enumerate(plain(texts, **options)):
        assert (rows[i]["n_words"], rows[i]["n_seen"]) == (n, seen), i
        assert rows[i]["score"] == pytest.approx(score, abs=1e-6)
        assert (rows[i]["per_word"] is None) == (n == 0)


def test_packed_integers_come_back():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0, 2 ** 64 - 1], np.uint64), rng.integers(0, 2 ** 63, 1000).astype(np.uint64)):
        assert (lm_scoring.unpacked(lm_scoring.packed(x)) == x).all()
        assert (lm_scoring.unpacked_sorted(lm_scoring.packed_sorted(np.sort(x))) == np.sort(x)).all()


def test_repeated_and_missing_ids_are_added_up(spark):
    texts = ["alpha beta gamma", "alpha beta gamma", "alpha beta", None]
    docs = documents(spark, texts).selectExpr("case when doc_id < 2 then 7 end as doc_id", "text")
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs).collect()}
    one = list(plain(texts))
    assert rows[7]["n_words"] == 6 and rows[7]["n_seen"] == one[0][1] + one[1][1]
    assert rows[7]["score"] == pytest.approx(one[0][2] + one[1][2], abs=1e-6) and rows[None]["n_words"] == 2


def test_copies_vouch_for_each_other_and_empty_table(spark):
    texts = ["alpha beta gamma", "alpha beta gamma", "delta epsilon zeta"]
    rows = {r["doc_id"]: r["n_seen"] for r in lm_scoring.score_documents(documents(spark, texts)).collect()}
    assert rows == {0: 2, 1: 2, 2: 0}
    assert lm_scoring.score_documents(documents(spark, [])).count() == 0


def test_bigrams_of_rare_words_are_counted_however_many_words_there_are(spark):
    rare = [f"r{k}" for k in range(66_000)]  # each in two texts, so that no fixed vocabulary of 65 536 holds any
    texts = [" ".join(rare[k:k + 1000]) for k in range(0, 66_000, 1000)] * 2
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(documents(spark, texts)).collect()}
    for i, (n, seen, _) in enumerate(plain(texts)):
        assert (rows[i]["n_words"], rows[i]["n_seen"]) == (n, seen) == (1000, 999), i


def test_rare_words_share_no_unknown_word(spark):
    often = [f"o{k}" for k in range(66_000)]
    texts = [" ".join(often[k:k + 1000] * 2) for k in range(0, 66_000, 1000)] + ["z1 z2 z3 z4", "o1 o5 o9 o13"]
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(documents(spark, texts)).collect()}
    expected = dict(enumerate(plain(texts)))
    assert rows[66]["score"] == pytest.approx(expected[66][2], abs=1e-6)
    assert rows[66]["score"] == pytest.approx(4 * math.log(1 / 132_004) + 3 * math.log(0.4), abs=1e-6)  # words that occur once
    assert rows[67]["score"] > rows[66]["score"]
