import pytest

from cratewise.llm import containment
from tests.llm.common import clashing, documents, prose, sample_texts, shingles, words

ITEMS = "item_id bigint, text string"


def plain(texts, items):
    for i, t in enumerate(texts):
        for k, item in items:
            if k is not None and len(words(item)) >= 5:
                need, have = shingles(item), shingles(t) if len(words(t)) >= 5 else frozenset()
                if 100 * len(need & have) >= 80 * len(need):
                    yield i, k, len(need), len(need & have)


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_equals_comparing_every_pair(spark, shape):
    long = sample_texts()[13].split()
    item, w = prose(77, 40), prose(77, 40).split()
    broken = [" ".join(w[:k] + ["other"] + w[k + 1:]) for k in (3, 17, 36)]
    items = [(1, item), (2, None), (3, ""), (4, "too few words"), (None, item), (5, " ".join(long[5000:5015])), (6, item.upper()), (7, prose(78, 300)),
             (8, "a b c d e"), (9, "For " * 30), (9, "For " * 30)]
    texts = [*sample_texts(), prose(1, 50) + " " + item + " " + prose(2, 5000), *broken, " ".join(w[:30]), " ".join(w[:36]), prose(78, 300)[:1500], "x a B c d E y"]
    found = containment.contained_items(shape(documents(spark, texts)), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(tuple(r) for r in found) == sorted(set(plain(texts, items)))
    assert {r["doc_id"] for r in found if r["item_id"] == 5} == {13}


def test_sketches_reach_every_sufficient_document(spark):
    items = [(n, prose(100 + n, n, 5000)) for n in range(5, 130)]
    for r in containment.item_sketches(spark.createDataFrame(items, ITEMS)).collect():
        missed = r["n_item"] - -(-80 * r["n_item"] // 100)
        assert len(r["sketch"]) == len(set(r["sketch"])) > missed or len(r["sketch"]) == r["n_item"]


def test_filter_and_empty_tables(spark):
    docs, items = documents(spark, [prose(1, 50), prose(2, 50), None]), spark.createDataFrame([(1, prose(1, 30))], ITEMS)
    found = containment.contained_items(docs, items)
    assert {r["doc_id"] for r in containment.without_contaminated(docs, found).collect()} == {1, 2}
    assert containment.contained_items(docs, items.limit(0)).count() == 0
    assert containment.contained_items(docs.limit(0), items).count() == 0
