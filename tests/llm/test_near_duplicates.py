import random

import pytest

from cratewise.llm import minhash_tensor
from cratewise.llm.components import connected_components
from tests.llm.common import clashing, components, documents, prose, sample_texts, shingles


def varied(seed: int, n: int, changes: int) -> str:
    w = prose(seed, n).split()
    rng = random.Random(changes * 1000 + seed)
    for k in rng.sample(range(n), changes):
        w[k] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def check(spark, docs, texts):
    rows = minhash_tensor.near_duplicates(docs).collect()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    expected = components(sets)
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), expected[i], expected[i] == i), i


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_awkward_texts(spark, shape):
    check(spark, shape(documents(spark)), sample_texts())


def test_links_near_the_threshold_and_chains(spark):
    texts = [varied(s, 400, c) for s in range(4) for c in (0, 0, 2, 4, 5, 6, 7, 8, 9, 12, 20)]
    w = prose(9, 500).split()
    texts += [" ".join(w[k * 16:k * 16 + 300]) for k in range(12)]  # each links to its neighbours only
    check(spark, documents(spark, texts), texts)


def test_nothing_is_linked_without_words_and_ids(spark):
    docs = spark.createDataFrame([(1, ""), (2, ""), (3, None), (None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f")], "doc_id bigint, text string")
    rows = minhash_tensor.near_duplicates(docs).collect()
    assert len(rows) == 6 and all(r["kept"] for r in rows)
    assert minhash_tensor.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(100, 400)] + [(7, k) for k in range(10, 60)] + [(500 + k, 500 + (k + 1) % 30) for k in range(30)] + [(3, 3)]
    rows = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    found = {r["id"]: r["component"] for r in rows}
    assert found == {**{k: 100 for k in range(100, 401)}, 7: 7, **{k: 7 for k in range(10, 60)}, **{k: 500 for k in range(500, 530)}}
