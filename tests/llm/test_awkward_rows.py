"""Null ids, repeated rows and clashing columns, for operators that keep a row each."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cratewise.llm import packing, pseudonyms, quality, secret_scan
from tests.llm.common import clashing, documents, prose, sample_texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def awkward(spark):
    texts = sample_texts()[:12] + ["mail a.person@example.org or pay 4111 1111 1111 1111", "password = Zk3/9xQ2vbL0Pq7RtY", prose(21, 80)]
    docs = documents(spark, texts)
    without = docs.where("doc_id in (5, 12, 13)").withColumn("doc_id", F.lit(None).cast("bigint"))
    return docs.unionByName(docs.where("doc_id % 2 = 0")).unionByName(without)


def by_row(rows, columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in rows)


def expected(plain, docs, columns):
    """The answer of each text, once per row of ``docs``."""
    one = {r["doc_id"]: r for r in plain}
    of = {5: 5, 12: 12, 13: 13}
    out, left = Counter(), list(of)
    for r in docs:
        i = r["doc_id"]
        own = one[i] if i is not None else one[left.pop(0)]
        out[tuple(str(i if c == "doc_id" else own[c]) for c in columns)] += 1
    return out


@pytest.mark.parametrize("name", ["op2", "op8", "op10"])
def test_each_row_gets_its_own_answer(spark, name):
    docs = awkward(spark)
    single = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    if name == "op2":
        model, columns = secret_scan.fit_markov(single), ["doc_id", "n_assign", "n_access", "n_hex", "spans"]
        run = lambda d: secret_scan.scan_secrets(d, model)
    elif name == "op8":
        labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
        model, columns = quality.fit_quality(single, labels), ["doc_id", "n_words", "base_failed", "kept"]
        run = lambda d: quality.judge_quality(d, model)
    else:
        columns, run = ["doc_id", "text"], lambda d: pseudonyms.pseudonymize(d, b"key")
    rows = docs.select("doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"] is not None)
    got = by_row(run(docs.select("doc_id", "text")).collect(), columns)
    # Rows without id come in any order, so they are compared without it.
    plain = run(single.select("doc_id", "text")).collect()
    assert got == expected(plain, rows, columns)


def test_packing_keeps_rows_without_id_and_repeats(spark):
    docs = awkward(spark)
    pieces = packing.pack_exact(docs, VOCABULARY).collect()
    assert sum(r["piece"] == 0 for r in pieces) == docs.count()
    assert sum(r["doc_id"] is None and r["piece"] == 0 for r in pieces) == 3
    used = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_matrix_with_clashing_columns(spark):
    docs = awkward(spark)
    plain = packing.packed_matrix(docs, VOCABULARY)
    odd = packing.packed_matrix(clashing(docs), VOCABULARY)
    assert odd.columns == plain.columns and odd.count() == plain.count()
