import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cratewise.llm import repeats
from tests.llm.common import clashing, documents, prose, sample_texts


def plain(texts, length):
    bodies, seen, twice = [(t or "").encode() for t in texts], set(), set()
    for b in bodies:
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            (twice if s in seen else seen).add(s)
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k:k + length] in twice:
                gone[k:k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        yield (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(), int((~gone).sum()),
               ",".join(f"{x}:{y}" for x, y in zip(edges[::2], edges[1::2])))


def check(docs, texts, length=400, **more):
    rows = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeated_bytes(docs, length=length, **more).collect()}
    for i, expected in enumerate(plain(texts, length)):
        assert rows[i] == expected, i


def test_cover_leads_every_pair_into_the_sample():
    cover = set(repeats.COVER)
    for shift in range(repeats.MODULUS):
        assert any((c + shift) % repeats.MODULUS in cover for c in cover), shift


def test_helpers():
    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    marks = repeats.fingerprints(data, 7)
    strings = [bytes(data[k:k + 7]) for k in range(len(data) - 6)]
    assert len({*zip(marks.tolist(), strings)}) == len({*marks.tolist()}) == len({*strings})
    values = np.random.default_rng(2).integers(0, 1 << 40, 1000).astype(np.uint64)
    assert (repeats.least_inside(values, 37) == [values[k:k + 37].min() for k in range(964)]).all()


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_awkward_texts(spark, shape):
    check(shape(documents(spark)), sample_texts())


def test_lengths_around_the_bound_and_shifts(spark):
    rng, passage = random.Random(4), prose(1, 200)
    texts = [prose(50 + k, 40 + k)[:rng.randrange(50, 200)] + passage[k % 7:k % 7 + 380 + 3 * k] + prose(90 + k, 30) for k in range(14)]
    texts += [passage[:399], passage[:400], passage[10:410] * 2, "é" * 300, "é" * 201, "ab" * 500]
    check(documents(spark, texts).repartition(3), texts)
    check(documents(spark, texts).repartition(3), texts, bucket_bytes=4096)


def test_chunks_meet(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1500)
    monkeypatch.setattr(repeats, "_TABLES", {})
    data = np.random.default_rng(5).integers(0, 3, 9000).astype(np.uint8)
    small = repeats.fingerprints(data, 400)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 16)
    monkeypatch.setattr(repeats, "_TABLES", {})
    assert (small == repeats.fingerprints(data, 400)).all()


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = prose(3, 200)
    docs = spark.createDataFrame([(1, long), (1, long), (None, prose(4, 200)), (None, None), (1, prose(5, 200))], "doc_id bigint, text string")
    rows = repeats.repeated_bytes(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"] == r["n_bytes"] > 0) for r in rows) == [(0, False), (0, False), (1, False), (1, True), (1, True)]
    assert repeats.repeated_bytes(docs.limit(0)).count() == 0


def test_one_passage_in_ten_thousand_texts(spark):
    passage = prose(11, 110)
    texts = [f"{prose(k, 3)} {passage} {prose(-k, 2)}" for k in range(10_000)]
    assert len(passage) > 500
    rows = repeats.repeated_bytes(documents(spark, texts).repartition(6), bucket_bytes=1 << 16).collect()
    assert len(rows) == 10_000 and all(r["n_removed"] >= len(passage) and r["n_spans"] == 1 and r["n_kept"] < 60 for r in rows)


def test_a_task_asks_for_a_string_twice_at_most():
    passage = prose(11, 110)
    batches = [pa.RecordBatch.from_pydict({"a": [k], "b": [k * 7919], "text": [passage + prose(100 + k, 80)]}) for k in range(12)]
    rows = [r for batch in repeats._rank_sample(218, 1)(iter(batches)) for r in batch.to_pylist()]
    asked = [m for r in rows if not r["known"] for m in np.unique(np.frombuffer(r["marks"], np.uint64))]
    assert max(asked.count(m) for m in set(asked)) == 2
    answers = repeats._answer_sample(pa.Table.from_pylist(rows))
    own = [repeats.fingerprints(np.frombuffer(passage.encode(), np.uint8), 218)[k] for k in range(len(passage) - 217) if k % repeats.MODULUS in repeats.COVER]
    held = {(a, np.uint64(m & (1 << 64) - 1)) for a, m in zip(answers["a"].to_pylist(), answers["mark"].to_pylist())}
    assert held == {(k, m) for k in range(12) for m in own}


def test_forgotten_strings_are_asked_for_again(monkeypatch):
    monkeypatch.setattr(repeats, "REMEMBERED", 8)
    rng, memory, times = np.random.default_rng(3), repeats._Asked(), {}
    for _ in range(300):
        marks = np.unique(rng.integers(0, 20, 4).astype(np.uint64))
        for m, done in zip(marks.tolist(), memory.settled(marks, np.zeros(len(marks), np.uint32))):
            assert not done or times[m] >= 2
            times[m] = times.get(m, 0) + (not done)
        assert len(memory.marks) <= 8 and (np.diff(memory.marks.astype(int)) > 0).all()


def test_equal_marks_with_other_checks_are_no_repeats():
    def bucket(checks):
        packed = lambda v, t: [np.array([x], t).tobytes() for x in v]
        return pa.table({"bucket": [0, 0], "known": [False, False], "keys": [np.array([k, k]).tobytes() for k in (1, 2)],
                         "starts": packed([5, 9], np.int64), "sizes": packed([1, 1], np.int64),
                         "marks": packed([77, 77], np.uint64), "checks": packed(checks, np.uint32)})
    assert repeats._sort_bucket(bucket([3, 4])).num_rows == 0
    assert repeats._sort_bucket(bucket([3, 3])).column("start").to_pylist() == [5, 9]
