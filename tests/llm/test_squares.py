import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cratewise.llm import queries
from cratewise.llm.squares import SquareCatchers, find_runs

from .common import clashing, documents, prose, sample_texts, words


def plain_runs(w, least=6, exponent=4):
    """By the definition, trying every period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(
                    all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def by_catchers(codes, steps, **options):
    catchers, at = SquareCatchers(len(codes), **options), 0
    while at < len(codes):
        k = next(steps)
        catchers.append(np.array(codes[at:at + k], np.int64))
        at += k
    return sorted(catchers.finish(), key=lambda r: (r[0], r[2]))


def repetitive(rng, n, alphabet):
    out = []
    while len(out) < n:
        root = [rng.randrange(alphabet) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 12, 17]))]
        out += (root * rng.randrange(1, 9))[:rng.randrange(1, 60)]
    return out[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_agree_with_their_definition_however_words_come(seed):
    rng = random.Random(seed)
    codes = repetitive(rng, rng.randrange(1, 260), rng.choice([1, 2, 2, 3, 6]))
    want = plain_runs(codes)
    for steps in (iter(lambda: 1, 0), iter(lambda: len(codes), 0), iter(lambda: rng.randrange(1, 20), 0)):
        assert by_catchers(codes, steps) == want
    assert by_catchers(codes, iter(lambda: 7, 0), least=9, exponent=5) == plain_runs(codes, 9, 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=70), st.integers(1, 9))
def test_two_letters(codes, step):
    assert by_catchers(codes, iter(lambda: step, 0)) == plain_runs(codes)


def test_long_repetitions_take_little_time():
    """Words all alike, a long root repeated, and a run in a run: far below quadratic work."""
    rng = np.random.default_rng(1)
    root = rng.integers(0, 1000, 25000)
    parts = [np.zeros(300000, np.int64), np.tile(root, 6), np.tile([1, 2], 100000), np.tile([1] * 9 + [2], 20000)]
    codes = np.concatenate([np.append(part, 5000 + i) for i, part in enumerate(parts)])
    runs = by_catchers(codes, iter(lambda: 65536, 0))
    assert [(r[1], r[2]) for r in runs if r[2] in (1, 25000, 2, 10) and r[1] > 1000] == [(300000, 1), (150000, 25000), (200000, 2), (200000, 10)]


def texts():
    rng = random.Random(5)
    made = [" ".join(f"x{c}" for c in repetitive(rng, n, 3)) for n in (5, 6, 40, 300)]
    return [*sample_texts(), *made, "a A a A a A a A", "la\tla\nla\x0bla\x0cla\rla", prose(8, 50) + " so" * 9 + " " + prose(9, 40), "一 " * 7]


def test_documents_agree_with_the_definition(spark):
    given_texts = texts()
    rows = {r["doc_id"]: r for r in find_runs(clashing(documents(spark, given_texts)), step=50).collect()}
    assert len(rows) == len(given_texts)
    for i, t in enumerate(given_texts):
        w = words(t)
        want = plain_runs(w) if len(w) < 2000 else None
        got = [(r["start"], r["length"], r["period"]) for r in rows[i]["runs"]]
        assert rows[i]["n_words"] == len(w) and (want is None or got == want)
        assert rows[i]["collapsed"] == kept(w, got)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["x " * 20, "x " * 20])
    odd = docs.selectExpr("cast(null as bigint) as doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(docs.select("doc_id", "text"))
    rows = find_runs(odd).collect()
    assert len(rows) == 6 and all([tuple(r["runs"][0])] == [(0, 20, 1)] and r["collapsed"] == "x" for r in rows)
    assert find_runs(docs.limit(0)).count() == 0


def test_query_follows_the_contract(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.op12_dyadic_runs(spark, sf_dir).collect()}
    given_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(given_docs)
    planted = 0
    for d in given_docs:
        w, h = words(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words(d["text"]))
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 3000:
            continue
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = rows[d["doc_id"]]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(w, runs).encode()).hexdigest()
    assert planted > 10
