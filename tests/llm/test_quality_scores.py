"""op8's ratios, threshold and verdicts from plain counters."""

import math
from collections import Counter

import numpy as np
import xxhash

from cratewise.llm import queries
from tests.llm.common import words

SF, BUCKETS = "/root/testdata/sf0.001", 1 << 16


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def of_word(w):
    return signed(xxhash.xxh64(w.encode(), seed=42).intdigest())


def of_id(i):
    return signed(xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), seed=42).intdigest())


def test_ratios_and_verdicts_from_counters(spark):
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality, toxic = {}, {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        quality[r["doc_id"]] = min(quality.get(r["doc_id"], 9), r["quality"])
        toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"])
    trusted = [i for i in quality if quality[i] == 1 and toxic[i] == 0]
    grams = {i: [of_word(w) % BUCKETS for w in w] for i, w in docs.items()}
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted and of_id(i) % 2 == 0:
            good.update(g)
    n_raw, n_good = sum(raw.values()), sum(good.values())

    def ratio(i):
        total = 0.0
        for g in grams[i]:
            total += math.log((good[g] + 1) / (n_good + BUCKETS)) - math.log((raw[g] + 1) / (n_raw + BUCKETS))
        return total / len(grams[i]) if grams[i] else None

    held = [ratio(i) for i in trusted if of_id(i) % 2 == 1 and i in docs and grams[i]]
    threshold = float(np.quantile(held, 0.01))
    rows = queries.op8_quality_llr(spark, SF).collect()
    assert len(rows) == len(docs) and n_good and held
    for r in rows:
        want = ratio(r["doc_id"])
        assert (r["llr"] is None) == (want is None)
        if want is not None:
            assert abs(r["llr"] - want) < 1e-9
        if want is None or abs(want - threshold) > 1e-9:
            assert r["kept"] == (not r["base_failed"] and want is not None and want >= threshold), r["doc_id"]
