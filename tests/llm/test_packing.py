import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cratewise.llm import bins, packing
from cratewise.llm.tokens import UnitEncoder
from tests.llm.common import clashing, documents, sample_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = UnitEncoder(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def test_cover_of_odd_texts():
    for text in [*sample_texts(), "don't we'll  x", " lead", "trail ", "\n a\n b \n", "<|endoftext|> y <|endoftext|>z", "a\x1c\x1db !\x1c", "日本語 текст 𝄞",
                 " wide  x", "tab\tx \ty", "a  b   c", "!? ?! 12ab34"]:
        for _ in range(2):  # with an empty and with a filled cache
            assert np.frombuffer(ENCODER.encode(text or ""), "<u4").tolist() == ids(text)[:-1], repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab C'1,.é \n\t \x1c<|日"), max_size=40))
def test_units_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)[:-1]


def check_plan(plan, counts, capacity):
    held = np.zeros(capacity + 1, np.int64)
    for lengths, times in zip(plan.lengths, plan.times):
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            held[n] += times
    assert (held == counts).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_hold_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    for plan in (bins.exact_complement(counts, 64), bins.best_fit_decreasing(counts, 64)):
        check_plan(plan, counts, 64)
        n, best = sum(plan.times), -(-sum(lengths) // 64)
        assert best <= n <= max(best, 11 * best / 9 + 1)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    open_bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(open_bins) if left >= n]
        if fits:
            open_bins[min(fits, key=lambda k: open_bins[k])] -= n
        else:
            open_bins.append(100 - n)
    plan = bins.best_fit_decreasing(np.bincount(lengths, minlength=101), 100)
    assert sum(plan.times) == len(open_bins)


def test_combinations_fill_gaps_exactly():
    counts = np.zeros(101, np.int64)
    counts[[70, 30, 60, 25, 15, 50, 20, 16, 14]] = [4, 4, 3, 3, 3, 2, 2, 2, 2]
    assert sum(bins.exact_complement(counts, 100).times) == 9


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_pieces_round_trip(spark, shape):
    texts = sample_texts()
    rows = packing.pack_exact(shape(documents(spark, texts)), PATH, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        expected, at = ids(text), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            chunk = np.array(expected[at:at + r["length"]], "<u4").tobytes()
            assert zlib.crc32(chunk) == r["ids_crc32"] and (r["length"] == 256 or k == 0)
            at += r["length"]
        assert at == len(expected)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(ids(t)) for t in texts)
    assert len(by_sequence) <= -(-total // 256) + 2


def test_matrix_round_trip(spark, tmp_path):
    texts = sample_texts()
    docs = documents(spark, texts)
    packing.write_packed(packing.packed_matrix(docs, PATH, capacity=256), str(tmp_path / "out"))
    pieces = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        row = np.frombuffer(r["input_ids"], "<u2")
        assert len(row) == r["n_tokens"] == r["cu_seqlens"][-1] and r["cu_seqlens"][:-1] == r["position_resets"]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            pieces[doc].append((start, row[r["cu_seqlens"][k]:r["cu_seqlens"][k + 1]].tolist()))
    for i, text in enumerate(texts):
        assert sum((p for _, p in sorted(pieces[i])), []) == ids(text)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["same text here"])
    assert packing.pack_exact(docs.unionByName(docs), PATH).count() == 2
    assert packing.pack_exact(docs.limit(0), PATH).count() == 0
    assert packing.packed_matrix(docs.limit(0), PATH).count() == 0
