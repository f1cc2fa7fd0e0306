"""Quality scores by a factorisation machine over words, structure and metadata.

A document is a sparse vector x: its distinct words by hash, weighted to unit
length, structure statistics of the whole text, and what its row says about it.
Statistics are spread over knots, so that their effect need not be linear. With
a weight w and ``rank`` factors v for each entry,

    z = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j
      = w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

and the score is the logistic function of z. The second line takes time in
proportion to the entries of x, not to their pairs.

Training takes a bounded sample of labelled rows. It is dealt to learners by a
hash of the id; in each round every learner goes on from the shared parameters
over its own rows, and the parameters are averaged by their rows. Scoring is one
pass over all texts, in their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cratewise.llm.storage import stored
from cratewise.llm.text import run_hashes, slices, word_hashes

STATISTICS = ("words", "longest word", "word length", "distinct words", "top word", "repeated runs", "equal lines", "line length",
              "symbols", "digits", "capitals", "stops", "other letters", "stated length", "length as stated")
KNOTS = 16  # per statistic; one more entry says that it is missing
# By byte: what kind of character it belongs to.
KINDS = {"symbols": b"#*$%&|<>{}[]=_/\\^~@+", "digits": b"0123456789", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "stops": b".,;:!?"}


@dataclass(frozen=True)
class FactorModel:
    """``bits``: 2 ** bits word entries; ``bias``, ``weights`` and ``factors`` by entry."""

    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def entries(bits: int) -> int:
    return (1 << bits) + len(STATISTICS) * (KNOTS + 1)


def _repeats(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many of its keys are distinct, and how often its most frequent one occurs."""
    order = np.lexsort((keys, owner))
    who, what = owner[order], keys[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, who[first], np.diff(np.append(first, len(who))))
    return np.bincount(who[first], minlength=rows), top


def _statistics(texts: pa.Array, hashes: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """A row a text, a column a statistic, from 0 to 1; not a number where there is nothing to measure."""
    rows, n = len(texts), np.diff(offsets)
    owner = np.repeat(np.arange(rows), n)
    ends = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
    starts = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    column = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        distinct, top = _repeats(hashes, owner, rows)
        column["words"] = np.log10(1 + n) / 6
        column["distinct words"], column["top word"] = distinct / n, top / n
        runs, inside = run_hashes(hashes, 3), owner[:max(0, len(owner) - 2)]
        within = inside == owner[2:] if len(owner) > 2 else np.zeros(0, bool)
        seen, _ = _repeats(runs[within], inside[within], rows)
        column["repeated runs"] = 1 - seen / np.maximum(n - 2, 0)
        lines = pc.split_pattern(texts, "\n")
        of = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
        flat = lines.flatten().dictionary_encode()
        filled = (pc.binary_length(pc.ascii_trim_whitespace(lines.flatten())).to_numpy(zero_copy_only=False) > 0) if len(of) else np.zeros(0, bool)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(of[filled], minlength=rows)
        apart, _ = _repeats(codes[filled], of[filled], rows)
        column["equal lines"], column["line length"] = 1 - apart / total, np.log10(1 + n / total) / 4

        def share(table: np.ndarray) -> np.ndarray:
            before = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            return before[ends] - before[starts]

        solid = np.ones(256, bool)
        solid[[32, 9, 10, 11, 12, 13]] = False
        filling = share(solid)
        for name, kind in KINDS.items():
            table = np.zeros(256, bool)
            table[list(kind)] = True
            column[name] = np.sqrt(share(table) / filling)  # small shares matter most
        column["other letters"] = share(np.arange(256) >= 128) / filling
        column["word length"] = filling / n / 16
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid[data], [False]]).astype(np.int8)))
        begin, length = edge[::2], edge[1::2] - edge[::2]
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, np.minimum(np.searchsorted(ends, begin, side="right"), rows - 1), length)
        column["longest word"] = np.where(n > 0, np.log10(1 + longest) / 4, np.nan)
        real = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        column["stated length"] = np.log10(1 + np.maximum(stated, 0)) / 7
        column["length as stated"] = np.where(np.isnan(stated), np.nan, (stated == real).astype(float))
    return np.column_stack([column[name] for name in STATISTICS]).astype(float)


def document_entries(texts: pa.Array, stated: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry numbers and values of all texts of a batch, and the offsets of each text in them."""
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    hashes, offsets = word_hashes(texts)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    slot = owner.astype(np.int64) << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64)
    held, counts = np.unique(slot, return_counts=True)
    who, value = held >> bits, np.log1p(counts)
    length = np.sqrt(np.bincount(who, value ** 2, minlength=rows))
    value = value / length[who]
    found = _statistics(texts, hashes, offsets, stated)
    place = np.clip(found, 0, 1) * (KNOTS - 1)
    low = np.minimum(np.floor(place), KNOTS - 2)
    part = place - low
    missing = np.isnan(found)
    first = (1 << bits) + np.arange(len(STATISTICS)) * (KNOTS + 1)
    at = np.where(missing, KNOTS, low).astype(np.int64) + first
    row = np.repeat(np.arange(rows), len(STATISTICS))
    second = ~missing.ravel()
    all_rows = np.concatenate([who, row, row[second]])
    index = np.concatenate([held & ((1 << bits) - 1), at.ravel(), at.ravel()[second] + 1])
    weight = np.concatenate([value, np.where(missing, 1, 1 - part).ravel(), part.ravel()[second]])
    order = np.argsort(all_rows, kind="stable")
    return index[order].astype(np.int32), weight[order].astype(np.float32), np.searchsorted(all_rows[order], np.arange(rows + 1))


def linear_time_scores(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, model: FactorModel) -> tuple[np.ndarray, np.ndarray]:
    """z of each document, and the sums of v x that its gradient needs; each document has entries."""
    starts = offsets[:-1]
    single = np.add.reduceat(model.weights[index] * value, starts)
    parts = model.factors[index] * value[:, None]
    sums = np.add.reduceat(parts, starts, axis=0)
    squares = np.add.reduceat(parts ** 2, starts, axis=0)
    return model.bias + single + 0.5 * (sums ** 2 - squares).sum(axis=1), sums


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _learn(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, labels: np.ndarray, flat: np.ndarray, slopes: np.ndarray,
           bits: int, rank: int, epochs: int, seed: int, rate: float, decay: float, batch: int = 64) -> None:
    """Adaptive gradient steps over the rows, in place: ``flat`` holds bias, weights and factors, ``slopes`` their squared gradients."""
    m = entries(bits)
    weights, factors = flat[1:1 + m], flat[1 + m:].reshape(m, rank)
    w_slope, v_slope = slopes[1:1 + m], slopes[1 + m:].reshape(m, rank)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            rows = order[k:k + batch]
            size = offsets[rows + 1] - offsets[rows]
            of = np.repeat(np.arange(len(rows)), size)
            begins = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(begins[-1]) - np.repeat(begins[:-1], size) + np.repeat(offsets[rows], size)
            i, x = index[at], value[at]
            z, sums = linear_time_scores(i, x, begins, FactorModel(bits, float(flat[0]), weights, factors))
            error = (logistic(z) - labels[rows]) / len(rows)
            slopes[0] += error.sum() ** 2
            flat[0] -= rate * error.sum() / np.sqrt(slopes[0])
            by = np.argsort(i, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(i[by]) > 0]))
            used, pull = i[by][first], (error[of] * x)[by]
            step = np.add.reduceat(pull, first) + decay * weights[used]
            w_slope[used] += step ** 2
            weights[used] -= rate * step / np.sqrt(w_slope[used])
            step = np.add.reduceat(pull[:, None] * (sums[of[by]] - factors[i[by]] * x[by][:, None]), first, axis=0) + decay * factors[used]
            v_slope[used] += step ** 2
            factors[used] -= rate * step / np.sqrt(v_slope[used])


def _source(docs: DataFrame, id: str, text: str, stated: str) -> DataFrame:
    length = F.col(stated).cast("double") if stated in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), length.alias("stated"))


def _stated(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("stated"), float("nan")).to_numpy(zero_copy_only=False)


def fit_factors(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", stated: str = "n_chars",
                label: str = "quality", limit: int = 20_000, bits: int = 14, rank: int = 8, learners: int = 4, rounds: int = 6,
                epochs: int = 3, rate: float = 0.1, decay: float = 1e-5, seed: int = 1) -> FactorModel:
    """Parameters learned from at most ``limit`` labelled documents, those with the least hashes of their ids.

    A document counts once, with the least of its labels; rows that repeat an id
    count as one of them. Null labels and ids don't count. Without labelled
    documents every parameter stays where it began, and all scores are near 0.5.
    """
    chosen = (labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id"))
              .agg(F.min(label).cast("float").alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            index, value, offsets = document_entries(batch.column("text"), _stated(batch), bits)
            cut = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(cut, pa.array(index)),
                                              pa.ListArray.from_arrays(cut, pa.array(value))], names=["id", "label", "index", "value"])

    source = _source(docs, id, text, stated).join(F.broadcast(chosen), "id")  # at most ``limit`` ids
    kind = source.schema["id"].dataType.simpleString()
    found = source.select("id", "label", "text", "stated").mapInArrow(work, f"id {kind}, label float, index array<int>, value array<float>")
    sample = stored(found.groupBy("id").agg(F.min(F.struct("label", "index", "value")).alias("row")).select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(learners)).cast("int").alias("learner"), "id", "row.*"), "labelled")

    m = entries(bits)
    flat = np.concatenate([np.zeros(1 + m), np.random.default_rng(seed).normal(0, 0.05, m * rank)])
    slopes = np.full(len(flat), 1e-4)
    for k in range(rounds):
        shared = (flat.astype(np.float32), slopes.astype(np.float32), seed + k)

        def learn(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks().sort_by("id")
            lists, values = rows.column("index").combine_chunks(), rows.column("value").combine_chunks()
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            own, slope = shared[0].astype(float), shared[1].astype(float)
            _learn(lists.flatten().to_numpy(), values.flatten().to_numpy().astype(float), offsets,
                   rows.column("label").to_numpy().astype(float), own, slope, bits, rank, epochs, shared[2], rate, decay)
            return pa.table({"n": pa.array([len(rows)], pa.int64()), "own": pa.array([own.astype(np.float32).tobytes()], pa.binary()),
                             "slope": pa.array([slope.astype(np.float32).tobytes()], pa.binary())})

        done = sample.groupBy("learner").applyInArrow(learn, "n bigint, own binary, slope binary").collect()  # a row a learner
        if not done:
            break
        share = np.array([r["n"] for r in done]) / sum(r["n"] for r in done)
        flat = sum(s * np.frombuffer(r["own"], np.float32).astype(float) for s, r in zip(share, done))
        slopes = sum(s * np.frombuffer(r["slope"], np.float32).astype(float) for s, r in zip(share, done))
    return FactorModel(bits, float(flat[0]), flat[1:1 + m].astype(np.float32), flat[1 + m:].reshape(m, rank).astype(np.float32))


def score_quality(docs: DataFrame, model: FactorModel, *, id: str = "doc_id", text: str = "text", stated: str = "n_chars") -> DataFrame:
    """id, score (0 to 1, higher: better): a row for each row of ``docs``.

    Null and empty texts have no words; their missing statistics score them.
    A missing or null ``stated`` length is a missing statistic too. Repeated rows
    and null ids are kept; other columns are neither read nor returned.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            index, value, offsets = document_entries(batch.column("text"), _stated(batch), model.bits)
            z, _ = linear_time_scores(index, value, offsets, model)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(logistic(z.astype(float)))], names=["id", "score"])

    source = _source(docs, id, text, stated)
    out = source.mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id), "score")
