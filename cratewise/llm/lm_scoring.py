"""Stupid-backoff scores of all documents under the corpus's own n-gram counts.

With counts c without the document's own occurrences, so that a text cannot
vouch for itself, and N words in all other documents:

    S(w | u v) = c(u v w) / c(u v)     if another document has u v w
               = backoff * S(w | v)    otherwise
    S(w)       = max(c(w), 1) / N

Every n-gram up to the order is counted. Documents are cut into words once, and
stored as batches of word numbers. A batch holds each of its n-grams once and
asks for its count in the bucket that its hash falls into; there the counts of
all batches are added up and sent back, in the order asked. So what is shuffled
is a few bytes for each distinct n-gram of a batch, however often it occurs, and
an n-gram that every document holds is one row a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cratewise.llm.storage import stored
from cratewise.llm.text import mix, slices, word_hashes

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 5 << 20  # of text in a batch, if no single text is longer
BUCKET_WORDS = 1_000_000  # words of the corpus per bucket and order


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers, their bytes grouped by significance and compressed."""
    raw = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if len(x) else b"")


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of about BATCH_BYTES of text, made of smaller or larger ones."""
    held, size = [], 0
    for batch in slices(batches, "text", BATCH_BYTES):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def token_batches(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, n, ids, sizes, words, codes): documents as word numbers, stored; ``words`` are the hashes behind the numbers, ascending."""
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, rows in enumerate(_gathered(batches)):
            hashes, offsets = word_hashes(rows.column("text").combine_chunks())
            found, codes = np.unique(hashes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | k], pa.int64()), pa.array([len(codes)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("id").combine_chunks()),
                pa.array([packed(np.diff(offsets))], pa.binary()), pa.array([packed_sorted(found)], pa.binary()),
                pa.array([packed(codes)], pa.binary())], names=["batch", "n", "ids", "sizes", "words", "codes"])

    kind = source.schema["id"].dataType.simpleString()
    return stored(source.mapInArrow(work, f"batch bigint, n bigint, ids array<{kind}>, sizes binary, words binary, codes binary"), "tokens")


def _grams(words: bytes, codes: bytes, sizes: bytes, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The row of each word; and for each order, the n-gram that ends at each word and whether the text has one there."""
    n = unpacked(sizes).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hashes = unpacked_sorted(words)[unpacked(codes).astype(np.int64)]
    out, gram = [(hashes, np.ones(len(hashes), bool))], hashes
    for k in range(1, order):
        before = np.concatenate([[np.uint64(0)], gram[:-1]]) if len(gram) else gram
        with np.errstate(over="ignore"):
            gram = mix(before * GOLDEN + hashes)
        out.append((gram, within >= k))
    return owner, out


def _asked(batches: DataFrame, order: int, buckets: int) -> DataFrame:
    """(part, batch, keys, counts): the distinct n-grams of each batch, by order and bucket of their hash."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in rows for r in batch.to_pylist()):
            _, grams = _grams(row["words"], row["codes"], row["sizes"], order)
            for k, (gram, there) in enumerate(grams):
                keys, counts = np.unique(gram[there], return_counts=True)
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array((k * buckets + full).astype(np.int32)), pa.array([row["batch"]] * len(full), pa.int64()),
                    pa.array([packed_sorted(keys[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
                    pa.array([packed(counts[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())], names=["part", "batch", "keys", "counts"])

    return batches.select("batch", "words", "codes", "sizes").mapInArrow(work, "part int, batch bigint, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(batch, part, totals): the counts of all batches together, in the order in which each batch asked."""
    def work(rows: pa.Table) -> pa.Table:
        keys = [unpacked_sorted(x) for x in rows.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in rows.column("counts").to_pylist()])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(found), np.uint64)
        np.add.at(totals, at, counts)
        parts = np.split(totals[at], np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"batch": rows.column("batch"), "part": rows.column("part"), "totals": pa.array([packed(x) for x in parts], pa.binary())})

    return asked.groupBy("part").applyInArrow(work, "batch bigint, part int, totals binary")


def _own(gram: np.ndarray, there: np.ndarray, owner: np.ndarray, totals: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the count of the n-gram that ends there in all documents and, if asked for, in its own; 0 where there is none."""
    found, at = np.unique(gram[there], return_inverse=True)
    every, own = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    every[there] = totals[at].astype(np.int64)
    if leave_out and len(found):
        _, place, counts = np.unique(owner[there] * len(found) + at, return_inverse=True, return_counts=True)
        own[there] = counts[place]
    return every, own


def score_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", order: int = 2, backoff: float = 0.4,
                    leave_out: bool = True) -> DataFrame:
    """id, n_words, n_seen (words scored without backing off to order one), score and per_word.

    ``score`` is the sum of natural logs of S over the words, lower-cased within
    ASCII; ``per_word`` its mean. ``leave_out`` takes a document's own
    occurrences from every count, or from none; a word that no other document
    has counts as one occurrence. Null and empty texts have no words, score 0
    and null ``per_word``. Each row leaves out its own occurrences; rows that
    repeat an id, or have none, are then added up. Other columns don't matter.
    """
    batches = token_batches(docs, id=id, text=text)
    total = batches.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_WORDS))
    kind = batches.schema["ids"].dataType.elementType.simpleString()
    step_down = math.log(backoff)

    def work(rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows.column("part").to_pylist(), range(len(rows))))
        batch = rows.slice(parts[0][1], 1).to_pylist()[0]  # part -1
        answers: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(order)]
        for part, at in parts[1:]:
            answers[part // buckets].append(unpacked(rows.column("totals")[at].as_py()))
        owner, grams = _grams(batch["words"], batch["codes"], batch["sizes"], order)
        n = unpacked(batch["sizes"]).astype(np.int64)
        outside = np.maximum(total - n, 1) if leave_out else np.full(len(n), max(total, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            every, own = _own(*grams[0], owner, np.concatenate(answers[0]), leave_out)
            value = np.log(np.maximum(every - own, 1)) - np.log(outside)[owner]
            seen = np.zeros(len(owner), bool)
            context = (every - own).astype(float)
            for k in range(1, order):
                there = grams[k][1]
                every, own = _own(*grams[k], owner, np.concatenate(answers[k]), leave_out)
                others = (every - own).astype(float)
                held = there & (others > 0)
                ratio = np.log(others) - np.log(np.concatenate([[np.nan], context[:-1]]) if len(context) else context)
                value = np.where(held, ratio, value + np.where(there, step_down, 0.0))
                seen |= held
                context = others
        return pa.table({"id": rows.column("ids")[parts[0][1]].values, "n_words": pa.array(n),
                         "n_seen": pa.array(np.bincount(owner, seen, minlength=len(n)).astype(np.int64)),
                         "score": pa.array(np.bincount(owner, value, minlength=len(n)).astype(float))})

    answers = _answered(_asked(batches, order, buckets))
    empty = {"ids": f"array<{kind}>", "sizes": "binary", "words": "binary", "codes": "binary"}
    both = batches.select("batch", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("totals"), *empty).unionByName(
        answers.select("batch", "part", "totals", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))
    scored = both.groupBy("batch").applyInArrow(work, f"id {kind}, n_words bigint, n_seen bigint, score double")
    sums = scored.groupBy(F.col("id").alias(id)).agg(F.sum("n_words").alias("n_words"), F.sum("n_seen").alias("n_seen"), F.sum("score").alias("score"))
    return sums.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
