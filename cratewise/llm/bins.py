"""Packing of token sequences, planned on the counts of each length.

However many documents there are, their pieces have at most ``capacity``
lengths, so the plan is made on one count per length. A pattern is a list of
lengths that share a sequence and the number of sequences filled that way; the
plan's size depends on the number of lengths only. Pieces take the slots of
their length by rank, which needs no ordering across tasks beyond one count
per task and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cratewise.llm.storage import joined_small, stored
from cratewise.llm.text import slices
from cratewise.llm.tokens import encoder


@dataclass
class Patterns:
    """Fillings of sequences: parallel lists of lengths and of how many sequences are filled so."""

    capacity: int
    lengths: list[tuple[int, ...]] = field(default_factory=list)
    times: list[int] = field(default_factory=list)

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.lengths.append(lengths)
            self.times.append(times)

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, end rank, first sequence, offset) of each run of equal slots."""
        out, taken, sequence = [], {}, 0
        for lengths, times in zip(self.lengths, self.times):
            offset = 0
            for n in lengths:
                rank = taken.get(n, 0)
                out.append((n, rank, rank + times, sequence, offset))
                taken[n] = rank + times
                offset += n
            sequence += times
        return out


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first one may be shorter than the others."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, total, capacity)]


def tokenized_pieces(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids, the last id being ``end_id``.

    Stored once: doc_id, piece, start, length, ids_crc32, ``part`` and ``rank``
    (the task that wrote the piece, and how many pieces of that length the task
    wrote before), and with ``keep_ids`` the ids as little-endian bytes, 16 bits
    wide where the vocabulary allows. Null texts count as empty.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    if keep_ids:
        schema += ", ids binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        small = encoder(path).library.get_vocab_size() <= 1 << 16
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows: list[list] = [[] for _ in range(8 if keep_ids else 7)]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(body or "") + end
                for piece, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    chunk = ids[4 * start:4 * (start + length)]
                    values = (doc_id, piece, start, length, zlib.crc32(chunk), part, int(seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        values += (np.frombuffer(chunk, "<u4").astype("<u2").tobytes() if small else chunk,)
                    for column, value in zip(rows, values):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return stored(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(work, schema), "pieces")


def pack_pieces(pieces: DataFrame, plan: Callable[[np.ndarray, int], Patterns], capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with length, part and rank.

    ``plan`` gets the count of each length 0..capacity, at most capacity + 1
    numbers, and returns the patterns.
    """
    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = stored(by_task.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # one row per length
        counts[row["length"]] = row["n"]
    slots = pieces.sparkSession.createDataFrame(
        plan(counts, capacity).slots(), "length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint")
    ranked = joined_small(pieces, by_task.drop("_n"), ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("rank"))
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "_length")),
                         (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return (placed.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))
            .drop("_before", "_rank", "_length", "_from", "_to", "_sequence"))


class BestFit:
    """Best-fit over open sequences, kept as groups of equal filling by remaining capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[list]] = {}  # remaining -> [filling, how many]
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)  # number of groups below each node; leaves are remaining capacities

    def _count(self, left: int, by: int) -> None:
        at = left + self.size
        while at:
            self.tree[at] += by
            at //= 2

    def put(self, filling: tuple[int, ...], times: int) -> None:
        left = self.capacity - sum(filling)
        self.open.setdefault(left, []).append([filling, times])
        self._count(left, 1)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that an open sequence has."""
        at = length + self.size
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None

    def place(self, length: int, count: int) -> None:
        """Place ``count`` pieces of ``length``, each in the open sequence that it fills best."""
        while count:
            left = self.tightest(length)
            if left is None:  # new sequences, filled by as many pieces of this length as fit
                each = self.capacity // length
                full, rest = divmod(count, each)
                if full:
                    self.put((length,) * each, full)
                if rest:
                    self.put((length,) * rest, 1)
                return
            group = self.open[left][-1]
            fits = min(group[1], count)
            group[1] -= fits
            if not group[1]:
                self.open[left].pop()
                self._count(left, -1)
            self.put(group[0] + (length,), fits)
            count -= fits

    def close(self, patterns: Patterns) -> None:
        for groups in self.open.values():
            for filling, times in groups:
                patterns.add(filling, times)


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Patterns:
    """Longest pieces first, each into the open sequence with the least room that holds it."""
    patterns, fit = Patterns(capacity), BestFit(capacity)
    patterns.add((capacity,), int(counts[capacity]))
    for length in range(capacity - 1, 0, -1):
        fit.place(length, int(counts[length]))
    fit.close(patterns)
    return patterns


def exact_complement(counts: np.ndarray, capacity: int) -> Patterns:
    """Fill the gap left by each length, longest first, exactly by one, two or three others.

    The available lengths are the index of single sums; pair and triple sums are
    looked up through it by complement, so a combination is found only while
    counts for all its parts remain. What no combination completes is packed
    by best fit, longest first. Filling short lengths exactly can use up parts
    that best fit needs, so several least lengths for seeking complements are
    planned, and the plan with the fewest sequences is taken.
    """
    plans = [_complement_from(counts, capacity, capacity * share // 16) for share in (0, 4, 6, 8, 10, 12, 14, 15)]
    return min(plans, key=lambda p: sum(p.times))


def _complement_from(counts: np.ndarray, capacity: int, least: int) -> Patterns:
    left, patterns, fit = counts.astype(np.int64).copy(), Patterns(capacity), BestFit(capacity)
    patterns.add((capacity,), int(left[capacity]))
    left[capacity] = 0
    rest: list[tuple[int, int]] = []
    for length in range(capacity - 1, max(least, 1) - 1, -1):
        while left[length]:
            parts = _complement(left, length, capacity - length)
            if parts is None:
                rest.append((length, int(left[length])))
                left[length] = 0
                break
            need = np.bincount((length, *parts), minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((left[used] // need[used]).min())
            left -= need * times
            patterns.add((length, *parts), times)
    rest += [(int(n), int(left[n])) for n in np.flatnonzero(left)[::-1]]
    for length, count in sorted(rest, reverse=True):
        fit.place(length, count)
    fit.close(patterns)
    return patterns


def _complement(left: np.ndarray, length: int, gap: int) -> tuple[int, ...] | None:
    """Available lengths, at most three and none above ``length``, that add up to ``gap``; long ones first."""
    free = left.copy()
    free[length] -= 1
    if gap <= length and free[gap]:
        return (gap,)
    top = min(gap - 1, length)
    a = np.arange(top, (gap - 1) // 2, -1)
    pairs = a[(free[a] > 0) & (free[gap - a] > (2 * a == gap))]
    if len(pairs):
        return int(pairs[0]), int(gap - pairs[0])
    for first in range(min(gap - 2, length), (gap + 2) // 3 - 1, -1):
        if not free[first]:
            continue
        free[first] -= 1
        room = gap - first
        b = np.arange(min(first, room - 1), (room - 1) // 2, -1)
        second = b[(free[b] > 0) & (free[room - b] > (2 * b == room))]
        free[first] += 1
        if len(second):
            return first, int(second[0]), int(room - second[0])
    return None
