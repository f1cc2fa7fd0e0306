"""Runs of repeated words, found online by catchers over dyadic blocks.

A run of period q holds the square of a word of q words at each of its places.
For every power of two b the words are cut into blocks of b. A completed block
[s, s + b) becomes a catcher: it waits for words s + b .. s + 3b and compares
each suffix of b words that an appended word completes with its own block. Equal
suffixes at distance q in [b, 2b) announce squares of period q; a catcher whose
next block agrees at the same distance opens a comparison, which is extended to
the left at once and to the right by the words appended later, until two words
q apart differ. What it has seen is one maximal run, however many squares it
holds. Each appended word meets one catcher a size, so the work is n log n.

Suffixes are compared by 64-bit hashes, made by doubling; comparisons are
extended over the words themselves, so that runs are exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cratewise.llm.text import mix, slices

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SquareCatchers:
    """Runs of at least ``least`` words and ``exponent`` periods in a sequence of integers that grows at its end.

    ``append`` takes any number of words at a time and ``finish`` ends the
    sequence; what they return together doesn't depend on how the words were
    divided. ``longest`` bounds the periods sought (half of it, in powers of two).
    """

    def __init__(self, longest: int, least: int = 6, exponent: int = 4) -> None:
        if exponent < 4:
            raise ValueError("a run must hold two whole blocks beside its first period: exponent 4 or more")
        self.least, self.exponent = least, exponent
        self.words = np.zeros(0, np.int64)  # all that was appended; grows by doubling
        self.n = 0
        sizes = max(1, (longest // exponent).bit_length()) if longest >= exponent else 0
        # By size: hashes of the suffixes the next size needs, hashes of the last two blocks, and the last agreements.
        self.tails = [np.zeros(0, np.uint64) for _ in range(sizes)]
        self.blocks = [(0, np.zeros(0, np.uint64)) for _ in range(sizes)]
        self.agreed = [np.zeros(0, bool) for _ in range(sizes)]
        self.open: list[tuple[int, int, int]] = []  # (period, left, right): words left .. right - 1 equal those a period on
        self.found: list[tuple[int, int, int]] = []
        self.closed: dict[int, int] = {}  # by period, where its last comparison ended
        self.runs: dict[int, tuple[list[int], list[int]]] = {}  # by period, starts and ends of its runs, ascending

    def append(self, more: np.ndarray) -> None:
        if not len(more):
            return
        old, self.n = self.n, self.n + len(more)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.zeros(max(len(more), old), np.int64)])
        self.words[old:self.n] = more
        self.open = [advanced for q, left, right in self.open if (advanced := self._advance(q, left, right))]
        hashes, first = more.astype(np.uint64), old  # of the suffixes of b words that begin at first, first + 1, ...
        for k in range(len(self.tails)):
            b = 1 << k
            if k:
                half = b >> 1
                # A suffix of b words is one of b / 2 and the one that follows it.
                joined = np.concatenate([self.tails[k - 1], hashes])
                self.tails[k - 1] = joined[max(0, len(joined) - half):]
                first += len(hashes) - len(joined)
                with np.errstate(over="ignore"):
                    hashes = mix(joined[:-half] * np.uint64(0x9E3779B97F4A7C15) + joined[half:]) if len(joined) > half else joined[:0]
            if not len(hashes):
                return  # longer suffixes are not complete yet either
            self._meet(k, first, hashes)

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period)."""
        for q, left, right in self.open:
            self._close(q, left, right)
        self.open = []
        return self.found

    def _meet(self, k: int, first: int, hashes: np.ndarray) -> None:
        """Compare each new suffix with the block that waits for it, and open comparisons where two agree in a row."""
        b = 1 << k
        base, held = self.blocks[k]
        at = np.arange(first, first + len(hashes))
        new = np.flatnonzero(at % b == 0)
        held = np.concatenate([held, hashes[new]])
        block = at // b - 1 - base
        known = block >= 0
        agree = known & (held[np.maximum(block, 0)] == hashes)
        keep = max(0, len(held) - 2)
        self.blocks[k] = (base + keep, held[keep:])
        # The same distance one block earlier must agree too.
        seen = np.concatenate([self.agreed[k], agree])
        self.agreed[k] = seen[max(0, len(seen) - b):]
        if len(seen) <= b:
            return
        pairs = np.flatnonzero(seen[b:] & seen[:-b])
        if len(pairs):
            t = first + len(hashes) - len(seen) + pairs  # where the earlier suffix begins
            s = (t // b - 1) * b
            self._open(b, s, t - s)

    def _open(self, b: int, starts: np.ndarray, periods: np.ndarray) -> None:
        """Words starts .. starts + 2b - 1 equal those a period on: extend each such stretch once."""
        keep = ~self._inside(b, starts, periods)
        starts, periods = starts[keep], periods[keep]
        order = np.lexsort((starts, periods))
        starts, periods = starts[order], periods[order]
        i = 0
        while i < len(starts):
            s, q = int(starts[i]), int(periods[i])
            end = int(np.searchsorted(periods, q, side="right"))
            over = next((right for p, left, right in self.open if p == q and left <= s < right), self.closed.get(q, -1))
            if over <= s:
                left, over = self._left(s, q), self._right(s, q)
                if over + q == self.n:
                    self.open.append((q, left, over))
                else:
                    self._close(q, left, over)
            i += max(1, int(np.searchsorted(starts[i:end], over)))

    def _inside(self, b: int, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """Which stretches lie inside a run of a divisor of their period, where they announce nothing new."""
        out, ends = np.zeros(len(starts), bool), starts + periods + b
        low = int(starts.min(initial=0))
        for p, left, right in self.open:
            out |= (starts >= left) & (ends <= right + p) & (periods % p == 0) & (periods != p)
        for p, (lefts, rights) in self.runs.items():
            tail = bisect_right(rights, low)  # runs of one period begin and end in the same order
            if p < 2 * b and tail < len(rights):
                first, last = np.array(lefts[tail:]), np.array(rights[tail:])
                at = np.searchsorted(first, starts, side="right") - 1
                out |= (at >= 0) & (ends <= last[np.maximum(at, 0)]) & (periods % p == 0) & (periods != p)
        return out

    def _left(self, s: int, q: int) -> int:
        step = 64
        while s > 0:
            low = max(0, s - step)
            differ = np.flatnonzero(self.words[low:s] != self.words[low + q:s + q])
            if len(differ):
                return low + int(differ[-1]) + 1
            s, step = low, step * 4
        return 0

    def _right(self, s: int, q: int) -> int:
        step, last = 64, self.n - q
        while s < last:
            high = min(last, s + step)
            differ = np.flatnonzero(self.words[s:high] != self.words[s + q:high + q])
            if len(differ):
                return s + int(differ[0])
            s, step = high, step * 4
        return last

    def _advance(self, q: int, left: int, right: int) -> tuple[int, int, int] | None:
        right = self._right(right, q)
        if right + q == self.n:
            return q, left, right
        self._close(q, left, right)
        return None

    def _close(self, q: int, left: int, right: int) -> None:
        """A finished comparison is a run if it is long enough and no divisor of its period is one."""
        self.closed[q] = right
        length = right - left + q
        if length < max(self.least, self.exponent * q):
            return
        root = self.words[left:left + q]
        for p in _prime_factors(q):
            d = q // p
            if np.array_equal(root[d:], root[:q - d]):
                return
        self.found.append((left, length, q))
        starts, ends = self.runs.setdefault(q, ([], []))
        starts.append(left)
        ends.append(left + length)


def _prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, and the offsets of each text in them."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = counts[np.concatenate([[0], np.cumsum(sizes)])]
    return flat.filter(full), offsets


def batch_runs(codes: np.ndarray, offsets: np.ndarray, least: int, exponent: int, step: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a batch, by start, then period.

    Texts of like length share one sequence; their words differ by the text's
    number, so that no run crosses from one to the next.
    """
    sizes = np.diff(offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    spread = int(codes.max(initial=0)) + 1
    classes = np.where(sizes >= max(least, exponent), np.frexp(np.maximum(sizes, 1))[1], 0)
    for c in np.unique(classes[classes > 0]):
        rows = np.flatnonzero(classes == c)
        begins = np.concatenate([[0], np.cumsum(sizes[rows])])
        catchers = SquareCatchers(int(sizes[rows].max()), least, exponent)
        held, count = [], 0
        for i, row in enumerate(rows):
            own = codes[offsets[row]:offsets[row + 1]] + i * spread
            for k in range(0, len(own), step):
                held.append(own[k:k + step])
                count += len(held[-1])
                if count >= step:
                    catchers.append(np.concatenate(held))
                    held, count = [], 0
        if held:
            catchers.append(np.concatenate(held))
        for start, length, q in sorted(catchers.finish(), key=lambda r: (r[0], r[2])):
            i = int(np.searchsorted(begins, start, side="right")) - 1
            out[rows[i]].append((start - int(begins[i]), length, q))
    return out


def find_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4, step: int = 1 << 16) -> DataFrame:
    """id, n_words, runs, collapsed: a row for each row of ``docs``.

    ``runs`` has the start (a word number from 0), length and period of every
    maximal stretch of identical words a smallest period apart, of at least
    ``least`` words and ``exponent`` periods; by start, then period.
    ``collapsed`` joins by single spaces the words that no run holds after its
    first period. Words are cut at ASCII white space, and case counts. Null and
    blank texts have no words, no runs and an empty ``collapsed``; repeated rows
    and null ids are kept; other columns are not returned. Words come to the
    catchers ``step`` at a time, which changes no result.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, offsets = _split(batch.column("text"))
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            runs = batch_runs(codes, offsets, least, exponent, step)
            marks = np.zeros(len(codes) + 1, np.int64)
            for row, own in enumerate(runs):
                for start, length, q in own:
                    marks[offsets[row] + start + q] += 1
                    marks[offsets[row] + start + length] -= 1
            kept = np.cumsum(marks[:-1]) == 0
            counts = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(counts), flat.filter(pa.array(kept)) if not kept.all() else flat)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.diff(offsets).astype(np.int64)),
                pa.array([[{"start": s, "length": m, "period": q} for s, m, q in own] for own in runs],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pc.binary_join(lists, " ")], names=["id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(work, f"id {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return out.select(F.col("id").alias(id), "n_words", "runs", "collapsed")
