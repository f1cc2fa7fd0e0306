"""Long byte strings that start more than once, by sorted suffix buckets and a difference cover.

Of all places of a text, those in a difference cover modulo 183 (14 of 183) are
sampled; any two places have a common shift below 183 that leads both into the
sample. Two equal strings of 400 bytes therefore have equal 218-byte strings at
sampled places less than 183 bytes after their starts. The sample is ranked
first: which of its 218-byte strings occur more than once. Only suffixes near
such a place can be part of a repeat. These go to suffix buckets, chosen by a
rare inner string so that neighbouring suffixes stay together, and one bucket
at a time is sorted; equal neighbours share 400 bytes.

Suffixes are ordered by fingerprints of the strings compared, not by the bytes
themselves, since only equality of 400 bytes is asked for: 64 bits in the sample,
which only chooses candidates, and 96 bits in the buckets, which decide (among
10^13 places fewer than one pair in a thousand runs is equal by chance). A bucket
holds 16 MB however large the corpus; a string of very many texts adds to its
bucket two entries a task, since a task asks for a string twice at most as long
as it remembers it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cratewise.llm.storage import joined_small, stored
from cratewise.llm.text import mix, slices

# A perfect difference set modulo 183; every other residue is the difference of exactly one pair.
MODULUS = 183
COVER = (0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168)
ANCHOR = 32  # bytes of the inner strings that choose a suffix's bucket
BUCKET_BYTES = 16 << 20
CHUNK = 1 << 20  # bytes of text worked on at once; a task holds some 150 bytes for each
REMEMBERED = 1 << 19  # strings that a task remembers to have asked for

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        draw = np.random.default_rng(400)
        for name in ("byte", "check"):
            _TABLES[name] = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        inverse = np.uint64(pow(int(_RATIO), -1, 1 << 64))
        for name, ratio in (("up", _RATIO), ("down", inverse)):
            _TABLES[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK, ratio)]), dtype=np.uint64)
        cover = np.zeros(MODULUS, bool)
        cover[list(COVER)] = True
        _TABLES["cover"] = cover
    return _TABLES


def fingerprints(data: np.ndarray, width: int, table: str = "byte") -> np.ndarray:
    """64-bit fingerprints of the ``width`` bytes from each place on, in constant time per place; ``check`` is an independent table."""
    t, out = _tables(), []
    for at in range(0, max(0, len(data) - width + 1), CHUNK - width):
        part = data[at:at + CHUNK]
        if len(part) < width:
            break
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[table][part] * t["up"][:len(part)], dtype=np.uint64)])
            n = min(len(part) - width + 1, CHUNK - width)
            out.append(mix((sums[width:width + n] - sums[:n]) * t["down"][:n]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def least_inside(values: np.ndarray, span: int) -> np.ndarray:
    """The least of the ``span`` values from each place on."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // span) * span, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[span - 1:span - 1 + n])


class _Slice:
    """The bytes of a batch end to end, with each place's text and place in it."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.place = np.arange(len(self.data)) - self.offsets[:-1][self.row] if len(self.data) else np.zeros(0, np.int64)
        self.left = self.offsets[1:][self.row] - np.arange(len(self.data)) if len(self.data) else np.zeros(0, np.int64)

    def sampled(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places at which ``width`` bytes of the same text start, and their fingerprints."""
        at = np.flatnonzero(_tables()["cover"][self.place % MODULUS] & (self.left >= width))
        return at, fingerprints(self.data, width)[at]


class _Asked:
    """Strings that a task has asked for, by mark and check, and how often (up to twice).

    Two questions are enough for the bucket to answer both; whoever holds the
    string later in the task knows that it repeats. The memory is bounded, and
    what is forgotten is asked for again, so it changes no result.
    """

    def __init__(self) -> None:
        self.marks, self.checks, self.times = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int8)

    def settled(self, marks: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Whether each of a batch's distinct strings was asked for twice before; the others are noted."""
        at = np.searchsorted(self.marks, marks)
        at[at == len(self.marks)] = 0
        same = (self.marks[at] == marks) & (self.checks[at] == checks) if len(self.marks) else np.zeros(len(marks), bool)
        done = np.zeros(len(marks), bool)
        done[same] = self.times[at[same]] > 1
        self.times[at[same]] = 2
        if len(self.marks) + len(marks) > REMEMBERED:
            keep = self.times > 1
            keep &= keep.sum() <= REMEMBERED // 2
            self.marks, self.checks, self.times = self.marks[keep], self.checks[keep], self.times[keep]
        new = ~same
        joined = np.concatenate([self.marks, marks[new]])
        order = np.argsort(joined, kind="stable")
        self.marks = joined[order]
        self.checks = np.concatenate([self.checks, checks[new]])[order]
        self.times = np.concatenate([self.times, np.ones(new.sum(), np.int8)])[order]
        return done


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _rank_sample(width: int, buckets: int):
    """A text's sampled strings by bucket; strings that a batch holds more than once are known to repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Asked()
        for batch in slices(batches, "text", CHUNK):
            s = _Slice(batch)
            at, marks = s.sampled(width)
            values, first, back, held = np.unique(marks, return_index=True, return_inverse=True, return_counts=True)
            settled = memory.settled(values, np.zeros(len(values), np.uint32))
            known, first = ((held > 1) | settled)[back], first[~settled]
            rows = []
            # Known repeats travel by text, so that a string of very many texts isn't gathered in one bucket.
            owner = np.unique(np.stack([s.row[at[known]].astype(np.uint64), marks[known]]), axis=1) if known.any() else np.zeros((2, 0), np.uint64)
            spread = (s.keys[owner[0].astype(np.int64)] if owner.shape[1] else np.zeros((0, 2), np.int64))
            rows.append((mix(spread[:, 1].view(np.uint64) if len(spread) else np.zeros(0, np.uint64)) % np.uint64(buckets), True, spread, owner[1]))
            asked = s.keys[s.row[at[first]]] if len(first) else np.zeros((0, 2), np.int64)
            rows.append((mix(marks[first]) % np.uint64(buckets), False, asked, marks[first]))
            yield _by_bucket(rows)

    def _by_bucket(rows) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for bucket, known, keys, marks in rows:
            order = np.lexsort((keys[:, 0], bucket)) if len(keys) else np.zeros(0, np.int64)
            bucket, keys, marks = bucket[order], keys[order], marks[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for x, y in zip(edges, [*edges[1:], len(bucket)]):
                part = keys[x:y]
                starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)]))
                counts = np.diff(np.append(starts, len(part)))
                for column, value in zip(out, (int(bucket[x]), known, _packed(part[starts]), _packed(counts.astype(np.int64)), _packed(marks[x:y]))):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))],
                                          names=["bucket", "known", "keys", "counts", "marks"])

    return work


def _flat(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]


def _sorted(marks: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of marks, then checks, then places, and which entries in it differ from the one before."""
    keys = [marks] if checks is None else [marks, checks]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for values in keys:
        ranked = values[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, new


def _repeated(marks: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
    """Whether each entry of a bucket has an equal neighbour when sorted."""
    order, new = _sorted(marks, checks)
    out = np.zeros(len(marks), bool)
    out[order] = ~new | ~np.append(new[1:], True)
    return out


def _answer_sample(table: pa.Table) -> pa.Table:
    """(a, b, mark): each text's sampled strings that occur more than once."""
    known, keys = table.column("known").to_pylist(), _flat(table, "keys", np.int64)
    counts, marks = _flat(table, "counts", np.int64), _flat(table, "marks", np.uint64)
    hit = [np.ones(len(m), bool) if k else None for k, m in zip(known, marks)]
    asked = [i for i, k in enumerate(known) if not k]
    if asked:
        found = _repeated(np.concatenate([marks[i] for i in asked]))
        for i, part in zip(asked, np.split(found, np.cumsum([len(marks[i]) for i in asked])[:-1])):
            hit[i] = part
    owners = np.concatenate([np.repeat(k.reshape(-1, 2), c, axis=0) for k, c in zip(keys, counts)])
    chosen = np.concatenate(hit)
    return pa.table({"a": owners[chosen, 0], "b": owners[chosen, 1], "mark": np.concatenate(marks)[chosen].view(np.int64)})


def _suffix_buckets(length: int, width: int, buckets: int):
    """Suffixes near repeated sampled strings by bucket, as runs of places with a fingerprint each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Asked()
        for batch in slices(batches, "text", CHUNK):
            s = _Slice(batch)
            at, marks = s.sampled(width)
            repeated = np.unique(np.concatenate([np.asarray(x, np.int64) for x in batch.column("marks").to_pylist()]).view(np.uint64))
            place = np.searchsorted(repeated, marks)
            place[place == len(repeated)] = 0
            hits = at[repeated[place] == marks]
            cover = np.zeros(len(s.data) + 1, np.int64)
            np.add.at(cover, np.maximum(hits - MODULUS + 1, s.offsets[s.row[hits]]), 1)
            np.add.at(cover, hits + 1, -1)
            where = np.flatnonzero((np.cumsum(cover)[:-1] > 0) & (s.left >= length))
            full = fingerprints(s.data, length)[where]
            check = (fingerprints(s.data, length, "check")[where] >> np.uint64(32)).astype(np.uint32)
            anchors = least_inside(fingerprints(s.data, ANCHOR), length - ANCHOR + 1)[where]
            bucket = (mix(anchors + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            order, new = _sorted(full, check)
            first, held = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
            settled = memory.settled(full[first], check[first])
            repeats = np.zeros(len(where), bool)
            repeats[order] = np.repeat((held > 1) | settled, held)
            first = first[~settled]
            out: list[list] = [[] for _ in range(7)]
            known = where[repeats]
            if len(known):
                starts, sizes = _runs(known, s.row[known])
                keys = s.keys[s.row[known[starts]]]
                to = (mix(keys[:, 1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                add_rows(out, to, True, keys, s.place[known[starts]], sizes, (), None)
            first.sort()
            starts, sizes = _runs(where[first], s.row[where[first]], bucket[first])
            if len(first):
                add_rows(out, bucket[first[starts]], False, s.keys[s.row[where[first[starts]]]], s.place[where[first[starts]]], sizes, (full[first], check[first]), starts)
            types = (pa.int64(), pa.bool_(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["bucket", "known", "keys", "starts", "sizes", "marks", "checks"])

    def add_rows(out, bucket, known, keys, starts, sizes, prints, firsts) -> None:
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        for x, y in zip(edges, [*edges[1:], len(order)]):
            part = order[x:y]
            held = [_packed(np.concatenate([v[firsts[r]:firsts[r] + sizes[r]] for r in part])) for v in prints] or [b"", b""]
            for column, value in zip(out, (int(bucket[part[0]]), known, _packed(keys[part]), _packed(starts[part].astype(np.int64)),
                                           _packed(sizes[part].astype(np.int64)), *held)):
                column.append(value)

    return work


def _runs(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entries and sizes of the runs of consecutive places that agree in ``same``."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(places)))


def _sort_bucket(table: pa.Table) -> pa.Table:
    """(a, b, start, n): runs of places whose 400 bytes start elsewhere too."""
    known, keys = table.column("known").to_pylist(), [k.reshape(-1, 2) for k in _flat(table, "keys", np.int64)]
    starts, sizes, marks, checks = (_flat(table, c, t) for c, t in (
        ("starts", np.int64), ("sizes", np.int64), ("marks", np.uint64), ("checks", np.uint32)))
    a = [np.zeros((0, 2), np.int64), *[k for k, yes in zip(keys, known) if yes]]
    begin = [np.zeros(0, np.int64), *[x for x, yes in zip(starts, known) if yes]]
    count = [np.zeros(0, np.int64), *[x for x, yes in zip(sizes, known) if yes]]
    asked = [i for i, yes in enumerate(known) if not yes]
    if asked:
        found = _repeated(np.concatenate([marks[i] for i in asked]), np.concatenate([checks[i] for i in asked]))
        size = np.concatenate([sizes[i] for i in asked])
        run = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        place = np.concatenate([starts[i] for i in asked])[run] + inside
        run, place = run[found], place[found]
        first, n = _runs(place, run)
        a.append(np.concatenate([keys[i] for i in asked])[run[first]])
        begin.append(place[first])
        count.append(n)
    key = np.concatenate(a)
    return pa.table({"a": key[:, 0], "b": key[:, 1], "start": np.concatenate(begin), "n": np.concatenate(count)})


def _cut(length: int):
    """(a, b, n_removed, n_spans, kept_sha256, removed) of texts with runs of repeated starts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            removed, spans, digests, places = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                body, merged, kept = text.encode(), [], hashlib.sha256()
                for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in runs):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                for (_, start), (end, _) in zip([[0, 0], *merged], [*merged, [len(body), 0]]):
                    kept.update(body[start:end])
                removed.append(sum(end - start for start, end in merged))
                spans.append(len(merged))
                digests.append(kept.hexdigest())
                places.append(",".join(f"{start}:{end}" for start, end in merged))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(places, pa.string())],
                                             names=["a", "b", "n_removed", "n_spans", "kept_sha256", "removed"])

    return work


def repeated_bytes(docs: DataFrame, *, text: str = "text", length: int = 400, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept and removed (start:end of each run, ends exclusive) of every row.

    A byte is removed if it lies in ``length`` bytes that also start anywhere
    else, in the same text or another one. Null texts count as empty; texts
    shorter than ``length`` lose nothing. Equal texts are found by digest first:
    of ``length`` bytes or more, they are removed whole, and one of them stands
    for all when other texts are compared. Rows that repeat an id are texts of
    their own. ``length`` must be at least 250.
    """
    width = length - MODULUS + 1
    if width < 2 * ANCHOR:
        raise ValueError("length must be at least 250")
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("a")
    rows = docs.select("doc_id", own, F.xxhash64(body).alias("b"), F.sha2(body, 256).alias("digest"), body.alias("text"))
    facts = stored(rows.select("doc_id", "a", "b", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    groups = facts.groupBy("digest").agg(F.min("a").alias("lead"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = stored(joined_small(facts, groups, ["digest"], most=200_000).select("a", "b", "lead"), "copies")
    extra = copies.where("a <> lead").select("a", "b").distinct()
    single = joined_small(rows.where(F.octet_length("text") >= length).select("a", "b", "text"), extra, ["a", "b"], "left_anti")

    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    share = total * len(COVER) // MODULUS * 8
    asked = single.mapInArrow(_rank_sample(width, max(1, -(-share // bucket_bytes))),
                              "bucket bigint, known boolean, keys binary, counts binary, marks binary")
    marks = stored(asked.groupBy("bucket").applyInArrow(_answer_sample, "a bigint, b bigint, mark bigint").distinct(), "marks")
    near = marks.count() * MODULUS // len(COVER) * 12
    by_text = marks.groupBy("a", "b").agg(F.collect_list("mark").alias("marks"))  # bounded by the text itself
    found = joined_small(single, marks.select("a", "b").distinct(), ["a", "b"], "left_semi").join(by_text, ["a", "b"])
    suffixes = found.mapInArrow(_suffix_buckets(length, width, max(1, -(-near // bucket_bytes))),
                                "bucket bigint, known boolean, keys binary, starts binary, sizes binary, marks binary, checks binary")
    runs = stored(suffixes.groupBy("bucket").applyInArrow(_sort_bucket, "a bigint, b bigint, start bigint, n bigint"), "runs")
    whole = runs.groupBy("a", "b").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    cut = joined_small(single, runs.select("a", "b").distinct(), ["a", "b"], "left_semi")
    cut = cut.join(whole, ["a", "b"]).mapInArrow(_cut(length), "a bigint, b bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed string")
    cut = cut.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "removed")])
    twice = copies.select("a", "b").distinct().withColumn("_twice", F.lit(True))
    gone = F.col("_twice").isNotNull() & (F.col("n_bytes") >= length)
    out = (facts.join(twice, ["a", "b"], "left").join(cut, ["a", "b"], "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(gone, F.concat(F.lit("0:"), F.col("n_bytes"))).otherwise(F.coalesce("removed", F.lit(""))).alias("removed")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "removed")
