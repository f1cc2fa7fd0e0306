"""(token, id) rows in order, each moved as a few bytes.

A task sorts the rows it makes in runs of bounded size and keeps a token of a
run once, with its ids, compressed. Runs are written once. Marks at equal
distances in them give the bounds of ranges of bounded size, by which the
written runs are cut and dealt; the task of a range merges its slices in memory.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType

from cratewise.operators.ordered import with_position
from cratewise.session import cut_lineage

RUN_BYTES = 1 << 25  # of the rows that a task sorts at once
CHUNK_ROWS = 1 << 18  # rows of a run that are written together
ROW_BYTES = 16  # of a row besides its token, where sizes are compared
MARK_BYTES = 1 << 17  # from one mark of a run to the next
RANGE_BYTES, LEAST_BYTES = 1 << 26, 1 << 21  # of a range; fewer only to have a range for each task, down to the least
OUT_ROWS = 1 << 16
_LOW = (1 << 32) - 1


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order, null first, and the place of each value among them."""
    coded = column.dictionary_encode(null_encoding="encode").combine_chunks()
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _keys(codes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Both places of each row in one number, in order."""
    key = np.left_shift(codes, 32)
    key |= ranks
    key.sort()
    return key


def _packed(tokens: pa.Array, counts: np.ndarray, ids: pa.Array) -> bytes:
    """Sorted rows as distinct tokens, how many rows each has, and the ids; the first eight bytes are the size before compression."""
    at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
    text = (tokens.buffers()[2] or pa.py_buffer(b"")).slice(at[0], at[-1] - at[0]).to_pybytes()
    sizes = pc.fill_null(pc.binary_length(tokens), -1).to_numpy()
    body = pickle.dumps((sizes, counts.astype(np.int32), text, ids), protocol=5)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def _unpacked(rows: pa.BinaryScalar) -> tuple[pa.Array, np.ndarray, pa.Array]:
    held = rows.as_buffer()
    body = pa.Codec("zstd").decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little"))
    sizes, counts, text, ids = pickle.loads(body)
    at = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int32)
    known = pa.py_buffer(np.packbits(sizes >= 0, bitorder="little"))
    tokens = pa.Array.from_buffers(pa.binary(), len(sizes), [known, pa.py_buffer(at), pa.py_buffer(text)])
    return tokens, counts.astype(np.int64), ids


def _doses(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of (id, tokens) rows, put together or cut up to RUN_BYTES; only one row may be more."""
    held, size = [], 0
    for batch in batches:
        weight = batch.nbytes + ROW_BYTES * len(batch.column("tokens").flatten())
        step = max(1, batch.num_rows // max(1, -(-weight // RUN_BYTES)))
        for start in range(0, batch.num_rows, step):
            if held and size + weight * step // batch.num_rows > RUN_BYTES:
                yield held
                held, size = [], 0
            held.append(batch.slice(start, step))
            size += weight * step // batch.num_rows
    if held:
        yield held


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rows, marks): chunks of sorted runs, and the (token, id) rows at which MARK_BYTES are full.

    The first mark of a run is set off by a share of the distance that differs
    from run to run, so that many short runs are marked as densely as few long ones.
    """
    part = TaskContext.get().partitionId()
    for run, held in enumerate(_doses(batches)):
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(x.column("tokens")), 0).to_numpy(zero_copy_only=False) for x in held])
        if not sizes.sum():
            continue
        tokens, codes = _coded(pa.chunked_array([x.column("tokens").flatten().cast(pa.binary()) for x in held]))
        ids, ranks = _coded(pa.chunked_array([x.column("id") for x in held]))
        held.clear()
        key = _keys(codes, np.repeat(ranks, sizes))
        del codes, ranks
        pa.default_memory_pool().release_unused()
        weight = pc.fill_null(pc.binary_length(tokens), 0).to_numpy().astype(np.int64) + ROW_BYTES
        ahead, full = int((part * 0.6180339887 + run * 0.7548776662) % 1 * MARK_BYTES), 0
        for start in range(0, len(key), CHUNK_ROWS):
            code, rank = key[start:start + CHUNK_ROWS] >> 32, key[start:start + CHUNK_ROWS] & _LOW
            sums = full + np.cumsum(weight[code])
            marks = np.searchsorted(sums, np.arange(full + (ahead - full) % MARK_BYTES, sums[-1], MARK_BYTES), "right")
            full = int(sums[-1])
            first, last = int(code[0]), int(code[-1]) + 1
            packed = _packed(tokens.slice(first, last - first), np.bincount(code - first), ids.take(pa.array(rank)))
            marked = pa.StructArray.from_arrays([tokens.take(pa.array(code[marks])).cast(pa.string(), safe=False), ids.take(pa.array(rank[marks]))],
                                                names=["token", "id"])
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.ListArray.from_arrays([0, len(marks)], marked)], names=["rows", "marks"])


def _order(token: bytes | None, id) -> tuple:
    return (token is not None, token), (id is not None, id)


def _cut(bounds: pa.Table):
    """(part, rows) of chunks: a row's part is the number of bounds up to it."""
    edges = list(zip(bounds.column("token").cast(pa.binary()).to_pylist(), bounds.column("id").to_pylist()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = [_order(*edge) for edge in edges]
        for batch in batches:
            for rows in batch.column("rows"):
                tokens, counts, ids = _unpacked(rows)
                starts = np.concatenate([[0], np.cumsum(counts)])
                part = bisect_right(order, _order(tokens[0].as_py(), ids[0].as_py()))
                cuts = [0]
                for token, id in edges[part:bisect_right(order, _order(tokens[-1].as_py(), ids[-1].as_py()))]:
                    place = bisect_left(range(len(tokens)), (token is not None, token), key=lambda k: (tokens[k].is_valid, tokens[k].as_py()))
                    first, last = int(starts[place]), int(starts[place + 1])
                    if tokens[place].as_py() == token:
                        first = bisect_left(range(len(ids)), (id is not None, id), first, last, key=lambda k: (ids[k].is_valid, ids[k].as_py()))
                    cuts.append(first)
                parts, slices = [], []
                for k, (first, last) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
                    if first < last:
                        x, y = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last)
                        own = np.minimum(starts[x + 1:y + 1], last) - np.maximum(starts[x:y], first)
                        parts.append(part + k)
                        slices.append(_packed(tokens.slice(x, y - x), own, ids.take(pa.array(np.arange(first, last)))))  # a slice would be pickled whole
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(slices, pa.binary())], names=["part", "rows"])

    return work


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range in order."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
            held.setdefault(part, []).append(rows)
    for part in sorted(held):
        tokens, counts, ids = zip(*map(_unpacked, held.pop(part)))
        tokens, codes = _coded(pa.chunked_array(tokens))
        ids, ranks = _coded(pa.chunked_array(ids))
        key = _keys(np.repeat(codes, np.concatenate(counts)), ranks)
        del codes, ranks
        for start in range(0, len(key), OUT_ROWS):
            now = key[start:start + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([tokens.take(pa.array(now >> 32)).cast(pa.string(), safe=False), ids.take(pa.array(now & _LOW))], names=["token", "id"])


def same_order(keys: DataFrame) -> bool:
    """Whether Arrow and Python sort the ids and tokens of ``keys`` as Spark does."""
    id, tokens = keys.schema["id"].dataType, keys.schema["tokens"].dataType
    plain = isinstance(id, (IntegralType, DecimalType, BooleanType, BinaryType, DateType, TimestampType, TimestampNTZType))
    return tokens.elementType == StringType() and (plain or id == StringType())


def ranged_rows(keys: DataFrame) -> DataFrame:
    """A (token, id) row for each of the ``tokens`` of ``keys``, in ranges that follow each other.

    Rows of a range are in order, nulls first; equal rows are kept and share a range.
    """
    kind = keys.schema["id"].dataType.simpleString()
    runs = cut_lineage(keys.select("id", "tokens").mapInArrow(_sorted_runs, f"rows binary, marks array<struct<token:string,id:{kind}>>"))
    marks = cut_lineage(runs.select(F.explode("marks").alias("m")).select("m.token", "m.id"))
    n = marks.count()
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n * MARK_BYTES // RANGE_BYTES), min(tasks, n * MARK_BYTES // LEAST_BYTES))
    first = F.expr(f"pos > 0 and pos * {parts} div {n or 1} > (pos - 1) * {parts} div {n or 1}")
    bounds = with_position(marks, [F.col("token"), F.col("id")], partitions=1 + n // 20_000).where(first).orderBy("pos").select("token", "id").toArrow()
    return (runs.select("rows").mapInArrow(_cut(bounds), "part int, rows binary")
            .repartitionById(len(bounds) + 1, "part").mapInArrow(_merged, f"token string, id {kind}"))
