"""Words, shingles and batches of texts, as columns and as Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a run of characters other than these six.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_shingles(df: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """Add the 64-bit hashes of the runs of ``size`` words, lower-cased within ASCII; fewer words make none."""
    hashed = F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(0), F.size("_hashed") - size),
                       lambda i: F.xxhash64(*[F.get("_hashed", i + k) for k in range(size)]))
    runs = F.when(F.size("_hashed") >= size, runs).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_hashed", hashed).withColumn(name, runs).drop("_hashed")


# Arrow side ------------------------------------------------------------------

def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and the offsets of each text in them."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    offsets = np.zeros(len(split) + 1, np.int64)
    np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=offsets[1:])
    coded = flat.dictionary_encode()
    values = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashed = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = values[codes] != "" if len(values) else np.zeros(0, bool)
    if not full.all():
        counts = np.concatenate([[0], np.cumsum(full)])
        offsets, codes = counts[offsets], codes[full]
    return hashed[codes], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (the finaliser of a public 64-bit mixer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on; ``len(hashes) - size + 1`` of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n])
    return out


def text_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and the offsets of each text in them.

    A text of fewer than ``size`` words has its whole sequence as one shingle,
    a text without words none.
    """
    hashes, offsets = word_hashes(texts)
    runs = run_hashes(hashes, size)
    lengths = np.diff(offsets)
    held = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), held)
    first = np.repeat(offsets[:-1], held)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(held) - held, held)
    at = first + within
    values = np.zeros(len(owner), np.uint64)
    whole = lengths[owner] >= size
    values[whole] = runs[at[whole]]
    for row in np.flatnonzero((lengths > 0) & (lengths < size)):
        part = hashes[offsets[row]:offsets[row + 1]]
        values[owner == row] = run_hashes(part, len(part))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    counts = np.bincount(owner[new], minlength=len(lengths))
    return values[new], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``most`` bytes, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
