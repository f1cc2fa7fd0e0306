"""Duplicate groups at three levels, copy ranking, merge plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cratewise.functions.frames import bin_product, pitch_class_matrix
from cratewise.operators.linked import greedy_groups
from cratewise.operators.ordered import with_halo, with_position
from cratewise.schemas import CUE, FrameGeometry
from cratewise.session import cut_lineage

THRESHOLD = 0.75
MIN_OVERLAP = 40
BITS_PER_WORD = 24
TILE = 48  # prints compared at once
PAIRS = 64  # listed pairs compared at once
BLOCK_PRINTS = 1024  # of about 8 kB, in a task twice


def _shared(files: DataFrame, key: str, level: str) -> DataFrame:
    """Rows whose ``key`` occurs twice or more.

    Counts are combined map-side before the shuffle and joined back on a unique
    key, so a hash shared by a third of the rows is no window and can be split
    by the adaptive skew join.
    """
    rows = files.where(F.length(key) > 0)
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    return rows.join(twice, key).select(F.lit(level).alias("level"), F.col(key).alias("group_key"), "id",
                                        F.lit(1.0).alias("confidence"))


def dup_exact_file(files: DataFrame) -> DataFrame:
    return _shared(files, "content_hash", "exact-file")


def unclaimed(files: DataFrame) -> DataFrame:
    """Files in no exact group: their content hash is unique or absent."""
    twice = (files.where(F.length("content_hash") > 0).groupBy("content_hash")
             .agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n"))
    return files.join(twice, "content_hash", "left_anti")


def dup_same_audio(files: DataFrame) -> DataFrame:
    return _shared(unclaimed(files), "audio_hash", "same-audio")


def fingerprint(frames: DataFrame, geometry: FrameGeometry, max_frames: int | None = None,
                chunk: int = 4096) -> DataFrame:
    """One 24-bit word per frame: (track_id, pos, word).

    With ``max_frames`` only every n-th frame of longer tracks counts; prints
    of different strides don't compare.

    Bit 2b: chroma band b rose since the previous sampled frame; bit 2b+1: it
    is above the next band. Chroma is a row-local matrix product; the look back
    is a one-row halo per chunk, so a long track is many small windows.
    """
    sampled = frames.select("track_id", F.col("frame").alias("_j"), "mags")
    if max_frames is not None:
        counts = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("_count"))
        step = F.greatest(F.lit(1), F.floor(F.col("_count") / max_frames))
        sampled = (sampled.join(counts, "track_id").withColumn("_step", step).where(F.col("_j") % F.col("_step") == 0)
                   .select("track_id", F.floor(F.col("_j") / F.col("_step")).alias("_j"), "mags"))
    raw = bin_product(pitch_class_matrix(geometry, 80, 4000))(F.col("mags"))
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x)
    chroma = (sampled.select("track_id", "_j", raw.alias("_c"))
              .withColumn("_t", total)
              .select("track_id", "_j", F.when(F.col("_t") > 0, F.transform("_c", lambda x: x / F.col("_t")))
                      .otherwise(F.col("_c")).alias("_c")))
    from pyspark.sql import Window
    w = Window.partitionBy("track_id", "_chunk").orderBy("_j")
    paired = (with_halo(chroma, "_j", chunk, before=1).withColumn("_p", F.lag("_c").over(w))
              .where(F.col("_core") & F.col("_p").isNotNull()))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(11)), F.lit(0),
        lambda acc, b: acc
        + F.when(F.get("_c", b) > F.get("_p", b), F.pow(F.lit(2), b * 2).cast("int")).otherwise(0)
        + F.when(F.get("_c", b) > F.get("_c", (b + 1) % 12), F.pow(F.lit(2), b * 2 + 1).cast("int")).otherwise(0))
    return paired.select("track_id", (F.col("_j") - 1).alias("pos"), bits.alias("word"))


def pack_fingerprints(words: DataFrame) -> DataFrame:
    """(track_id, words): one word per frame, 4 bytes each."""
    packed = words.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return packed.select("track_id", F.transform("w", lambda x: x["word"]).alias("words"))


def fingerprint_similarity(pairs: DataFrame, a: str = "a_words", b: str = "b_words",
                           max_offset: int = 200) -> DataFrame:
    """Adds ``score``, the best share of equal bits over even offsets, to rows that carry two word arrays.

    Overlaps of fewer than ``MIN_OVERLAP`` words score nothing.
    """
    @pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left))
        for at in range(0, len(left), PAIRS):
            words = [[np.asarray(x, np.uint32) for x in side.iloc[at:at + PAIRS]] for side in (left, right)]
            out[at:at + PAIRS] = _pair_scores(words[0], words[1], max_offset)
        return pd.Series(out)
    return pairs.withColumn("score", score(F.col(a), F.col(b)))


def _spectrum(block: list[np.ndarray], size: int) -> np.ndarray:
    """Bits as +-1 signals: the transform of each print and bit."""
    shifts = np.arange(BITS_PER_WORD, dtype=np.uint32)
    signs = np.zeros((len(block), BITS_PER_WORD, size), np.float32)
    for n, words in enumerate(block):
        signs[n, :, :len(words)] = ((words[None, :] >> shifts[:, None]) & 1) * 2.0 - 1.0
    return np.fft.rfft(signs, axis=2).astype(np.complex64)


def _common_size(left: list[np.ndarray], right: list[np.ndarray]) -> int:
    return 1 << int(max(1, max(map(len, left)) + max(map(len, right)) - 1)).bit_length()


def _best_over_offsets(correlation: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, max_offset: int) -> np.ndarray:
    """The cross-correlation, summed over bits, counts equal minus unequal bits at every offset (first axis)."""
    size = len(correlation)
    best = np.zeros(correlation.shape[1:])
    for offset in range(-max_offset, max_offset + 1, 2):
        if abs(offset) >= size:
            continue
        overlap = np.minimum(n_left, n_right + offset) - max(0, offset)
        usable = overlap >= MIN_OVERLAP
        if not usable.any():
            continue
        bits = np.where(usable, overlap * BITS_PER_WORD, 1)
        differing = (bits - np.rint(correlation[offset % size])) / 2
        best = np.maximum(best, np.where(usable, 1 - differing / bits, 0.0))
    return best


def _pair_scores(left: list[np.ndarray], right: list[np.ndarray], max_offset: int) -> np.ndarray:
    """Best agreement of the first with the first, the second with the second, and so on."""
    size = _common_size(left, right)
    product = (_spectrum(left, size) * _spectrum(right, size).conj()).sum(axis=1).T
    return _best_over_offsets(np.fft.irfft(product, n=size, axis=0), np.array([len(w) for w in left]),
                              np.array([len(w) for w in right]), max_offset)


def _block_scores(left: list[np.ndarray], right: list[np.ndarray], max_offset: int) -> np.ndarray:
    """Best agreement of every left/right pair of two blocks."""
    size = _common_size(left, right)
    product = np.matmul(_spectrum(left, size).transpose(2, 0, 1), _spectrum(right, size).conj().transpose(2, 1, 0))
    return _best_over_offsets(np.fft.irfft(product, n=size, axis=0), np.array([len(w) for w in left])[:, None],
                              np.array([len(w) for w in right])[None, :], max_offset)


def similar_edges(prints: DataFrame, threshold: float = THRESHOLD, max_offset: int = 200,
                  block: int | None = None, tile: int = TILE) -> DataFrame:
    """All pairs (i, j, score), i < j, of distinct fingerprints at or over the threshold.

    ``prints(id, words)``. At the default threshold a quarter of all bits may
    differ, so no index over words can promise to find every pair; the exact way
    is a triangular grid of blocks. A cell's two blocks are compared tile by
    tile in one task, and only pairs over the threshold leave it. A print is
    sent to as many cells as there are blocks, so blocks are as large as leaves
    every task a cell, up to ``BLOCK_PRINTS``. The work is quadratic in
    *distinct* fingerprints and evenly spread.
    """
    n = prints.count()
    if block is None:
        tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        block = min(BLOCK_PRINTS, max(tile, math.ceil(n / math.ceil(math.sqrt(4 * tasks)))))
    blocks = max(1, math.ceil(n / block))
    cell = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(
        F.least(x, F.col("_b")).alias("_i"), F.greatest(x, F.col("_b")).alias("_j")))
    placed = (prints.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
              .select("id", "words", "_b", F.inline(cell)))
    kind = prints.schema["id"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        i, j = rows.column("_i")[0].as_py(), rows.column("_j")[0].as_py()
        rows = rows.sort_by("id")
        sides = [rows.filter(pc.equal(rows.column("_b"), x)) for x in (i, j)]
        ids = [s.column("id").to_pylist() for s in sides]
        words = [[np.asarray(w, np.uint32) for w in s.column("words").to_pylist()] for s in sides]
        out = []
        for a in range(0, len(ids[0]), tile):
            for b in range(a if i == j else 0, len(ids[1]), tile):
                scores = _block_scores(words[0][a:a + tile], words[1][b:b + tile], max_offset)
                for p, q in zip(*np.nonzero(scores >= threshold)):
                    x, y = ids[0][a + p], ids[1][b + q]
                    if i != j or x < y:
                        # the score does not depend on the side
                        out.append((min(x, y), max(x, y), float(scores[p, q])))
        return pa.table({"i": pa.array([e[0] for e in out], rows.schema.field("id").type), "j": pa.array([e[1] for e in out], rows.schema.field("id").type),
                         "score": pa.array([e[2] for e in out], pa.float64())})

    return placed.groupBy("_i", "_j").applyInArrow(compare, f"i {kind}, j {kind}, score double")


def dup_similar_groups(prints: DataFrame, threshold: float = THRESHOLD, max_offset: int = 200) -> DataFrame:
    """Similar-audio groups over (id, words) rows that no stronger level claimed.

    Identical fingerprints have the same neighbours and match each other fully,
    so only the first id of each takes part; the copies follow it. A third of
    the library being one fingerprint costs one row in the grid.
    """
    usable = prints.where(F.size("words") > 0).withColumn("_h", F.sha2(F.array_join("words", ","), 256))
    firsts = cut_lineage(usable.groupBy("_h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_n"),
                                                  F.any_value("words").alias("words")))
    groups = cut_lineage(greedy_groups(similar_edges(firsts.select("id", "words"), threshold, max_offset)))
    # Class -> (seed, score); a class that nobody claimed seeds for its own copies.
    placed = (firsts.join(groups.select(F.col("member").alias("id"), "seed", "score"), "id", "left")
              .join(groups.select(F.col("seed").alias("id")).distinct().withColumn("_seeds", F.lit(True)), "id", "left")
              .where(F.col("seed").isNotNull() | F.col("_seeds")
                     | ((F.col("_n") > 1) & (F.size("words") >= MIN_OVERLAP)))
              .select("_h", F.col("id").alias("_first"), F.coalesce("seed", "id").alias("group_key"),
                      F.coalesce("score", F.lit(1.0)).alias("confidence")))
    return usable.join(placed, "_h").select(
        F.lit("similar-audio").alias("level"), "group_key", "id", "confidence")


def find_duplicate_groups(files: DataFrame, prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All three levels; each file is in one group at most, the strongest wins."""
    exact, same = dup_exact_file(files), dup_same_audio(files)
    rest = unclaimed(files)
    twice = rest.where(F.length("audio_hash") > 0).groupBy("audio_hash").agg(
        F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    rest = rest.join(twice, "audio_hash", "left_anti").select("id")
    similar = dup_similar_groups(prints.join(rest, "id", "left_semi"), threshold)
    text = F.col("group_key").cast("string").alias("group_key")
    return (exact.unionByName(same)
            .unionByName(similar.select("level", text, "id", "confidence")))


def manual_edit_count() -> Column:
    return (F.col("manual_bpm").isNotNull().cast("int") + F.col("manual_grid").isNotNull().cast("int")
            + F.col("manual_key_tonic").isNotNull().cast("int")
            + (F.coalesce(F.size("cues"), F.lit(0)) > 0).cast("int"))


def rank_copies(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Rank 0 is the copy to keep: hand edits, lossless, bit rate, sample rate, size.

    The rank is a running position over a range partitioning, so a group that
    holds a third of all files is spread over many tasks.
    """
    rows = groups.join(facts, "id").select(
        "level", "group_key", "id", "manual_edits", F.coalesce("lossless", F.lit(False)).alias("_l"),
        F.coalesce("bitrate_kbps", F.lit(0)).alias("_b"), F.coalesce("sample_rate", F.lit(0)).alias("_s"), "size_bytes")
    ranked = with_position(rows, [F.desc("manual_edits"), F.desc("_l"), F.desc("_b"), F.desc("_s"),
                                  F.desc("size_bytes"), F.col("id")], "rank", group=["level", "group_key"])
    return ranked.drop("_l", "_b", "_s")


def keepers(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """The rank-0 copy only: one map-side combined aggregation, no ranking."""
    order = F.struct((-F.col("manual_edits")).alias("a"), (~F.coalesce("lossless", F.lit(False))).alias("b"),
                     (-F.coalesce("bitrate_kbps", F.lit(0))).alias("c"), (-F.coalesce("sample_rate", F.lit(0))).alias("d"),
                     (-F.col("size_bytes")).alias("e"), F.col("id").alias("id"))
    return groups.join(facts, "id").groupBy("level", "group_key").agg(F.min(order)["id"].alias("keeper_id"))


MERGED = ["manual_bpm", "manual_grid", "manual_key_tonic", "manual_key_mode", "reviewed_at", "cues"]


def plan_merge(pairs: DataFrame, edits: DataFrame, cue_tolerance: float = 0.05) -> DataFrame:
    """``pairs(keeper_id, donor_id, rank)`` -> one row per keeper: its values after all its donors were merged.

    The keeper wins every conflict; of its donors, the first by rank with a
    value fills a NULL. Donor cues are added in the order of rank unless a cue
    that the keeper has by then is within the tolerance. Donors are reduced
    per field and per cue time before a keeper's rows meet, so a keeper with
    very many donors costs one row per distinct cue time.
    """
    keep = edits.select(F.col("id").alias("keeper_id"), *[F.col(c).alias(f"k_{c}") for c in MERGED])
    give = pairs.join(edits.select(F.col("id").alias("donor_id"), *[F.col(c).alias(f"d_{c}") for c in MERGED]), "donor_id")
    order = F.struct("rank", "donor_id")

    def earliest(c: str, *more: str) -> Column:
        return F.min(F.when(F.col(f"d_{c}").isNotNull(), F.struct("rank", "donor_id", *[F.col(f"d_{x}") for x in (c, *more)])))

    given = give.groupBy("keeper_id").agg(
        F.count(F.lit(1)).alias("donors"), *[earliest(c).alias(f"_{c}") for c in ("manual_bpm", "manual_grid", "reviewed_at")],
        earliest("manual_key_tonic", "manual_key_mode").alias("_key"))
    cues = (give.select("keeper_id", order.alias("o"), F.posexplode("d_cues").alias("at", "cue"))
            .groupBy("keeper_id", F.col("cue.time_sec").alias("t")).agg(F.min(F.struct("o", "at", "cue")).alias("c"))
            .groupBy("keeper_id").agg(F.array_sort(F.collect_list("c")).alias("_offered")))
    empty = F.array().cast(f"array<{CUE}>")
    own = F.coalesce("k_cues", empty)

    def merge(held: Column, offer: Column) -> Column:
        cue = offer["cue"]
        known = F.exists(held, lambda k: F.abs(k["time_sec"] - cue["time_sec"]) <= cue_tolerance)
        return F.when(known, held).otherwise(F.concat(held, F.array(cue)))

    j = given.join(cues, "keeper_id", "left").join(keep, "keeper_id")
    j = j.withColumn("_all", F.aggregate(F.coalesce("_offered", F.array().cast(cues.schema["_offered"].dataType)), own, merge))
    by_time = lambda a, b: (F.when(a["time_sec"] < b["time_sec"], -1).when(a["time_sec"] > b["time_sec"], 1).otherwise(0))

    def gained(c: str, given_as: str) -> Column:
        return F.col(f"k_{c}").isNull() & F.col(given_as).isNotNull()

    key = gained("manual_key_tonic", "_key")
    return j.select(
        "keeper_id", "donors",
        F.array_compact(F.array(F.when(gained("manual_bpm", "_manual_bpm"), "manual BPM"), F.when(key, "manual key"),
                                F.when(gained("manual_grid", "_manual_grid"), "manual grid"),
                                F.when(gained("reviewed_at", "_reviewed_at"), "reviewed mark"))).alias("fields"),
        *[F.coalesce(f"k_{c}", F.col(f"_{c}")[f"d_{c}"]).alias(c) for c in ("manual_bpm", "manual_grid")],
        F.coalesce("k_manual_key_tonic", F.col("_key")["d_manual_key_tonic"]).alias("manual_key_tonic"),
        F.when(key, F.col("_key")["d_manual_key_mode"]).otherwise(F.col("k_manual_key_mode")).alias("manual_key_mode"),
        F.coalesce("k_reviewed_at", F.col("_reviewed_at")["d_reviewed_at"]).alias("reviewed_at"),
        F.slice("_all", F.size(own) + 1, F.greatest(F.lit(0), F.size("_all") - F.size(own))).alias("added_cues"),
        F.array_sort("_all", by_time).alias("cues"))


def apply_merge(tracks: DataFrame, plans: DataFrame, pairs: DataFrame) -> DataFrame:
    """One new version of the table: each keeper once, updated, and its donors gone."""
    new = plans.select(F.col("keeper_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in MERGED], F.lit(True).alias("_merged"))
    kept = tracks.join(pairs.select(F.col("donor_id").alias("id")).distinct(), "id", "left_anti").join(new, "id", "left")
    return kept.select(*[F.when(F.col("_merged"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in MERGED else F.col(c)
                         for c in tracks.columns])


def cluster_confidence(groups: DataFrame) -> DataFrame:
    return groups.groupBy("level", "group_key").agg(
        F.count(F.lit(1)).alias("members"), F.min("confidence").alias("confidence"))
