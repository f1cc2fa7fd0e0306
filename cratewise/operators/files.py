"""Import identity and reconciliation of library rows with files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cratewise.functions import text as tx


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def import_new(incoming: DataFrame, library: DataFrame, order: str = "id") -> DataFrame:
    """First row per content hash that the library does not hold yet; rows without a hash are all new.

    The minimum per hash is a map-side combined aggregation, so a hash that
    many copies share is reduced before the shuffle.
    """
    rest = [c for c in incoming.columns if c not in ("content_hash", order)]
    first = incoming.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct(order, *rest)).alias("r"))
    known = library.select("content_hash").where("content_hash is not null")
    fresh = first.select("content_hash", "r.*").join(known, "content_hash", "left_anti").select(incoming.columns)
    return fresh.unionByName(incoming.where("content_hash is null"))


def import_new_paths(incoming: DataFrame, library: DataFrame) -> DataFrame:
    return incoming.join(library.select(F.col("file_path").alias("path")), "path", "left_anti")


def propose_relocations(missing: DataFrame, files: DataFrame) -> DataFrame:
    """One row per missing track: ``matched``, ``ambiguous`` or ``unmatched``.

    A unique relative path wins over a unique base name. A file that several
    tracks resolve to goes to the first of them (by id), the others are
    ambiguous. ``missing(id, file_path, relative_path, name)``,
    ``files(path, relative_path, name)``.
    """
    def clean(path: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")

    def keyed(key: Column, name: str) -> DataFrame:
        # One row per key: how many files carry it, and the file if it is the only one.
        return files.select(key.alias(name), "path").groupBy(name).agg(
            F.count(F.lit(1)).alias(f"_n_{name}"), F.min("path").alias(f"_p_{name}"))

    by_rel = keyed(clean(F.col("relative_path")), "_rel")
    by_base = keyed(F.coalesce(F.nullif(F.col("name"), F.lit("")), tx.basename(F.col("path"))), "_base")
    rel = F.nullif(clean(F.col("relative_path")), F.lit(""))
    base = F.coalesce(F.nullif(F.col("name"), F.lit("")), tx.basename(F.col("file_path")))
    found = (missing.withColumns({"_rel": rel, "_base": base})
             .join(by_rel, "_rel", "left").join(by_base, "_base", "left"))
    rel_one, base_one = F.col("_n__rel") == 1, F.col("_n__base") == 1
    decided = found.select(
        "id", "file_path",
        F.when(F.col("_n__rel") > 1, "ambiguous").when(rel_one, "matched")
        .when(F.col("_n__base") > 1, "ambiguous").when(base_one, "matched").otherwise("unmatched").alias("_s"),
        F.when(rel_one, F.col("_p__rel")).when(F.col("_n__rel").isNull() & base_one, F.col("_p__base")).alias("_new"),
        F.when(rel_one, "relativePath").otherwise("basename").alias("_by"))
    claims = decided.where("_s = 'matched'").groupBy("_new").agg(F.min("id").alias("_first"))
    won = F.col("_s").eqNullSafe("matched") & (F.col("id") == F.col("_first"))
    return decided.join(claims, "_new", "left").select(
        "id", F.col("file_path").alias("old_path"),
        F.when(won, F.col("_new")).alias("new_path"), F.when(won, F.col("_by")).alias("match_by"),
        F.when(won, "matched").when(F.col("_s") == "matched", "ambiguous").otherwise(F.col("_s")).alias("outcome"))


def verify_relocations(proposals: DataFrame, hashes: DataFrame, tracks: DataFrame) -> DataFrame:
    """The file's hash must equal the stored one, where one is stored.

    ``hashes(path, content_hash)`` is missing a path that could not be read.
    """
    return (proposals.join(hashes.select(F.col("path").alias("new_path"), F.col("content_hash").alias("_found")), "new_path", "left")
            .join(tracks.select("id", F.nullif(F.col("content_hash"), F.lit("")).alias("_stored")), "id")
            .withColumn("result", F.when(F.col("_found").isNull(), "read_failed")
                        .when(F.col("_stored") != F.col("_found"), "hash_mismatch").otherwise("ok"))
            .drop("_found", "_stored"))


def should_skip_long(duration_sec: Column, size_bytes: Column, channels: Column, sample_rate: int = 48000) -> Column:
    """True where decoding whole would be too large; such rows go to chunked jobs."""
    pcm = duration_sec * sample_rate * F.greatest(F.lit(2), F.coalesce(channels, F.lit(2))) * 4
    return (duration_sec > 900) | (pcm > 128 * 1024 ** 2) | (size_bytes > 64 * 1024 ** 2)


# Tempo ratios that count as the same pulse.
TEMPO_MULTIPLES = [1.0, 2.0, 0.5, 3.0, 1 / 3, 2 / 3, 1.5]


def tempo_accuracy(estimates: DataFrame) -> DataFrame:
    """``estimates(bpm, truth)`` -> how many are within 4 %, and within 4 % of a multiple."""
    def near(factor: float) -> Column:
        t = F.col("truth") * F.lit(factor)
        return F.abs(F.col("bpm") - t) / t <= 0.04
    any_multiple = near(TEMPO_MULTIPLES[0])
    for m in TEMPO_MULTIPLES[1:]:
        any_multiple = any_multiple | near(m)
    return estimates.agg(F.count(F.lit(1)).alias("scored"), F.count_if(near(1.0)).alias("accuracy1"),
                         F.count_if(any_multiple).alias("accuracy2"))
