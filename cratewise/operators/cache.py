"""Artefact cache: size, eviction plan, keys, plausibility, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cratewise.operators.ordered import with_position

DEFAULT_LIMIT_BYTES = 2 * 1024 ** 3


def cache_size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
                       F.count(F.lit(1)).alias("entries"), F.count_if("pinned").alias("pinned"))


def plan_eviction(entries: DataFrame, limit_bytes: int = DEFAULT_LIMIT_BYTES) -> DataFrame:
    """Least recently used unpinned entries to drop until the cache fits.

    An entry goes while total - (bytes of entries dropped before it) is over the
    limit; that running sum is taken over range partitions, not one window.
    """
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    run = with_position(entries.where(~F.col("pinned")), [F.col("last_used_at"), F.col("id")],
                        "eviction_order", {"size_bytes": "freed_before"})
    return run.where(F.lit(total) - F.col("freed_before") > limit_bytes)


def eviction_summary(entries: DataFrame, limit_bytes: int = DEFAULT_LIMIT_BYTES) -> DataFrame:
    """Entries removed, bytes freed, and whether pins keep the cache over the limit."""
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    freed = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return plan_eviction(entries, limit_bytes).agg(
        F.count(F.lit(1)).alias("removed"), freed.alias("freed_bytes"),
        (F.lit(total) - freed > limit_bytes).alias("blocked_by_pins"))


def cache_key(audio_hash: Column, source: Column, model: Column, version: Column, checkpoint: Column,
              algorithm: Column, quality: Column, stems: Column) -> Column:
    return F.concat_ws(":", audio_hash, source, model, version,
                       F.coalesce(checkpoint, F.lit("no-weights")), algorithm, quality, stems)


def stems_plausible(stems: DataFrame, jobs: DataFrame) -> DataFrame:
    """``stems(job_id, size_bytes)``, ``jobs(job_id, source_bytes)`` -> reason or NULL."""
    per = stems.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"),
                                      F.count_if(F.col("size_bytes") < 1024).alias("tiny"))
    n = F.coalesce("n", F.lit(0))
    return jobs.join(per, "job_id", "left").select("job_id", (
        F.when(n == 0, "The service returned no stems.")
        .when(F.col("tiny") > 0, F.concat(F.col("tiny").cast("string"), F.lit(" stem(s) came back empty.")))
        .when(F.col("bytes") < F.col("source_bytes"),
              "Stems are smaller than the source; separation looks truncated.")).alias("reason"))


def expire_results(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Terminal jobs whose last update is before the cutoff."""
    return jobs.where(F.col("status").isin("done", "failed", "cancelled") & (F.col("updated_at") < cutoff))
