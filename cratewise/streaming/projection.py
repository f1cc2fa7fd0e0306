"""Catalogue projection kept up to date from a stream of track versions.

Every micro-batch appends its projected rows; the table is merged on read. A
write therefore costs the batch and never the table, and ``compact`` folds old
batches together when reads have to look at too many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cratewise.streaming.replay import run_to_table


def project_stream(versions: DataFrame, folder: str, project, key: str = "id", order: str = "seq"):
    """Project a stream of (id, seq, deleted, ...) versions into ``folder``.

    ``project`` turns the latest version per id of a batch into a catalogue row;
    ``deleted`` rows stay as tombstones.
    """
    def latest(batch: DataFrame) -> DataFrame:
        values = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")
        return project(last)
    return run_to_table(versions, folder, "append", latest)


def read_projection(spark: SparkSession, folder: str, key: str = "id", order: str = "seq") -> DataFrame:
    """Current rows: the highest version of each id, without deleted ones."""
    rows = spark.read.parquet(f"{folder}/table")
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")
    return last.where(~F.col("deleted")).drop("deleted")


def compact(spark: SparkSession, folder: str, target: str, key: str = "id", order: str = "seq") -> None:
    """Write the current state as one base batch of a new folder."""
    rows = spark.read.parquet(f"{folder}/table")
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    (rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")
     .write.mode("overwrite").parquet(f"{target}/table/batch_id=-1"))


def backfill(spark: SparkSession, source: DataFrame, folder: str, version: str, project):
    """Resumable projection of a whole table: bounded batches, one checkpoint per version.

    A new ``version`` starts over in its own folder; an interrupted run goes on
    after its last finished batch.
    """
    return run_to_table(source, f"{folder}/version={version}", "append", project)
