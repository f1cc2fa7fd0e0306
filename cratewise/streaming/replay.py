"""Helpers to run a stream over files and to keep its results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cratewise.sources.folders import scratch_folder


ROWS_PER_FILE = 1000


def file_stream(spark: SparkSession, rows: DataFrame, order: str, batches: int = 3, cuts: list | None = None) -> DataFrame:
    """``rows`` replayed as a stream in ``order``: one micro-batch per slice, of like size or cut at the values ``cuts``.

    Slices are written one after the other, because a file stream takes files by
    age and an early slice read late would count as late data. Each slice is
    dealt over as many files as its rows fill and the session has tasks for,
    and a trigger takes that many files.
    """
    folder = scratch_folder(spark, "stream-in")
    if cuts is None:
        cuts = rows.approxQuantile(order, [k / batches for k in range(1, batches)], 0.001) if batches > 1 else []
    batches = len(cuts) + 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, min(tasks, rows.count() // (batches * ROWS_PER_FILE)))
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = rows
        if low is not None:
            part = part.where(F.col(order) >= low)
        if high is not None:
            part = part.where(F.col(order) < high)
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_table(stream: DataFrame, folder: str, mode: str, write=None):
    """Run a stream over all available data; batch n is (over)written to ``batch_id=n``.

    A batch that is run again after a failure replaces its own folder, so the
    table holds each batch once.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        out = write(batch) if write else batch
        out.write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/table")


def latest_per_key(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode table: the row of the last batch of each key."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    if not keys:
        return batches.agg(F.max_by(F.struct(*values), "batch_id").alias("s")).select("s.*")
    return (batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("s"))
            .select(*keys, "s.*"))


def dropped_late(query) -> int:
    """Rows a finished query dropped because they came after the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for p in query.recentProgress for op in (p.get("stateOperators") or []))
