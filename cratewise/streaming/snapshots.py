"""A versioned table of deltas, published by manifests.

A writer first writes its rows to a folder of their own, then publishes the next
manifest, which lists all folders of the table. A manifest is written aside and
renamed into place, and the rename fails if that version exists: of two writers
one publishes, and the other reads the new manifest and tries the next version.
A reader takes the newest manifest and so sees whole batches only. Rows merge on
read: of each key the one with the highest order counts, so an older version
that a running backfill brings late never replaces a newer edit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, oldest first."""
    fs, path = _files(spark, folder)
    place = path(f"{folder}/manifest")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """{"version": n, "parts": {name: folder}, "schema": ...}; version 0 has no parts."""
    known = versions(spark, folder)
    if not known:
        return {"version": 0, "parts": {}, "schema": None}
    at = known[-1] if version is None else version
    return json.loads(spark.read.option("wholetext", True).text(f"{folder}/manifest/{at:010d}.json").first()[0])


def _publish(spark: SparkSession, folder: str, content: dict) -> bool:
    """Put a manifest in place, unless its version exists."""
    fs, path = _files(spark, folder)
    fs.mkdirs(path(f"{folder}/manifest"))
    aside = path(f"{folder}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    target = path(f"{folder}/manifest/{content['version']:010d}.json")
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), kinds)  # fails if the target exists
        return True
    except Exception as lost:
        if not fs.exists(target):
            raise lost
        fs.delete(aside, False)
        return False


def upsert(rows: DataFrame, folder: str, name: str | None = None) -> int:
    """Add ``rows`` as one part and publish it; returns the version that first shows them.

    A part ``name`` that is published already is left as it is, so a batch that
    is run again after a failure counts once.
    """
    spark = rows.sparkSession
    name = name or uuid.uuid4().hex
    part = f"data/{name}-{uuid.uuid4().hex}"
    held = manifest(spark, folder)
    if name in held["parts"]:
        return held["version"]
    rows.write.parquet(f"{folder}/{part}")
    while True:
        held = manifest(spark, folder)
        if name in held["parts"]:
            return held["version"]
        fresh = {"version": held["version"] + 1, "parts": held["parts"] | {name: part}, "schema": held["schema"] or rows.schema.jsonValue()}
        if _publish(spark, folder, fresh):
            return fresh["version"]


def snapshot(spark: SparkSession, folder: str, key: str = "id", order: str = "seq", version: int | None = None) -> DataFrame | None:
    """The table as of the newest, or the given, version: each key once, by its highest order; None before the first version."""
    held = manifest(spark, folder, version)
    if not held["parts"]:
        return None
    rows = spark.read.parquet(*[f"{folder}/{part}" for part in dict.fromkeys(held["parts"].values())])
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")


def compact(spark: SparkSession, folder: str, key: str = "id", order: str = "seq") -> int:
    """Write the newest snapshot as one part that stands for all its parts; names stay known, parts published meanwhile stay too."""
    held = manifest(spark, folder)
    merged = snapshot(spark, folder, key, order)
    if merged is None:
        return 0
    part = f"data/compact-{uuid.uuid4().hex}"
    merged.write.parquet(f"{folder}/{part}")
    while True:
        now = manifest(spark, folder)
        parts = {name: part if name in held["parts"] else where for name, where in now["parts"].items()}
        fresh = now | {"version": now["version"] + 1, "parts": parts}
        if _publish(spark, folder, fresh):
            return fresh["version"]


def backfill(source: DataFrame, folder: str, version: str, project) -> None:
    """Project a stream of rows into the versioned table, a published part per micro-batch.

    An interrupted run goes on after its last finished batch; a new projection
    ``version`` starts over in a table of its own. Edits may be upserted at any
    time, before, between and after batches.
    """
    place = f"{folder}/version={version}"

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert(project(batch), place, f"backfill-{batch_id}")

    query = (source.writeStream.outputMode("append").option("checkpointLocation", f"{place}/checkpoint")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
