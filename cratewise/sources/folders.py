"""File listings and scratch folders."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cratewise.functions import text as tx
from cratewise.session import checkpoint_folder, written

# File extensions that count as audio.
AUDIO_EXTENSIONS = ["mp3", "wav", "flac", "ogg", "oga", "m4a", "aac", "aiff", "aif"]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _list_folders(root: str):
    """The entries of one folder a row, in batches; links, names with a leading dot and names that aren't UTF-8 are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["relative_path", "size_bytes", "folder"])

        for batch in batches:
            for inside in batch["relative_path"]:
                rows = []
                try:
                    entries = os.scandir(f"{root}/{inside}")
                except OSError:
                    continue  # an unreadable folder is skipped
                with entries:
                    for entry in entries:
                        try:
                            entry.name.encode()
                            if entry.name.startswith(".") or entry.is_symlink():
                                continue
                            name = f"{inside}/{entry.name}" if inside else entry.name
                            if entry.is_dir(follow_symlinks=False):
                                rows.append((name, 0, True))
                            elif entry.is_file(follow_symlinks=False):
                                rows.append((name, entry.stat(follow_symlinks=False).st_size, False))
                        except (OSError, UnicodeEncodeError):
                            continue
                        if len(rows) == 10_000:
                            yield table(rows)
                            rows = []
                yield table(rows)

    return work


def _walked(spark: SparkSession, root: str, wanted: list[str], max_depth: int | None) -> DataFrame:
    """(relative_path, size_bytes) below ``root``: one job a level, the folders of a level spread over tasks."""
    level = spark.createDataFrame([("",)], "relative_path string")
    files, depth, n = None, 0, 1
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        listed = level.repartition(tasks).mapInPandas(_list_folders(root), "relative_path string, size_bytes bigint, folder boolean")
        listed = written(listed.where(F.col("folder") | tx.extension(F.col("relative_path")).isin(wanted)), "listing")
        here = listed.where("not folder").select("relative_path", "size_bytes")
        files = here if files is None else files.unionByName(here)
        level = listed.where("folder").select("relative_path")
        depth += 1
        n = 0 if max_depth is not None and depth > max_depth else level.count()
    return files


def scan_folder(spark: SparkSession, folder: str, extensions: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(path, relative_path, name, size_bytes) of audio files, at most ``max_depth`` folders deep if stated.

    Names with a leading dot are skipped, and file contents are never read. A
    mounted folder, which all executors see, is listed level by level without
    following links, so a cycle of links ends; an unreadable or missing folder
    has no files. Other stores, which have no links, are listed by Spark, which
    also hides names with a leading underscore.
    """
    wanted = [e.lower() for e in (extensions or AUDIO_EXTENSIONS)]
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getScheme() == "file":
        root = system.makeQualified(place).toUri().getPath()
        files = _walked(spark, root, wanted, max_depth).withColumn("path", F.concat(F.lit(f"file:{root.rstrip('/')}/"), "relative_path"))
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
                 .select("path", F.col("length").alias("size_bytes")))
        plain = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:", ""), "^/+", "/")
        inside = "/" + folder.split(":", 1)[-1].strip("/") + "/"
        relative = F.substr(plain, F.lit(len(inside) + 1))
        shallow = F.lit(True) if max_depth is None else F.size(F.split("relative_path", "/")) <= max_depth + 1
        files = (files.withColumn("relative_path", relative)
                 .where(tx.extension(F.col("relative_path")).isin(wanted) & shallow & ~F.col("relative_path").rlike(r"(^|/)\.")))
    return (files.select("path", "relative_path", tx.basename(F.col("relative_path")).alias("name"), "size_bytes")
            .orderBy(F.collate(F.col("relative_path"), "UNICODE")))


def read_log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log files with one JSON object per line; the schema is given, not inferred."""
    return spark.read.schema(schema).json(path)


def read_job_log(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON text column into columns beside the others."""
    return rows.withColumn("_j", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "_j.*")
