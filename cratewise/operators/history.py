"""Analysis history, cascading deletes, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cratewise.operators.ordered import with_neighbour


def append_history(history: DataFrame, tracks: DataFrame, results: DataFrame) -> DataFrame:
    """Archive new results; the first one for a track also archives the stored one.

    ``results`` and ``history`` are (id, track_id, saved_at, ...); ``tracks``
    carries the currently stored result under the same value columns. A track
    that has no stored result yet (all values NULL) leaves nothing to archive.
    """
    values = [c for c in history.columns if c not in ("id", "track_id", "saved_at")]
    first = (results.join(history.select("track_id").distinct(), "track_id", "left_anti")
             .groupBy("track_id").agg(F.min("saved_at").alias("saved_at")))
    stored = tracks.where(F.greatest(F.lit(False), F.lit(False), *[F.col(c).isNotNull() for c in values]))
    legacy = (stored.join(first, "track_id").select(
        F.concat(F.lit("legacy:"), F.col("track_id").cast("string")).alias("id"), "track_id", "saved_at", *values))
    known = results.join(tracks.select("track_id"), "track_id", "left_semi")
    return history.unionByName(legacy).unionByName(known.select(history.columns))


def current_from_history(history: DataFrame) -> DataFrame:
    """Latest snapshot per track, by a map-side combined aggregation."""
    values = [c for c in history.columns if c != "track_id"]
    return (history.groupBy("track_id")
            .agg(F.max_by(F.struct(*values), F.struct("saved_at", "id")).alias("s")).select("track_id", "s.*"))


def history_intervals(history: DataFrame) -> DataFrame:
    """Each snapshot as a validity interval [valid_from, valid_to)."""
    nxt = with_neighbour(history, ["track_id"], ["saved_at", "id"], {"saved_at": "valid_to"}, "next")
    return nxt.withColumnRenamed("saved_at", "valid_from")


def cascade_delete(ids: DataFrame, tracks: DataFrame, jobs: DataFrame,
                   children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Delete tracks with all their rows, except those with an active job.

    ``ids(track_id)``; each child table has ``track_id``. Returns the remaining
    tables plus ``refused``, the ids that were kept because a job is active.
    """
    active = jobs.where(F.col("status").isin("queued", "running") | F.coalesce("cancel_pending", F.lit(False)))
    refused = ids.join(active.select("track_id"), "track_id", "left_semi").distinct()
    gone = ids.join(refused, "track_id", "left_anti").distinct()
    out = {"refused": refused,
           "tracks": tracks.join(gone.withColumnRenamed("track_id", "id"), "id", "left_anti"),
           "jobs": jobs.join(gone, "track_id", "left_anti")}
    for name, child in children.items():
        out[name] = child.join(gone, "track_id", "left_anti")
    return out


# What each stored version of a table lacks, as the default of the new column.
MIGRATIONS: dict[str, list[tuple[int, dict[str, str]]]] = {
    "tracks": [(2, {"manual_grid": "cast(null as string)"}), (3, {"title": "cast(null as string)", "artist": "cast(null as string)"})],
    "jobs": [
        (10, {"phase": "'analysis'", "run_id": "uuid()", "owner": "cast(null as string)", "attempt_id": "cast(null as string)",
              "lease_until": "cast(null as bigint)", "max_attempts": "3", "next_attempt_at": "0L", "updated_at": "queued_at", "stage": "status",
              "progress": "case when status = 'done' then 1D else 0D end"}),
        (12, {"track_id": "id"})],
    "catalog_keys": [(15, {"tokens": "cast(null as array<string>)"})],
}


def migrate(rows: DataFrame, table: str, from_version: int) -> DataFrame:
    """Bring a table of an old version up to date: add only what is absent, and only what belongs to that table.

    Defaults that are taken from other columns need those columns.
    """
    for version, columns in MIGRATIONS[table]:
        if version > from_version:
            rows = rows.select("*", *[F.expr(e).alias(c) for c, e in columns.items() if c not in rows.columns])
    return rows
