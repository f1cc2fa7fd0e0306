"""Playlists in long form: (playlist, pos, track_id), positions from 0.

A playlist may be of any size, so no operator gathers one into an array or a
window; positions move by arithmetic or by a distributed running count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cratewise.operators.ordered import with_position


def add(rows: DataFrame, additions: DataFrame) -> DataFrame:
    """``additions(playlist, track_id)``, one per playlist; a track already in is left alone."""
    sizes = rows.groupBy("playlist").agg((F.max("pos") + 1).alias("pos"))
    fresh = additions.join(rows.select("playlist", "track_id"), ["playlist", "track_id"], "left_anti")
    return rows.unionByName(fresh.join(sizes, "playlist", "left").select(
        "playlist", F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), "track_id"))


def remove(rows: DataFrame, removals: DataFrame) -> DataFrame:
    """``removals(playlist, track_id)``, any number; the rest close up.

    New position = old position - removals before it. Both counts come from one
    running sum over (playlist, pos), so a huge playlist is spread as well.
    """
    flagged = rows.join(removals.select("playlist", "track_id", F.lit(1).alias("_gone")).distinct(),
                        ["playlist", "track_id"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
    counted = with_position(flagged, [F.col("pos")], "_at", {"_gone": "_before"}, group=["playlist"])
    return counted.where("_gone = 0").select(
        "playlist", (F.col("_at") - F.col("_before")).cast("bigint").alias("pos"), "track_id")


def purge(rows: DataFrame, track_ids: DataFrame) -> DataFrame:
    """Drop tracks from every playlist that has them."""
    hits = rows.join(track_ids.select("track_id"), "track_id", "left_semi").select("playlist", "track_id")
    return remove(rows, hits)


def reorder(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(playlist, track_id, to_index)``, one per playlist; the index is clamped."""
    size = rows.groupBy("playlist").agg(F.count(F.lit(1)).alias("_n"))
    plan = (moves.join(rows, ["playlist", "track_id"]).join(size, "playlist")
            .select("playlist", F.col("pos").alias("_from"),
                    F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor("to_index"))).alias("_to")))
    pos, a, b = F.col("pos"), F.col("_from"), F.col("_to")
    moved = (F.when(a.isNull(), pos).when(pos == a, b)
             .when((pos > a) & (pos <= b), pos - 1).when((pos < a) & (pos >= b), pos + 1).otherwise(pos))
    return rows.join(plan, "playlist", "left").select("playlist", moved.cast("bigint").alias("pos"), "track_id")
