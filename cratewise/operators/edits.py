"""Effective values, grid edits, edit validation, cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cratewise.schemas import CUE, GRID


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def effective_bpm(manual_grid="manual_grid", manual_bpm="manual_bpm", analysis="analysis") -> Column:
    """First anchor of a manual grid, else the manual BPM, else the analysis."""
    return F.coalesce(F.get(_c(manual_grid)["anchors"], F.lit(0))["bpm"], _c(manual_bpm),
                      _c(analysis)["tempo"]["bpm"])


def effective_key(analysis="analysis") -> Column:
    """Struct (tonic, mode, manual); a manual key counts only when both parts are set."""
    tonic, mode, a = F.col("manual_key_tonic"), F.col("manual_key_mode"), _c(analysis)
    manual = tonic.isNotNull() & mode.isNotNull()
    return (F.when(manual, F.struct(tonic.alias("tonic"), mode.alias("mode"), F.lit(True).alias("manual")))
            .when(a["key"].isNotNull(), F.struct(a["key"]["tonic"].alias("tonic"), a["key"]["mode"].alias("mode"),
                                                 F.lit(False).alias("manual"))))


def set_grid_bpm(grid: Column, bpm: Column) -> Column:
    """One anchor at the first downbeat; an unusable tempo leaves the grid alone."""
    pinned = F.array(F.struct(grid["first_downbeat_sec"].alias("time_sec"), F.lit(0).alias("beat_index"),
                              bpm.cast("double").alias("bpm")))
    changed = (grid.withField("anchors", pinned).withField("is_fixed", F.lit(True))
               .withField("grid_confidence", F.lit(1.0)))
    return F.when(grid.isNull(), F.lit(None).cast(GRID)).when(
        (bpm > 0) & ~F.isnan(bpm) & (bpm < float("inf")), changed).otherwise(grid)


def scale_tempo(grid: Column, factor: Column) -> Column:
    """Multiply every tempo; anchor times pivot on the first downbeat."""
    pivot = grid["first_downbeat_sec"]
    anchors = F.transform(grid["anchors"], lambda a: F.struct(
        (pivot + (a["time_sec"] - pivot) / factor).alias("time_sec"),
        a["beat_index"].alias("beat_index"), (a["bpm"] * factor).alias("bpm")))
    return F.when((factor > 0) & (factor < float("inf")), grid.withField("anchors", anchors)).otherwise(grid)


def nudge_grid(grid: Column, delta: Column) -> Column:
    anchors = F.transform(grid["anchors"], lambda a: F.struct(
        (a["time_sec"] + delta).alias("time_sec"), a["beat_index"].alias("beat_index"), a["bpm"].alias("bpm")))
    return (grid.withField("anchors", anchors)
            .withField("first_downbeat_sec", grid["first_downbeat_sec"] + delta))


def effective_grid() -> Column:
    """Manual grid, else the automatic grid re-pinned to a manual BPM, else automatic."""
    auto, bpm = F.col("analysis.grid"), F.col("manual_bpm")
    return (F.when(F.col("manual_grid").isNotNull(), F.col("manual_grid"))
            .when(auto.isNotNull() & bpm.isNotNull(), set_grid_bpm(auto, bpm)).otherwise(auto))


def grid_is_manual() -> Column:
    return F.col("manual_grid").isNotNull() | (
        F.col("analysis.grid").isNotNull() & F.col("manual_bpm").isNotNull())


def effective_tracks(tracks: DataFrame) -> DataFrame:
    """The one view in which manual values win over automatic ones."""
    key = effective_key()
    return tracks.select("*", effective_bpm().alias("bpm"), key["tonic"].alias("tonic"),
                         key["mode"].alias("mode"), F.coalesce(key["manual"], F.lit(False)).alias("key_manual"),
                         effective_grid().alias("grid"), grid_is_manual().alias("grid_manual"))


def lock_grid(tracks: DataFrame, locks: DataFrame) -> DataFrame:
    """``locks(id, locked)``: locking freezes the effective grid as the manual one."""
    wanted = locks.select("id", F.col("locked").alias("_lock"))
    frozen = effective_grid()
    return (tracks.join(wanted, "id", "left")
            .withColumn("manual_grid", F.when(F.col("_lock"), frozen).otherwise(F.col("manual_grid")))
            .withColumn("grid_locked", F.coalesce("_lock", "grid_locked")).drop("_lock"))


def validate_edits(edits: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds ``reason``: NULL for an accepted edit, else why it is refused.

    ``edits(id, track_id, kind, bpm, tonic, mode, time_sec, name)`` with kind
    ``bpm``, ``grid``, ``key``, ``cue`` or ``review``. NULL bpm or key clears.
    """
    facts = tracks.select(F.col("id").alias("track_id"),
                          F.coalesce("grid_locked", F.lit(False)).alias("_locked"), "duration_sec")
    bpm, kind, t = F.col("bpm"), F.col("kind"), F.col("time_sec")
    bad_bpm = F.isnan(bpm) | (bpm < 20) | (bpm > 400)
    bad_time = F.isnan(t) | (F.abs(t) == float("inf"))
    bad_key = (F.col("tonic").isNull() != F.col("mode").isNull()) | (F.col("tonic") < 0) | (F.col("tonic") > 11)
    reason = (F.when(F.col("_locked").isNull(), "unknown track")
              .when(kind.isin("bpm", "grid") & F.coalesce(bad_bpm, F.lit(False)), "tempo out of range")
              .when((kind == "grid") & F.coalesce(bad_time, F.lit(True)), "anchor time not finite")
              .when(kind.isin("bpm", "grid") & F.col("_locked"), "grid locked")
              .when((kind == "key") & F.coalesce(bad_key, F.lit(False)), "incomplete key")
              .when((kind == "cue") & F.coalesce(bad_time | (t < 0) | (t >= F.col("duration_sec")), F.lit(True)),
                    "cue outside track"))
    return (edits.join(facts, "track_id", "left").withColumn("reason", reason)
            .drop("_locked", "duration_sec"))


def apply_edits(tracks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Latest manual values per track; any tempo, grid or key edit clears ``reviewed_at``.

    One map-side combined aggregation per track picks the last edit of each
    kind, so a track with very many edits is not gathered anywhere.
    """
    kind, seq = F.col("kind"), F.col("id")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.struct(value.alias("v"), seq.alias("seq")), F.when(when, seq))

    latest = accepted.where(kind.isin("bpm", "grid", "key")).groupBy(F.col("track_id").alias("id")).agg(
        last(F.col("bpm"), (kind == "bpm") & F.col("bpm").isNotNull()).alias("_bpm"),
        F.max(F.when((kind == "bpm") & F.col("bpm").isNull(), seq)).alias("_clear"),
        last(F.struct("time_sec", "bpm"), kind == "grid").alias("_grid"),
        last(F.struct("tonic", "mode"), kind == "key").alias("_key"),
        F.lit(True).alias("_edited"))
    g = F.col("_grid.v")
    from_edit = F.when(F.col("_grid").isNotNull(), F.struct(
        F.array(F.struct(g["time_sec"].alias("time_sec"), F.lit(0).alias("beat_index"), g["bpm"].alias("bpm"))).alias("anchors"),
        F.lit(4).alias("beats_per_bar"), g["time_sec"].alias("first_downbeat_sec"), F.lit(True).alias("is_fixed"),
        F.lit(1.0).alias("grid_confidence"), F.lit(1.0).alias("downbeat_confidence"))).cast(GRID)
    never = F.lit(-1)
    b_seq = F.coalesce(F.col("_bpm.seq"), never)
    g_seq = F.coalesce(F.col("_grid.seq"), never)
    c_seq = F.coalesce(F.col("_clear"), never)
    # The grid a BPM edit re-pins: the last grid edit, the stored manual grid, or
    # the automatic one if a clear came in between.
    base = (F.when(g_seq > c_seq, from_edit).when(c_seq >= 0, F.col("analysis.grid")).otherwise(effective_grid()))
    grid = (F.when((c_seq > b_seq) & (c_seq > g_seq), F.lit(None).cast(GRID))
            .when(b_seq > g_seq, set_grid_bpm(base, F.col("_bpm.v")))
            .when(g_seq >= 0, from_edit).otherwise(F.col("manual_grid")))
    bpm = (F.when((c_seq > b_seq) & (c_seq > g_seq), F.lit(None).cast("double"))
           .when(b_seq > g_seq, F.col("_bpm.v")).when(g_seq >= 0, g["bpm"]).otherwise(F.col("manual_bpm")))
    keyed = F.col("_key").isNotNull()
    return tracks.join(latest, "id", "left").withColumns({
        "manual_grid": grid, "manual_bpm": bpm,
        "manual_key_tonic": F.when(keyed, F.col("_key.v.tonic")).otherwise(F.col("manual_key_tonic")),
        "manual_key_mode": F.when(keyed, F.col("_key.v.mode")).otherwise(F.col("manual_key_mode")),
        "reviewed_at": F.when(F.col("_edited"), F.lit(None)).otherwise(F.col("reviewed_at")),
    }).drop("_bpm", "_clear", "_grid", "_key", "_edited")


def add_cue(cues: Column, cue_id: Column, time_sec: Column, name: Column) -> Column:
    """Append and keep the list sorted by time; a blank name becomes ``Cue``."""
    cue = F.struct(cue_id.cast("string").alias("id"),
                   F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Cue")).alias("name"),
                   time_sec.cast("double").alias("time_sec"))
    empty = F.array().cast(f"array<{CUE}>")
    return F.array_sort(F.array_append(F.coalesce(cues, empty), cue),
                        lambda a, b: F.when(a["time_sec"] < b["time_sec"], -1)
                        .when(a["time_sec"] > b["time_sec"], 1).otherwise(0))


def remove_cue(cues: Column, cue_id: Column) -> Column:
    return F.filter(cues, lambda c: c["id"] != cue_id)


def tap_tempo(taps: DataFrame) -> DataFrame:
    """``taps(group_id, seq, at_sec)``: 60 over the median gap between 0.2 and 2 s.

    Gaps come from a range-partitioned lag and the median from their ranks, so
    one long tap run is no hot task and no buffer.
    """
    from cratewise.operators.ordered import grouped_quantiles, with_neighbour
    gaps = with_neighbour(taps, ["group_id"], ["seq"], {"at_sec": "_before"}, "previous")
    gap = F.col("at_sec") - F.col("_before")
    kept = gaps.select("group_id", gap.alias("gap")).where((F.col("gap") > 0.2) & (F.col("gap") < 2))
    return grouped_quantiles(kept, ["group_id"], "gap", {"median": 0.5}).select(
        "group_id", (F.lit(60.0) / F.col("median")).alias("bpm"), F.col("n").alias("gaps"))
