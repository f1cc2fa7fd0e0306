"""Beat tracking, downbeats, grids and positions on a grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cratewise.functions.numbers import clamp01, settle
from cratewise.operators.ordered import with_halo
from cratewise.operators.tempo import pack_series
from cratewise.schemas import ANCHOR
from cratewise.session import cut_lineage


def _periods(bpm: float, frame_rate: float) -> tuple[float, int, int]:
    period = 60 * frame_rate / bpm
    start = max(1, int(np.floor(period / 2 + 0.5)))
    return period, start, max(start + 1, int(np.floor(period * 2 + 0.5)))


def _forward(values: np.ndarray, tail: np.ndarray, bpm: float, frame_rate: float, tightness: float):
    """Scores and predecessor distances of one chunk, given the scores before it.

    A distance of 0 means that a frame starts a chain.
    """
    period, low, high = _periods(bpm, frame_rate)
    back = np.arange(high, low - 1, -1)
    penalty = tightness * np.log(back / period) ** 2
    score = np.concatenate([tail, values])
    origin = len(tail)
    step = np.zeros(len(values), np.int32)
    for t in range(len(values)):
        at = origin + t
        first = max(0, at - high)
        stop = at - low + 1
        if stop <= first:
            continue
        options = score[first:stop] - penalty[high - at + first:high - at + stop]
        # of equal candidates the nearest wins
        best = len(options) - 1 - int(np.argmax(options[::-1]))
        score[at] += options[best]
        step[t] = at - (first + best)
    return score, step, high


def track_beats(envelope: DataFrame, tempo: DataFrame, frame_rate: float, tightness: float = 100.0,
                chunk: int = 65536) -> DataFrame:
    """(track_id, i, time_sec): the beat sequence by dynamic programming.

    The recurrence looks back two periods at most, so a track is worked through
    chunk by chunk, carrying only that tail; no task holds more than one chunk.
    A round handles chunk r of all tracks at once, so the number of rounds is
    the length of the longest track in chunks (one round up to 12 minutes).
    """
    series = cut_lineage(pack_series(envelope, chunk).select("track_id", "chunk", "samples"))
    rounds = (series.agg(F.max("chunk")).first()[0] or 0) + 1
    period = F.lit(60.0 * frame_rate) / F.col("raw_bpm")
    state = cut_lineage(tempo.where((F.col("raw_bpm") > 0) & (period >= 1)).select(
        "track_id", "raw_bpm", F.array().cast("array<double>").alias("tail"),
        F.lit(float("-inf")).alias("top"), F.lit(0).cast("bigint").alias("end")))
    steps = []
    for r in range(rounds):
        def forward(batches, r=r):
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    x = np.asarray(row.samples, np.float64)
                    tail = np.asarray(row.tail, np.float64)
                    score, step, high = _forward(x, tail, row.raw_bpm, frame_rate, tightness)
                    own = score[len(tail):]
                    k = int(np.argmax(own))
                    top, end = (float(own[k]), r * chunk + k) if own[k] > row.top else (row.top, row.end)
                    out.append((row.track_id, row.raw_bpm, score[-high:].tolist(), top, end, step.tolist()))
                yield pd.DataFrame(out, columns=["track_id", "raw_bpm", "tail", "top", "end", "steps"])

        here = series.where(F.col("chunk") == r).join(state, "track_id")
        done = cut_lineage(here.mapInPandas(
            forward, "track_id bigint, raw_bpm double, tail array<double>, top double, end bigint, steps array<int>"))
        steps.append(done.select("track_id", "steps"))
        state = done.drop("steps") if r == 0 else cut_lineage(
            done.drop("steps").unionByName(state.join(done.select("track_id"), "track_id", "left_anti")))
    position = state.select("track_id", F.col("end").alias("at"))
    found = None
    for r in reversed(range(rounds)):
        def backward(batches, r=r):
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    at, hits, step = int(row.at), [], row.steps
                    while at >= r * chunk:
                        hits.append(at)
                        d = int(step[at - r * chunk])
                        at = at - d if d else -1
                    out.append((row.track_id, at, hits))
                yield pd.DataFrame(out, columns=["track_id", "at", "hits"])

        ready = position.where(F.col("at") >= r * chunk).join(steps[r], "track_id")
        done = cut_lineage(ready.mapInPandas(backward, "track_id bigint, at bigint, hits array<bigint>"))
        beats = done.select("track_id", F.lit(r).alias("_r"), F.posexplode(F.reverse("hits")).alias("_k", "frame"))
        found = beats if found is None else found.unionByName(beats)
        if r:
            position = cut_lineage(done.select("track_id", "at").unionByName(
                position.join(done.select("track_id"), "track_id", "left_anti")))
    per = found.groupBy("track_id", "_r").agg(F.count(F.lit(1)).alias("_n"))
    # One row per track and chunk: how many beats came in earlier chunks.
    earlier = per.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_n"))).alias("m"))
    base = F.aggregate(F.map_values(F.map_filter("m", lambda k, v: k < F.col("_r"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.join(earlier, "track_id").select(
        "track_id", (base + F.col("_k")).alias("i"), (F.col("frame") / F.lit(float(frame_rate))).alias("time_sec"))


def downbeat_phase(beats: DataFrame, kick: DataFrame, frame_rate: float, beats_per_bar: int = 4) -> DataFrame:
    """(track_id, phase, confidence): the beat of the bar with the most kick energy.

    Each beat takes the largest kick value within one frame; beats join frames
    on (track, frame), which no track can skew.
    """
    centre = F.floor(F.col("time_sec") * frame_rate + 0.5)
    near = beats.select("track_id", "i", centre.alias("_f"), F.explode(F.sequence(centre - 1, centre + 1)).alias("frame"))
    peaks = (near.join(kick, ["track_id", "frame"]).groupBy("track_id", "i")
             .agg(F.greatest(F.max("value"), F.lit(0.0)).alias("v"), F.max((F.col("frame") == F.col("_f")).cast("int")).alias("_in"))
             .where("_in = 1"))
    totals = peaks.groupBy("track_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("i") % beats_per_bar == p, F.col("v"))), F.lit(0.0)).alias(f"_{p}")
        for p in range(beats_per_bar)])
    counts = beats.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"_{p}")).alias("t"), F.lit(p).alias("p")) for p in range(beats_per_bar)]))
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    enough = (F.col("_n") >= beats_per_bar * 2) & F.col("_r").isNotNull()
    return (counts.join(totals.withColumn("_r", ranked), "track_id", "left").select(
        "track_id", F.when(enough, first["p"]).otherwise(0).alias("phase"),
        F.when(enough & (first["t"] < 0), clamp01(F.lit(1.0) - second["t"] / first["t"])).otherwise(0.0).alias("confidence")))


def fit_grid(beats: DataFrame, tempo: DataFrame, downbeat: DataFrame, beats_per_bar: int = 4, chunk: int = 8192) -> DataFrame:
    """Analytic grid of each track: a fitted line, or anchors where the tempo moves.

    Two aggregations per track (line, then residuals); local tempi are means per
    window of beats, so the only array per track is one value per window.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("track_id", "_chunk").orderBy("i")
    steps = (with_halo(beats, "i", chunk, after=1).withColumn("_gap", F.lead("time_sec").over(w) - F.col("time_sec"))
             .where("_core").select("track_id", "i", "time_sec", "_gap"))
    line = steps.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope("time_sec", "i").alias("_slope"),
        F.regr_intercept("time_sec", "i").alias("_icept"), F.avg("_gap").alias("_mean"),
        F.stddev_pop("_gap").alias("_std"), F.min("time_sec").alias("_t0"))
    resid = (steps.join(line.select("track_id", "_slope", "_icept"), "track_id").groupBy("track_id")
             .agg(F.avg(F.abs(F.col("time_sec") - (F.col("_slope") * F.col("i") + F.col("_icept")))).alias("offset_sec")))
    size = max(4, beats_per_bar * 2)
    local = (steps.groupBy("track_id", F.floor(F.col("i") / size).alias("_b"))
             .agg(F.avg("_gap").alias("_g"), F.min("time_sec").alias("_t")).where("_g is not null")
             .groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("_b", "_g", "_t"))).alias("_w")))
    anchor = lambda t, i, bpm: F.struct(t.alias("time_sec"), i.cast("int").alias("beat_index"), bpm.alias("bpm"))
    moving = F.aggregate(
        "_w", F.array().cast(f"array<{ANCHOR}>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (F.abs(F.lit(60.0) / x["_g"] - F.element_at(acc, -1)["bpm"]) / F.element_at(acc, -1)["bpm"] > 0.02),
            F.array_append(acc, anchor(x["_t"], x["_b"] * size, F.lit(60.0) / x["_g"]))).otherwise(acc))
    starts = beats.where(F.col("i") < beats_per_bar).groupBy("track_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), "time_sec"))).alias("_s"), F.max("i").alias("_last"))
    j = (tempo.select("track_id", "raw_bpm").join(line, "track_id", "left").join(resid, "track_id", "left")
         .join(local, "track_id", "left").join(starts, "track_id", "left")
         .join(downbeat.select("track_id", "phase", F.col("confidence").alias("_dc")), "track_id", "left"))
    enough = F.coalesce(F.col("_n") >= 2, F.lit(False))
    stability = clamp01(F.lit(1.0) - F.col("_std") / F.greatest(F.col("_mean"), F.lit(1e-9)))
    j = j.withColumns({"stability": F.when(enough, stability).otherwise(0.0),
                       "offset_sec": F.when(enough, F.col("offset_sec")).otherwise(0.0)})
    fixed = (F.col("stability") > 0.9) & (F.col("offset_sec") < 0.035)
    fitted = F.when(F.col("_slope") > 0, F.lit(60.0) / F.col("_slope")).otherwise(F.col("raw_bpm"))
    anchors = (F.when(~enough, F.array(anchor(F.lit(0.0), F.lit(0), F.col("raw_bpm"))))
               .when(fixed, F.array(anchor(F.col("_icept"), F.lit(0), fitted))).otherwise(moving))
    first = F.try_element_at("_s", F.least(F.coalesce("phase", F.lit(0)).cast("int"), F.col("_last").cast("int")))
    return j.select(
        "track_id", F.struct(
            anchors.alias("anchors"), F.lit(beats_per_bar).alias("beats_per_bar"),
            F.when(enough, first).otherwise(0.0).alias("first_downbeat_sec"), (~enough | fixed).alias("is_fixed"),
            F.when(enough, clamp01(F.lit(1.0) - F.col("offset_sec") / 0.05) * F.col("stability")).otherwise(0.0).alias("grid_confidence"),
            F.when(enough, F.coalesce("_dc", F.lit(0.0))).otherwise(0.0).alias("downbeat_confidence")).alias("grid"),
        "offset_sec", "stability")


# --- positions on a grid: arithmetic on the anchors, no rows are joined ------------

def segments(anchors: Column, duration: Column) -> Column:
    """One struct per anchor: start, interval, first and last beat step, beats before it."""
    def segment(a: Column, n: Column) -> Column:
        interval = F.lit(60.0) / a["bpm"]
        following = F.get(anchors, n + 1)["time_sec"]
        stop = F.coalesce(following, duration)
        # steps k with time + k * interval before the next anchor and inside the track
        last = F.least(F.ceil((stop - 1e-9 - a["time_sec"]) / interval) - 1, F.floor((duration - a["time_sec"]) / interval))
        earliest = F.ceil(-a["time_sec"] / interval)
        first = F.when(n == 0, earliest).otherwise(F.greatest(F.lit(0), earliest))
        return F.struct(a["time_sec"].alias("t"), interval.alias("step"), first.cast("bigint").alias("k0"),
                        F.greatest(last, first - 1).cast("bigint").alias("k1"))
    return F.transform(anchors, segment)


def with_segments(grids: DataFrame) -> DataFrame:
    """``grids(anchors, duration_sec, ...)`` plus ``segs`` with the running beat index."""
    raw = settle(grids, _s=segments(F.col("anchors"), F.col("duration_sec")))
    start = F.struct(F.lit(0).cast("bigint").alias("i"), F.array().cast(
        "array<struct<t:double,step:double,k0:bigint,k1:bigint,i0:bigint>>").alias("out"))
    folded = F.aggregate("_s", start, lambda acc, x: F.struct(
        (acc["i"] + x["k1"] - x["k0"] + 1).alias("i"),
        F.array_append(acc["out"], F.struct(x["t"], x["step"], x["k0"], x["k1"], acc["i"].alias("i0"))).alias("out")))
    return settle(raw, _f=folded).withColumns({"segs": F.col("_f.out"), "beat_count": F.col("_f.i")}).drop("_s", "_f")


def beat_time(index: Column) -> Column:
    """Time of beat ``index`` from the ``segs`` of the row; NULL outside."""
    inside = F.filter("segs", lambda s: (index >= s["i0"]) & (index <= s["i0"] + s["k1"] - s["k0"]))
    s = F.get(inside, F.lit(0))
    return s["t"] + (index - s["i0"] + s["k0"]) * s["step"]


def beat_at_or_before(position: Column, slack: float = 0.0) -> Column:
    """Index of the last beat at or before a time; NULL before the first."""
    def last(s: Column) -> Column:
        k = F.least(F.floor((position + slack - s["t"]) / s["step"]), s["k1"])
        return F.when(k >= s["k0"], s["i0"] + k - s["k0"])
    return F.array_max(F.transform("segs", last))


def first_beat_from(position: Column) -> Column:
    """Index of the first beat at or after a time; NULL beyond the last."""
    def first(s: Column) -> Column:
        k = F.greatest(F.ceil((position - s["t"]) / s["step"]), s["k0"])
        return F.when(k <= s["k1"], s["i0"] + k - s["k0"])
    return F.array_min(F.transform("segs", first))


def derive_beats(grids: DataFrame) -> DataFrame:
    """(track_id, i, time_sec) rows of a grid, generated in place."""
    seg = with_segments(grids).select("track_id", F.explode("segs").alias("s")).where("s.k1 >= s.k0")
    return seg.select("track_id", "s", F.explode(F.sequence("s.k0", "s.k1")).alias("k")).select(
        "track_id", (F.col("s.i0") + F.col("k") - F.col("s.k0")).alias("i"),
        (F.col("s.t") + F.col("k") * F.col("s.step")).alias("time_sec"))


def bar_index_at(grids: DataFrame, position: str) -> DataFrame:
    """Adds ``bar``: bar number of a time on the row's grid, -1 before the downbeat."""
    g = with_segments(grids)
    down = F.coalesce(first_beat_from(F.col("first_downbeat_sec") - 1e-6), F.lit(0))
    g = settle(g, _down=down, _at=beat_at_or_before(F.col(position), 1e-9))
    at, down = F.col("_at"), F.col("_down")
    return g.withColumn("bar", F.when(at.isNull() | (at < down), -1).otherwise(
        F.floor((at - down) / F.col("beats_per_bar"))).cast("bigint")).drop("segs", "beat_count", "_down", "_at")


def nearest_beat(position: Column) -> Column:
    """Time of the beat nearest to a time, ``_at`` being the one before it; the earlier wins a tie."""
    here, following = beat_time(F.col("_at")), beat_time(F.col("_at") + 1)
    return F.when(following.isNotNull() & (F.abs(following - position) < F.abs(here - position)), following).otherwise(here)


def snap_to_beat(grids: DataFrame, position: str) -> DataFrame:
    """Adds ``nearest_sec``, the shift that puts a beat on the time, and the new downbeat."""
    g = settle(with_segments(grids), _at=F.coalesce(beat_at_or_before(F.col(position)), F.lit(0).cast("bigint")))
    g = settle(g, nearest_sec=nearest_beat(F.col(position)))
    pos, near = F.col(position), F.col("nearest_sec")
    return (g.withColumn("shift_sec", F.when(F.col("beat_count") == 0, pos).otherwise(pos - near))
            .withColumn("new_downbeat_sec", F.when(F.col("beat_count") == 0, pos).otherwise(near))
            .drop("segs", "beat_count", "_at"))


def phase_align(pairs: DataFrame, bar: bool = False) -> DataFrame:
    """Adds ``seek_sec``: where to put the own position to match the other's phase.

    A row carries both grids (``anchors``/``o_anchors``, ``duration_sec``/
    ``o_duration_sec``, ``beats_per_bar``) and both positions (``position_sec``,
    ``o_position_sec``). NULL where either grid has fewer than two beats.
    """
    o = with_segments(pairs.select("*", F.struct("anchors", "duration_sec").alias("_own"))
                      .withColumns({"anchors": F.col("o_anchors"), "duration_sec": F.col("o_duration_sec")}))
    o = settle(o, _i=F.coalesce(beat_at_or_before(F.col("o_position_sec"), 1e-6), F.lit(0).cast("bigint")))
    o = settle(o, _start=beat_time(F.col("_i")), _next=beat_time(F.least(F.col("_i") + 1, F.col("beat_count") - 1)))
    length = F.col("_next") - F.col("_start")
    o = settle(o, _phase=F.when((F.col("beat_count") >= 2) & (length > 0), (F.col("o_position_sec") - F.col("_start")) / length))
    o = (o.drop("segs", "beat_count", "_i", "_start", "_next")
         .withColumns({"anchors": F.col("_own.anchors"), "duration_sec": F.col("_own.duration_sec")}))
    m = with_segments(o)
    mine = F.coalesce(beat_at_or_before(F.col("position_sec"), 1e-6), F.lit(0).cast("bigint"))
    if bar:
        per = F.col("beats_per_bar")
        mine = F.floor(mine / per + 0.5) * per
        mine = F.greatest(F.lit(0), F.least(mine, F.col("beat_count") - 1 - per))
    m = settle(m, _m=mine)
    m = settle(m, _begin=beat_time(F.col("_m")), _end=beat_time(F.least(F.col("_m") + 1, F.col("beat_count") - 1)))
    return m.withColumn("seek_sec", F.when(F.col("beat_count") >= 2, F.col("_begin") + F.col("_phase") * (
        F.col("_end") - F.col("_begin")))).drop("segs", "beat_count", "_own", "_phase", "_m", "_begin", "_end")
