"""Bars, sections, labels and phrases from a grid and per-second curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cratewise.functions.numbers import clamp01, settle
from cratewise.operators.beats import beat_time, first_beat_from, with_segments
from cratewise.operators.ordered import with_halo
from cratewise.session import cut_lineage

MIN_BARS_BETWEEN = 8
BOUNDARY_SHIFT = 0.25


def bar_ranges(grids: DataFrame) -> DataFrame:
    """(track_id, duration_sec, bar, start_sec, end_sec, bar_count); bar 0 starts at zero.

    Bar n starts on beat downbeat + (n - 1) * beats per bar, by arithmetic on
    the anchors; a downbeat at time zero adds no bar of its own.
    """
    per, last = F.col("beats_per_bar"), F.col("beat_count") - 1
    g = settle(with_segments(grids), _d=first_beat_from(F.col("first_downbeat_sec") - 1e-6))
    # skip a beat that is not after zero or not before the end
    g = settle(g, _first=F.when(beat_time(F.col("_d")) > 0, F.col("_d")).otherwise(F.col("_d") + per),
               _last=F.when(beat_time(last) < F.col("duration_sec"), last).otherwise(last - 1))
    n = F.when(F.col("_first") <= F.col("_last"), F.floor((F.col("_last") - F.col("_first")) / per) + 1).otherwise(0)
    g = settle(g, bar_count=F.coalesce(n, F.lit(0)).cast("bigint") + 1)
    rows = g.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bar_count") - 1)).alias("bar"))

    def start(bar: Column) -> Column:
        return F.when(bar == 0, 0.0).otherwise(beat_time(F.col("_first") + (bar - 1) * per))
    rows = settle(rows, start_sec=start(F.col("bar")), _next=start(F.col("bar") + 1))
    return rows.select("track_id", "duration_sec", "bar", "start_sec",
                       F.when(F.col("bar") + 1 < F.col("bar_count"), F.col("_next"))
                       .otherwise(F.col("duration_sec")).alias("end_sec"), "bar_count")


def mean_over_range(ranges: DataFrame, curve: DataFrame, value: str) -> DataFrame:
    """Mean of a per-second curve over [start_sec, end_sec), weighted by overlap.

    A range emits the seconds it covers and joins on (track, second): no range
    condition, and no track can make a hot key. A missing second counts as 0.
    """
    low, high = F.floor("start_sec"), F.ceil("end_sec")
    covered = F.when(F.col("end_sec") > F.col("start_sec"), F.sequence(low, high - 1))
    pieces = ranges.select("*", F.explode_outer(covered).alias("sec"))
    overlap = F.least(F.col("end_sec"), F.col("sec") + 1) - F.greatest(F.col("start_sec"), F.col("sec"))
    # The other range columns hang on the keys; grouping by all of them keeps
    # them without a join back.
    sums = (pieces.join(curve.select("track_id", "sec", value), ["track_id", "sec"], "left")
            .groupBy(*ranges.columns).agg(F.sum(F.coalesce(value, F.lit(0.0)) * overlap).alias("_s"), F.sum(overlap).alias("_w")))
    return sums.withColumn(value, F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(0.0)).drop("_s", "_w")


def bars(grids: DataFrame, curve: DataFrame) -> DataFrame:
    return mean_over_range(bar_ranges(grids), curve, "energy")


def section_boundaries(bars_: DataFrame, chunk: int = 1024) -> DataFrame:
    """(track_id, section, bar): bar 0, then shifts of at least 0.25 between 4-bar means.

    Two boundaries are eight bars apart at least: an ordered fold over the
    candidate bars of a track, which are the only values gathered per track.
    """
    w = Window.partitionBy("track_id", "_chunk").orderBy("bar")
    after = F.avg("energy").over(w.rowsBetween(0, 3))
    before = F.avg("energy").over(w.rowsBetween(-4, -1))
    shifts = (with_halo(bars_, "bar", chunk, before=4, after=3).withColumn("_d", F.abs(after - before))
              .where("_core").where((F.col("bar") >= 4) & (F.col("bar") + 4 <= F.col("bar_count")) & (F.col("_d") >= BOUNDARY_SHIFT)))
    found = shifts.groupBy("track_id").agg(F.array_sort(F.collect_list("bar")).alias("c"))
    tracks = bars_.where("bar = 0").select("track_id")
    chosen = F.aggregate(F.coalesce("c", F.array().cast("array<bigint>")), F.array(F.lit(0).cast("bigint")),
                         lambda acc, x: F.when(x - F.element_at(acc, -1) >= MIN_BARS_BETWEEN, F.array_append(acc, x)).otherwise(acc))
    return tracks.join(found, "track_id", "left").select("track_id", F.posexplode(chosen).alias("section", "bar"))


def sections(bars_: DataFrame, curve: DataFrame, vocal: bool = True, chunk: int = 1024) -> DataFrame:
    """Labelled sections with energy relative to the loudest one of the track."""
    bars_ = cut_lineage(bars_)  # read three times below
    b = section_boundaries(bars_, chunk)
    starts = b.join(bars_.select("track_id", "bar", "start_sec", "duration_sec"), ["track_id", "bar"])
    nxt = starts.select("track_id", (F.col("section") - 1).alias("section"), F.col("start_sec").alias("_end"))
    ranges = starts.join(nxt, ["track_id", "section"], "left").select(
        "track_id", "section", "start_sec", F.coalesce("_end", "duration_sec").alias("end_sec"), "duration_sec")
    e = mean_over_range(ranges, curve, "energy")
    if vocal:
        e = mean_over_range(e, curve, "vocal")
    else:
        e = e.withColumn("vocal", F.lit(0.35))
    e = cut_lineage(e)
    per = e.groupBy("track_id").agg(F.greatest(F.max("energy"), F.lit(1e-9)).alias("_peak"), F.count(F.lit(1)).alias("section_count"))
    rel = e.join(per, "track_id").withColumn("energy", F.col("energy") / F.col("_peak"))
    following = rel.select("track_id", (F.col("section") - 1).alias("section"), F.col("energy").alias("_next"))
    full = rel.join(following, ["track_id", "section"], "left").withColumns({
        "energy_delta": F.coalesce("_next", "energy") - F.col("energy"),
        "position": F.when(F.col("duration_sec") > 0, F.col("start_sec") / F.col("duration_sec")).otherwise(0.0)})
    full = settle(full, _l=section_label())
    label = F.col("_l")
    return full.select("track_id", "section", "start_sec", "end_sec", "energy", "vocal", "energy_delta", "position",
                       label["label"].alias("label"), F.least(F.lit(1.0), label["confidence"]).alias("confidence"))


def section_label() -> Column:
    """Ordered rules on energy, vocal, energy_delta, position, section, section_count."""
    e, voc, d, pos = F.col("energy"), F.col("vocal"), F.col("energy_delta"), F.col("position")
    first, final = F.col("section") == 0, F.col("section") == F.col("section_count") - 1
    single = F.col("section_count") == 1

    def out(label, confidence) -> Column:
        return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"),
                        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))
    return (F.when(single & (voc > 0.55), out("Vocal", 0.45))
            .when(single & (voc < 0.25), out("Instrumental", 0.45))
            .when(single, out("Verse", 0.3))
            .when(first & (e < 0.6), out("Intro", (F.lit(1.0) - e) * 0.2 + 0.7))
            .when(final & (e < 0.7), out("Outro", (F.lit(1.0) - e) * 0.2 + 0.65))
            .when((d > 0.22) & (e < 0.8), out("Build", F.least(F.lit(0.85), d + 0.5)))
            .when(e > 0.78, out("Drop", F.least(F.lit(0.9), e * 0.5 + 0.45)))
            .when(e < 0.3, out(F.when(voc > 0.45, "Breakdown").otherwise("Sparse"), F.lit(0.55) + (F.lit(0.3) - e)))
            .when((e < 0.55) & (d > -0.1) & (pos > 0.3) & (pos < 0.8), out("Breakdown", 0.55))
            .when(voc > 0.55, out("Verse", voc * 0.3 + 0.5))
            .when(voc < 0.25, out("Instrumental", F.lit(0.5) + (F.lit(0.25) - voc)))
            .otherwise(out(F.when(pos > 0.55, "Bridge").otherwise("Vocal"), 0.4)))


PHRASE_PRIORS = {8: 0.08, 16: 0.12, 32: 0.04}


def phrases(grids: DataFrame, curve: DataFrame) -> DataFrame:
    """(track_id, phrase, bar, start_sec, end_sec, length_bars, confidence).

    For each length: how much larger the energy change is on its boundaries
    than on the other bars. Means over four bars before and after a bar come
    from one range join, so long tracks are spread by second.
    """
    ranges = bar_ranges(grids)
    starts = ranges.select("track_id", "bar", "start_sec")
    n = F.col("bar_count")
    mid = ranges.where((F.col("bar") >= 4) & (F.col("bar") + 4 <= n)).select(
        "track_id", "bar", "bar_count", F.col("start_sec").alias("_at"), F.least(F.col("bar") + 4, n - 1).alias("_to"))
    edges = (mid.join(starts.select("track_id", (F.col("bar") + 4).alias("bar"), F.col("start_sec").alias("_lo")), ["track_id", "bar"])
             .join(starts.select("track_id", F.col("bar").alias("_to"), F.col("start_sec").alias("_hi")), ["track_id", "_to"]))
    two = edges.select("track_id", "bar", "bar_count", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("_lo").alias("start_sec"), F.col("_at").alias("end_sec")),
        F.struct(F.lit(1).alias("side"), F.col("_at").alias("start_sec"), F.col("_hi").alias("end_sec")))))
    means = mean_over_range(two, curve, "energy")
    deltas = means.groupBy("track_id", "bar", "bar_count").agg(
        F.abs(F.sum(F.when(F.col("side") == 1, F.col("energy")).otherwise(-F.col("energy")))).alias("_d"))
    sums = deltas.groupBy("track_id").agg(*[x for k in PHRASE_PRIORS for x in (
        F.coalesce(F.avg(F.when(F.col("bar") % k == 0, F.col("_d"))), F.lit(0.0)).alias(f"_on{k}"),
        F.coalesce(F.avg(F.when(F.col("bar") % k != 0, F.col("_d"))), F.lit(0.0)).alias(f"_off{k}"))])
    has_curve = curve.select("track_id").distinct().withColumn("_curve", F.lit(True))
    tracks = (ranges.where("bar = 0").select("track_id", "duration_sec", "bar_count").join(sums, "track_id", "left")
              .join(has_curve, "track_id", "left"))

    def score(k: int) -> Column:
        on, off = F.coalesce(f"_on{k}", F.lit(0.0)), F.coalesce(f"_off{k}", F.lit(0.0))
        ratio = F.when(off > 1e-6, on / off).when(on > 0, 1.2).otherwise(0.0)
        measured = F.col("_curve").isNotNull() & (n >= k + 4)
        value = F.when(measured, F.least(F.lit(0.7), ratio * 0.25) + PHRASE_PRIORS[k]).otherwise(PHRASE_PRIORS[k])
        return F.when(n >= k, value)
    # -score first, then the shorter length: the first best of 8, 16, 32
    options = F.array_compact(F.array(*[F.when(score(k).isNotNull(), F.struct((-score(k)).alias("s"), F.lit(k).alias("k")))
                                        for k in PHRASE_PRIORS]))
    best = F.array_min(options)
    chosen = tracks.withColumn("_b", best).select(
        "track_id", "duration_sec", "bar_count", F.coalesce(F.col("_b.k"), F.lit(8)).alias("length_bars"),
        F.when(F.col("_b").isNull(), 0.3).otherwise(clamp01(-F.col("_b.s"))).alias("confidence"))
    heads = chosen.select("*", F.explode(F.expr("sequence(0L, bar_count - 1, cast(length_bars as bigint))")).alias("bar"))
    end = starts.select("track_id", F.col("bar").alias("_e"), F.col("start_sec").alias("_end"))
    return (heads.join(starts, ["track_id", "bar"]).withColumn("_e", F.col("bar") + F.col("length_bars"))
            .join(end, ["track_id", "_e"], "left")
            .select("track_id", "bar", "start_sec", F.coalesce("_end", "duration_sec").alias("end_sec"), "length_bars", "confidence"))
