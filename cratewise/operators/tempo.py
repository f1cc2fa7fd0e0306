"""Tempo from an onset envelope."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cratewise.functions.numbers import clamp01, fold_range, log2, settle
from cratewise.operators.pcm import padded_chunks

# What counts as the same pulse at another level.
RELATED = [0.5, 1.0, 2.0, 1 / 3, 3.0, 2 / 3, 1.5]


@dataclass(frozen=True)
class TempoOptions:
    min_bpm: float = 50.0
    max_bpm: float = 220.0
    prior_bpm: float = 124.0
    prior_width: float = 0.9
    preferred_min: float = 78.0
    preferred_max: float = 165.0


def pack_series(rows: DataFrame, chunk: int, position: str = "frame", value: str = "value") -> DataFrame:
    """(track, position, value) rows as bounded arrays, in the PCM chunk layout."""
    packed = rows.groupBy("track_id", F.floor(F.col(position) / chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct(position, value))).alias("s"))
    return packed.select("track_id", F.lit(0).alias("channel"), "chunk", (F.col("chunk") * chunk).alias("start_sample"),
                         F.transform("s", lambda x: x[value]).alias("samples"))


def autocorrelation(envelope: DataFrame, frame_rate: float, options: TempoOptions = TempoOptions(),
                    chunk: int = 4096) -> DataFrame:
    """Unbiased autocorrelation (track_id, lag, auto) over the lags of the tempo range.

    A chunk and the frames after it give their share of every lag; only one row
    per chunk and lag is shuffled, whatever the track length.
    """
    min_lag = max(1, math.floor(60 * frame_rate / options.max_bpm))
    max_lag = math.ceil(60 * frame_rate / options.min_bpm)

    @pandas_udf("array<struct<lag:int,s:double,n:bigint>>")
    def shares(x: pd.Series, core: pd.Series) -> pd.Series:
        out = []
        for a, c in zip(x, core):
            a, c = np.asarray(a, np.float64), int(c)
            lags = range(min_lag, min(max_lag, len(a) - 1) + 1)
            ends = [min(c, len(a) - lag) for lag in lags]
            out.append([{"lag": lag, "s": float(a[:e] @ a[lag:lag + e]), "n": e} for lag, e in zip(lags, ends)])
        return pd.Series(out, dtype=object)

    padded = padded_chunks(pack_series(envelope, chunk), chunk, after=max_lag)
    rows = padded.select("track_id", F.inline(shares("samples", "core")))
    return rows.groupBy("track_id", "lag").agg((F.sum("s") / F.sum("n")).alias("auto"))


def tempogram(envelope: DataFrame, frame_rate: float, options: TempoOptions = TempoOptions(),
              chunk: int = 4096) -> DataFrame:
    """(track_id, lag, bpm, auto, score): harmonic sum under a log-normal prior.

    The lags of one track are a few hundred at most, so their array is bounded.
    """
    packed = autocorrelation(envelope, frame_rate, options, chunk).groupBy("track_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lag", "auto")))).alias("m"))
    rows = packed.select("track_id", "m", F.explode("m").alias("lag", "auto"))
    total = F.col("auto")
    for multiple, weight in ((2, 0.5), (3, 0.25), (4, 0.125)):
        total = total + F.coalesce(F.try_element_at("m", F.col("lag") * multiple), F.lit(0.0)) * weight
    bpm = F.lit(60.0 * frame_rate) / F.col("lag")
    octaves = log2(bpm / options.prior_bpm) / options.prior_width
    return rows.select("track_id", "lag", bpm.alias("bpm"), "auto", (total * F.exp(F.lit(-0.5) * octaves * octaves)).alias("score"))


def estimate_tempo(gram: DataFrame, options: TempoOptions = TempoOptions()) -> DataFrame:
    """BPM, raw BPM, confidences and up to four alternates per track."""
    s = gram.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("lag", "bpm", "score"))).alias("g"))
    s = settle(s, peak=F.aggregate("g", F.lit(0.0), lambda a, x: F.greatest(a, x["score"])))
    s = settle(s, at=F.get(F.filter(F.transform("g", lambda x, i: F.when(x["score"] == F.col("peak"), i)),
                                          lambda i: i.isNotNull()), F.lit(0)))
    n, at = F.size("g"), F.col("at")

    def score(i: Column) -> Column:
        return F.get("g", i)["score"]

    def bpm(i: Column) -> Column:
        return F.get("g", i)["bpm"]

    a, b, c = score(at - 1), score(at), score(at + 1)
    denom = a - b * 2 + c
    shift = (a - c) * 0.5 / denom
    refined = (F.when((at <= 0) | (at >= n - 1) | (denom == 0), bpm(at))
               .when(shift < 0, bpm(at) + shift * (bpm(at) - bpm(at - 1)))
               .otherwise(bpm(at) + shift * (bpm(at + 1) - bpm(at))))
    strength = lambda i: score(i) / F.col("peak")
    local = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i >= 1) & (i < n - 1) & (i != at) & (score(i) > score(i - 1))
                     & (score(i) >= score(i + 1)) & (strength(i) > 0.2))
    ranked = F.array_sort(F.transform(local, lambda i: F.struct((-strength(i)).alias("s"), i.alias("i"), bpm(i).alias("bpm"))))
    kind = "array<struct<s:double,i:int,bpm:double>>"
    distinct = F.aggregate(ranked, F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) < 4) & ~F.exists(acc, lambda d: F.abs(d["bpm"] - x["bpm"]) < 1.5), F.array_append(acc, x)).otherwise(acc))
    found = F.col("peak") > 0
    out = settle(s, raw_bpm=F.when(found, refined).otherwise(options.prior_bpm),
                 alternates=F.when(found, distinct).otherwise(F.array().cast(kind)))
    raw = F.col("raw_bpm")

    def related(x: Column) -> Column:
        hit = F.lit(False)
        for r in RELATED:
            hit = hit | (F.abs(x - raw * F.lit(r)) < 2)
        return hit
    rival = F.get(F.filter("alternates", lambda x: ~related(x["bpm"])), F.lit(0))["s"]

    def at_bpm(target: Column) -> Column:
        return F.aggregate("g", F.lit(0.0), lambda acc, x: F.when(
            F.abs(x["bpm"] - target) < 1.5, F.greatest(acc, x["score"] / F.col("peak"))).otherwise(acc))
    return out.select(
        "track_id", fold_range(raw, options.preferred_min, options.preferred_max).alias("bpm"), "raw_bpm",
        F.when(found, clamp01(F.lit(1.0) + F.coalesce(rival, F.lit(0.0)))).otherwise(0.0).alias("confidence"),
        F.when(found, clamp01(F.lit(1.0) - F.greatest(at_bpm(raw / 2), at_bpm(raw * 2)))).otherwise(0.0).alias("octave_confidence"),
        F.transform("alternates", lambda x: F.struct(x["bpm"].alias("bpm"), (-x["s"]).alias("strength"))).alias("alternates"))
