"""Energy features, score, curve, and the library-wide percentile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cratewise.functions.frames import bin_product, mel_matrix
from cratewise.functions.numbers import clamp01, half_up
from cratewise.operators.ordered import with_halo, with_position
from cratewise.operators.spectrum import CHUNK, mel_bands
from cratewise.schemas import FrameGeometry

# Feature weights, and the range mapped to 0..1.
ENERGY_WEIGHTS = {"loudness": 0.3, "kick": 0.22, "onset_density": 0.15, "bass": 0.1, "highs": 0.1, "flux": 0.08, "percussive": 0.05}
ENERGY_RANGES = {"loudness": (-30.0, -6.0), "kick": (0.0, 6.0), "onset_density": (0.5, 8.0), "bass": (0.05, 0.45),
                 "highs": (0.02, 0.3), "flux": (0.0, 40.0)}
_FEATURES = {"loudness": "loudness_lufs", "kick": "kick_strength", "onset_density": "onset_density", "bass": "bass_ratio",
             "highs": "high_activity", "flux": "spectral_flux"}


def normalise(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(
        clamp01((value - low) / (high - low)))


def energy_features(frames: DataFrame, envelope: DataFrame, geometry: FrameGeometry, bands: int = 84,
                    chunk: int = CHUNK) -> DataFrame:
    """Band shares, flux, kick strength and onset density per track."""
    hz = np.array([geometry.hz(b) for b in range(geometry.bins)])
    matrix = np.stack([hz < 200, (hz > 4000) & (hz >= 200), np.ones_like(hz, bool)], axis=1).astype(float)
    matrix[0] = 0
    _, edges = mel_matrix(geometry, bands)
    above = np.nonzero(edges > 140)[0]
    kick_bands = max(1, int(above[0]) if len(above) else -1)
    w = Window.partitionBy("track_id", "_chunk").orderBy("frame")
    rise = F.aggregate(F.zip_with(F.slice("mags", 2, geometry.bins), F.slice("_p", 2, geometry.bins),
                                  lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    rows = (with_halo(frames, "frame", chunk, before=1).withColumn("_p", F.lag("mags").over(w)).where("_core")
            .select("track_id", "frame", bin_product(matrix)(F.col("mags")).alias("_s"),
                    F.when(F.col("_p").isNotNull(), rise).alias("_flux")))
    sums = rows.groupBy("track_id").agg(
        F.sum(F.get("_s", F.lit(0))).alias("_low"), F.sum(F.get("_s", F.lit(1))).alias("_high"),
        F.sum(F.get("_s", F.lit(2))).alias("_all"), F.avg("_flux").alias("_flux"))
    kick = mel_bands(frames, geometry, bands).groupBy("track_id").agg(
        F.avg(F.greatest(F.lit(0.0), F.array_max(F.slice("bands", 1, kick_bands)))).alias("kick_strength"))
    v, before, after = F.col("value"), F.lag("value").over(w), F.lead("value").over(w)
    peaks = (with_halo(envelope, "frame", chunk, before=1, after=1)
             .withColumn("_peak", (v > 0.15) & (v >= before) & (v > after)).where("_core").groupBy("track_id")
             .agg((F.count_if("_peak") / (F.count(F.lit(1)) / F.lit(geometry.frame_rate))).alias("onset_density")))
    total = F.col("_all")
    out = sums.join(kick, "track_id").join(peaks, "track_id", "left").select(
        "track_id", F.when(total > 0, F.col("_low") / total).otherwise(0.0).alias("bass_ratio"),
        F.when(total > 0, F.col("_high") / total).otherwise(0.0).alias("high_activity"),
        F.coalesce("_flux", F.lit(0.0)).alias("spectral_flux"), "kick_strength",
        F.coalesce("onset_density", F.lit(0.0)).alias("onset_density"))
    # The percussive share is the flux again, on the same 0..40 range.
    return out.withColumn("percussive_ratio", normalise(F.col("spectral_flux"), 0.0, 40.0))


def energy_score(features: DataFrame) -> DataFrame:
    """Raw score, level 1..10, confidence, and contributions ordered by points."""
    parts = {n: normalise(F.col(_FEATURES[n]), *ENERGY_RANGES[n]) for n in _FEATURES}
    parts["percussive"] = F.col("percussive_ratio")
    f = features.withColumns({f"n_{n}": e for n, e in parts.items()})
    score = F.lit(0.0)
    for n, weight in ENERGY_WEIGHTS.items():
        score = score + F.col(f"n_{n}") * weight
    order = ["loudness", "kick", "onset_density", "bass", "highs", "flux", "percussive"]
    values = [F.col(f"n_{n}") for n in order]
    mean = sum(values[1:], values[0]) / len(values)
    var = sum(((x - mean) * (x - mean) for x in values[1:]), (values[0] - mean) * (values[0] - mean)) / len(values)
    ranked = F.array_sort(F.array(*[F.struct((-(F.col(f"n_{n}") * w)).alias("p"), F.lit(i).alias("i"), F.lit(n).alias("name"),
                                             F.col(f"n_{n}").alias("normalised"), F.lit(w).alias("weight"))
                                    for i, (n, w) in enumerate(ENERGY_WEIGHTS.items())]))
    return f.withColumn("raw_score", score).select(
        *features.columns, "raw_score",
        F.greatest(F.lit(1), F.least(F.lit(10), half_up(F.col("raw_score") * 9 + 1))).cast("int").alias("level"),
        clamp01(F.lit(1.0) - F.sqrt(var) * 2).alias("confidence"),
        F.transform(ranked, lambda x: F.struct(x["name"].alias("name"), x["normalised"].alias("normalised"),
                                               x["weight"].alias("weight"), (-x["p"]).alias("points"))).alias("contributions"))


def energy_curve(envelope: DataFrame, frame_rate: float) -> DataFrame:
    """Mean onset strength per block of round(rate) frames, divided by the track's maximum."""
    per = max(1, int(np.floor(frame_rate + 0.5)))
    means = envelope.groupBy("track_id", F.floor(F.col("frame") / per).alias("sec")).agg(F.avg("value").alias("energy"))
    size = envelope.groupBy("track_id").agg(F.greatest(F.lit(1), F.floor((F.max("frame") + 1) / per)).alias("_n"))
    whole = means.join(size, "track_id").where(F.col("sec") < F.col("_n")).drop("_n")
    top = whole.groupBy("track_id").agg(F.max("energy").alias("_top"))
    return whole.join(top, "track_id").select(
        "track_id", "sec", F.when(F.col("_top") > 0, F.col("energy") / F.col("_top")).otherwise(F.col("energy")).alias("energy"))


def library_energy_percentile(scores: DataFrame) -> DataFrame:
    """Mid-rank percentile of each ``raw_score`` in the whole library.

    Counts per distinct score are made first; their running sum is taken over
    range partitions. No window spans the table, and a score that very many
    tracks share is one row.
    """
    usable = scores.where(F.col("raw_score").isNotNull() & ~F.isnan("raw_score") & (F.abs("raw_score") < float("inf")))
    counts = usable.groupBy("raw_score").agg(F.count(F.lit(1)).alias("_n"))
    total = usable.count()
    ranks = with_position(counts, [F.col("raw_score")], "_pos", {"_n": "_below"})
    pct = (F.col("_below") + F.col("_n") * 0.5) / F.lit(float(max(total, 1)))
    ranks = ranks.select("raw_score", (pct if total >= 2 else F.lit(None).cast("double")).alias("percentile"))
    return (scores.join(ranks, "raw_score", "left")
            .withColumn("display_level", half_up(F.col("percentile") * 10)).withColumn("sample_size", F.lit(total).cast("bigint")))
