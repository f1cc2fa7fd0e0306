"""Key decision from chroma."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cratewise.functions import keys as ks
from cratewise.functions.numbers import clamp01

# Key profiles, tonic first; the first two are published, the third is the analyser's own.
PROFILES = {
    "krumhansl": {"major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
                  "minor": [6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]},
    "temperley": {"major": [5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0],
                  "minor": [5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0]},
    "electronic": {"major": [7.0, 1.5, 3.0, 1.5, 4.5, 4.0, 1.8, 5.5, 1.8, 3.2, 2.0, 2.2],
                   "minor": [7.0, 1.8, 3.2, 5.5, 1.8, 3.6, 1.9, 5.2, 3.4, 2.0, 3.0, 2.2]},
}
CANDIDATE = "struct<tonic:int,mode:string,score:double>"


def _templates() -> np.ndarray:
    """(12, 24): unit-length, zero-mean profiles, averaged over the three sets.

    Correlation with unit vectors is linear, so the mean of three correlations
    is one product with the mean template. Column 2t is major, 2t + 1 minor.
    """
    out = np.zeros((12, 24))
    for tonic in range(12):
        for m, mode in enumerate(("major", "minor")):
            for profile in PROFILES.values():
                p = np.asarray(profile[mode]) - np.mean(profile[mode])
                out[:, 2 * tonic + m] += np.roll(p / np.linalg.norm(p), tonic) / len(PROFILES)
    return out


def key_score(chroma: DataFrame) -> DataFrame:
    """Best key of each (track_id, chroma) row with margin, ambiguity and alternates."""
    templates = _templates()

    @pandas_udf("array<double>")
    def correlate(c: pd.Series) -> pd.Series:
        if len(c) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(c.to_numpy()).astype(np.float64)
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) @ templates), dtype=object)

    def named(i: Column, s: Column) -> Column:
        return F.struct((-s).alias("s"), i.alias("i"))
    ranked = chroma.select("track_id", "chroma", correlate("chroma").alias("_c")).withColumn(
        "_r", F.array_sort(F.transform("_c", lambda s, i: named(i, s))))
    best, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    tonic = F.floor(best["i"] / 2).cast("int")
    mode = F.when(best["i"] % 2 == 0, "major").otherwise("minor")
    other = ks.relative_tonic(tonic, mode) * 2 + F.when(mode == "major", 1).otherwise(0)
    top = -best["s"]
    candidates = F.transform(F.slice("_r", 2, 3), lambda x: F.struct(
        F.floor(x["i"] / 2).cast("int").alias("tonic"), F.when(x["i"] % 2 == 0, "major").otherwise("minor").alias("mode"),
        (-x["s"]).alias("score")))
    return ranked.select(
        "track_id", tonic.alias("tonic"), mode.alias("mode"), top.alias("score"),
        clamp01(F.greatest(F.lit(0.0), top) * 0.6 + (top + second["s"]) * 2).alias("confidence"),
        (top - F.get("_c", other) < 0.05).alias("relative_ambiguous"), candidates.alias("alternates"))


def key_support(detected: DataFrame, support: DataFrame) -> DataFrame:
    """A second reading (bass chroma) moves the confidence and never the key."""
    s = support.select("track_id", F.col("tonic").alias("s_tonic"), F.col("mode").alias("s_mode"), F.col("confidence").alias("s_conf"))
    j = detected.join(s, "track_id")
    tonic = F.col("tonic") == F.col("s_tonic")
    agreed = tonic & (F.col("mode") == F.col("s_mode"))
    confidence = (F.when(agreed, clamp01(F.col("confidence") + 0.08)).when(tonic, clamp01(F.col("confidence") + 0.03))
                  .otherwise(clamp01(F.col("confidence") * 0.9)))
    known = F.exists("alternates", lambda a: (a["tonic"] == F.col("s_tonic")) & (a["mode"] == F.col("s_mode")))
    extra = F.struct(F.col("s_tonic").alias("tonic"), F.col("s_mode").alias("mode"), F.col("s_conf").alias("score"))
    by_score = F.array_sort(F.array_append("alternates", extra), lambda a, b: F.when(a["score"] > b["score"], -1)
                            .when(a["score"] < b["score"], 1).otherwise(0))
    return j.select("track_id", "tonic", "mode", confidence.alias("confidence"), "relative_ambiguous", agreed.alias("agreed"),
                    F.slice(F.when(~agreed & ~known, by_score).otherwise(F.col("alternates")), 1, 4).alias("alternates"))
