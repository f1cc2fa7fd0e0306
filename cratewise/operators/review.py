"""Review reasons, staleness, provenance and tag write planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cratewise.functions import keys as ks, text as tx
from cratewise.functions.numbers import half_up
from cratewise.schemas import ANALYSIS_VERSION

VERIFY_BELOW = 0.7
BLOCK_BELOW = 0.5


def is_stale(current_version: int = ANALYSIS_VERSION, outdated: Column | None = None) -> Column:
    old = F.coalesce("analysis_version", F.lit(0)) < current_version
    if outdated is not None:
        old = old | outdated
    return F.col("analysis").isNotNull() & old


def review_reasons(current_version: int = ANALYSIS_VERSION, outdated: Column | None = None) -> Column:
    """Reasons a row needs a look; a failure or a missing analysis stands alone."""
    a, manual_grid = F.col("analysis"), F.col("manual_grid").isNotNull()
    old = (F.coalesce("analysis_version", F.lit(0)) < current_version) | a["loudness"].isNull() | a["energy"].isNull()
    if outdated is not None:
        old = old | outdated
    no_key = F.col("manual_key_tonic").isNull()
    listed = F.array_compact(F.array(
        F.when(old, "Analysis needs updating"),
        F.when(~manual_grid & F.col("manual_bpm").isNull() & (a["tempo"]["confidence"] < VERIFY_BELOW),
               "Tempo confidence below 70%"),
        F.when(~manual_grid & (a["grid"]["grid_confidence"] < VERIFY_BELOW), "Beat-grid confidence below 70%"),
        F.when(no_key & (a["key"]["confidence"] < VERIFY_BELOW), "Key confidence below 70%"),
        F.when(no_key & a["key"]["relative_ambiguous"], "Relative major/minor is ambiguous")))
    return (F.when(F.length("analysis_error") > 0,
                   F.array(F.concat(F.lit("Analysis failed: "), F.col("analysis_error"))))
            .when(a.isNull(), F.array(F.lit("Not analysed"))).otherwise(listed))


def needs_review(current_version: int = ANALYSIS_VERSION, outdated: Column | None = None) -> Column:
    return F.col("reviewed_at").isNull() & (F.size(review_reasons(current_version, outdated)) > 0)


def stale_tracks(tracks: DataFrame, current_version: int = ANALYSIS_VERSION) -> DataFrame:
    return tracks.where(is_stale(current_version))


MOST_ANALYZERS = 1000


def stale_analyzers(tracks: DataFrame, provenance: DataFrame, expected: DataFrame) -> DataFrame:
    """(track_id, analyzer) pairs without an identical stored run.

    ``expected`` is the fixed analyser list (about ten rows), so the pairs are
    made by a row-local explode of that list, not by a join.
    """
    wanted = [tuple(r) for r in expected.select("analyzer", "version", "params_hash").limit(MOST_ANALYZERS + 1).collect()]
    if len(wanted) > MOST_ANALYZERS:
        raise ValueError("the expected analysers are a fixed list, not a table")
    pairs = tracks.select(F.col("id").alias("track_id"), F.inline(F.array(*[
        F.struct(F.lit(a).alias("analyzer"), F.lit(v).alias("version"), F.lit(p).alias("params_hash"))
        for a, v, p in wanted])))
    return (pairs.join(provenance, ["track_id", "analyzer", "version", "params_hash"], "left_anti")
            .select("track_id", "analyzer"))


# Analyser names, versions and parameters.
ANALYZERS = {
    "preprocessing": ("1.0.0", {"sampleRate": "22050", "fftSize": "1024", "hopSize": "256"}),
    "tempo": ("1.0.0", {"method": "autocorrelation-harmonic-prior"}),
    "grid": ("1.0.0", {"method": "dynamic-programming", "beatsPerBar": "4"}),
    "key": ("1.1.0", {"fftSize": "4096", "hopSize": "2048", "bassChroma": "hpss-lowband"}),
    "loudness": ("1.0.0", {"sampleRate": "source", "truePeakFactor": "4"}),
    "energy": ("1.1.0", {"curve": "per-second", "weights": "fixed-v1"}),
    "vocals": ("1.0.0", {"method": "spectral-heuristic"}),
    "structure": ("1.0.0", {"method": "energy-vocal-bar-suggestions"}),
    "phrase": ("1.0.0", {"method": "effective-grid-8-16-32"}),
    "hpss": ("1.0.0", {"method": "median-filter", "harmonicWidth": "17", "percussiveWidth": "17"}),
    "fingerprint": ("1.0.0", {"method": "spectral-fingerprint"}),
}


def param_fingerprint(params: Column) -> Column:
    """Identity of a parameter map that does not depend on entry order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params)))), 256)


def expected_analyzers(spark: SparkSession) -> DataFrame:
    rows = [(name, version, params) for name, (version, params) in ANALYZERS.items()]
    return (spark.createDataFrame(rows, "analyzer string, version string, params map<string,string>")
            .withColumn("params_hash", param_fingerprint(F.col("params"))))


def record_provenance(tracks: DataFrame, completed_at: int) -> DataFrame:
    """One row per analysed track and analyser, with the confidence it reported."""
    a = F.col("analysis")
    confidence = {
        "tempo": a["tempo"]["confidence"], "grid": a["grid"]["grid_confidence"],
        "key": a["key"]["confidence"], "energy": a["energy"]["confidence"],
        "phrase": a["phrases"]["confidence"],
        "hpss": F.lit(1.0) - F.abs(F.lit(0.5) - a["hpss"]["percussive_ratio"])}
    nothing = F.lit(None).cast("double")
    runs = F.array(*[F.struct(
        F.lit(name).alias("analyzer"), F.lit(version).alias("version"),
        param_fingerprint(F.create_map(*[F.lit(x) for kv in params.items() for x in kv])).alias("params_hash"),
        confidence.get(name, nothing).alias("confidence")) for name, (version, params) in ANALYZERS.items()])
    return tracks.where(a.isNotNull()).select(
        F.col("id").alias("track_id"), F.inline(runs)).withColumn("completed_at", F.lit(completed_at))


def gate_by_review(tracks: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds ``blocked``; a track without a flag row is allowed."""
    return (tracks.join(flags.select("id", F.col("needs_review").alias("_f")), "id", "left")
            .withColumn("blocked", F.coalesce("_f", F.lit(False))).drop("_f"))


def _percent(col: Column) -> Column:
    return half_up(col * 100).cast("string")


def write_plan(tracks: DataFrame, include_camelot: bool = False, include_comment: bool = False,
               override_low_confidence: bool = False) -> DataFrame:
    """Proposed tag changes, one row each; files without a tag writer give none.

    ``tracks`` is the effective view. A manual value is never blocked; an
    automatic one below 0.5 is, and one below 0.7 is kept with a warning.
    """
    a, tags = F.col("analysis"), F.col("tags")
    bpm, tonic, mode = F.col("bpm"), F.col("tonic"), F.col("mode")
    text, real = F.lit(None).cast("string"), F.lit(None).cast("double")

    def change(field, label, pos, current, proposed, confidence, source, graded=True):
        low = F.coalesce(confidence < BLOCK_BELOW, F.lit(False)) & (source == "automatic")
        doubt = F.coalesce(confidence < VERIFY_BELOW, F.lit(False)) & (source == "automatic")
        blocked = low & F.lit(not override_low_confidence)
        return F.struct(
            F.lit(field).alias("field"), F.lit(label).alias("label"), F.lit(pos).alias("pos"),
            current.cast("string").alias("current"), proposed.alias("proposed"),
            confidence.alias("confidence"), source.alias("source"),
            F.when(blocked, F.concat(F.lit("Confidence "), _percent(confidence),
                                     F.lit("% is below the 50% floor for writing tags"))).alias("blocked"),
            F.when(doubt & ~blocked, F.concat(F.lit("Confidence "), _percent(confidence),
                                              F.lit("% - verify before writing"))).alias("warning"),
            (~doubt & ~low if graded else F.lit(False)).alias("selected"))

    manual_bpm = F.col("manual_bpm").isNotNull()
    tempo_source = F.when(manual_bpm, "manual").otherwise("automatic")
    tempo_conf = F.when(manual_bpm, real).otherwise(a["tempo"]["confidence"])
    key_source = F.when(F.col("key_manual"), "manual").otherwise("automatic")
    key_conf = F.when(F.col("key_manual"), real).otherwise(a["key"]["confidence"])
    new_bpm = half_up(bpm).cast("string")
    old_bpm = half_up(tags["tagged_bpm"]).cast("string")
    classic = ks.tonality(tonic, mode)
    rows = [F.when(bpm.isNotNull() & ~new_bpm.eqNullSafe(old_bpm),
                   change("bpm", "BPM", 0, old_bpm, new_bpm, tempo_conf, tempo_source)),
            F.when(tonic.isNotNull() & ~classic.eqNullSafe(tags["tagged_key"]),
                   change("key", "Key", 1, tags["tagged_key"], classic, key_conf, key_source))]
    if include_camelot:
        rows.append(F.when(tonic.isNotNull(), change(
            "camelot", "Camelot (comment)", 2, text, ks.camelot(tonic, mode), key_conf, key_source)))
    if include_comment:
        lufs = a["loudness"]["integrated_lufs"]
        summary = F.concat_ws(
            " | ", F.when(bpm.isNotNull(), F.format_string("%.1f BPM", bpm)),
            F.when(tonic.isNotNull(), F.concat(ks.key_name(tonic, mode), F.lit(" ("), ks.camelot(tonic, mode), F.lit(")"))),
            F.concat(F.lit("Energy "), a["energy"]["level"].cast("string"), F.lit("/10")),
            F.when(F.abs(lufs) < float("inf"), F.format_string("%.1f LUFS", lufs)))
        rows.append(F.when(a.isNotNull(), change(
            "comment", "Comment", 3, tags["comment"], summary, real, F.lit("automatic"), graded=False)))
    writable = tx.extension(F.col("name")).isin("mp3", "flac")
    return tracks.where(writable).select("id", F.inline(F.array_compact(F.array(*rows))))


def write_payload(plan: DataFrame, fields: list[str]) -> DataFrame:
    """Unblocked changes of the chosen fields as one row per track (at most four each)."""
    chosen = plan.where(F.col("blocked").isNull() & F.col("field").isin(fields))
    part = F.when(F.col("field").isin("camelot", "comment"), F.struct("pos", "proposed"))
    return chosen.groupBy("id").agg(
        F.max(F.when(F.col("field") == "bpm", F.col("proposed"))).alias("bpm"),
        F.max(F.when(F.col("field") == "key", F.col("proposed"))).alias("initial_key"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["proposed"]), " | "),
                 F.lit("")).alias("comment"))
