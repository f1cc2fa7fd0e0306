"""From samples to the full feature row of each track."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cratewise.operators import (beats as bt, duplicates as du, energy as en, key as ky, pcm as pc, spectrum as sp,
                                 structure as st, tempo as tp)
from cratewise.operators.ordered import with_halo
from cratewise.schemas import FrameGeometry
from cratewise.session import cut_lineage

ANALYSIS_RATE = 22050
ONSET = FrameGeometry(ANALYSIS_RATE, 1024, 256)
KEY = FrameGeometry(ANALYSIS_RATE, 4096, 2048)


def analyze(pcm: DataFrame, sample_rate: int, size: int, bands: int = 84) -> tuple[DataFrame, dict[str, float]]:
    """One feature row per track, and how long each written stage took in seconds.

    Tables that several stages read (analysis signal, the two frame tables, the
    envelope, the grid) are written once; everything else stays one lazy plan.
    ``size`` is the chunk length of ``pcm``; on the analysis signal it must be a
    whole number of 2 048-sample hops.
    """
    timings: dict[str, float] = {}

    @contextmanager
    def stage(name: str):
        began = time.monotonic()
        yield
        timings[name] = time.monotonic() - began

    with stage("signal"):
        signal = cut_lineage(pc.resample(pc.downmix(pcm), sample_rate, ANALYSIS_RATE, size))
    out_size = size * ANALYSIS_RATE // sample_rate
    with stage("frames.onset"):
        frames = cut_lineage(pc.stft(signal, ONSET.fft_size, ONSET.hop_size, out_size))
    with stage("frames.key"):
        key_frames = cut_lineage(pc.stft(signal, KEY.fft_size, KEY.hop_size, out_size))
    mel = sp.mel_bands(frames, ONSET, bands)
    with stage("onset"):
        envelope = cut_lineage(sp.onset_normalise(sp.onset_flux(mel)))
    with stage("tempo"):
        lengths = pc.track_lengths(pcm).select("track_id", (F.col("length") / sample_rate).alias("duration_sec"))
        found = tp.estimate_tempo(tp.tempogram(envelope, ONSET.frame_rate))
        tempo = cut_lineage(lengths.select("track_id").join(found, "track_id", "left").select(
            "track_id", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (
                ("bpm", 124.0), ("raw_bpm", 124.0), ("confidence", 0.0), ("octave_confidence", 0.0))],
            F.coalesce("alternates", F.array().cast("array<struct<bpm:double,strength:double>>")).alias("alternates")))
    with stage("beats"):
        beats = cut_lineage(bt.track_beats(envelope, tempo, ONSET.frame_rate))
    with stage("grid"):
        kick = sp.band_limited_onset(mel, ONSET, bands, 30, 140)
        downbeat = bt.downbeat_phase(beats, kick, ONSET.frame_rate)
        grid = cut_lineage(bt.fit_grid(beats, tempo, downbeat))
    with stage("key"):
        tuning = cut_lineage(sp.tuning_cents(key_frames, KEY))
        parts = cut_lineage(sp.hpss(key_frames))
        bass = ky.key_score(sp.chroma(parts, tuning, KEY, 40.0, 250.0, "harmonic"))
        key = cut_lineage(ky.key_support(ky.key_score(sp.chroma(key_frames, tuning, KEY)), bass))
    loudness = pc.measure_loudness(pcm, sample_rate, size)
    features = (en.energy_features(frames, envelope, ONSET, bands)
                .join(loudness.select("track_id", F.col("integrated_lufs").alias("loudness_lufs")), "track_id", "left"))
    energy = en.energy_score(features)
    with stage("curves"):
        activity = cut_lineage(sp.vocal_activity(frames, ONSET))
        curve = en.energy_curve(envelope, ONSET.frame_rate)
        vocal = sp.per_second(activity, ONSET.frame_rate).withColumnRenamed("value", "vocal")
        curves = cut_lineage(curve.join(vocal, ["track_id", "sec"], "full"))
    with stage("structure"):
        grids = grid.join(lengths, "track_id").select(
            "track_id", "duration_sec", "grid.anchors", "grid.beats_per_bar", "grid.first_downbeat_sec")
        sections = cut_lineage(st.sections(st.bars(grids, curves), curves))
        phrases = cut_lineage(st.phrases(grids, curves))
    words = du.pack_fingerprints(du.fingerprint(frames, ONSET))
    # Sections and phrases of one track are at least eight bars apart.
    labels = sections.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("section", "label", "start_sec", "end_sec"))).alias("sections"))
    phrase = phrases.groupBy("track_id").agg(F.first("length_bars").alias("phrase_bars"), F.first("confidence").alias("phrase_confidence"))
    hp = sp.hpss_energy(parts)
    rows = (lengths.join(tempo, "track_id", "left")
            .join(grid, "track_id", "left")
            .join(key.select("track_id", "tonic", "mode", F.col("confidence").alias("key_confidence"), "relative_ambiguous", "agreed"), "track_id", "left")
            .join(loudness, "track_id", "left")
            .join(energy.select("track_id", "raw_score", "level", F.col("confidence").alias("energy_confidence"), "contributions"), "track_id", "left")
            .join(sp.vocal_coverage(activity), "track_id", "left").join(labels, "track_id", "left").join(phrase, "track_id", "left")
            .join(hp, "track_id", "left").join(words, "track_id", "left"))
    return rows, timings


_ANALYZERS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def register_analyzer(name: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
    """Add a caller's own frame analyser: one bounded chunk of frames in, rows out."""
    _ANALYZERS[name] = (function, schema)


def run_analyzer(name: str, frames: DataFrame, chunk: int = 4096, before: int = 0, after: int = 0) -> DataFrame:
    """Run it per (track, chunk); ``_core`` tells own frames from the halo."""
    function, schema = _ANALYZERS[name]
    return with_halo(frames, "frame", chunk, before, after).groupBy("track_id", "_chunk").applyInPandas(function, schema)
