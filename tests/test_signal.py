"""Signal operators on synthetic sound, and independence of the chunk size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cratewise.operators import beats as bt, key as ky, pcm as pc, spectrum as sp, tempo as tp
from cratewise.plans.analyze import ANALYSIS_RATE, analyze, register_analyzer, run_analyzer
from cratewise.plans.views import FrameGeometry

RATE = 22050


def pcm_table(spark, signals, size):
    """signals: {track: [channel arrays]} -> packed PCM."""
    rows = [(t, c, k, k * size, x[k * size:(k + 1) * size].tolist())
            for t, channels in signals.items() for c, x in enumerate(channels)
            for k in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "track_id bigint, channel int, chunk bigint, start_sample bigint, samples array<double>")


def flat(df):
    """{(track, channel): samples} in order."""
    out = {}
    for r in df.orderBy("track_id", "channel", "start_sample").collect():
        out.setdefault((r["track_id"], r["channel"]), []).extend(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


def tone(hz, seconds, rate=RATE, gain=0.5):
    return gain * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def kicks(bpm, seconds, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    since = t % (60 / bpm)
    noise = np.random.default_rng(7).normal(0, 0.002, len(t))
    return 0.9 * np.sin(2 * np.pi * 60 * since) * np.exp(-since * 30) + noise


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(0, 0.2, 5000)


@pytest.mark.parametrize("job", ["resample", "k_weight", "stft", "true_peak", "loudness", "overlap"])
def test_chunk_size_does_not_matter(spark, noise, job):
    results = []
    for size in (512, 2048):
        p = pcm_table(spark, {1: [noise]}, size)
        if job == "resample":
            results.append(flat(pc.resample(p, 44100, 22050, size))[1, 0])
        elif job == "k_weight":
            results.append(flat(pc.k_weight(p, 8000, size))[1, 0])
        elif job == "stft":
            results.append(np.array([r["mags"] for r in pc.stft(p, 256, 64, size).orderBy("frame").collect()]))
        elif job == "true_peak":
            results.append(pc.true_peak(p, size).first()["true_peak"])
        elif job == "loudness":
            results.append([r["lufs"] for r in pc.block_loudness(p, 1000, 0.4, 0.1).orderBy("block").collect()])
        else:
            q = pcm_table(spark, {1: [noise]}, size - 64)
            results.append(flat(pc.overlap_add(q, lambda x: x, size, 64))[1, 0])
    assert np.shape(results[0]) == np.shape(results[1])
    np.testing.assert_allclose(results[0], results[1], atol=1e-9)


def test_overlap_add_gives_the_signal_back(spark, noise):
    out = flat(pc.overlap_add(pcm_table(spark, {1: [noise]}, 400), lambda x: x, 500, 100))[1, 0]
    np.testing.assert_allclose(out, noise, atol=1e-9)


def test_stft_puts_a_tone_in_its_bin(spark):
    frames = pc.stft(pcm_table(spark, {1: [tone(1000, 1)]}, 4096), 1024, 256, 4096)
    mags = frames.where("frame = 20").first()["mags"]
    assert int(np.argmax(mags)) == round(1000 * 1024 / RATE)
    assert frames.count() == -(-RATE // 256)


def test_loudness_follows_gain(spark):
    loud = tone(997, 5, 48000, 0.5)
    rows = {r["track_id"]: r for r in pc.measure_loudness(pcm_table(spark, {1: [loud], 2: [loud / 2]}, 48000), 48000, 48000).collect()}
    assert abs(rows[1]["integrated_lufs"] - rows[2]["integrated_lufs"] - 6.02) < 0.05
    assert rows[1]["true_peak_dbtp"] >= rows[1]["sample_peak_dbfs"] - 1e-9
    # full-scale 997 Hz mono reads -3.01 LUFS by definition of the scale
    assert abs(rows[1]["integrated_lufs"] - (-3.01 - 6.02)) < 0.1


def test_hpss_and_vocal_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(3)
    geometry = FrameGeometry(22050, 126, 1050)
    rows = [(1, f, np.abs(rng.normal(size=64)).tolist()) for f in range(120)]
    frames = spark.createDataFrame(rows, "track_id bigint, frame bigint, mags array<double>")
    h = [np.array([r["harmonic"] for r in sp.hpss(frames, chunk=c).orderBy("frame").collect()]) for c in (16, 512)]
    np.testing.assert_allclose(h[0], h[1], atol=1e-12)
    v = [np.array([r["value"] for r in sp.vocal_activity(frames, geometry, c).orderBy("frame").collect()]) for c in (16, 512)]
    np.testing.assert_allclose(v[0], v[1], atol=1e-12)


def test_peaks_work_without_python_rows(spark):
    x = np.random.default_rng(6).normal(size=1000)
    table = pcm_table(spark, {1: [x], 2: [x[:3]]}, 64)
    for buckets in (7, 400):
        found = pc.peaks(table, buckets)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        rows = {(r["track_id"], r["bucket"]): r["peak"] for r in found.collect()}
        per = 1000 // buckets
        assert len(rows) == 2 * buckets
        assert all(rows[1, b] == np.abs(x[b * per:(b + 1) * per]).max() for b in range(buckets))
        assert all(rows[2, b] == (abs(x[b]) if b < 3 else 0) for b in range(buckets))
    gaps = spark.createDataFrame([(1, 0, 0, 0, [1.0, None, 2.0, 3.0])], table.schema)
    assert {r["bucket"]: r["peak"] for r in pc.peaks(gaps, 2).collect()} == {0: None, 1: 3.0}


def test_hpss_of_missing_magnitudes_and_of_a_chunk_with_only_edge_rows(spark):
    # Frames 0..8 in chunks of 16: the second chunk holds frame 8 as an edge row and none of its own.
    rng = np.random.default_rng(4)
    mags = [np.abs(rng.normal(size=12)).tolist() for _ in range(9)]
    mags[2], mags[5] = None, mags[5][:7]
    mags[6] = [None if b == 3 else x for b, x in enumerate(mags[6])]
    frames = spark.createDataFrame([(1, f, m) for f, m in enumerate(mags)] + [(2, 0, None)], "track_id bigint, frame bigint, mags array<double>")
    cell = np.full((9, 12), np.nan)
    for f, m in enumerate(mags):
        cell[f, :len(m or [])] = [np.nan if x is None else x for x in m or []]
    parts = {(r["track_id"], r["frame"]): r for r in sp.hpss(frames, chunk=16).collect()}
    assert len(parts) == 10 and parts[2, 0]["harmonic"] == [] and parts[1, 2]["percussive"] == [] and parts[1, 6]["harmonic"][3] is None
    for f, m in enumerate(mags):
        assert len(parts[1, f]["harmonic"]) == len(m or [])
        for b, x in enumerate(m or []):
            if x is not None:
                h, p = np.nanmedian(cell[:, b]), np.nanmedian(cell[f, max(0, b - 8):b + 9])
                assert parts[1, f]["harmonic"][b] == pytest.approx(x * h / (h + p)) and parts[1, f]["percussive"][b] == pytest.approx(x * p / (h + p))
    energy = {r["track_id"]: r for r in sp.hpss_energy(sp.hpss(frames, chunk=16)).collect()}
    known = [x for m in mags for x in m or [] if x is not None]
    assert energy[1]["harmonic_energy"] + energy[1]["percussive_energy"] == pytest.approx(sum(known))
    assert energy[2]["harmonic_energy"] is None and energy[2]["percussive_ratio"] is None


def plain_beats(env, bpm, rate, tightness=100.0):
    """The recurrence over a whole track in one loop."""
    period = 60 * rate / bpm
    lo = max(1, int(period / 2 + 0.5))
    hi = max(lo + 1, int(period * 2 + 0.5))
    score, back = list(env), [-1] * len(env)
    for t in range(len(env)):
        best, at = -np.inf, -1
        for d in range(lo, hi + 1):
            if t - d < 0:
                break
            c = score[t - d] - tightness * np.log(d / period) ** 2
            if c > best:
                best, at = c, t - d
        if at >= 0:
            score[t], back[t] = env[t] + best, at
    t, out = int(np.argmax(score)), []
    while t >= 0:
        out.append(t)
        t = back[t]
    return [x / rate for x in reversed(out)]


@pytest.mark.parametrize("chunk", [64, 150, 65536])
def test_beats_equal_one_loop(spark, chunk):
    rng = np.random.default_rng(5)
    envs = {1: rng.random(400), 2: rng.random(90)}
    rows = [(k, i, float(x)) for k, e in envs.items() for i, x in enumerate(e)]
    env = spark.createDataFrame(rows, "track_id bigint, frame bigint, value double")
    tempo = spark.createDataFrame([(1, 120.0), (2, 95.0)], "track_id bigint, raw_bpm double")
    got = bt.track_beats(env, tempo, 21.0, chunk=chunk).orderBy("track_id", "i").collect()
    for k, bpm in ((1, 120.0), (2, 95.0)):
        mine = [r["time_sec"] for r in got if r["track_id"] == k]
        assert [r["i"] for r in got if r["track_id"] == k] == list(range(len(mine)))
        np.testing.assert_allclose(mine, plain_beats(envs[k], bpm, 21.0))


def test_c_major_chord_is_c_major(spark):
    geometry = FrameGeometry(RATE, 4096, 2048)
    sound = sum(tone(hz, 4, gain=0.2) for hz in (261.63, 329.63, 392.0, 523.25, 293.66, 440.0))
    frames = pc.stft(pcm_table(spark, {1: [sound]}, 8192), 4096, 2048, 8192)
    tuning = sp.tuning_cents(frames, geometry)
    assert abs(tuning.first()["cents"]) < 10
    key = ky.key_score(sp.chroma(frames, tuning, geometry)).first()
    assert (key["tonic"], key["mode"]) in {(0, "major"), (9, "minor")}


def test_whole_analysis_of_a_kick_track(spark):
    sound = kicks(126, 20, 44100)
    table = pcm_table(spark, {1: [sound, sound]}, 131072)
    rows, timings = analyze(table, 44100, 131072)
    r = rows.first()
    assert abs(r["bpm"] - 126) < 1
    assert abs(r["duration_sec"] - 20) < 1e-6
    assert 1 <= r["level"] <= 10
    assert r["integrated_lufs"] < 0
    assert r["sections"] and r["grid"]["anchors"] and len(r["words"]) > 1000
    assert abs(r["grid"]["anchors"][0]["bpm"] - 126) < 2
    assert "frames.onset" in timings
    assert ANALYSIS_RATE == 22050


def test_registered_analyzer_sees_bounded_chunks(spark):
    def loudest(pdf):
        own = pdf[pdf["_core"]]
        return pd.DataFrame({"track_id": own["track_id"], "frame": own["frame"], "top": [max(m) for m in own["mags"]], "n": len(pdf)})

    register_analyzer("loudest", loudest, "track_id bigint, frame bigint, top double, n int")
    frames = spark.createDataFrame([(1, f, [float(f), 0.5]) for f in range(100)], "track_id bigint, frame bigint, mags array<double>")
    out = run_analyzer("loudest", frames, chunk=10, before=2).collect()
    assert len(out) == 100 and max(r["n"] for r in out) <= 12
    assert all(r["top"] == max(float(r["frame"]), 0.5) for r in out)


def test_tempo_is_folded_from_any_distance(spark):
    from cratewise.functions.numbers import fold_range
    values = [1e-300, 0.001, 0.1, 0.3, 78 / 512, 78 / 256, 39.0, 77.999, 78.0, 100.0, 165.0, 165.001, 330.0, 165.0 * 256, 165.0 * 512, 50_000.0, 1e6, 1e300]

    def plain(x):
        while x < 78:
            x *= 2
        while x > 165:
            x /= 2
        return x
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*values, 0.0, -3.0, None])], "i int, x double")
    found = [r["y"] for r in rows.select("i", fold_range(F.col("x"), 78.0, 165.0).alias("y")).orderBy("i").collect()]
    assert found == [*map(plain, values), 0.0, -3.0, None]
