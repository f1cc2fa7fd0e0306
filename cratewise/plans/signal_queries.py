"""Sample and frame level queries."""

import numpy as np
from pyspark.sql import functions as F

from cratewise.functions.frames import mel_matrix
from cratewise.functions.numbers import round6
from cratewise.operators import pcm as pc, spectrum as sp
from cratewise.plans import views as v
from cratewise.plans.registry import Book
from cratewise.plans.views import PCM_CHUNK, PCM_RATE, VECTOR_GEOMETRY as GEO, oracle, sql6

BOOK = Book()
query = BOOK.query
CHUNK = 16          # frames per chunk: small, so that the test data has seams
BANDS = 20
STFT_SIZE, STFT_HOP = 20, 10


def long_samples(df, value="x"):
    """Packed samples as rows (track_id, i, x)."""
    return df.select("track_id", "start_sample", F.posexplode("samples").alias("p", "_x")).select(
        "track_id", (F.col("start_sample") + F.col("p")).alias("i"), round6(F.col("_x")).alias(value))


def sql_array(values):
    """Numbers as a SQL list of doubles."""
    return "[" + ",".join(f"{float(x)!r}::DOUBLE" for x in values) + "]"


_MONO = "mono AS (SELECT track_id, i, sum(x) * 0.5::DOUBLE AS x FROM samples GROUP BY ALL)"


@query("downmix", oracle("samples", f"WITH {_MONO} SELECT track_id, i, {sql6('x')} AS x FROM mono"))
def downmix(spark, sf):
    return long_samples(pc.downmix(v.pcm(spark, sf)))


@query("resample", oracle("samples", f"""WITH {_MONO}, kern AS (SELECT {sql_array(pc.lowpass_kernel(0.5))} AS k),
taps AS (SELECT unnest(k) AS w, generate_subscripts(k, 1) - 32 AS d FROM kern),
y AS (SELECT m.track_id, m.i - d AS i, sum(m.x * w) AS y FROM mono m, taps GROUP BY ALL),
n AS (SELECT track_id, count(*) AS n FROM mono GROUP BY 1)
SELECT y.track_id, y.i // 2 AS i, {sql6('y')} AS x FROM y JOIN n USING (track_id) WHERE y.i >= 0 AND y.i < n AND y.i % 2 = 0"""))
def resample(spark, sf):
    return long_samples(pc.resample(pc.downmix(v.pcm(spark, sf)), PCM_RATE, PCM_RATE // 2, PCM_CHUNK))


def stft_frames(spark, sf):
    return pc.stft(pc.downmix(v.pcm(spark, sf)), STFT_SIZE, STFT_HOP, PCM_CHUNK)


@query("stft", oracle("samples", f"""WITH {_MONO}, f AS (SELECT track_id, f.f AS frame, n.n AS n, x * (0.5 - 0.5 * cos(2 * pi() * n.n / {STFT_SIZE})) AS w
  FROM range(0, 100) f(f), range({STFT_SIZE}) n(n), mono WHERE mono.i = f.f * {STFT_HOP} + n.n - {STFT_SIZE // 2})
SELECT track_id, frame, b.b AS bin, {sql6(f'sqrt(pow(sum(w * cos(2 * pi() * b.b * n / {STFT_SIZE})), 2) + pow(sum(w * sin(2 * pi() * b.b * n / {STFT_SIZE})), 2))')} AS mag
FROM f, range({STFT_SIZE // 2 + 1}) b(b) GROUP BY ALL"""))
def stft(spark, sf):
    return stft_frames(spark, sf).select("track_id", "frame", F.posexplode("mags").alias("bin", "m")).select(
        "track_id", "frame", F.col("bin").cast("bigint").alias("bin"), round6(F.col("m")).alias("mag"))


@query("audio_hash", oracle("samples", f"""WITH {_MONO}, q AS (SELECT track_id, i, floor(x * 512 + 0.5)::BIGINT & 65535 AS q FROM mono),
c AS (SELECT track_id, i // {PCM_CHUNK} AS c, sha256(unhex(string_agg(printf('%02x%02x', q & 255, q >> 8), '' ORDER BY i))) AS d FROM q GROUP BY ALL)
SELECT track_id, sha256(string_agg(d, '' ORDER BY c)) AS audio_hash FROM c GROUP BY 1"""))
def audio_hash(spark, sf):
    return pc.audio_hash(pc.downmix(v.pcm(spark, sf)), PCM_RATE)


def _peaks_sql(buckets):
    return f"""WITH n AS (SELECT track_id, greatest(1, (max(i) + 1) // {buckets}) AS w FROM samples GROUP BY 1),
m AS (SELECT track_id, i // w AS bucket, max(abs(x)) AS peak FROM samples JOIN n USING (track_id) WHERE channel = 0 GROUP BY ALL)
SELECT track_id, b.b AS bucket, {sql6('coalesce(peak, 0)')} AS peak FROM n CROSS JOIN range({buckets}) b(b) LEFT JOIN m USING (track_id) WHERE m.bucket = b.b
UNION ALL SELECT track_id, b.b, 0 FROM n CROSS JOIN range({buckets}) b(b) WHERE (track_id, b.b) NOT IN (SELECT track_id, bucket FROM m)"""


@query("peaks", oracle("samples", _peaks_sql(64)))
def peaks(spark, sf):
    return pc.peaks(v.pcm(spark, sf).where("channel = 0"), 64).withColumn("peak", round6(F.col("peak")))


@query("peaks_short", oracle("samples", _peaks_sql(4096)))
def peaks_short(spark, sf):
    """More buckets than samples: each sample is a bucket, the rest is silence."""
    return pc.peaks(v.pcm(spark, sf).where("channel = 0"), 4096).withColumn("peak", round6(F.col("peak")))


@query("sample_peak_crest", oracle("samples", f"""SELECT track_id, {sql6('20 * log10(max(abs(x)))')} AS peak_dbfs, {sql6('20 * log10(max(abs(x)) / sqrt(avg(x * x)))')} AS crest_factor_db
FROM samples GROUP BY 1"""))
def sample_peak_crest(spark, sf):
    return pc.sample_stats(v.pcm(spark, sf)).select(
        "track_id", round6(F.col("peak_dbfs")).alias("peak_dbfs"), round6(F.col("crest_factor_db")).alias("crest_factor_db"))


@query("true_peak", oracle("samples", f"""WITH k AS (SELECT d.d AS d, p.p AS p, d.d - p.p / 4::DOUBLE AS x FROM range(-16, 17) d(d), range(1, 4) p(p)),
w AS (SELECT d, p, sin(pi() * x) / (pi() * x) * (0.54 + 0.46 * cos(pi() * x / 17)) AS w FROM k),
n AS (SELECT track_id, max(i) + 1 AS n FROM samples GROUP BY 1),
o AS (SELECT s.track_id, s.channel, s.i - d AS i, p, sum(s.x * w) AS y FROM samples s, w GROUP BY ALL),
a AS (SELECT track_id, max(abs(y)) AS m FROM o JOIN n USING (track_id) WHERE i >= 0 AND i < n GROUP BY 1 UNION ALL SELECT track_id, max(abs(x)) FROM samples GROUP BY 1)
SELECT track_id, {sql6('20 * log10(max(m))')} AS true_peak_dbtp FROM a GROUP BY 1"""))
def true_peak(spark, sf):
    return pc.true_peak(v.pcm(spark, sf), PCM_CHUNK).select("track_id", round6(F.col("true_peak_dbtp")).alias("true_peak_dbtp"))


_S, _H = pc.k_weight_filters(8000)
_FILTER = (f"{_S[0]!r}::DOUBLE * s.x + {_S[1]!r}::DOUBLE * w.x0 + {_S[2]!r}::DOUBLE * w.x1 - {_S[3]!r}::DOUBLE * w.s0 - {_S[4]!r}::DOUBLE * w.s1")


@query("k_weight", oracle("samples", f"""WITH w(track_id, channel, i, x0, x1, s0, s1, y0, y1) AS (
  SELECT DISTINCT track_id, channel, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM samples
  UNION ALL SELECT w.track_id, w.channel, s.i, s.x, w.x0, {_FILTER}, w.s0,
    ({_FILTER}) - 2 * w.s0 + w.s1 - {_H[3]!r}::DOUBLE * w.y0 - {_H[4]!r}::DOUBLE * w.y1, w.y0
  FROM w JOIN samples s ON s.track_id = w.track_id AND s.channel = w.channel AND s.i = w.i + 1)
SELECT track_id, channel, i, {sql6('y0')} AS x FROM w WHERE i >= 0""", recursive=True))
def k_weight(spark, sf):
    w = pc.k_weight(v.pcm(spark, sf), 8000, PCM_CHUNK)
    return w.select("track_id", "channel", "start_sample", F.posexplode("samples").alias("p", "_x")).select(
        "track_id", "channel", (F.col("start_sample") + F.col("p")).alias("i"), round6(F.col("_x")).alias("x"))


@query("overlap_add_chunks", oracle("samples", f"SELECT track_id, channel, i, {sql6('2 * x')} AS x FROM samples"))
def overlap_add_chunks(spark, sf):
    packed = v.pack_pcm(v.samples(spark, sf), 200)
    out = pc.overlap_add(packed, lambda x: 2 * x, 240, 40)
    return out.select("track_id", "channel", "start_sample", F.posexplode("samples").alias("p", "_x")).select(
        "track_id", "channel", (F.col("start_sample") + F.col("p")).alias("i"), round6(F.col("_x")).alias("x"))


# --- loudness ------------------------------------------------------------------

_BLOCKS = """blk(name, size, step) AS (VALUES ('m', 40, 10), ('s', 300, 100)),
blocks AS (SELECT name, track_id, b.b AS block, sum(x * x) / any_value(size) AS ms, -0.691 + 10 * log10(sum(x * x) / any_value(size)) AS lufs
  FROM samples, blk, range(0, 100) b(b) WHERE i >= b.b * step AND i < b.b * step + size GROUP BY name, track_id, b.b HAVING count(*) = 2 * any_value(size)),
lim AS (SELECT name, track_id, -0.691 + 10 * log10(avg(ms)) + CASE WHEN name = 'm' THEN -10 ELSE -20 END AS lim FROM blocks WHERE lufs > -70 GROUP BY name, track_id),
kept AS (SELECT b.* FROM blocks b JOIN lim USING (name, track_id) WHERE lufs > -70 AND lufs > lim)"""


def momentary(spark, sf):
    return pc.block_loudness(v.pcm(spark, sf), PCM_RATE, 0.4, 0.1)


def short_term(spark, sf):
    return pc.block_loudness(v.pcm(spark, sf), PCM_RATE, 3.0, 1.0)


@query("block_loudness", oracle("samples", f"WITH {_BLOCKS} SELECT track_id, block, {sql6('ms')} AS mean_square, {sql6('lufs')} AS lufs FROM blocks WHERE name = 'm'"))
def block_loudness(spark, sf):
    return momentary(spark, sf).select("track_id", "block", round6(F.col("mean_square")).alias("mean_square"), round6(F.col("lufs")).alias("lufs"))


@query("integrated_lufs", oracle("samples", f"WITH {_BLOCKS} SELECT track_id, {sql6('-0.691 + 10 * log10(avg(ms))')} AS integrated_lufs FROM kept WHERE name = 'm' GROUP BY 1"))
def integrated_lufs(spark, sf):
    return pc.integrated_lufs(momentary(spark, sf)).withColumn("integrated_lufs", round6(F.col("integrated_lufs")))


@query("loudness_range", oracle("samples", f"WITH {_BLOCKS} SELECT track_id, {sql6('CASE WHEN count(*) > 1 THEN quantile_cont(lufs, 0.95) - quantile_cont(lufs, 0.1) ELSE 0 END')} AS range_lu FROM kept WHERE name = 's' GROUP BY 1"))
def loudness_range(spark, sf):
    return pc.loudness_range(short_term(spark, sf)).withColumn("range_lu", round6(F.col("range_lu")))


@query("loudness_maxima", oracle("samples", f"WITH {_BLOCKS} SELECT track_id, {sql6('max(lufs) FILTER (name = chr(109))')} AS max_momentary, {sql6('max(lufs) FILTER (name = chr(115))')} AS max_short_term FROM blocks GROUP BY 1"))
def loudness_maxima(spark, sf):
    m = momentary(spark, sf).groupBy("track_id").agg(round6(F.max("lufs")).alias("max_momentary"))
    s = short_term(spark, sf).groupBy("track_id").agg(round6(F.max("lufs")).alias("max_short_term"))
    return m.join(s, "track_id", "left")


_S4, _H4 = pc.k_weight_filters(4000)
_FILTER4 = (f"{_S4[0]!r}::DOUBLE * s.x + {_S4[1]!r}::DOUBLE * w.x0 + {_S4[2]!r}::DOUBLE * w.x1 - {_S4[3]!r}::DOUBLE * w.s0 - {_S4[4]!r}::DOUBLE * w.s1")


@query("measure_loudness", oracle("samples", f"""WITH long AS (SELECT (track_id * 1000 + i) // 5000 AS track_id, (track_id * 1000 + i) % 5000 AS i, channel, x FROM samples),
w(track_id, channel, i, x0, x1, s0, s1, y0, y1) AS (
  SELECT DISTINCT track_id, channel, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM long
  UNION ALL SELECT w.track_id, w.channel, s.i, s.x, w.x0, {_FILTER4}, w.s0,
    ({_FILTER4}) - 2 * w.s0 + w.s1 - {_H4[3]!r}::DOUBLE * w.y0 - {_H4[4]!r}::DOUBLE * w.y1, w.y0
  FROM w JOIN long s ON s.track_id = w.track_id AND s.channel = w.channel AND s.i = w.i + 1),
blocks AS (SELECT track_id, b.b AS block, sum(y0 * y0) / 1600 AS ms, -0.691 + 10 * log10(sum(y0 * y0) / 1600) AS lufs
  FROM w, range(0, 20) b(b) WHERE i >= b.b * 400 AND i < b.b * 400 + 1600 GROUP BY track_id, b.b HAVING count(*) = 3200),
lim AS (SELECT track_id, -0.691 + 10 * log10(avg(ms)) - 10 AS lim FROM blocks WHERE lufs > -70 GROUP BY 1),
kept AS (SELECT track_id, -0.691 + 10 * log10(avg(ms)) AS integrated FROM blocks JOIN lim USING (track_id) WHERE lufs > -70 AND lufs > lim GROUP BY 1)
SELECT p.track_id, {sql6('20 * log10(p.m)')} AS sample_peak_dbfs, {sql6('kept.integrated')} AS integrated_lufs,
  {sql6('(SELECT max(lufs) FROM blocks b WHERE b.track_id = p.track_id)')} AS max_momentary_lufs
FROM (SELECT track_id, max(abs(x)) AS m FROM long GROUP BY 1) p LEFT JOIN kept USING (track_id)""", recursive=True))
def measure_loudness(spark, sf):
    """Tracks of 5 000 samples at 4 000 Hz: nine momentary blocks each."""
    long = v.samples(spark, sf).select((F.col("track_id") * v.SAMPLES_PER_TRACK + F.col("i")).alias("e"), "channel", "x")
    packed = v.pack_pcm(long.selectExpr("e div 5000 as track_id", "e % 5000 as i", "channel", "x"), 1024)
    m = pc.measure_loudness(packed, 4000, 1024)
    return m.select("track_id", *[round6(F.col(c)).alias(c) for c in ("sample_peak_dbfs", "integrated_lufs", "max_momentary_lufs")])


# --- peak pyramids ---------------------------------------------------------------

_ENV = "env AS (SELECT track_id, i AS bucket, abs(x) AS peak FROM samples WHERE channel = 0)"


def envelope(spark, sf):
    return v.samples(spark, sf).where("channel = 0").select("track_id", F.col("i").alias("bucket"), F.abs("x").alias("peak"))


@query("peak_pyramid", oracle("samples", f"""WITH {_ENV}, lv AS (SELECT unnest([32, 125, 500, 1000]) AS level),
b AS (SELECT level, b.b AS bucket, floor(b.b / level::DOUBLE * 1000) AS lo, greatest(floor(b.b / level::DOUBLE * 1000) + 1, floor((b.b + 1) / level::DOUBLE * 1000)) AS hi FROM lv, range(1000) b(b) WHERE b.b < level)
SELECT track_id, level, b.bucket, {sql6('max(peak)')} AS peak FROM env e JOIN b ON e.bucket >= lo AND e.bucket < hi GROUP BY ALL"""))
def peak_pyramid(spark, sf):
    return pc.peak_pyramid(envelope(spark, sf), 1000, [32, 125, 500, 1000]).withColumn("peak", round6(F.col("peak")))


@query("view_window", oracle("samples", f"""WITH {_ENV}, b AS (SELECT b.b AS bucket, 213 + floor(b.b / 100::DOUBLE * 188) AS lo, 213 + floor((b.b + 1) / 100::DOUBLE * 188) AS hi FROM range(100) b(b))
SELECT track_id, b.bucket, {sql6('max(peak)')} AS peak FROM env e JOIN b ON e.bucket >= lo AND e.bucket < greatest(lo + 1, hi) GROUP BY ALL"""))
def view_window(spark, sf):
    return pc.view_window(envelope(spark, sf), 1000, 0.2135, 0.4005, 100).withColumn("peak", round6(F.col("peak")))


@query("select_level", oracle("samples", f"""WITH {_ENV}, b AS (SELECT b.b AS bucket, floor(b.b / 125::DOUBLE * 1000) AS lo, greatest(floor(b.b / 125::DOUBLE * 1000) + 1, floor((b.b + 1) / 125::DOUBLE * 1000)) AS hi FROM range(125) b(b))
SELECT track_id, b.bucket, {sql6('max(peak)')} AS peak FROM env e JOIN b ON e.bucket >= lo AND e.bucket < hi GROUP BY ALL"""))
def select_level(spark, sf):
    level = pc.select_level(0.5, 60, [32, 125, 500, 1000])
    pyramid = pc.peak_pyramid(envelope(spark, sf), 1000, [level])
    return pyramid.select("track_id", "bucket", round6(F.col("peak")).alias("peak"))


# --- onsets -----------------------------------------------------------------------

_MEL, _EDGES = mel_matrix(GEO, BANDS)
_WEIGHTS = ",".join(f"({b},{k},{float(_MEL[b, k])!r}::DOUBLE)" for b, k in zip(*np.nonzero(_MEL)))
_BANDS = f"""wt(bin, band, w) AS (VALUES {_WEIGHTS}),
bands AS (SELECT f.track_id, f.frame, k.k AS band, ln(1 + 1000 * coalesce(e.e, 0)) AS v FROM frames f CROSS JOIN range({BANDS}) k(k)
  LEFT JOIN (SELECT track_id, frame, band, sum(mag * w) AS e FROM cells JOIN wt USING (bin) GROUP BY ALL) e ON e.track_id = f.track_id AND e.frame = f.frame AND e.band = k.k)"""
_FLUX = f"""{_BANDS}, mx AS (SELECT *, greatest(0, max(v) OVER (PARTITION BY track_id, frame ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS m FROM bands),
flux AS (SELECT track_id, frame, sum(coalesce(greatest(v - p, 0), 0)) AS value FROM (SELECT *, lag(m, 2) OVER (PARTITION BY track_id, band ORDER BY frame) AS p FROM mx) GROUP BY ALL)"""
_NORM = """up AS (SELECT track_id, frame, greatest(value - avg(value) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 16 PRECEDING AND CURRENT ROW), 0) AS value FROM flux),
env AS (SELECT track_id, frame, value / nullif(max(value) OVER (PARTITION BY track_id), 0) AS value FROM up)"""


def bands(spark, sf):
    return sp.mel_bands(v.frames(spark, sf), GEO, BANDS)


@query("mel_bands", oracle("cells", f"WITH {_BANDS} SELECT track_id, frame, band, {sql6('v')} AS v FROM bands"))
def mel_bands(spark, sf):
    return bands(spark, sf).select("track_id", "frame", F.posexplode("bands").alias("band", "_v")).select(
        "track_id", "frame", F.col("band").cast("bigint").alias("band"), round6(F.col("_v")).alias("v"))


@query("onset_flux", oracle("cells", f"WITH {_FLUX} SELECT track_id, frame, {sql6('value')} AS value FROM flux"))
def onset_flux(spark, sf):
    return sp.onset_flux(bands(spark, sf), chunk=CHUNK).withColumn("value", round6(F.col("value")))


@query("onset_normalise", oracle("cells", f"WITH {_FLUX}, {_NORM} SELECT track_id, frame, {sql6('value')} AS value FROM env"))
def onset_normalise(spark, sf):
    return sp.onset_envelope(v.frames(spark, sf), GEO, BANDS, CHUNK).withColumn("value", round6(F.col("value")))


_LO, _HI = sp.band_range(GEO, BANDS, 30, 600)
_KICK = f"""{_BANDS}, flux AS (SELECT track_id, frame, sum(coalesce(greatest(v - p, 0), 0)) AS value
  FROM (SELECT *, lag(v) OVER (PARTITION BY track_id, band ORDER BY frame) AS p FROM bands WHERE band BETWEEN {_LO} AND {_HI}) GROUP BY ALL), {_NORM}"""


@query("band_limited_onset", oracle("cells", f"WITH {_KICK} SELECT track_id, frame, {sql6('value')} AS value FROM env"))
def band_limited_onset(spark, sf):
    return sp.band_limited_onset(bands(spark, sf), GEO, BANDS, 30, 600, CHUNK).withColumn("value", round6(F.col("value")))


# --- HPSS, tuning, chroma, vocals -----------------------------------------------------

_HPSS = """med AS (SELECT *, quantile_cont(mag, 0.5) OVER (PARTITION BY track_id, bin ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h,
  quantile_cont(mag, 0.5) OVER (PARTITION BY track_id, frame ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS p FROM cells),
hp AS (SELECT track_id, frame, bin, hz, mag * CASE WHEN h + p > 0 THEN h / (h + p) ELSE 0.5 END AS hv, mag * (1 - CASE WHEN h + p > 0 THEN h / (h + p) ELSE 0.5 END) AS pv FROM med)"""


def all_bins(spark, sf):
    """Frames with every bin of the geometry, null where the vector has none."""
    bins = F.transform(F.sequence(F.lit(0), F.lit(GEO.bins - 1)), lambda b: F.get("mags", b))
    return v.frames(spark, sf).withColumn("mags", bins)


@query("hpss", oracle("cells", f"WITH {_HPSS} SELECT track_id, frame, bin, {sql6('hv')} AS harmonic, {sql6('pv')} AS percussive FROM hp"))
def hpss(spark, sf):
    p = sp.hpss(all_bins(spark, sf), chunk=CHUNK)
    return p.select("track_id", "frame", F.posexplode(F.arrays_zip("harmonic", "percussive")).alias("bin", "z")).select(
        "track_id", "frame", F.col("bin").cast("bigint").alias("bin"), round6(F.col("z.harmonic")).alias("harmonic"),
        round6(F.col("z.percussive")).alias("percussive"))


@query("hpss_energy", oracle("cells", f"WITH {_HPSS} SELECT track_id, {sql6('sum(hv)')} AS harmonic_energy, {sql6('sum(pv)')} AS percussive_energy, {sql6('sum(pv) / (sum(hv) + sum(pv))')} AS percussive_ratio FROM hp GROUP BY 1"))
def hpss_energy(spark, sf):
    e = sp.hpss_energy(sp.hpss(all_bins(spark, sf), chunk=CHUNK))
    return e.select("track_id", *[round6(F.col(c)).alias(c) for c in ("harmonic_energy", "percussive_energy", "percussive_ratio")])


_TUNE = """nb AS (SELECT track_id, bin, mag AS b, lag(mag) OVER w AS a, lead(mag) OVER w AS c FROM cells WINDOW w AS (PARTITION BY track_id, frame ORDER BY bin)),
pk AS (SELECT track_id, b, (bin + CASE WHEN a - 2 * b + c <> 0 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END) * 175 AS hz,
  CASE WHEN a - 2 * b + c <> 0 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END AS off FROM nb WHERE bin BETWEEN 1 AND 62 AND b > a AND b >= c AND b > 0),
dv AS (SELECT track_id, b, 2 * pi() * (69 + 12 * log2(hz / 440) - floor(69 + 12 * log2(hz / 440) + 0.5)) AS ang FROM pk WHERE abs(off) <= 1 AND hz >= 200 AND hz <= 3000),
tune AS (SELECT track_id, atan2(sum(b * sin(ang)), sum(b * cos(ang))) / (2 * pi()) * 100 AS cents FROM dv GROUP BY 1)"""


def tuning(spark, sf):
    return sp.tuning_cents(v.frames(spark, sf), GEO)


@query("tuning_cents", oracle("cells", f"WITH {_TUNE} SELECT track_id, {sql6('cents')} AS cents FROM tune"))
def tuning_cents(spark, sf):
    return tuning(spark, sf).withColumn("cents", round6(F.col("cents")))


_CHROMA = f"""{_TUNE}, har(n, w) AS (VALUES (1, 1.0), (2, 0.5), (3, 0.33), (4, 0.25)),
ch0 AS (SELECT track_id, ((floor(69 + 12 * log2(hz / n / (440 * pow(2, cents / 1200))) + 0.5)::BIGINT % 12) + 12) % 12 AS pc, sum(ln(1 + mag) * w::DOUBLE) AS s
  FROM cells JOIN tune USING (track_id), har WHERE bin >= 1 AND hz >= 55 AND hz <= 5000 AND hz / n >= 55 GROUP BY ALL),
chroma AS (SELECT t.track_id, p.p AS pc, coalesce(s, 0) / sum(coalesce(s, 0)) OVER (PARTITION BY t.track_id) AS c
  FROM tune t CROSS JOIN range(12) p(p) LEFT JOIN ch0 ON ch0.track_id = t.track_id AND ch0.pc = p.p)"""


def track_chroma(spark, sf):
    return sp.chroma(v.frames(spark, sf), tuning(spark, sf), GEO)


@query("chroma", oracle("cells", f"WITH {_CHROMA} SELECT track_id, pc, {sql6('c')} AS c FROM chroma"))
def chroma(spark, sf):
    return track_chroma(spark, sf).select("track_id", F.posexplode("chroma").alias("pc", "_c")).select(
        "track_id", F.col("pc").cast("bigint").alias("pc"), round6(F.col("_c")).alias("c"))


_VOCAL = """sums AS (SELECT track_id, frame, sum(mag) FILTER (hz >= 200 AND hz <= 4000) AS band, sum(mag) AS total FROM cells WHERE bin >= 1 GROUP BY ALL),
win AS (SELECT *, list_sort(list(band) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS l,
  avg(band) OVER m AS mean, stddev_pop(band) OVER m AS sd FROM sums WINDOW m AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
raw AS (SELECT track_id, frame, least(1, band / total * 1.4) * least(1, least(1, l[len(l) // 2 + 1] / band) * 1.2) * least(1, 0.35 + least(1, sd / mean / 0.45)) AS r FROM win),
sm AS (SELECT track_id, frame, avg(r) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM raw),
vocal AS (SELECT track_id, frame, s / max(s) OVER (PARTITION BY track_id) AS value FROM sm)"""


def activity(spark, sf):
    return sp.vocal_activity(v.frames(spark, sf), GEO, CHUNK)


@query("vocal_activity", oracle("cells", f"WITH {_VOCAL} SELECT track_id, frame, {sql6('value')} AS value FROM vocal"))
def vocal_activity(spark, sf):
    return activity(spark, sf).withColumn("value", round6(F.col("value")))


@query("vocal_coverage", oracle("cells", f"WITH {_VOCAL} SELECT track_id, {sql6('avg(CASE WHEN value >= 0.45 THEN 1 ELSE 0 END)')} AS coverage FROM vocal GROUP BY 1"))
def vocal_coverage(spark, sf):
    return sp.vocal_coverage(activity(spark, sf)).withColumn("coverage", round6(F.col("coverage")))


@query("vocal_between", oracle("cells", f"""WITH {_VOCAL}, rg AS (SELECT DISTINCT track_id, r.r AS range_id, r.r * 0.7 AS a, r.r * 0.7 + 0.5 AS b FROM frames, range(5) r(r))
SELECT rg.track_id, range_id, {sql6('coalesce(avg(value), 0)')} AS value FROM rg LEFT JOIN vocal v ON v.track_id = rg.track_id AND frame >= floor(a * 21) AND frame < ceil(b * 21) GROUP BY ALL"""))
def vocal_between(spark, sf):
    ranges = v.frames(spark, sf).select("track_id").distinct().selectExpr("track_id", "explode(sequence(0L, 4L)) as range_id").selectExpr(
        "track_id", "range_id", "range_id * 0.7D as start_sec", "range_id * 0.7D + 0.5D as end_sec")
    return sp.vocal_between(activity(spark, sf), ranges, GEO.frame_rate, CHUNK).withColumn("value", round6(F.col("value")))


@query("per_second", oracle("onsets", f"""SELECT track_id, s.s AS sec, {sql6('avg(value)')} AS value FROM onsets o JOIN range(24) s(s) ON frame >= floor(s.s * 20.5) AND frame < floor((s.s + 1) * 20.5)
GROUP BY ALL"""))
def per_second(spark, sf):
    return sp.per_second(v.onsets(spark, sf), 20.5).withColumn("value", round6(F.col("value")))


_STEMS = """lr AS (SELECT track_id, frame, bin, hz, mag AS l, mag * (1 + (bin % 5) / 4::DOUBLE) / 2 AS r FROM cells),
mid AS (SELECT *, 0.5 * (l + r) AS m FROM lr),
med AS (SELECT a.track_id, a.frame, a.bin, a.hz, a.l, a.r, a.m,
  (SELECT quantile_cont(x.m, 0.5) FROM range(-15, 16) d(d) JOIN mid x ON x.track_id = a.track_id AND x.bin = a.bin AND x.frame = greatest(0, least(49, a.frame + d.d))) AS h,
  (SELECT quantile_cont(x.m, 0.5) FROM range(-15, 16) d(d) JOIN mid x ON x.track_id = a.track_id AND x.frame = a.frame AND x.bin = greatest(0, least(63, a.bin + d.d))) AS p FROM mid a),
mk AS (SELECT *, h * h / (h * h + p * p + 1e-8) AS hm, p * p / (h * h + p * p + 1e-8) AS pm, pow(greatest(0, least(1, 1 - abs(l - r) / (l + r + 1e-8))), 2) AS ce FROM med),
raw AS (SELECT *, hm * ce / (1 + pow(150 / greatest(hz, 1e-6), 4)) / (1 + pow(hz / 6000, 4)) AS vo, pm AS dr, hm / (1 + pow(hz / 250, 4)) AS ba FROM mk),
r4 AS (SELECT *, greatest(0, 1 - (vo + dr + ba)) AS me FROM raw),
st AS (SELECT track_id, unnest(['vocals', 'drums', 'bass', 'melody']) AS stem, unnest([vo * m / s, dr * m / s, ba * m / s, me * m / s]) AS e FROM (SELECT *, vo + dr + ba + me + 1e-8 AS s FROM r4))"""


def stereo(spark, sf):
    return v.frames(spark, sf).select("track_id", "frame", F.col("mags").alias("left"), F.transform(
        "mags", lambda x, i: x * (F.lit(1.0) + (i % 5) / F.lit(4.0)) / 2).alias("right"))


@query("stem_masks", oracle("cells", f"WITH {_STEMS} SELECT track_id, stem, {sql6('sum(e)')} AS energy, {sql6('sum(e) / sum(sum(e)) OVER (PARTITION BY track_id)')} AS share FROM st GROUP BY track_id, stem"))
def stem_masks(spark, sf):
    return sp.stem_energy(stereo(spark, sf), GEO.sample_rate, GEO.fft_size, chunk=CHUNK).select(
        "track_id", "stem", round6(F.col("energy")).alias("energy"), round6(F.col("share")).alias("share"))


@query("stem_masks_two", oracle("cells", f"WITH {_STEMS} SELECT track_id, CASE stem WHEN 'vocals' THEN 'vocals' ELSE 'instrumental' END AS stem, {sql6('sum(e)')} AS energy FROM st GROUP BY ALL"))
def stem_masks_two(spark, sf):
    return sp.stem_energy(stereo(spark, sf), GEO.sample_rate, GEO.fft_size, True, chunk=CHUNK).select(
        "track_id", "stem", round6(F.col("energy")).alias("energy"))
