"""Catalogue-shaped views over the given tables.

Each view is a projection of one given table, so its size follows that table.
Nothing here ranks or groups a whole table: positions come from dense ids.
``ORACLE_VIEWS`` spells the same projections for the SQL check.
"""

from __future__ import annotations


from cratewise.schemas import FrameGeometry
from pyspark.sql import DataFrame, SparkSession, functions as F

FRAMES_PER_TRACK = 50
SAMPLES_PER_TRACK = 1000
PCM_CHUNK = 250
PCM_RATE = 100


# 64 bins of 175 Hz at 21 frames per second: the geometry given to the vectors.
VECTOR_GEOMETRY = FrameGeometry(22050, 126, 1050)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = """named_struct('anchors', array(named_struct('time_sec', {t}, 'beat_index', 0, 'bpm', {bpm})),
              'beats_per_bar', 4, 'first_downbeat_sec', {t}, 'is_fixed', true,
              'grid_confidence', {conf}, 'downbeat_confidence', 0.5D)"""
    down = "(p % 8) / 16D"
    return table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "p").select(
        F.col("p").alias("id"),
        F.expr("concat(p_name, '.', element_at(array('mp3','flac','wav','mp3'), cast(p % 4 as int) + 1))").alias("name"),
        F.expr("sha2(cast(p div 2 as string), 256)").alias("content_hash"),
        F.expr("sha2(concat('a', cast(p div 3 as string)), 256)").alias("audio_hash"),
        F.expr("concat(p_brand, '/', p_name, '.mp3')").alias("relative_path"),
        F.expr("case when p % 6 = 5 then null else concat('/music/', p_brand, '/', p_name, cast(p % 40 as string), '.mp3') end").alias("file_path"),
        F.lit("audio/mpeg").alias("mime_type"),
        F.expr("cast(round(p_retailprice * 1000) as bigint)").alias("size_bytes"),
        F.expr("180D + p % 240").alias("duration_sec"),
        F.col("p").alias("added_at"),
        F.expr("""named_struct('title', case when p % 5 = 0 then null else p_name end,
            'artist', case when p % 13 = 0 then null else p_brand end, 'album', p_type,
            'album_artist', cast(null as string), 'genre', p_type,
            'year', cast(1980 + p % 45 as int), 'track_number', cast(p % 12 as int),
            'tagged_bpm', case when p % 3 = 0 then 80D + p_size else null end,
            'tagged_key', case when p % 5 = 1 then 'Am' else null end,
            'comment', cast(null as string), 'codec', 'mpeg',
            'bitrate_kbps', case when p % 9 = 0 then null else cast(128 + 64 * (p % 4) as int) end,
            'sample_rate', case when p % 2 = 0 then 44100 else 48000 end, 'channels', 2,
            'lossless', p % 4 = 1)""").alias("tags"),
        F.expr(f"""case when p % 31 = 0 then null else named_struct(
            'tempo', named_struct('bpm', 80D + p_size, 'confidence', (p % 100) / 100D),
            'grid', {grid.format(t=down, bpm='80D + p_size', conf='(p % 83) / 83D')},
            'key', named_struct('tonic', cast(p % 12 as int),
                'mode', case when (p div 12) % 2 = 0 then 'major' else 'minor' end,
                'confidence', (p % 97) / 97D, 'relative_ambiguous', p % 11 = 0),
            'energy', named_struct('level', cast(1 + p % 10 as int), 'raw_score', (p % 89) / 89D,
                'confidence', (p % 53) / 53D),
            'loudness', named_struct('integrated_lufs', -20D + (p % 120) / 10D),
            'hpss', named_struct('percussive_ratio', (p % 41) / 41D),
            'phrases', named_struct('confidence', (p % 37) / 37D),
            'vocal_coverage', (p % 101) / 100D,
            'structure', named_struct('sections', case when p % 6 = 5 then null else
                array(named_struct('label', element_at(array('Intro','Verse','Build','Drop','Sparse'),
                      cast(p % 6 as int) + 1))) end)) end""").alias("analysis"),
        F.expr("case when p % 31 = 0 then null else cast(1 + p % 3 as int) end").alias("analysis_version"),
        F.expr("case when p % 23 = 0 then 'decode' else null end").alias("analysis_error"),
        F.expr("case when p % 17 = 0 then 100D + p % 60 else null end").alias("manual_bpm"),
        F.expr(f"case when p % 29 = 0 then {grid.format(t=down, bpm='90D + p % 50', conf='1D')} else null end").alias("manual_grid"),
        F.expr("case when p % 19 = 0 then cast((p + 5) % 12 as int) else null end").alias("manual_key_tonic"),
        F.expr("case when p % 19 = 0 and p % 38 <> 0 then 'minor' else null end").alias("manual_key_mode"),
        F.expr("case when p % 4 = 0 then p * 1000 else null end").alias("reviewed_at"),
        F.expr("p % 37 = 0").alias("grid_locked"),
        F.expr("""case when p % 7 = 0 then array(
              named_struct('id', 'a', 'name', 'In', 'time_sec', 8D + p % 10),
              named_struct('id', 'b', 'name', 'Out', 'time_sec', 100D + p % 50)) else
            cast(array() as array<struct<id:string,name:string,time_sec:double>>) end""").alias("cues"),
        F.expr("p % 3 <> 0").alias("has_fingerprint"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("from_id"),
        F.expr("event_id % 200").alias("to_id"),
        F.expr("""case event_type when 'purchase' then 'accepted' when 'view' then 'played'
                  when 'click' then 'skipped' else 'shown' end""").alias("action"),
        F.col("value").alias("predicted"), F.expr("cast(event_id % 8 as int)").alias("rank"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("at"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("job_id"), F.expr("event_id % 3").alias("run_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.expr("""case event_type when 'signup' then 'queued' when 'purchase' then 'done'
                  when 'error' then 'failed' else 'running' end""").alias("status"),
        F.expr("""case when event_type = 'error' then element_at(
                  array('timeout','decode','worker_crash','storage','service_unavailable','worker_message'),
                  cast(event_id % 6 as int) + 1) end""").alias("error_code"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrogram frames: 50 vectors to a track, magnitudes are absolute values."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {FRAMES_PER_TRACK}").alias("track_id"),
        F.expr(f"vec_id % {FRAMES_PER_TRACK}").alias("frame"),
        F.expr("transform(embedding, x -> abs(cast(x as double)))").alias("mags"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-second energy and vocal curves: 500 events make one track."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 500").alias("track_id"),
        F.expr("event_id % 500").alias("sec"),
        F.expr("(value % 37D) / 37.1D * case when (event_id % 500) div 60 % 2 = 0 then 0.3D else 1D end").alias("energy"),
        F.expr("(value % 11D) / 11.3D").alias("vocal"))


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An onset envelope per track, 21 frames a second, 500 frames a track."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 500").alias("track_id"), F.expr("event_id % 500").alias("frame"),
        F.expr("(value % 29D) / 29.3D * case when event_id % 10 = 0 then 1D else 0.2D end").alias("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of samples in long form, 100 samples a second."""
    one = table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {SAMPLES_PER_TRACK}").alias("track_id"),
        F.expr(f"event_id % {SAMPLES_PER_TRACK}").alias("i"),
        F.expr("(value % 53D - 26D) / 61D").alias("x0"),
        F.expr("event_id").alias("e"))
    both = F.array(F.struct(F.lit(0).alias("channel"), F.col("x0").alias("x")),
                   F.struct(F.lit(1).alias("channel"), F.expr("x0 * 0.5D + (e % 13) / 100D").alias("x")))
    return one.select("track_id", "i", F.inline(both))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples packed in chunks, as stored: 250 samples to a row."""
    return pack_pcm(samples(spark, sf_dir), PCM_CHUNK)


def pack_pcm(long: DataFrame, chunk: int) -> DataFrame:
    packed = long.groupBy("track_id", "channel", F.expr(f"i div {chunk}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return packed.select("track_id", "channel", "chunk",
                         F.expr(f"chunk * {chunk}").alias("start_sample"),
                         F.expr("transform(s, v -> v.x)").alias("samples"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per curve track, two anchors each."""
    ids = table(spark, sf_dir, "events").selectExpr("event_id div 500 as track_id").distinct()
    return ids.selectExpr(
        "track_id", "500D as duration_sec", "4 as beats_per_bar", "0.75D + track_id % 4 as first_downbeat_sec",
        """array(named_struct('time_sec', 0.25D + track_id % 3, 'beat_index', 0, 'bpm', 100D + track_id % 7),
                 named_struct('time_sec', 250.1D, 'beat_index', 400, 'bpm', 64D + track_id % 5)) as anchors""")


def files_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"),
        F.expr("sha2(concat(lang, source, cast(n_chars div 3 as string)), 256)").alias("audio_hash"),
        F.col("n_chars").alias("size_bytes"), (F.col("lang") == "en").alias("lossless"),
        F.expr("case when doc_id % 4 = 0 then null else cast(128 + 32 * (doc_id % 3) as int) end").alias("bitrate_kbps"),
        F.expr("cast(44100 + 3900 * (doc_id % 2) as int)").alias("sample_rate"),
        F.expr("case when doc_id % 6 = 0 then 120D + doc_id % 9 end").alias("manual_bpm"),
        F.expr("case when doc_id % 10 = 0 then cast(doc_id % 12 as int) end").alias("manual_key_tonic"),
        F.expr("case when doc_id % 10 = 0 then 'minor' end").alias("manual_key_mode"),
        F.expr("case when doc_id % 15 = 0 then doc_id * 1.5D end").alias("manual_grid"),
        F.expr("case when doc_id % 8 = 0 then doc_id * 10 end").alias("reviewed_at"),
        F.expr("cast(doc_id % 3 as int)").alias("cue_count"))


def playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist rows (playlist, pos, track_id); positions run from 0."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("playlist"), F.col("turn").alias("pos"),
        F.expr("(conv_id * 8 + turn) % 200").alias("track_id"))


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.col("url").alias("path"),
        F.regexp_replace(clean, "^https?://[^/]*/", "").alias("relative_path"),
        F.regexp_extract(clean, "([^/]*)$", 1).alias("name"))


def missing_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files under a host that is gone; some lost their relative path."""
    f = folder_files(spark, sf_dir)
    return f.select(
        F.col("page_id").alias("id"), F.concat(F.lit("old://"), F.col("path")).alias("file_path"),
        F.expr("case when page_id % 3 = 0 then null else concat('/', relative_path) end").alias("relative_path"),
        F.expr("case when page_id % 10 = 9 then concat(name, 'x') else name end").alias("name"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("size_bytes"),
        F.expr("unix_micros(cast(o_orderdate as timestamp))").alias("last_used_at"),
        (F.col("o_orderpriority") == "1-URGENT").alias("pinned"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyser runs: line 1..7 of an order is one analyser's run."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), F.concat(F.lit("a"), F.col("l_linenumber")).alias("analyzer"),
        F.col("l_returnflag").alias("version"), F.col("l_linestatus").alias("params_hash"))


# The same projections for the SQL check, one common table expression each.
ORACLE_VIEWS: dict[str, str] = {}
ORACLE_VIEWS["tracks"] = """tracks AS (SELECT p_partkey AS id,
  p_name || '.' || (['mp3','flac','wav','mp3'])[p_partkey % 4 + 1] AS name,
  sha256((p_partkey // 2)::VARCHAR) AS content_hash,
  sha256('a' || (p_partkey // 3)::VARCHAR) AS audio_hash,
  p_brand || '/' || p_name || '.mp3' AS relative_path,
  CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE '/music/' || p_brand || '/' || p_name || (p_partkey % 40)::VARCHAR || '.mp3' END AS file_path,
  round(p_retailprice * 1000)::BIGINT AS size_bytes,
  180::DOUBLE + p_partkey % 240 AS duration_sec, p_partkey AS added_at,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS artist, p_type AS album,
  CASE WHEN p_partkey % 3 = 0 THEN 80::DOUBLE + p_size END AS tagged_bpm,
  CASE WHEN p_partkey % 5 = 1 THEN 'Am' END AS tagged_key,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (128 + 64 * (p_partkey % 4))::INTEGER END AS bitrate_kbps,
  CASE WHEN p_partkey % 2 = 0 THEN 44100 ELSE 48000 END AS sample_rate,
  p_partkey % 4 = 1 AS lossless,
  p_partkey % 31 <> 0 AS analysed,
  CASE WHEN p_partkey % 31 <> 0 THEN 80::DOUBLE + p_size END AS auto_bpm,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 100) / 100::DOUBLE END AS bpm_conf,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 83) / 83::DOUBLE END AS grid_conf,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 12)::INTEGER END AS tonic,
  CASE WHEN p_partkey % 31 <> 0 THEN CASE WHEN (p_partkey // 12) % 2 = 0 THEN 'major' ELSE 'minor' END END AS mode,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 97) / 97::DOUBLE END AS key_conf,
  CASE WHEN p_partkey % 31 <> 0 THEN p_partkey % 11 = 0 END AS rel_ambiguous,
  CASE WHEN p_partkey % 31 <> 0 THEN (1 + p_partkey % 10)::INTEGER END AS energy_level,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 89) / 89::DOUBLE END AS raw_score,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 53) / 53::DOUBLE END AS energy_conf,
  CASE WHEN p_partkey % 31 <> 0 THEN -20::DOUBLE + (p_partkey % 120) / 10::DOUBLE END AS lufs,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 41) / 41::DOUBLE END AS percussive_ratio,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 37) / 37::DOUBLE END AS phrase_conf,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 101) / 100::DOUBLE END AS vocal,
  CASE WHEN p_partkey % 31 <> 0 AND p_partkey % 6 <> 5 THEN (['Intro','Verse','Build','Drop','Sparse'])[p_partkey % 6 + 1] END AS first_section,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE (1 + p_partkey % 3)::INTEGER END AS analysis_version,
  CASE WHEN p_partkey % 23 = 0 THEN 'decode' END AS analysis_error,
  CASE WHEN p_partkey % 17 = 0 THEN 100::DOUBLE + p_partkey % 60 END AS manual_bpm,
  CASE WHEN p_partkey % 29 = 0 THEN 90::DOUBLE + p_partkey % 50 END AS manual_grid_bpm,
  CASE WHEN p_partkey % 19 = 0 THEN ((p_partkey + 5) % 12)::INTEGER END AS manual_key_tonic,
  CASE WHEN p_partkey % 19 = 0 AND p_partkey % 38 <> 0 THEN 'minor' END AS manual_key_mode,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 1000 END AS reviewed_at,
  p_partkey % 37 = 0 AS grid_locked,
  (p_partkey % 8) / 16::DOUBLE AS first_downbeat,
  p_partkey % 7 = 0 AS has_cues, 8::DOUBLE + p_partkey % 10 AS cue_a, 100::DOUBLE + p_partkey % 50 AS cue_b,
  p_partkey % 3 <> 0 AS has_fingerprint
  FROM part)"""
ORACLE_VIEWS["eff"] = """eff AS (SELECT *,
  coalesce(manual_grid_bpm, manual_bpm, auto_bpm) AS bpm,
  CASE WHEN manual_key_tonic IS NOT NULL AND manual_key_mode IS NOT NULL THEN manual_key_tonic ELSE tonic END AS eff_tonic,
  CASE WHEN manual_key_tonic IS NOT NULL AND manual_key_mode IS NOT NULL THEN manual_key_mode ELSE mode END AS eff_mode,
  (manual_key_tonic IS NOT NULL AND manual_key_mode IS NOT NULL) AS key_manual
  FROM tracks)"""
ORACLE_VIEWS["feedback"] = """feedback AS (SELECT event_id AS id, user_id AS from_id, event_id % 200 AS to_id,
  CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'played' WHEN 'click' THEN 'skipped' ELSE 'shown' END AS action,
  value AS predicted, (event_id % 8)::INTEGER AS rank, epoch_us(ts) AS "at" FROM events)"""
ORACLE_VIEWS["job_events"] = """job_events AS (SELECT event_id, user_id AS job_id, event_id % 3 AS run_id, ts AS "at",
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN event_type = 'error' THEN (['timeout','decode','worker_crash','storage','service_unavailable','worker_message'])[event_id % 6 + 1] END AS error_code
  FROM events)"""
ORACLE_VIEWS["frames"] = f"""frames AS (SELECT vec_id // {FRAMES_PER_TRACK} AS track_id, vec_id % {FRAMES_PER_TRACK} AS frame,
  list_transform(embedding, lambda x: abs(x::DOUBLE)) AS mags FROM embeddings)"""
ORACLE_VIEWS["cells"] = """cells AS (SELECT track_id, frame, b.b AS bin, mags[b.b + 1] AS mag, b.b * 175::DOUBLE AS hz
  FROM frames, range(64) b(b))"""
ORACLE_VIEWS["curve"] = """curve AS (SELECT event_id // 500 AS track_id, event_id % 500 AS sec,
  (value % 37::DOUBLE) / 37.1::DOUBLE * CASE WHEN (event_id % 500) // 60 % 2 = 0 THEN 0.3::DOUBLE ELSE 1::DOUBLE END AS energy,
  (value % 11::DOUBLE) / 11.3::DOUBLE AS vocal FROM events)"""
ORACLE_VIEWS["onsets"] = """onsets AS (SELECT event_id // 500 AS track_id, event_id % 500 AS frame,
  (value % 29::DOUBLE) / 29.3::DOUBLE * CASE WHEN event_id % 10 = 0 THEN 1::DOUBLE ELSE 0.2::DOUBLE END AS value FROM events)"""
ORACLE_VIEWS["samples"] = f"""s0 AS (SELECT event_id AS e, event_id // {SAMPLES_PER_TRACK} AS track_id, event_id % {SAMPLES_PER_TRACK} AS i,
  (value % 53::DOUBLE - 26::DOUBLE) / 61::DOUBLE AS x0 FROM events),
samples AS (SELECT track_id, i, 0 AS channel, x0 AS x FROM s0
  UNION ALL SELECT track_id, i, 1, x0 * 0.5::DOUBLE + (e % 13) / 100::DOUBLE FROM s0)"""
ORACLE_VIEWS["grids"] = """anchors AS (SELECT track_id, 500::DOUBLE AS duration_sec, 4 AS beats_per_bar,
    0.75::DOUBLE + track_id % 4 AS first_downbeat_sec, a.n AS n,
    CASE WHEN a.n = 0 THEN 0.25::DOUBLE + track_id % 3 ELSE 250.1::DOUBLE END AS time_sec,
    CASE WHEN a.n = 0 THEN 100::DOUBLE + track_id % 7 ELSE 64::DOUBLE + track_id % 5 END AS bpm,
    CASE WHEN a.n = 0 THEN 250.1::DOUBLE ELSE 500::DOUBLE END AS end_sec
  FROM (SELECT DISTINCT event_id // 500 AS track_id FROM events), range(2) a(n))"""
ORACLE_VIEWS["beats"] = """beats AS (SELECT track_id, duration_sec, beats_per_bar, first_downbeat_sec, t,
    row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS i
  FROM (SELECT a.*, a.time_sec + k.k * (60 / a.bpm) AS t FROM anchors a, range(-2000, 2000) k(k)
        WHERE (k.k >= 0 OR a.n = 0) AND (k.k < 0 OR a.time_sec + k.k * (60 / a.bpm) < a.end_sec - 1e-9))
  WHERE t >= 0 AND t <= duration_sec)"""
ORACLE_VIEWS["bars"] = """downbeats AS (SELECT track_id, min(i) AS i0 FROM beats WHERE t >= first_downbeat_sec - 1e-6 GROUP BY track_id),
starts AS (SELECT track_id, duration_sec, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS bar, t AS start_sec FROM (
    SELECT DISTINCT track_id, duration_sec, 0::DOUBLE AS t FROM anchors
    UNION ALL SELECT b.track_id, b.duration_sec, b.t FROM beats b JOIN downbeats d USING (track_id)
      WHERE b.i >= d.i0 AND (b.i - d.i0) % b.beats_per_bar = 0 AND b.t > 0 AND b.t < b.duration_sec)),
bar_ranges AS (SELECT track_id, duration_sec, bar, start_sec,
    coalesce(lead(start_sec) OVER (PARTITION BY track_id ORDER BY bar), duration_sec) AS end_sec FROM starts),
bars AS (SELECT r.track_id, r.duration_sec, r.bar, r.start_sec, r.end_sec,
    CASE WHEN sum(least(r.end_sec, s.s + 1) - greatest(r.start_sec, s.s)) > 0 THEN
      sum(coalesce(c.energy, 0) * (least(r.end_sec, s.s + 1) - greatest(r.start_sec, s.s)))
      / sum(least(r.end_sec, s.s + 1) - greatest(r.start_sec, s.s)) ELSE 0 END AS energy
  FROM bar_ranges r JOIN range(500) s(s) ON s.s >= floor(r.start_sec) AND s.s < ceil(r.end_sec)
  LEFT JOIN curve c ON c.track_id = r.track_id AND c.sec = s.s
  GROUP BY ALL)"""
ORACLE_VIEWS["files_dup"] = """files_dup AS (SELECT doc_id AS id, sha256(text) AS content_hash,
  sha256(lang || source || (n_chars // 3)::VARCHAR) AS audio_hash,
  n_chars AS size_bytes, lang = 'en' AS lossless,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (128 + 32 * (doc_id % 3))::INTEGER END AS bitrate_kbps,
  (44100 + 3900 * (doc_id % 2))::INTEGER AS sample_rate,
  CASE WHEN doc_id % 6 = 0 THEN 120::DOUBLE + doc_id % 9 END AS manual_bpm,
  CASE WHEN doc_id % 10 = 0 THEN (doc_id % 12)::INTEGER END AS manual_key_tonic,
  CASE WHEN doc_id % 10 = 0 THEN 'minor' END AS manual_key_mode,
  CASE WHEN doc_id % 15 = 0 THEN doc_id * 1.5::DOUBLE END AS manual_grid,
  CASE WHEN doc_id % 8 = 0 THEN doc_id * 10 END AS reviewed_at,
  (doc_id % 3)::INTEGER AS cue_count FROM documents)"""
ORACLE_VIEWS["playlist"] = """playlist AS (SELECT conv_id AS playlist, turn AS pos, (conv_id * 8 + turn) % 200 AS track_id FROM conversations)"""
ORACLE_VIEWS["folder_files"] = """folder_files AS (SELECT page_id, url AS path,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/', '') AS relative_path,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages)"""
ORACLE_VIEWS["missing_tracks"] = """missing_tracks AS (SELECT page_id AS id, 'old://' || path AS file_path,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE '/' || relative_path END AS relative_path,
  CASE WHEN page_id % 10 = 9 THEN name || 'x' ELSE name END AS name FROM folder_files)"""
ORACLE_VIEWS["cache_entries"] = """cache_entries AS (SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS size_bytes,
  epoch_us(o_orderdate) AS last_used_at, o_orderpriority = '1-URGENT' AS pinned FROM orders)"""
ORACLE_VIEWS["provenance"] = """provenance AS (SELECT l_orderkey AS track_id, 'a' || l_linenumber AS analyzer,
  l_returnflag AS version, l_linestatus AS params_hash FROM lineitem)"""

_NEEDS = {"eff": ["tracks"], "cells": ["frames"], "beats": ["grids"],
          "bars": ["grids", "beats", "curve"], "missing_tracks": ["folder_files"]}


def oracle(views: str, body: str, recursive: bool = False) -> str:
    """A SQL text: the named views, then ``body`` (which may add its own)."""
    ordered: list[str] = []

    def add(view: str) -> None:
        for need in _NEEDS.get(view, []):
            add(need)
        if view not in ordered:
            ordered.append(view)

    for view in views.split():
        add(view)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    extra = body[len("WITH "):] if body.startswith("WITH ") else None
    ctes = ",\n".join(ORACLE_VIEWS[v] for v in ordered)
    if extra is not None:
        return head + (ctes + ",\n" if ctes else "") + extra
    return (head + ctes + "\n" if ctes else "") + body


def sql6(expr: str) -> str:
    """Six decimals, half up, as ``functions.numbers.round6``."""
    return f"floor(({expr}) * 1e6 + 0.5e0) / 1e6"
