"""Review, history, playlists, feedback, cache and file reconciliation queries."""

from pyspark.sql import functions as F

from cratewise.functions.numbers import round6
from cratewise.operators import (cache as ca, edits as ed, feedback as fb, files as fi, history as hi,
                                 playlists as pl, review as rv)
from cratewise.plans import views as v
from cratewise.plans.catalog_queries import _KEYS, _REASONS
from cratewise.plans.registry import Book
from cratewise.plans.views import oracle, sql6
from cratewise.sources.tags import read_tags as normalise_tags

BOOK = Book()
query = BOOK.query


def track_view(spark, sf):
    return ed.effective_tracks(v.tracks(spark, sf))


@query("review_reasons", oracle("eff", f"SELECT id, array_to_string({_REASONS}, '; ') AS reasons FROM eff"))
def review_reasons(spark, sf):
    return v.tracks(spark, sf).select("id", F.array_join(rv.review_reasons(), "; ").alias("reasons"))


@query("needs_review", oracle("eff", f"SELECT id FROM eff WHERE reviewed_at IS NULL AND len({_REASONS}) > 0"))
def needs_review(spark, sf):
    return v.tracks(spark, sf).where(rv.needs_review()).select("id")


@query("stale_tracks", oracle("tracks", "SELECT id, analysis_version FROM tracks WHERE analysed AND analysis_version < 3"))
def stale_tracks(spark, sf):
    return rv.stale_tracks(v.tracks(spark, sf)).select("id", "analysis_version")


_EXPECTED = [(f"a{n}", "R" if n % 2 else "A", "F") for n in range(1, 8)]


@query("stale_analyzers", oracle("provenance", """WITH e AS (SELECT 'a' || n AS analyzer, CASE WHEN n % 2 = 1 THEN 'R' ELSE 'A' END AS version FROM range(1, 8) r(n))
SELECT o_orderkey AS track_id, e.analyzer FROM orders o, e WHERE NOT EXISTS (SELECT 1 FROM provenance p
  WHERE p.track_id = o_orderkey AND p.analyzer = e.analyzer AND p.version = e.version AND p.params_hash = 'F')"""))
def stale_analyzers(spark, sf):
    expected = spark.createDataFrame(_EXPECTED, "analyzer string, version string, params_hash string")
    ids = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return rv.stale_analyzers(ids, v.provenance(spark, sf), expected)


@query("param_fingerprint", """SELECT user_id, count(*) AS n, sha256('{"k":"' || (props->>'k') || '","t":"' || event_type || '"}') AS fp
FROM events GROUP BY user_id, event_type, props->>'k'""")
def param_fingerprint(spark, sf):
    e = v.table(spark, sf, "events").select("user_id", F.create_map(
        F.lit("t"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")).alias("m"))
    return (e.select("user_id", rv.param_fingerprint(F.col("m")).alias("fp"))
            .groupBy("user_id", "fp").agg(F.count(F.lit(1)).alias("n")))


@query("record_provenance", oracle("tracks", f"""WITH c AS (SELECT id, unnest(['tempo','grid','key','energy','phrase','hpss','preprocessing','loudness','vocals','structure','fingerprint']) AS analyzer,
  unnest([bpm_conf, grid_conf, key_conf, energy_conf, phrase_conf, 1 - abs(0.5 - percussive_ratio), NULL, NULL, NULL, NULL, NULL]) AS confidence FROM tracks WHERE analysed)
SELECT id AS track_id, analyzer, CASE WHEN analyzer IN ('key','energy') THEN '1.1.0' ELSE '1.0.0' END AS version, {sql6('confidence')} AS confidence FROM c"""))
def record_provenance(spark, sf):
    return rv.record_provenance(v.tracks(spark, sf), 0).select(
        "track_id", "analyzer", "version", round6(F.col("confidence")).alias("confidence"))


@query("gate_by_review", """SELECT d.doc_id AS id, coalesce(l.quality = 0 OR l.toxic = 1, false) AS blocked FROM documents d LEFT JOIN labels l USING (doc_id)""")
def gate_by_review(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    flags = v.table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                                ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("needs_review"))
    return rv.gate_by_review(docs, flags)


_PLAN = """p AS (SELECT *, floor(bpm + 0.5)::BIGINT::VARCHAR AS new_bpm, floor(tagged_bpm + 0.5)::BIGINT::VARCHAR AS old_bpm,
  (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[eff_tonic + 1] AS pitch,
  ((((CASE WHEN eff_mode = 'minor' THEN (eff_tonic + 3) % 12 ELSE eff_tonic END) * 7) % 12 + 7) % 12 + 1) || CASE WHEN eff_mode = 'major' THEN 'B' ELSE 'A' END AS wheel,
  CASE WHEN manual_bpm IS NOT NULL THEN NULL ELSE bpm_conf END AS tc, CASE WHEN key_manual THEN NULL ELSE key_conf END AS kc
  FROM eff WHERE regexp_matches(name, '\\.(mp3|flac)$')),
r AS (SELECT id, 0 AS pos, 'bpm' AS field, old_bpm AS current, new_bpm AS proposed, tc AS confidence, CASE WHEN manual_bpm IS NOT NULL THEN 'manual' ELSE 'automatic' END AS source
    FROM p WHERE bpm IS NOT NULL AND new_bpm IS DISTINCT FROM old_bpm
  UNION ALL SELECT id, 1, 'key', tagged_key, pitch || CASE WHEN eff_mode = 'minor' THEN 'm' ELSE '' END, kc, CASE WHEN key_manual THEN 'manual' ELSE 'automatic' END
    FROM p WHERE eff_tonic IS NOT NULL AND (pitch || CASE WHEN eff_mode = 'minor' THEN 'm' ELSE '' END) IS DISTINCT FROM tagged_key
  UNION ALL SELECT id, 2, 'camelot', NULL, wheel, kc, CASE WHEN key_manual THEN 'manual' ELSE 'automatic' END FROM p WHERE eff_tonic IS NOT NULL
  UNION ALL SELECT id, 3, 'comment', NULL, concat_ws(' | ', printf('%.1f BPM', bpm), pitch || ' ' || eff_mode || ' (' || wheel || ')',
     'Energy ' || energy_level || '/10', printf('%.1f LUFS', lufs)), NULL, 'automatic' FROM p WHERE analysed),
plan AS (SELECT id, pos, field, current, proposed, source, confidence,
  CASE WHEN confidence < 0.5 THEN 'Confidence ' || floor(confidence * 100 + 0.5)::BIGINT || '% is below the 50% floor for writing tags' END AS blocked,
  CASE WHEN confidence >= 0.5 AND confidence < 0.7 THEN 'Confidence ' || floor(confidence * 100 + 0.5)::BIGINT || '% - verify before writing' END AS warning,
  field <> 'comment' AND coalesce(confidence >= 0.7, true) AS selected FROM r)"""


def plan_rows(spark, sf):
    return rv.write_plan(track_view(spark, sf), include_camelot=True, include_comment=True)


@query("write_plan", oracle("eff", f"WITH {_PLAN} SELECT id, field, current, proposed, source, {sql6('confidence')} AS confidence, blocked, warning, selected FROM plan"))
def write_plan(spark, sf):
    return plan_rows(spark, sf).select("id", "field", "current", "proposed", "source",
                                       round6(F.col("confidence")).alias("confidence"), "blocked", "warning", "selected")


@query("write_payload", oracle("eff", f"""WITH {_PLAN} SELECT id, max(proposed) FILTER (field = 'bpm') AS bpm, max(proposed) FILTER (field = 'key') AS initial_key,
  string_agg(proposed, ' | ' ORDER BY pos) FILTER (field IN ('camelot','comment')) AS comment FROM plan WHERE blocked IS NULL GROUP BY id"""))
def write_payload(spark, sf):
    return rv.write_payload(plan_rows(spark, sf), ["bpm", "key", "camelot", "comment"])


# --- tags and export report ------------------------------------------------

@query("read_tags", """SELECT doc_id AS id, nullif(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), '') AS title,
  coalesce(nullif(trim(source), ''), nullif(trim(lang), '')) AS artist, CASE WHEN doc_id % 50 > 0 THEN (doc_id % 50)::INTEGER END AS year,
  CASE WHEN n_chars % 200 > 0 THEN (n_chars % 200)::DOUBLE END AS tagged_bpm,
  CASE WHEN n_chars > 0 THEN floor(n_chars * 250 / 1000 + 0.5)::INTEGER END AS bitrate_kbps FROM documents""")
def read_tags(spark, sf):
    raw = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("artist"),
        F.array("lang").alias("artists"), F.expr("cast(doc_id % 50 as int)").alias("year"),
        F.expr("cast(n_chars % 200 as double)").alias("bpm"), F.expr("cast(n_chars * 250 as double)").alias("bitrate"))
    return normalise_tags(raw).select("id", "title", "artist", "year", "tagged_bpm", "bitrate_kbps")


# --- history -----------------------------------------------------------------

def snapshots(spark, sf):
    return v.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("track_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("saved_at"), F.col("value").alias("bpm"))


_SNAP = "s AS (SELECT event_id::VARCHAR AS id, user_id AS track_id, epoch_us(ts) AS saved_at, value AS bpm FROM events)"


@query("append_history", f"""WITH {_SNAP}, old AS (SELECT * FROM s WHERE track_id % 2 = 0), n AS (SELECT s.* FROM s JOIN part ON p_partkey = track_id),
f AS (SELECT track_id, min(saved_at) AS saved_at FROM s WHERE track_id NOT IN (SELECT track_id FROM old) GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM n
UNION ALL SELECT 'legacy:' || track_id, track_id, saved_at, p_size::DOUBLE FROM f JOIN part ON p_partkey = track_id WHERE p_partkey % 3 <> 0""")
def append_history(spark, sf):
    s = snapshots(spark, sf)
    # a third of the tracks was never analysed
    stored = v.table(spark, sf, "part").select(F.col("p_partkey").alias("track_id"), F.expr("if(p_partkey % 3 = 0, null, double(p_size))").alias("bpm"))
    return hi.append_history(s.where("track_id % 2 = 0"), stored, s)


@query("current_from_history", f"WITH {_SNAP} SELECT track_id, id, saved_at, bpm FROM s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY saved_at DESC, id DESC) = 1")
def current_from_history(spark, sf):
    return hi.current_from_history(snapshots(spark, sf))


@query("history_intervals", f"WITH {_SNAP} SELECT id, track_id, saved_at AS valid_from, lead(saved_at) OVER (PARTITION BY track_id ORDER BY saved_at, id) AS valid_to, bpm FROM s")
def history_intervals(spark, sf):
    return hi.history_intervals(snapshots(spark, sf))


def delete_inputs(spark, sf):
    tracks = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    jobs = v.table(spark, sf, "events").selectExpr(
        "event_id % 1999 as track_id", "case when event_id % 5 = 0 then 'running' else 'done' end as status",
        "event_id % 7 = 0 as cancel_pending", "event_id as job_id")
    rows = v.playlist(spark, sf)
    history = v.table(spark, sf, "lineitem").selectExpr("l_partkey as track_id", "l_orderkey", "l_linenumber")
    ids = v.table(spark, sf, "supplier").selectExpr("s_suppkey * 3 as track_id")
    return hi.cascade_delete(ids, tracks, jobs, {"playlist": rows, "history": history})


_DEL = """j AS (SELECT event_id % 1999 AS track_id, event_id % 5 = 0 OR event_id % 7 = 0 AS active FROM events),
ids AS (SELECT s_suppkey * 3 AS track_id FROM supplier),
gone AS (SELECT track_id FROM ids WHERE track_id NOT IN (SELECT track_id FROM j WHERE active))"""


@query("cascade_delete", oracle("playlist", f"""WITH {_DEL}
SELECT 'tracks' AS tbl, count(*) AS n, sum(p_partkey)::BIGINT AS s FROM part WHERE p_partkey NOT IN (SELECT track_id FROM gone)
UNION ALL SELECT 'jobs', count(*), sum(track_id)::BIGINT FROM j WHERE track_id NOT IN (SELECT track_id FROM gone)
UNION ALL SELECT 'playlist', count(*), sum(track_id)::BIGINT FROM playlist WHERE track_id NOT IN (SELECT track_id FROM gone)
UNION ALL SELECT 'history', count(*), sum(l_partkey)::BIGINT FROM lineitem WHERE l_partkey NOT IN (SELECT track_id FROM gone)
UNION ALL SELECT 'refused', count(*), sum(track_id)::BIGINT FROM ids WHERE track_id NOT IN (SELECT track_id FROM gone)"""))
def cascade_delete(spark, sf):
    out = None
    for name, df in delete_inputs(spark, sf).items():
        key = "id" if name == "tracks" else "track_id"
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("s")).select(F.lit(name).alias("tbl"), "n", "s")
        out = row if out is None else out.unionByName(row)
    return out


@query("migrate", """SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'done' ELSE 'queued' END AS status, epoch_us(ts) AS queued_at, 'analysis' AS phase,
  CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS attempt_id, CAST(NULL AS BIGINT) AS lease_until, 3 AS max_attempts, 0::BIGINT AS next_attempt_at,
  epoch_us(ts) AS updated_at, CASE event_type WHEN 'purchase' THEN 'done' ELSE 'queued' END AS stage,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END::DOUBLE AS progress, event_id AS track_id FROM events""")
def migrate(spark, sf):
    old = v.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.expr("case event_type when 'purchase' then 'done' else 'queued' end").alias("status"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("queued_at"))
    return hi.migrate(old, "jobs", 9).drop("run_id")  # random by definition


@query("migrate_tracks", "SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS manual_grid, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS artist FROM part")
def migrate_tracks(spark, sf):
    return hi.migrate(v.table(spark, sf, "part").selectExpr("p_partkey as id", "p_name as name"), "tracks", 1)

# --- playlists and feedback ---------------------------------------------------

_PLS = "pls AS (SELECT playlist, count(*) AS n FROM playlist GROUP BY 1)"


@query("playlist_add", oracle("playlist", f"""WITH {_PLS} SELECT playlist, pos, track_id FROM playlist
UNION ALL SELECT playlist, n, playlist * 3 % 200 FROM pls WHERE (playlist, playlist * 3 % 200) NOT IN (SELECT (playlist, track_id) FROM playlist)"""))
def playlist_add(spark, sf):
    rows = v.playlist(spark, sf)
    return pl.add(rows, rows.select("playlist").distinct().selectExpr("playlist", "playlist * 3 % 200 as track_id"))


@query("playlist_remove", oracle("playlist", """SELECT playlist, row_number() OVER (PARTITION BY playlist ORDER BY pos) - 1 AS pos, track_id
  FROM playlist WHERE track_id % 4 <> 1"""))
def playlist_remove(spark, sf):
    rows = v.playlist(spark, sf)
    return pl.remove(rows, rows.where("track_id % 4 = 1").select("playlist", "track_id"))


@query("playlist_purge", oracle("playlist", """SELECT playlist, row_number() OVER (PARTITION BY playlist ORDER BY pos) - 1 AS pos, track_id
  FROM playlist WHERE track_id NOT IN (SELECT s_suppkey FROM supplier)"""))
def playlist_purge(spark, sf):
    return pl.purge(v.playlist(spark, sf), v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("track_id")))


@query("playlist_reorder", oracle("playlist", f"""WITH {_PLS}, m AS (SELECT playlist, n, (playlist % 3)::BIGINT AS f, least(n - 1, playlist % 5) AS t FROM pls WHERE playlist % 3 < n)
SELECT p.playlist, CASE WHEN m.f IS NULL THEN pos WHEN pos = f THEN t WHEN pos > f AND pos <= t THEN pos - 1 WHEN pos < f AND pos >= t THEN pos + 1 ELSE pos END AS pos, track_id
FROM playlist p LEFT JOIN m USING (playlist)"""))
def playlist_reorder(spark, sf):
    rows = v.playlist(spark, sf)
    moves = rows.where("pos = playlist % 3").selectExpr("playlist", "track_id", "playlist % 5 as to_index")
    return pl.reorder(rows, moves)


@query("recently_played", oracle("feedback", 'SELECT to_id, "at" FROM feedback WHERE action IN (\'accepted\',\'played\') ORDER BY "at" DESC, id DESC LIMIT 20'))
def recently_played(spark, sf):
    return fb.recently_played(v.feedback(spark, sf))


@query("feedback_for", oracle("feedback", "SELECT * FROM feedback WHERE from_id = 7"))
def feedback_for(spark, sf):
    return fb.feedback_for(v.feedback(spark, sf), 7)


@query("acceptance_stats", oracle("feedback", "SELECT count(*) AS shown, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'accepted' AND rank = 0) AS top_rank_accepted FROM feedback"))
def acceptance_stats(spark, sf):
    return fb.acceptance_stats(v.feedback(spark, sf))


# --- cache ----------------------------------------------------------------------

@query("cache_size", oracle("cache_entries", "SELECT sum(size_bytes)::BIGINT AS bytes, count(*) AS entries, count(*) FILTER (pinned) AS pinned FROM cache_entries"))
def cache_size(spark, sf):
    return ca.cache_size(v.cache_entries(spark, sf))


_EVICT = """t AS (SELECT sum(size_bytes) AS total FROM cache_entries),
e AS (SELECT c.*, coalesce(sum(size_bytes) OVER (ORDER BY last_used_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before,
  row_number() OVER (ORDER BY last_used_at, id) - 1 AS eviction_order FROM cache_entries c WHERE NOT pinned)"""
_LIMIT = 2 * 1024 ** 3 * 20


@query("plan_eviction", oracle("cache_entries", f"WITH {_EVICT} SELECT id, size_bytes, last_used_at, pinned, eviction_order, freed_before FROM e, t WHERE total - freed_before > {_LIMIT}"))
def plan_eviction(spark, sf):
    return ca.plan_eviction(v.cache_entries(spark, sf), _LIMIT)


@query("eviction_summary", oracle("cache_entries", f"""WITH {_EVICT} SELECT count(*) AS removed, coalesce(sum(size_bytes), 0)::BIGINT AS freed_bytes,
  (SELECT total FROM t) - coalesce(sum(size_bytes), 0) > {_LIMIT} AS blocked_by_pins FROM e, t WHERE total - freed_before > {_LIMIT}"""))
def eviction_summary(spark, sf):
    return ca.eviction_summary(v.cache_entries(spark, sf), _LIMIT)


@query("cache_key", """SELECT doc_id, concat_ws(':', sha256(text), source, 'dsp', '1', CASE WHEN doc_id % 2 = 0 THEN 'w' || doc_id ELSE 'no-weights' END, 'alg', 'balanced', lang) AS key FROM documents""")
def cache_key(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", ca.cache_key(
        F.sha2("text", 256), F.col("source"), F.lit("dsp"), F.lit("1"),
        F.expr("case when doc_id % 2 = 0 then concat('w', doc_id) end"), F.lit("alg"), F.lit("balanced"), F.col("lang")).alias("key"))


@query("stems_plausible", """WITH s AS (SELECT l_orderkey AS job_id, floor(l_extendedprice)::BIGINT AS b FROM lineitem),
p AS (SELECT job_id, count(*) AS n, sum(b) AS bytes, count(*) FILTER (b < 1024) AS tiny FROM s GROUP BY 1)
SELECT o_orderkey AS job_id, CASE WHEN n IS NULL THEN 'The service returned no stems.' WHEN tiny > 0 THEN tiny || ' stem(s) came back empty.'
  WHEN bytes < floor(o_totalprice) THEN 'Stems are smaller than the source; separation looks truncated.' END AS reason
FROM orders LEFT JOIN p ON job_id = o_orderkey""")
def stems_plausible(spark, sf):
    stems = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.floor("l_extendedprice").alias("size_bytes"))
    jobs = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.floor("o_totalprice").alias("source_bytes"))
    return ca.stems_plausible(stems, jobs)


@query("expire_results", oracle("job_events", "SELECT event_id, job_id, status FROM job_events WHERE status IN ('done','failed','cancelled') AND event_id IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15')"))
def expire_results(spark, sf):
    jobs = v.job_events(spark, sf).withColumnRenamed("at", "updated_at")
    return ca.expire_results(jobs, F.lit("2024-01-15").cast("timestamp")).select("event_id", "job_id", "status")


# --- files ------------------------------------------------------------------------

@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", fi.content_hash(F.col("text").cast("binary")).alias("content_hash"))


@query("import_new", oracle("files_dup", """SELECT min(id) AS id, content_hash FROM files_dup
  WHERE id % 7 <> 0 AND content_hash NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr') GROUP BY content_hash
  UNION ALL SELECT id, NULL FROM files_dup WHERE id % 7 = 0"""))
def import_new(spark, sf):
    library = v.table(spark, sf, "documents").where("lang = 'fr'").select(F.sha2("text", 256).alias("content_hash"))
    # every seventh file could not be hashed
    hashed = v.files_dup(spark, sf).select("id", F.expr("if(id % 7 = 0, null, content_hash)").alias("content_hash"))
    return fi.import_new(hashed, library)


@query("import_new_paths", oracle("folder_files", "SELECT page_id, path FROM folder_files WHERE path NOT IN (SELECT url FROM pages WHERE length(html) > 2000)"))
def import_new_paths(spark, sf):
    library = v.table(spark, sf, "pages").where("length(html) > 2000").select(F.col("url").alias("file_path"))
    return fi.import_new_paths(v.folder_files(spark, sf).select("page_id", "path"), library)


_RELOC = """rel AS (SELECT relative_path AS k, count(*) AS n, min(path) AS p FROM folder_files GROUP BY 1),
bas AS (SELECT CASE WHEN name <> '' THEN name WHEN regexp_extract(path, '([^/]*)$', 1) <> '' THEN regexp_extract(path, '([^/]*)$', 1) ELSE path END AS k, count(*) AS n, min(path) AS p FROM folder_files GROUP BY 1),
m AS (SELECT id, file_path, nullif(ltrim(relative_path, '/'), '') AS r, CASE WHEN name <> '' THEN name WHEN regexp_extract(file_path, '([^/]*)$', 1) <> '' THEN regexp_extract(file_path, '([^/]*)$', 1) ELSE file_path END AS b FROM missing_tracks),
d AS (SELECT m.id, file_path, CASE WHEN rel.n > 1 THEN 'ambiguous' WHEN rel.n = 1 THEN 'matched' WHEN bas.n > 1 THEN 'ambiguous' WHEN bas.n = 1 THEN 'matched' ELSE 'unmatched' END AS s,
  CASE WHEN rel.n = 1 THEN rel.p WHEN rel.n IS NULL AND bas.n = 1 THEN bas.p END AS np, CASE WHEN rel.n = 1 THEN 'relativePath' ELSE 'basename' END AS how
  FROM m LEFT JOIN rel ON rel.k = m.r LEFT JOIN bas ON bas.k = m.b),
w AS (SELECT *, s = 'matched' AND row_number() OVER (PARTITION BY s, np ORDER BY id) = 1 AS won FROM d),
proposals AS (SELECT id, file_path AS old_path, CASE WHEN won THEN np END AS new_path, CASE WHEN won THEN how END AS match_by,
  CASE WHEN won THEN 'matched' WHEN s = 'matched' THEN 'ambiguous' ELSE s END AS outcome FROM w)"""


def proposals(spark, sf):
    return fi.propose_relocations(v.missing_tracks(spark, sf), v.folder_files(spark, sf).drop("page_id"))


@query("propose_relocations", oracle("missing_tracks", f"WITH {_RELOC} SELECT * FROM proposals"))
def propose_relocations(spark, sf):
    return proposals(spark, sf)


@query("verify_relocations", oracle("missing_tracks", f"""WITH {_RELOC}, h AS (SELECT url AS path, min(sha256(html)) AS content_hash FROM pages WHERE length(html) > 1500 GROUP BY url)
SELECT p.id, new_path, CASE WHEN h.content_hash IS NULL THEN 'read_failed' WHEN t.page_id % 7 <> 0 AND h.content_hash <> sha256(t.html) THEN 'hash_mismatch' ELSE 'ok' END AS result
FROM proposals p JOIN pages t ON t.page_id = p.id LEFT JOIN h ON h.path = p.new_path WHERE outcome = 'matched'"""))
def verify_relocations(spark, sf):
    pages = v.table(spark, sf, "pages")
    hashes = pages.where("length(html) > 1500").groupBy(F.col("url").alias("path")).agg(F.min(F.sha2("html", 256)).alias("content_hash"))
    tracks = pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 7 != 0, F.sha2("html", 256)).alias("content_hash"))
    return fi.verify_relocations(proposals(spark, sf).where("outcome = 'matched'"), hashes, tracks).select("id", "new_path", "result")


@query("should_skip_long", oracle("tracks", """SELECT id, duration_sec * 3 > 900 OR duration_sec * 3 * 48000 * 2 * 4 > 134217728 OR size_bytes * 50 > 67108864 AS skip FROM tracks"""))
def should_skip_long(spark, sf):
    return v.tracks(spark, sf).select("id", fi.should_skip_long(
        F.col("duration_sec") * 3, F.col("size_bytes") * 50, F.col("tags.channels")).alias("skip"))


@query("tempo_accuracy", oracle("eff", """SELECT count(*) AS scored, count(*) FILTER (abs(auto_bpm - t) / t <= 0.04) AS accuracy1,
  count(*) FILTER (list_bool_or(list_transform([1, 2, 0.5, 3, 1/3::DOUBLE, 2/3::DOUBLE, 1.5], lambda r: abs(auto_bpm - t * r) / (t * r) <= 0.04))) AS accuracy2
  FROM (SELECT auto_bpm, 60::DOUBLE + id % 150 AS t FROM eff WHERE analysed)"""))
def tempo_accuracy(spark, sf):
    rows = v.tracks(spark, sf).where("analysis is not null").selectExpr("analysis.tempo.bpm as bpm", "60D + id % 150 as truth")
    return fi.tempo_accuracy(rows)
