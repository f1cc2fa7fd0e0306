"""Catalogue and effective-value queries."""

from pyspark.sql import functions as F

from cratewise.functions import keys as ks, text as tx
from cratewise.functions.numbers import round6
from cratewise.operators import catalog as cat, edits as ed, review as rv
from cratewise.plans import views as v
from cratewise.plans.registry import Book
from cratewise.plans.views import oracle, sql6

BOOK = Book()
query = BOOK.query

_BLOB = "lower(name || ' ' || coalesce(artist,'') || ' ' || coalesce(title,'') || ' ' || coalesce(album,''))"
_NAME = """CASE WHEN artist IS NOT NULL AND title IS NOT NULL THEN artist || ' — ' || title
  WHEN title IS NOT NULL THEN title ELSE regexp_replace(name, '\\.[^.]+$', '') END"""
_REASONS = """CASE WHEN analysis_error IS NOT NULL THEN ['Analysis failed: ' || analysis_error]
  WHEN NOT analysed THEN ['Not analysed'] ELSE list_filter([
   CASE WHEN coalesce(analysis_version,0) < 3 THEN 'Analysis needs updating' END,
   CASE WHEN manual_grid_bpm IS NULL AND manual_bpm IS NULL AND bpm_conf < 0.7 THEN 'Tempo confidence below 70%' END,
   CASE WHEN manual_grid_bpm IS NULL AND grid_conf < 0.7 THEN 'Beat-grid confidence below 70%' END,
   CASE WHEN manual_key_tonic IS NULL AND key_conf < 0.7 THEN 'Key confidence below 70%' END,
   CASE WHEN manual_key_tonic IS NULL AND rel_ambiguous THEN 'Relative major/minor is ambiguous' END],
   lambda x: x IS NOT NULL) END"""
_KEYS = f"""keys AS (SELECT id, {_NAME} AS name, coalesce(bpm, 0) AS bpm, {_BLOB} AS search, added_at,
  reviewed_at IS NULL AND (NOT analysed OR len({_REASONS}) > 0) AS review,
  analysis_error IS NOT NULL AS failed, reviewed_at IS NOT NULL AS reviewed,
  analysed AND analysis_version < 3 AS stale FROM eff)"""


def keys(spark, sf):
    return cat.catalog_keys(v.tracks(spark, sf))


def flat(df):
    """Key columns that both engines print alike (the token array is its own query)."""
    return df.select("id", "name", "bpm", "added_at", "review", "failed", "reviewed", "stale",
                     *[c for c in ("total", "offset") if c in df.columns])


_FLAT = "id, name, bpm, added_at, review, failed, reviewed, stale"


# The same flags where a track also counts as outdated when an expected analyser has no identical stored run.
_WITH_RUNS = f"""expected AS (SELECT 'a' || n AS analyzer, CASE WHEN n % 2 = 1 THEN 'R' ELSE 'A' END AS version FROM range(1, 3) r(n)),
old AS (SELECT DISTINCT id FROM eff, expected e WHERE NOT EXISTS (SELECT 1 FROM provenance p WHERE p.track_id = eff.id AND p.analyzer = e.analyzer AND p.version = e.version AND p.params_hash = 'F')),
{_KEYS.replace('coalesce(analysis_version,0) < 3', '(coalesce(analysis_version,0) < 3 OR id IN (SELECT id FROM old))')
      .replace('analysed AND analysis_version < 3 AS stale', 'analysed AND (coalesce(analysis_version,0) < 3 OR id IN (SELECT id FROM old)) AS stale')}"""


def keys_with_runs(spark, sf):
    tracks = v.tracks(spark, sf)
    expected = spark.range(1, 3).selectExpr("concat('a', id) as analyzer", "if(id % 2 = 1, 'R', 'A') as version", "'F' as params_hash")
    missing = rv.stale_analyzers(tracks, v.provenance(spark, sf), expected)
    return cat.catalog_keys(tracks, stale_analyzers=missing)


@query("catalog_keys_with_runs", oracle("eff provenance", f"WITH {_WITH_RUNS} SELECT {_FLAT} FROM keys"))
def catalog_keys_with_runs(spark, sf):
    return flat(keys_with_runs(spark, sf))


@query("catalog_stats_with_runs", oracle("eff provenance", f"""WITH {_WITH_RUNS} SELECT count(*) AS total, count(*) FILTER (stale) AS stale, count(*) FILTER (review) AS review FROM keys"""))
def catalog_stats_with_runs(spark, sf):
    return keys_with_runs(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if("stale").alias("stale"), F.count_if("review").alias("review"))


@query("load_library", oracle("tracks", "SELECT id, name, added_at FROM tracks ORDER BY added_at DESC"))
def load_library(spark, sf):
    return v.tracks(spark, sf).select("id", "name", "added_at").orderBy(F.desc("added_at"))


@query("project_catalog", oracle("tracks", """
SELECT id, name, relative_path, file_path, size_bytes, duration_sec, added_at, title, artist, album, analysis_version,
  analysis_error, manual_bpm, manual_key_tonic, manual_key_mode, reviewed_at, has_fingerprint, auto_bpm, tonic, mode,
  energy_level, raw_score, vocal, first_section FROM tracks"""))
def project_catalog(spark, sf):
    p = cat.project_catalog(v.tracks(spark, sf))
    return p.select("id", "name", "relative_path", "file_path", "size_bytes", "duration_sec", "added_at", "tags.title",
                    "tags.artist", "tags.album", "analysis_version", "analysis_error", "manual_bpm",
                    "manual_key_tonic", "manual_key_mode", "reviewed_at", "has_fingerprint",
                    F.col("analysis.tempo.bpm").alias("auto_bpm"), "analysis.key.tonic", "analysis.key.mode",
                    F.col("analysis.energy.level").alias("energy_level"), "analysis.energy.raw_score",
                    F.col("analysis.vocal_coverage").alias("vocal"), "analysis.first_section")


@query("catalog_keys", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT}, search FROM keys"))
def catalog_keys(spark, sf):
    return keys(spark, sf).drop("tokens")


@query("display_name", oracle("tracks", f"SELECT id, {_NAME} AS display FROM tracks"))
def display_name(spark, sf):
    return v.tracks(spark, sf).select("id", tx.display_name(F.col("tags.artist"), F.col("tags.title"), F.col("name")).alias("display"))


@query("search_tokens", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i, 0 AS kind FROM w
  UNION ALL SELECT doc_id, w[g] || ' ' || w[g + 1], g, 1 FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS g FROM w)),
f AS (SELECT doc_id, token, min(kind * 1000000 + i) AS p FROM t GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(token, '|' ORDER BY p), '') AS tokens, count(token) AS n FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def search_tokens(spark, sf):
    t = tx.search_tokens(F.col("text"))
    return (v.table(spark, sf, "documents").select("doc_id", t.alias("t"))
            .select("doc_id", F.array_join("t", "|").alias("tokens"), F.size("t").cast("bigint").alias("n")))


@query("pick_search_token", """
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations),
u AS (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w)
SELECT conv_id, turn, t AS token FROM conversations LEFT JOIN u USING (conv_id, turn) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY
  t IN ('artist','title','album','recording','song','track','wav','mp3','flac','aac','m4a'),
  NOT regexp_full_match(t, '[0-9]+'), -length(t), i) = 1""")
def pick_search_token(spark, sf):
    return (v.table(spark, sf, "conversations")
            .select("conv_id", "turn", tx.pick_token(tx.words(F.col("text"))).alias("token")))


@query("search_contains", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT} FROM keys WHERE contains(search, 'blue')"))
def search_contains(spark, sf):
    return flat(cat.search_contains(keys(spark, sf), "  Blue "))


@query("search_token_prefix", oracle("eff", f"""WITH {_KEYS} SELECT {_FLAT} FROM keys
  WHERE contains(search, 'red wid') AND regexp_matches(search, '(^|[^a-z0-9])red[^a-z0-9]+wid')"""))
def search_token_prefix(spark, sf):
    return flat(cat.search_token_prefix(keys(spark, sf), "red wid"))


@query("token_index", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
SELECT DISTINCT doc_id AS id, token FROM (SELECT doc_id, unnest(w) AS token FROM w
  UNION ALL SELECT doc_id, w[g] || ' ' || w[g + 1] FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS g FROM w))""")
def token_index(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.search_tokens(F.col("text")).alias("tokens"))
    return cat.token_index(docs)


for _flag in ("review", "failed", "reviewed"):
    @query(f"filter_{_flag}", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT} FROM keys WHERE {_flag}"))
    def filter_flag(spark, sf, flag=_flag):
        return flat(cat.filter_flag(keys(spark, sf), flag))

for _sort, _order in (("added", "added_at DESC, id DESC"), ("bpm", "bpm, id"), ("name", "lower(name), id")):
    @query(f"sort_{_sort}", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT}, row_number() OVER (ORDER BY {_order}) - 1 AS pos FROM keys"))
    def sort_rows(spark, sf, sort=_sort):
        from cratewise.operators.ordered import with_position
        return with_position(flat(keys(spark, sf)), cat.sort_order(sort), "pos")

    @query(f"page_{_sort}", oracle("eff", f"""WITH {_KEYS} SELECT {_FLAT}, (SELECT count(*) FROM keys) AS total,
        100::BIGINT AS "offset" FROM keys ORDER BY {_order} LIMIT 100 OFFSET 100"""))
    def page_rows(spark, sf, sort=_sort):
        return flat(cat.page_offset(keys(spark, sf), sort=sort, offset=100))


@query("page_search_review", oracle("eff", f"""WITH {_KEYS}, m AS (SELECT * FROM keys WHERE contains(search, 'ring') AND review)
SELECT {_FLAT}, (SELECT count(*) FROM m) AS total, 0::BIGINT AS "offset" FROM m ORDER BY lower(name), id LIMIT 50"""))
def page_search_review(spark, sf):
    return flat(cat.page_offset(keys(spark, sf), "ring", "review", "name", 0, 50))


@query("page_clamped", oracle("eff", f"""WITH {_KEYS}, n AS (SELECT count(*) AS total, greatest(0, (count(*) - 1) // 70 * 70) AS o FROM keys),
r AS (SELECT *, row_number() OVER (ORDER BY bpm, id) - 1 AS pos FROM keys)
SELECT {_FLAT}, total, o AS "offset" FROM r, n WHERE pos >= o"""))
def page_clamped(spark, sf):
    return flat(cat.page_offset(keys(spark, sf), sort="bpm", offset=10**12, limit=70))


@query("page_keyset", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT} FROM keys WHERE bpm > 100 OR (bpm = 100 AND id > 50) ORDER BY bpm, id LIMIT 100"))
def page_keyset(spark, sf):
    return flat(cat.page_keyset(keys(spark, sf), "bpm", (100.0, 50), 100))


@query("page_from_tail", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT} FROM (SELECT * FROM keys ORDER BY added_at, id LIMIT 90 OFFSET 10) ORDER BY added_at DESC"))
def page_from_tail(spark, sf):
    k = keys(spark, sf)
    total = k.count()
    return flat(cat.page_from_tail(k, "added", total, total - 100, 90))


@query("matching_all", oracle("eff", f"WITH {_KEYS} SELECT {_FLAT} FROM keys WHERE contains(search, 'ring') AND review ORDER BY lower(name), id"))
def matching_all(spark, sf):
    return flat(cat.matching(keys(spark, sf), "ring", "review", "name"))


@query("hydrate_ids", oracle("tracks playlist", "SELECT playlist, pos, p.track_id AS id, name, duration_sec FROM playlist p JOIN tracks t ON t.id = p.track_id"))
def hydrate_ids(spark, sf):
    ids = v.playlist(spark, sf).withColumnRenamed("track_id", "id")
    rows = cat.project_catalog(v.tracks(spark, sf)).select("id", "name", "duration_sec")
    return cat.hydrate(ids, rows)


@query("catalog_stats", oracle("eff", f"""WITH {_KEYS} SELECT count(*) AS total, count(*) AS indexed, count(*) FILTER (stale) AS stale,
  count(*) FILTER (review) AS review, true AS complete FROM keys"""))
def catalog_stats(spark, sf):
    t = v.tracks(spark, sf)
    return cat.catalog_stats(t, cat.catalog_keys(t))


@query("missing_path_rows", oracle("missing_tracks", """SELECT m.id, m.file_path FROM missing_tracks m
  WHERE file_path NOT IN (SELECT 'old://' || path FROM folder_files WHERE length(name) > 3)"""))
def missing_path_rows(spark, sf):
    listing = v.folder_files(spark, sf).where(F.length("name") > 3).select(F.concat(F.lit("old://"), "path").alias("path"))
    return cat.missing_path_rows(v.missing_tracks(spark, sf), listing).select("id", "file_path")


# --- effective values and edits -------------------------------------------

@query("effective_bpm", oracle("eff", "SELECT id, bpm FROM eff"))
def effective_bpm(spark, sf):
    return v.tracks(spark, sf).select("id", ed.effective_bpm().alias("bpm"))


@query("effective_key", oracle("eff", "SELECT id, eff_tonic AS tonic, eff_mode AS mode, key_manual FROM eff"))
def effective_key(spark, sf):
    return ed.effective_tracks(v.tracks(spark, sf)).select("id", "tonic", "mode", "key_manual")


_GRID_COLS = "id, anchor_time, anchor_bpm, downbeat, confidence"


def grid_columns(df, grid):
    first = F.get(grid["anchors"], F.lit(0))
    return df.select("id", first["time_sec"].alias("anchor_time"), first["bpm"].alias("anchor_bpm"),
                     grid["first_downbeat_sec"].alias("downbeat"), grid["grid_confidence"].alias("confidence"))


@query("effective_grid", oracle("eff", """SELECT id, first_downbeat AS anchor_time, bpm AS anchor_bpm, first_downbeat AS downbeat,
  CASE WHEN manual_grid_bpm IS NOT NULL OR manual_bpm IS NOT NULL THEN 1 ELSE grid_conf END::DOUBLE AS confidence,
  (manual_grid_bpm IS NOT NULL OR manual_bpm IS NOT NULL) AS grid_manual
  FROM eff WHERE analysed OR manual_grid_bpm IS NOT NULL"""))
def effective_grid(spark, sf):
    e = ed.effective_tracks(v.tracks(spark, sf)).where("grid is not null")
    first = F.get(F.col("grid.anchors"), F.lit(0))
    return e.select("id", first["time_sec"].alias("anchor_time"), first["bpm"].alias("anchor_bpm"),
                    F.col("grid.first_downbeat_sec").alias("downbeat"), F.col("grid.grid_confidence").alias("confidence"), "grid_manual")


@query("set_grid_bpm", oracle("tracks", """SELECT id, first_downbeat AS anchor_time, 99.5::DOUBLE AS anchor_bpm,
  first_downbeat AS downbeat, 1::DOUBLE AS confidence FROM tracks WHERE analysed"""))
def set_grid_bpm(spark, sf):
    t = v.tracks(spark, sf).where("analysis is not null")
    return grid_columns(t.withColumn("g", ed.set_grid_bpm(F.col("analysis.grid"), F.lit(99.5))), F.col("g"))


_MOVED = """g AS (SELECT track_id AS id, n, time_sec, bpm, first_downbeat_sec FROM anchors)"""


def _anchor_rows(df, grid):
    return df.select(F.col("track_id").alias("id"), grid["first_downbeat_sec"].alias("downbeat"),
                     F.posexplode(grid["anchors"]).alias("n", "a")).select(
        "id", F.col("n").cast("bigint").alias("n"), round6(F.col("a.time_sec")).alias("time_sec"),
        round6(F.col("a.bpm")).alias("bpm"), round6(F.col("downbeat")).alias("downbeat"))


def _stored_grid():
    return F.struct("anchors", "beats_per_bar", "first_downbeat_sec", F.lit(True).alias("is_fixed"),
                    F.lit(1.0).alias("grid_confidence"), F.lit(1.0).alias("downbeat_confidence"))


@query("scale_tempo", oracle("grids", f"""WITH {_MOVED} SELECT id, n, {sql6('first_downbeat_sec + (time_sec - first_downbeat_sec) / 1.5')} AS time_sec,
  {sql6('bpm * 1.5')} AS bpm, {sql6('first_downbeat_sec')} AS downbeat FROM g"""))
def scale_tempo(spark, sf):
    g = v.grids(spark, sf).withColumn("g", _stored_grid())
    return _anchor_rows(g.withColumn("h", ed.scale_tempo(F.col("g"), F.lit(1.5))), F.col("h"))


@query("nudge_grid", oracle("grids", f"""WITH {_MOVED} SELECT id, n, {sql6('time_sec + 0.013')} AS time_sec, {sql6('bpm')} AS bpm,
  {sql6('first_downbeat_sec + 0.013')} AS downbeat FROM g"""))
def nudge_grid(spark, sf):
    g = v.grids(spark, sf).withColumn("g", _stored_grid())
    return _anchor_rows(g.withColumn("h", ed.nudge_grid(F.col("g"), F.lit(0.013))), F.col("h"))


@query("lock_grid", oracle("eff", """SELECT id, CASE WHEN locked THEN bpm ELSE manual_grid_bpm END AS grid_bpm,
  (locked OR grid_locked) AS grid_locked FROM (SELECT *, id % 3 = 0 AS locked FROM eff)"""))
def lock_grid(spark, sf):
    t = v.tracks(spark, sf)
    locks = t.selectExpr("id", "case when id % 3 = 0 then true end as locked")
    # A row that is locked has the effective grid; its BPM shows the freeze.
    return ed.lock_grid(t, locks).select(
        "id", F.coalesce(F.get(F.col("manual_grid.anchors"), F.lit(0))["bpm"],
                         F.when(F.col("id") % 3 == 0, F.col("manual_bpm"))).alias("grid_bpm"), "grid_locked")


@query("tap_tempo", f"""WITH g AS (SELECT user_id AS group_id, epoch_us(ts) / 1e6 / 20000 AS t, event_id FROM events),
d AS (SELECT group_id, t - lag(t) OVER (PARTITION BY group_id ORDER BY event_id) AS gap FROM g)
SELECT group_id, {sql6('60 / quantile_cont(gap, 0.5)')} AS bpm, count(*) AS gaps FROM d WHERE gap > 0.2 AND gap < 2 GROUP BY 1""")
def tap_tempo(spark, sf):
    taps = v.table(spark, sf, "events").select(
        F.col("user_id").alias("group_id"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) / F.lit(20000)).alias("at_sec"))
    return ed.tap_tempo(taps).withColumn("bpm", round6(F.col("bpm")))


def edits(spark, sf):
    return v.table(spark, sf, "events").selectExpr(
        "event_id as id", "event_id % 997 as track_id",
        """case event_type when 'purchase' then 'bpm' when 'error' then 'grid' when 'view' then 'key'
           when 'click' then 'cue' else 'review' end as kind""",
        """case event_type when 'purchase' then case when event_id % 11 = 0 then null else value * 4 end
           when 'error' then value * 3 end as bpm""",
        "case when event_type = 'view' and event_id % 5 <> 0 then cast(event_id % 13 as int) end as tonic",
        "case when event_type = 'view' and event_id % 7 <> 0 then 'major' end as mode",
        "case when event_type in ('click', 'error') then value end as time_sec")


_EDITS = """edits AS (SELECT event_id AS id, event_id % 997 AS track_id,
  CASE event_type WHEN 'purchase' THEN 'bpm' WHEN 'error' THEN 'grid' WHEN 'view' THEN 'key' WHEN 'click' THEN 'cue' ELSE 'review' END AS kind,
  CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 4 END WHEN 'error' THEN value * 3 END AS bpm,
  CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN (event_id % 13)::INTEGER END AS tonic,
  CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN 'major' END AS mode,
  CASE WHEN event_type IN ('click', 'error') THEN value END AS time_sec FROM events),
checked AS (SELECT e.*, t.id AS tid, CASE WHEN t.id IS NULL THEN 'unknown track'
  WHEN kind IN ('bpm','grid') AND (bpm < 20 OR bpm > 400) THEN 'tempo out of range'
  WHEN kind IN ('bpm','grid') AND grid_locked THEN 'grid locked'
  WHEN kind = 'key' AND ((e.tonic IS NULL) <> (e.mode IS NULL) OR coalesce(e.tonic > 11, false)) THEN 'incomplete key'
  WHEN kind = 'cue' AND NOT (time_sec >= 0 AND time_sec < duration_sec) THEN 'cue outside track' END AS reason
  FROM edits e LEFT JOIN tracks t ON t.id = e.track_id)"""


@query("validate_edits", oracle("tracks", f"WITH {_EDITS} SELECT id, track_id, kind, reason FROM checked"))
def validate_edits(spark, sf):
    return ed.validate_edits(edits(spark, sf), v.tracks(spark, sf)).select("id", "track_id", "kind", "reason")


@query("apply_edits", oracle("eff", f"""WITH {_EDITS}, ok AS (SELECT * FROM checked WHERE reason IS NULL),
b AS (SELECT track_id, max(id) AS s, arg_max(bpm, id) AS bpm FROM ok WHERE kind = 'bpm' AND bpm IS NOT NULL GROUP BY 1),
c AS (SELECT track_id, max(id) AS s FROM ok WHERE kind = 'bpm' AND bpm IS NULL GROUP BY 1),
g AS (SELECT track_id, max(id) AS s, arg_max(bpm, id) AS bpm FROM ok WHERE kind = 'grid' GROUP BY 1),
k AS (SELECT track_id, max(id) AS s FROM ok WHERE kind = 'key' GROUP BY 1),
j AS (SELECT e.*, coalesce(b.s, -1) AS bs, b.bpm AS bb, coalesce(c.s, -1) AS cs, coalesce(g.s, -1) AS gs, g.bpm AS gb, k.s AS ks,
   o.tonic AS kt, o.mode AS km FROM eff e LEFT JOIN b ON b.track_id = e.id LEFT JOIN c ON c.track_id = e.id
   LEFT JOIN g ON g.track_id = e.id LEFT JOIN k ON k.track_id = e.id LEFT JOIN ok o ON o.id = k.s)
SELECT id, CASE WHEN cs > bs AND cs > gs THEN NULL WHEN bs > gs THEN bb WHEN gs >= 0 THEN gb ELSE manual_bpm END AS manual_bpm,
  CASE WHEN cs > bs AND cs > gs THEN NULL WHEN bs > gs THEN CASE WHEN analysed OR (gs > cs) OR (cs < 0 AND manual_grid_bpm IS NOT NULL) THEN bb END
       WHEN gs >= 0 THEN gb ELSE manual_grid_bpm END AS grid_bpm,
  CASE WHEN ks IS NOT NULL THEN kt ELSE manual_key_tonic END AS manual_key_tonic,
  CASE WHEN ks IS NOT NULL THEN km ELSE manual_key_mode END AS manual_key_mode,
  CASE WHEN bs >= 0 OR cs >= 0 OR gs >= 0 OR ks IS NOT NULL THEN NULL ELSE reviewed_at END AS reviewed_at FROM j"""))
def apply_edits(spark, sf):
    t = v.tracks(spark, sf)
    accepted = ed.validate_edits(edits(spark, sf), t).where("reason is null")
    return ed.apply_edits(t, accepted).select(
        "id", "manual_bpm", F.get(F.col("manual_grid.anchors"), F.lit(0))["bpm"].alias("grid_bpm"),
        "manual_key_tonic", "manual_key_mode", "reviewed_at")


@query("add_cue", oracle("tracks", """SELECT id, array_to_string(list_transform(list_sort(list_concat(
    CASE WHEN has_cues THEN [{'t': cue_a, 'o': 0, 'n': 'In'}, {'t': cue_b, 'o': 1, 'n': 'Out'}] ELSE [] END, [{'t': 50::DOUBLE + id % 90, 'o': 2, 'n': 'Cue'}])),
    lambda c: c.n || '@' || c.t::BIGINT), ',') AS cues FROM tracks"""))
def add_cue(spark, sf):
    t = v.tracks(spark, sf)
    cues = ed.add_cue(F.col("cues"), F.col("id"), F.expr("50D + id % 90"), F.lit("  "))
    return t.select("id", F.array_join(F.transform(cues, lambda c: F.concat(
        c["name"], F.lit("@"), c["time_sec"].cast("bigint").cast("string"))), ",").alias("cues"))


@query("remove_cue", oracle("tracks", "SELECT id, CASE WHEN has_cues THEN 1 ELSE 0 END::BIGINT AS left_over FROM tracks"))
def remove_cue(spark, sf):
    return v.tracks(spark, sf).select("id", F.size(ed.remove_cue(F.col("cues"), F.lit("a"))).cast("bigint").alias("left_over"))


# --- key notation ------------------------------------------------------------

@query("key_notation", oracle("eff", """WITH k AS (SELECT id, eff_tonic AS t, eff_mode AS m,
  ((CASE WHEN eff_mode = 'minor' THEN (eff_tonic + 3) % 12 ELSE eff_tonic END) * 7) % 12 + 1 AS o FROM eff WHERE eff_tonic IS NOT NULL)
SELECT id, ((o + 6) % 12 + 1) || CASE WHEN m = 'major' THEN 'B' ELSE 'A' END AS camelot, o || CASE WHEN m = 'major' THEN 'd' ELSE 'm' END AS open_key,
  ((t + CASE WHEN m = 'major' THEN 9 ELSE 3 END) % 12)::INTEGER AS relative_tonic, CASE WHEN m = 'major' THEN 'minor' ELSE 'major' END AS relative_mode,
  (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[t + 1] || CASE WHEN m = 'minor' THEN 'm' ELSE '' END AS tonality,
  (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[t + 1] || ' ' || m AS name FROM k"""))
def key_notation(spark, sf):
    t, m = F.col("tonic"), F.col("mode")
    return ed.effective_tracks(v.tracks(spark, sf)).where("tonic is not null").select(
        "id", ks.camelot(t, m).alias("camelot"), ks.open_key(t, m).alias("open_key"),
        ks.relative_tonic(t, m).alias("relative_tonic"), ks.relative_mode(m).alias("relative_mode"),
        ks.tonality(t, m).alias("tonality"), ks.key_name(t, m).alias("name"))
