"""Source, sink and whole-analysis queries. Files are written by Spark from the given tables."""

from pyspark.sql import functions as F

from cratewise.functions import text as tx
from cratewise.functions.numbers import round6
from cratewise.operators import edits as ed
from cratewise.plans import views as v
from cratewise.plans.analyze import analyze as run_analysis
from cratewise.plans.registry import Book
from cratewise.plans.views import oracle
from cratewise.sources import collection as co, folders as fo

BOOK = Book()
query = BOOK.query


def rows(spark, sf):
    return co.export_rows(ed.effective_tracks(v.tracks(spark, sf)))


def playlist_rows(spark, sf):
    t = rows(spark, sf).select(F.col("id").alias("track_id"), "filename", "relative_path", "artist", "title", "duration_sec")
    return v.playlist(spark, sf).join(t, "track_id")


_LINES = """pl AS (SELECT p.playlist, p.pos, t.* FROM playlist p JOIN tracks t ON t.id = p.track_id),
lines AS (SELECT DISTINCT playlist, 0::BIGINT AS line_no, '#EXTM3U' AS line FROM pl
  UNION ALL SELECT playlist, pos * 2 + 1, '#EXTINF:' || floor(duration_sec + 0.5)::BIGINT || ',' || CASE WHEN artist IS NOT NULL AND title IS NOT NULL THEN artist || ' - ' || title ELSE name END FROM pl
  UNION ALL SELECT playlist, pos * 2 + 2, 'F:\\Music\\' || replace(relative_path, '/', '\\') FROM pl)"""


def lines(spark, sf):
    return co.m3u8_lines(playlist_rows(spark, sf), "F:\\Music\\")


@query("m3u8_lines", oracle("tracks playlist", f"WITH {_LINES} SELECT * FROM lines"))
def m3u8_lines(spark, sf):
    return lines(spark, sf)


def written_playlists(spark, sf):
    folder = fo.scratch_folder(spark, "m3u8")
    co.write_m3u8(lines(spark, sf), folder)
    return folder


@query("read_m3u8", oracle("tracks playlist", f"""WITH {_LINES} SELECT a.playlist::INTEGER AS playlist, regexp_extract(a.line, '^#EXTINF:([0-9]+),', 1)::DOUBLE AS duration_sec,
  regexp_extract(a.line, '^#EXTINF:[0-9]+,(.*)$', 1) AS label, b.line AS path FROM lines a JOIN lines b ON b.playlist = a.playlist AND b.line_no = a.line_no + 1 WHERE a.line LIKE '#EXTINF:%'"""))
def read_m3u8(spark, sf):
    return co.read_m3u8(spark, written_playlists(spark, sf))


@query("scan_folder", oracle("tracks playlist", f"WITH {_LINES} SELECT playlist, sum(octet_length(encode(line)) + 1)::BIGINT AS size_bytes FROM lines GROUP BY 1"))
def scan_folder(spark, sf):
    files = fo.scan_folder(spark, written_playlists(spark, sf), ["txt"])
    return files.groupBy(F.regexp_extract("relative_path", "playlist=([0-9]+)/", 1).cast("bigint").alias("playlist")).agg(
        F.sum("size_bytes").alias("size_bytes"))


_XML = """x AS (SELECT *, row_number() OVER (ORDER BY added_at, id) AS track_id FROM eff)"""


def written_collection(spark, sf):
    folder = fo.scratch_folder(spark, "collection")
    co.write_collection_xml(rows(spark, sf), folder, "/Music & more", "Set <1>")
    return folder


_ROUND_TRIP = f"""WITH {_XML} SELECT track_id, coalesce(title, name) AS name, coalesce(artist, '') AS artist,
  coalesce(floor(bpm * 100 + 0.5) / 100, 0) AS average_bpm,
  CASE WHEN eff_tonic IS NULL OR eff_mode IS NULL THEN '' ELSE (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[eff_tonic + 1] || CASE WHEN eff_mode = 'minor' THEN 'm' ELSE '' END END AS tonality,
  'file://localhost/Music%20%26%20more/' || replace(replace(relative_path, '#', '%23'), ' ', '%20') AS location,
  CASE WHEN analysed OR manual_grid_bpm IS NOT NULL THEN printf('%.3f', floor(first_downbeat * 1000 + 0.5) / 1000) || ' ' || printf('%.2f', bpm) || ' 4/4 1' ELSE '' END AS tempos,
  array_to_string(list_concat(CASE WHEN analysed OR manual_grid_bpm IS NOT NULL THEN ['Downbeat@' || printf('%.3f', floor(first_downbeat * 1000 + 0.5) / 1000)] ELSE [] END,
     CASE WHEN has_cues THEN ['In@' || printf('%.3f', cue_a), 'Out@' || printf('%.3f', cue_b)] ELSE [] END), ',') AS marks FROM x"""


def text_of(back):
    return back.select("track_id", "name", "artist", "average_bpm", "tonality", "location",
                       F.array_join(F.transform("tempos", lambda t: F.concat_ws(" ", F.format_string("%.3f", t["inizio"]), F.format_string("%.2f", t["bpm"]),
                                                                               t["metro"], t["battito"].cast("string"))), ",").alias("tempos"),
                       F.array_join(F.transform("marks", lambda m: F.concat_ws("@", m["name"], F.format_string("%.3f", m["start"]))), ",").alias("marks"))


@query("collection_round_trip", oracle("eff", _ROUND_TRIP))
def collection_round_trip(spark, sf):
    return text_of(co.read_collection_xml(spark, written_collection(spark, sf)))


@query("collection_document", oracle("eff", _ROUND_TRIP))
def collection_document(spark, sf):
    """The same out of one document with its playlist."""
    file = f"{fo.scratch_folder(spark, 'collection')}.xml"
    co.write_collection_document(rows(spark, sf), file, "/Music & more", "Set <1>")
    return text_of(co.read_collection_document(spark, file))


@query("location_url", """SELECT conv_id, turn, 'file://localhost/C:/My%20Music/' || array_to_string(list_transform(string_split(text, '/'),
  lambda s: replace(replace(replace(replace(replace(replace(url_encode(s), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%3A', ':')), '/') AS url FROM conversations""")
def location_url(spark, sf):
    return v.table(spark, sf, "conversations").select("conv_id", "turn", tx.location_url(F.lit("C:\\My Music\\"), F.col("text")).alias("url"))


@query("export_report", oracle("eff", "SELECT count(*) AS track_count, count(bpm) AS with_bpm, count(eff_tonic) AS with_key, count(*) FILTER (analysed OR manual_grid_bpm IS NOT NULL) AS with_grid FROM eff"))
def export_report(spark, sf):
    return co.export_report(rows(spark, sf))


@query("export_missing", oracle("eff", """SELECT id, name AS filename, 'bpm' AS kind FROM eff WHERE bpm IS NULL UNION ALL SELECT id, name, 'key' FROM eff WHERE eff_tonic IS NULL
UNION ALL SELECT id, name, 'grid' FROM eff WHERE NOT (analysed OR manual_grid_bpm IS NOT NULL)"""))
def export_missing(spark, sf):
    return co.export_missing(rows(spark, sf))


@query("read_job_log", "SELECT event_id, event_type, (props->>'k')::INTEGER AS k FROM events")
def read_job_log(spark, sf):
    return fo.read_job_log(v.table(spark, sf, "events").select("event_id", "event_type", "props"), "props", "k int")


@query("read_log_lines", "SELECT event_id, event_type AS level, value FROM events")
def read_log_lines(spark, sf):
    folder = fo.scratch_folder(spark, "log")
    v.table(spark, sf, "events").selectExpr("event_id", "event_type as level", "value").write.json(folder)
    return fo.read_log_lines(spark, folder, "event_id bigint, level string, value double")


@query("analyze")
def analyze(spark, sf):
    """Full analysis of tracks of 5 000 samples at 22 050 Hz."""
    long = v.samples(spark, sf).select(((F.col("track_id") * v.SAMPLES_PER_TRACK + F.col("i"))).alias("e"), "channel", "x")
    long = long.selectExpr("e div 5000 as track_id", "e % 5000 as i", "channel", "x")
    out, _ = run_analysis(v.pack_pcm(long, 4096), 22050, 4096)
    return out.select("track_id", "duration_sec", round6(F.col("bpm")).alias("bpm"), round6(F.col("confidence")).alias("tempo_confidence"),
                      "grid.is_fixed", "tonic", "mode", round6(F.col("integrated_lufs")).alias("integrated_lufs"), "level",
                      F.size("sections").alias("section_count"), "phrase_bars", F.size("words").alias("fingerprint_words"))
