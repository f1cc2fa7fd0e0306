"""Pairwise ranking queries."""

from pyspark.sql import functions as F

from cratewise.functions.numbers import round6
from cratewise.operators import feedback as fb, ranking as rk
from cratewise.plans import views as v
from cratewise.plans.registry import Book
from cratewise.plans.views import oracle, sql6

BOOK = Book()
query = BOOK.query

_RECENT = "recent AS (SELECT DISTINCT to_id FROM (SELECT to_id FROM feedback WHERE action IN ('accepted','played') ORDER BY \"at\" DESC, id DESC LIMIT 20))"
_RANKED = f"""{_RECENT},
rv AS (SELECT id, name, artist, bpm, ((((CASE WHEN eff_mode = 'minor' THEN (eff_tonic + 3) % 12 ELSE eff_tonic END) * 7) % 12 + 7) % 12 + 1) AS wheel,
  CASE WHEN eff_mode = 'major' THEN 'B' ELSE 'A' END AS letter, coalesce(energy_level, 5) AS energy, coalesce(vocal, 0.4::DOUBLE) AS vocal, first_section,
  CASE first_section WHEN 'Intro' THEN 1 WHEN 'Instrumental' THEN 0.85 WHEN 'Sparse' THEN 0.85 WHEN 'Build' THEN 0.6 WHEN 'Drop' THEN 0.25 ELSE 0.5 END::DOUBLE AS sec,
  id IN (SELECT to_id FROM recent) AS recent, analysed FROM eff WHERE bpm > 0 AND eff_tonic IS NOT NULL),
pairs AS (SELECT s.id AS from_id, c.id AS to_id, c.name AS to_name, c.recent, s.artist IS NOT NULL AND c.artist IS NOT NULL AND s.artist = c.artist AS same_artist,
  c.bpm AS c_bpm, s.bpm AS s_bpm, c.energy AS c_energy, s.energy AS s_energy, c.first_section, c.vocal AS c_vocal, s.vocal AS s_vocal,
  s.wheel || s.letter AS s_key, c.wheel || c.letter AS c_key,
  greatest(0, 1 - least(abs(log2(c.bpm / s.bpm)), abs(log2(c.bpm / (s.bpm * 2))), abs(log2(c.bpm / (s.bpm * 0.5::DOUBLE)))) / 0.06::DOUBLE) AS t,
  CASE WHEN s.letter = c.letter AND s.wheel = c.wheel THEN 1 WHEN s.wheel = c.wheel THEN 0.85
    WHEN s.letter = c.letter AND least(abs(s.wheel - c.wheel), 12 - abs(s.wheel - c.wheel)) = 1 THEN 0.8
    WHEN s.letter = c.letter AND least(abs(s.wheel - c.wheel), 12 - abs(s.wheel - c.wheel)) = 2 THEN 0.45 ELSE 0.1 END::DOUBLE AS h,
  greatest(0, 1 - abs(c.energy - s.energy - 1) / 4::DOUBLE) AS e, c.sec AS sec, greatest(0, 1 - s.vocal * c.vocal * 1.6::DOUBLE) AS vo
  FROM rv s, rv c WHERE c.analysed AND c.id <> s.id SOURCE),
scored AS (SELECT *, floor(greatest(0, least(1, 0 + t * 0.34::DOUBLE + h * 0.30::DOUBLE + e * 0.16::DOUBLE + sec * 0.12::DOUBLE + vo * 0.08::DOUBLE
   - CASE WHEN same_artist THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN recent THEN 0.25::DOUBLE ELSE 0 END)) * 100 + 0.5::DOUBLE)::BIGINT AS score FROM pairs),
topk AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY score DESC, to_name, to_id)::INTEGER AS rank FROM scored QUALIFY rank <= 8),
listed AS (SELECT *, array_to_string(list_transform(list_sort([
     {{'p': -{sql6('t * 0.34::DOUBLE')}, 'i': 0, 'n': 'tempo'}}, {{'p': -{sql6('h * 0.30::DOUBLE')}, 'i': 1, 'n': 'key'}},
     {{'p': -{sql6('e * 0.16::DOUBLE')}, 'i': 2, 'n': 'energy'}}, {{'p': -{sql6('sec * 0.12::DOUBLE')}, 'i': 3, 'n': 'section'}},
     {{'p': -{sql6('vo * 0.08::DOUBLE')}, 'i': 4, 'n': 'vocals'}}]), lambda r: r.n), ',') AS reasons,
   concat_ws('; ', CASE WHEN t < 0.3 THEN 'Tempo needs more than a comfortable pitch shift' END, CASE WHEN h < 0.3 THEN 'Keys clash' END,
     CASE WHEN vo < 0.4 THEN 'Vocals will overlap' END, CASE WHEN same_artist THEN 'Same artist as the current track' END,
     CASE WHEN recent THEN 'Played recently' END) AS warnings FROM topk)"""


def ranked(spark, sf):
    # At most 20 ids, so they travel as constants.
    recent = sorted({r["to_id"] for r in fb.recently_played(v.feedback(spark, sf), 20).collect()})
    return rk.rank_view(v.tracks(spark, sf), recent)


@query("recommend_all", oracle("eff feedback", f"WITH {_RANKED.replace('SOURCE', '')} SELECT from_id, rank, to_id, to_name, score, reasons, warnings FROM listed"))
def recommend_all(spark, sf):
    return rk.recommend_all(ranked(spark, sf))


@query("recommend", oracle("eff feedback", f"""WITH {_RANKED.replace('SOURCE', 'AND s.id = 34')} SELECT to_id AS id, to_name AS name, score, reasons, warnings,
  CASE WHEN c_key = s_key THEN 'Same key (' || c_key || ')' ELSE CASE h WHEN 0.85 THEN 'Relative major/minor' WHEN 0.8 THEN 'One step on the wheel'
    WHEN 0.45 THEN 'Two steps on the wheel' ELSE 'Key contrast' END || ' (' || s_key || ' to ' || c_key || ')' END AS key_text,
  'Energy ' || c_energy || '/10 (' || CASE WHEN c_energy > s_energy THEN 'up ' || (c_energy - s_energy) WHEN c_energy < s_energy THEN 'down ' || (s_energy - c_energy) ELSE 'level' END || ')' AS energy_text,
  CASE first_section WHEN 'Intro' THEN 'Opens with an intro' WHEN 'Sparse' THEN 'Opens sparse' WHEN 'Build' THEN 'Opens on a build'
    WHEN 'Drop' THEN 'Opens straight into a drop' WHEN 'Verse' THEN 'Opens on verse' ELSE 'No structure analysed' END AS section_text,
  printf('%.1f BPM, %.1f%% away', c_bpm, (pow(2, least(abs(log2(c_bpm / s_bpm)), abs(log2(c_bpm / (s_bpm * 2))), abs(log2(c_bpm / (s_bpm * 0.5::DOUBLE))))) - 1) * 100)
   || CASE WHEN abs(log2(c_bpm / s_bpm)) <= 0.5 THEN '' WHEN c_bpm > s_bpm THEN ' at double time' ELSE ' at half time' END AS tempo_text,
  CASE WHEN c_vocal * s_vocal > 0.45 THEN 'Both tracks are vocal-heavy (' || floor(c_vocal * s_vocal * 100 + 0.5)::BIGINT || '% overlap)'
    WHEN c_vocal < 0.2 THEN 'Incoming track is largely instrumental' ELSE 'Vocal overlap is manageable' END AS vocal_text FROM listed"""))
def recommend(spark, sf):
    tracks = ranked(spark, sf)
    return rk.recommend(tracks.where("id = 34"), tracks)


_PAIR = """pr AS (SELECT a.id AS from_id, b.id AS to_id, a.bpm AS fb, b.bpm AS tb, a.duration_sec AS fd, b.duration_sec AS td FROM feedback f
  JOIN eff a ON a.id = f.from_id JOIN eff b ON b.id = f.to_id)"""


def track_pairs(spark, sf):
    t = v.tracks(spark, sf)
    log = v.feedback(spark, sf).select("id", "from_id", "to_id")
    return (log.join(rk.audition_sides(t, "from"), "from_id").join(rk.audition_sides(t, "to"), "to_id")
            .withColumnRenamed("from_beats", "beats_per_bar"))


@query("transition_window", oracle("eff feedback", f"""WITH {_PAIR}, w AS (SELECT *, greatest(1, least(8, 60 / fb * 4 * 16 / 2, 60 / tb * 4 * 8, fd / 4, td / 4)) AS fade FROM pr WHERE fb > 0 AND tb > 0)
SELECT from_id, to_id, {sql6('fade')} AS crossfade_sec, {sql6('greatest(0, fd - greatest(fade * 2, 60 / fb * 4 * 16 / 2))')} AS from_start_sec FROM w"""))
def transition_window(spark, sf):
    return rk.transition_window(track_pairs(spark, sf)).select(
        "from_id", "to_id", round6(F.col("crossfade_sec")).alias("crossfade_sec"),
        round6(F.col("from_start_sec")).alias("from_start_sec"))


@query("sync_ratio", oracle("eff feedback", f"""WITH {_PAIR}, r AS (SELECT from_id, to_id, tb / (fb * (1 + from_id % 4)) AS r FROM pr WHERE fb > 0 AND tb > 0),
h AS (SELECT *, r / pow(2, list_min(list_filter(range(9), lambda n: r / pow(2, n) <= 1.42::DOUBLE))) AS h FROM r)
SELECT from_id, to_id, {sql6('h * pow(2, list_min(list_filter(range(9), lambda n: h * pow(2, n) >= 0.71::DOUBLE)))')} AS ratio FROM h"""))
def sync_ratio(spark, sf):
    p = track_pairs(spark, sf).where("from_bpm > 0 and to_bpm > 0")
    return p.select("from_id", "to_id", round6(rk.sync_ratio(F.col("from_bpm") * (1 + F.col("from_id") % 4), F.col("to_bpm"))).alias("ratio"))


@query("pair_components", oracle("eff feedback", f"""WITH {_RANKED.split('pairs AS')[0].rstrip().rstrip(',')},
f AS (SELECT id, from_id, to_id FROM feedback)
SELECT f.id, {sql6('greatest(0, 1 - least(abs(log2(c.bpm / s.bpm)), abs(log2(c.bpm / (s.bpm * 2))), abs(log2(c.bpm / (s.bpm * 0.5::DOUBLE)))) / 0.06::DOUBLE)')} AS tempo,
  CASE WHEN s.letter = c.letter AND s.wheel = c.wheel THEN 1 WHEN s.wheel = c.wheel THEN 0.85
    WHEN s.letter = c.letter AND least(abs(s.wheel - c.wheel), 12 - abs(s.wheel - c.wheel)) = 1 THEN 0.8
    WHEN s.letter = c.letter AND least(abs(s.wheel - c.wheel), 12 - abs(s.wheel - c.wheel)) = 2 THEN 0.45 ELSE 0.1 END::DOUBLE AS key,
  {sql6('greatest(0, 1 - abs(c.energy - s.energy - 1) / 4::DOUBLE)')} AS energy, c.sec AS section, {sql6('greatest(0, 1 - s.vocal * c.vocal * 1.6::DOUBLE)')} AS vocals
FROM f JOIN rv s ON s.id = f.from_id JOIN rv c ON c.id = f.to_id"""))
def pair_components(spark, sf):
    r = ranked(spark, sf)
    f = v.feedback(spark, sf).select(F.col("id").alias("pair"), "from_id", "to_id")
    s = r.select(*[F.col(c).alias(f"s_{c}") for c in r.columns])
    c = r.select(*[F.col(x).alias(f"c_{x}") for x in r.columns])
    j = f.join(s, F.col("from_id") == F.col("s_id")).join(c, F.col("to_id") == F.col("c_id"))
    return j.select(F.col("pair").alias("id"), round6(rk.tempo_score(F.col("s_bpm"), F.col("c_bpm"))).alias("tempo"),
                    rk.harmonic_score(F.col("s_wheel"), F.col("s_letter"), F.col("c_wheel"), F.col("c_letter")).alias("key"),
                    round6(rk.energy_score(F.col("s_energy"), F.col("c_energy"))).alias("energy"),
                    F.col("c_section_score").alias("section"),
                    round6(rk.vocal_score(F.col("s_vocal"), F.col("c_vocal"))).alias("vocals"))
