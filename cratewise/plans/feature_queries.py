"""Tempo, beat, structure, key and energy queries."""

import numpy as np
from pyspark.sql import functions as F

from cratewise.functions.frames import mel_matrix
from cratewise.functions.numbers import fold_range, round6
from cratewise.operators import beats as bt, energy as en, key as ky, spectrum as sp, structure as st, tempo as tp
from cratewise.plans import signal_queries as sq, views as v
from cratewise.plans.registry import Book
from cratewise.plans.views import VECTOR_GEOMETRY as GEO, oracle, sql6

BOOK = Book()
query = BOOK.query
RATE = 21.0


# --- tempo ------------------------------------------------------------------------

_AUTO = """auto AS (SELECT a.track_id, l.l AS lag, avg(a.value * b.value) AS auto FROM onsets a, onsets b, range(5, 27) l(l)
  WHERE a.track_id = b.track_id AND b.frame = a.frame + l.l GROUP BY ALL),
gram AS (SELECT a.track_id, a.lag, 60 * 21::DOUBLE / a.lag AS bpm, a.auto,
  (a.auto + 0.5 * coalesce(b.auto, 0) + 0.25 * coalesce(c.auto, 0) + 0.125 * coalesce(d.auto, 0)) * exp(-0.5 * pow(log2(60 * 21::DOUBLE / a.lag / 124) / 0.9, 2)) AS score
  FROM auto a LEFT JOIN auto b ON b.track_id = a.track_id AND b.lag = a.lag * 2 LEFT JOIN auto c ON c.track_id = a.track_id AND c.lag = a.lag * 3
  LEFT JOIN auto d ON d.track_id = a.track_id AND d.lag = a.lag * 4)"""
_TEMPO = f"""{_AUTO}, g AS (SELECT *, lag(score) OVER w AS sp, lead(score) OVER w AS sn, lag(bpm) OVER w AS bp, lead(bpm) OVER w AS bn,
   max(score) OVER (PARTITION BY track_id) AS peak, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) AS pos FROM gram WINDOW w AS (PARTITION BY track_id ORDER BY lag)),
top AS (SELECT track_id, peak, CASE WHEN sp IS NULL OR sn IS NULL OR sp - 2 * score + sn = 0 THEN bpm
   WHEN 0.5 * (sp - sn) / (sp - 2 * score + sn) < 0 THEN bpm + 0.5 * (sp - sn) / (sp - 2 * score + sn) * (bpm - bp)
   ELSE bpm + 0.5 * (sp - sn) / (sp - 2 * score + sn) * (bn - bpm) END AS raw FROM g WHERE pos = 1),
loc AS (SELECT track_id, bpm, score / peak AS s, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) AS r FROM g WHERE pos <> 1 AND score > sp AND score >= sn AND score / peak > 0.2),
pick(track_id, r, acc) AS (SELECT track_id, 0::BIGINT, []::DOUBLE[] FROM top
  UNION ALL SELECT p.track_id, p.r + 1, CASE WHEN len(acc) < 4 AND len(list_filter(acc, lambda a: abs(a - l.bpm) < 1.5)) = 0 THEN list_append(acc, l.bpm) ELSE acc END
  FROM pick p JOIN loc l ON l.track_id = p.track_id AND l.r = p.r + 1),
alts AS (SELECT track_id, arg_max(acc, r) AS acc FROM pick GROUP BY 1),
riv AS (SELECT a.track_id, arg_min(l.s, l.r) AS s FROM alts a JOIN loc l USING (track_id) JOIN top t USING (track_id) WHERE list_contains(acc, l.bpm)
   AND len(list_filter([0.5, 1, 2, 1/3::DOUBLE, 3, 2/3::DOUBLE, 1.5], lambda x: abs(l.bpm - raw * x) < 2)) = 0 GROUP BY 1),
oct AS (SELECT t.track_id, max(CASE WHEN abs(bpm - raw / 2) < 1.5 OR abs(bpm - raw * 2) < 1.5 THEN score / g.peak ELSE 0 END) AS o FROM top t JOIN g USING (track_id) GROUP BY 1),
up AS (SELECT *, raw * pow(2, list_min(list_filter(range(9), lambda n: raw * pow(2, n) >= 78))) AS lifted FROM top),
tempo AS (SELECT track_id, lifted / pow(2, list_min(list_filter(range(9), lambda n: lifted / pow(2, n) <= 165))) AS bpm, raw AS raw_bpm,
   greatest(0, least(1, 1 - coalesce(riv.s, 0))) AS confidence, greatest(0, least(1, 1 - o)) AS octave_confidence, acc
   FROM up JOIN alts USING (track_id) JOIN oct USING (track_id) LEFT JOIN riv USING (track_id))"""


def gram(spark, sf):
    return tp.tempogram(v.onsets(spark, sf), RATE, chunk=64)


def tempo_rows(spark, sf):
    return tp.estimate_tempo(gram(spark, sf))


@query("tempogram", oracle("onsets", f"WITH {_AUTO} SELECT track_id, lag::INTEGER AS lag, {sql6('auto')} AS auto, {sql6('score')} AS score FROM gram"))
def tempogram(spark, sf):
    return gram(spark, sf).select("track_id", "lag", round6(F.col("auto")).alias("auto"), round6(F.col("score")).alias("score"))


@query("tempo", oracle("onsets", f"WITH {_TEMPO} SELECT track_id, {sql6('bpm')} AS bpm, {sql6('raw_bpm')} AS raw_bpm, {sql6('confidence')} AS confidence, {sql6('octave_confidence')} AS octave_confidence, array_to_string(list_transform(acc, lambda a: printf('%.3f', a)), ',') AS alternates FROM tempo", recursive=True))
def tempo(spark, sf):
    return tempo_rows(spark, sf).select("track_id", *[round6(F.col(c)).alias(c) for c in ("bpm", "raw_bpm", "confidence", "octave_confidence")],
                                        F.array_join(F.transform("alternates", lambda a: F.format_string("%.3f", a["bpm"])), ",").alias("alternates"))


@query("fold_tempo", f"""WITH r AS (SELECT event_id, value + 3 AS b FROM events), u AS (SELECT event_id, b * pow(2, list_min(list_filter(range(9), lambda n: b * pow(2, n) >= 78))) AS u FROM r)
SELECT event_id, {sql6('u / pow(2, list_min(list_filter(range(9), lambda n: u / pow(2, n) <= 165)))')} AS bpm FROM u""")
def fold_tempo(spark, sf):
    return v.table(spark, sf, "events").select("event_id", round6(fold_range(F.col("value") + 3, 78.0, 165.0)).alias("bpm"))


# --- beats and grids -----------------------------------------------------------------

# The recurrence as a recursive CTE: a track's scores and steps so far are lists that grow by one frame a turn; then the chain is followed back.
_TRACKED = f"""{_TEMPO}, par AS (SELECT track_id, period, low, greatest(low + 1, floor(period * 2 + 0.5))::BIGINT AS high FROM
  (SELECT track_id, 60 * {RATE}::DOUBLE / raw_bpm AS period, greatest(1, floor(60 * {RATE}::DOUBLE / raw_bpm / 2 + 0.5))::BIGINT AS low FROM tempo WHERE raw_bpm > 0 AND 60 * {RATE}::DOUBLE / raw_bpm >= 1)),
env AS (SELECT track_id, list(value ORDER BY frame) AS x FROM onsets GROUP BY 1),
dp(track_id, t, sc, st) AS (SELECT track_id, 0::BIGINT, []::DOUBLE[], []::BIGINT[] FROM env JOIN par USING (track_id)
  UNION ALL SELECT track_id, t + 1, list_append(sc, x[t + 1] + coalesce(best.v, 0)), list_append(st, coalesce(-best.d, 0)) FROM
   (SELECT dp.track_id, t, sc, st, x, list_max(list_transform(range(low, least(high, t) + 1), lambda d: {{'v': sc[t - d + 1] - 100 * pow(ln(d / period), 2), 'd': -d}})) AS best
    FROM dp JOIN env USING (track_id) JOIN par USING (track_id) WHERE t < len(x))),
fin AS (SELECT track_id, st, list_position(sc, list_max(sc))::BIGINT - 1 AS f FROM dp JOIN env USING (track_id) WHERE t = len(x)),
chain(track_id, f) AS (SELECT track_id, f FROM fin
  UNION ALL SELECT c.track_id, c.f - fin.st[c.f + 1] FROM chain c JOIN fin USING (track_id) WHERE fin.st[c.f + 1] > 0)"""


@query("track_beats", oracle("onsets", f"""WITH {_TRACKED} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS i, {sql6(f'f / {RATE}::DOUBLE')} AS time_sec FROM chain""", recursive=True))
def track_beats(spark, sf):
    b = bt.track_beats(v.onsets(spark, sf), tempo_rows(spark, sf), RATE, chunk=128)
    return b.select("track_id", "i", round6(F.col("time_sec")).alias("time_sec"))


_BEATS_IN = "bts AS (SELECT event_id // 500 AS track_id, event_id % 500 AS i, (event_id % 500) * (0.45 + (event_id // 500) % 5 * 0.01)::DOUBLE + (value % 7::DOUBLE) / 700 * ((event_id // 500) % 3) + CASE WHEN event_id % 500 > 250 THEN (event_id % 500 - 250) * 0.05::DOUBLE * ((event_id // 500) % 2) ELSE 0 END AS t FROM events)"


def beat_rows(spark, sf):
    return v.table(spark, sf, "events").selectExpr(
        "event_id div 500 as track_id", "event_id % 500 as i",
        """(event_id % 500) * cast(0.45 + (event_id div 500) % 5 * 0.01 as double) + (value % 7D) / 700 * ((event_id div 500) % 3)
           + case when event_id % 500 > 250 then (event_id % 500 - 250) * 0.05D * ((event_id div 500) % 2) else 0 end as time_sec""")


def kick_rows(spark, sf):
    return v.onsets(spark, sf)


_PHASE = """c AS (SELECT track_id, i, floor(t * 2::DOUBLE + 0.5)::BIGINT AS f FROM bts),
pk AS (SELECT c.track_id, c.i, max(o.value) AS v FROM c JOIN onsets o ON o.track_id = c.track_id AND o.frame BETWEEN c.f - 1 AND c.f + 1
  WHERE c.f >= 0 AND c.f < 500 GROUP BY ALL),
tt AS (SELECT track_id, i % 4 AS p, sum(v) AS t FROM pk GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, p) AS r FROM tt),
phase AS (SELECT track_id, max(p) FILTER (r = 1)::INTEGER AS phase, greatest(0, 1 - max(t) FILTER (r = 2) / max(t) FILTER (r = 1)) AS confidence FROM rk GROUP BY 1)"""


@query("downbeat_phase", oracle("onsets", f"WITH {_BEATS_IN}, {_PHASE} SELECT track_id, phase, {sql6('confidence')} AS confidence FROM phase"))
def downbeat_phase(spark, sf):
    return bt.downbeat_phase(beat_rows(spark, sf), kick_rows(spark, sf), 2.0).withColumn("confidence", round6(F.col("confidence")))


@query("fit_grid", oracle("onsets", f"""WITH {_BEATS_IN}, {_PHASE}, gp AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY i) - t AS gap FROM bts),
ln AS (SELECT track_id, regr_slope(t, i) AS m, regr_intercept(t, i) AS b, greatest(0, least(1, 1 - stddev_pop(gap) / avg(gap))) AS stability FROM gp GROUP BY 1),
rs AS (SELECT track_id, avg(abs(t - (m * i + b))) AS off FROM bts JOIN ln USING (track_id) GROUP BY 1),
lw AS (SELECT track_id, i // 8 AS w, 60 / avg(gap) AS bpm FROM gp GROUP BY ALL HAVING avg(gap) IS NOT NULL),
walk(track_id, w, cur, n) AS (SELECT track_id, 0::BIGINT, bpm, 1 FROM lw WHERE w = 0
  UNION ALL SELECT k.track_id, l.w, CASE WHEN abs(l.bpm - cur) / cur > 0.02 THEN l.bpm ELSE cur END, n + CASE WHEN abs(l.bpm - cur) / cur > 0.02 THEN 1 ELSE 0 END
  FROM walk k JOIN lw l ON l.track_id = k.track_id AND l.w = k.w + 1),
na AS (SELECT track_id, max(n) AS n FROM walk GROUP BY 1)
SELECT track_id, stability > 0.9 AND off < 0.035 AS is_fixed, CASE WHEN stability > 0.9 AND off < 0.035 THEN 1 ELSE n END::BIGINT AS anchors,
 {sql6('CASE WHEN stability > 0.9 AND off < 0.035 THEN 60 / m ELSE (SELECT bpm FROM lw WHERE lw.track_id = ln.track_id AND w = 0) END')} AS first_bpm,
 {sql6('CASE WHEN stability > 0.9 AND off < 0.035 THEN b ELSE (SELECT t FROM bts x WHERE x.track_id = ln.track_id AND i = 0) END')} AS first_time,
 {sql6('(SELECT t FROM bts x WHERE x.track_id = ln.track_id AND x.i = phase.phase)')} AS downbeat,
 {sql6('greatest(0, least(1, 1 - off / 0.05)) * stability')} AS grid_confidence, {sql6('off')} AS offset_sec, {sql6('stability')} AS stability
FROM ln JOIN rs USING (track_id) JOIN na USING (track_id) JOIN phase USING (track_id)""", recursive=True))
def fit_grid(spark, sf):
    beats = beat_rows(spark, sf)
    down = bt.downbeat_phase(beats, kick_rows(spark, sf), 2.0)
    g = bt.fit_grid(beats, beats.select("track_id").distinct().withColumn("raw_bpm", F.lit(120.0)), down, chunk=64)
    first = F.get(F.col("grid.anchors"), F.lit(0))
    return g.select("track_id", "grid.is_fixed", F.size("grid.anchors").cast("bigint").alias("anchors"), round6(first["bpm"]).alias("first_bpm"),
                    round6(first["time_sec"]).alias("first_time"), round6(F.col("grid.first_downbeat_sec")).alias("downbeat"),
                    round6(F.col("grid.grid_confidence")).alias("grid_confidence"), round6(F.col("offset_sec")).alias("offset_sec"),
                    round6(F.col("stability")).alias("stability"))


@query("derive_beats", oracle("beats", f"SELECT track_id, i, {sql6('t')} AS time_sec FROM beats"))
def derive_beats(spark, sf):
    return bt.derive_beats(v.grids(spark, sf)).withColumn("time_sec", round6(F.col("time_sec")))


_POS = "q AS (SELECT event_id, event_id // 500 AS track_id, (event_id % 500) * 0.991::DOUBLE + 0.003::DOUBLE AS pos, (event_id * 7 % 500) * 0.993::DOUBLE + 0.002::DOUBLE AS opos FROM events)"


def positions(spark, sf):
    q = v.table(spark, sf, "events").selectExpr(
        "event_id", "event_id div 500 as track_id", "(event_id % 500) * 0.991D + 0.003D as position_sec",
        "(event_id * 7 % 500) * 0.993D + 0.002D as o_position_sec")
    return q.join(v.grids(spark, sf), "track_id")


@query("bar_index_at", oracle("beats", f"""WITH {_POS}, d AS (SELECT track_id, min(i) AS i0 FROM beats WHERE t >= first_downbeat_sec - 1e-6 GROUP BY 1),
a AS (SELECT event_id, q.track_id, max(i) AS i FROM q JOIN beats b ON b.track_id = q.track_id AND b.t <= q.pos + 1e-9 GROUP BY ALL)
SELECT q.event_id, CASE WHEN a.i IS NULL OR a.i < i0 THEN -1 ELSE (a.i - i0) // 4 END AS bar FROM q JOIN d USING (track_id) LEFT JOIN a USING (event_id)"""))
def bar_index_at(spark, sf):
    return bt.bar_index_at(positions(spark, sf), "position_sec").select("event_id", "bar")


@query("snap_to_beat", oracle("beats", f"""WITH {_POS} SELECT event_id, {sql6('arg_min(t, {"d": abs(t - pos), "i": i})')} AS nearest_sec, {sql6('any_value(pos) - arg_min(t, {"d": abs(t - pos), "i": i})')} AS shift_sec
FROM q JOIN beats USING (track_id) GROUP BY 1""".replace('"d"', "'d'").replace('"i"', "'i'")))
def snap_to_beat(spark, sf):
    return bt.snap_to_beat(positions(spark, sf), "position_sec").select(
        "event_id", round6(F.col("nearest_sec")).alias("nearest_sec"), round6(F.col("shift_sec")).alias("shift_sec"))


_ALIGN = f"""{_POS}, nt AS (SELECT max(track_id) + 1 AS n FROM anchors), nb AS (SELECT track_id, max(i) AS m FROM beats GROUP BY 1),
p AS (SELECT q.*, (q.track_id + 1) % n AS other FROM q, nt),
oi AS (SELECT event_id, max(i) AS i FROM p JOIN beats b ON b.track_id = p.other AND b.t <= p.opos + 1e-6 GROUP BY 1),
mi AS (SELECT event_id, max(i) AS i FROM p JOIN beats b ON b.track_id = p.track_id AND b.t <= p.pos + 1e-6 GROUP BY 1),
x AS (SELECT p.*, coalesce(oi.i, 0) AS oi, MINE AS mi, onb.m AS om, mnb.m AS mm FROM p LEFT JOIN oi USING (event_id) LEFT JOIN mi USING (event_id)
  JOIN nb onb ON onb.track_id = p.other JOIN nb mnb ON mnb.track_id = p.track_id)
SELECT event_id, {sql6('m0.t + (opos - o0.t) / (o1.t - o0.t) * (m1.t - m0.t)')} AS seek_sec FROM x
JOIN beats o0 ON o0.track_id = other AND o0.i = oi JOIN beats o1 ON o1.track_id = other AND o1.i = least(oi + 1, om)
JOIN beats m0 ON m0.track_id = x.track_id AND m0.i = mi JOIN beats m1 ON m1.track_id = x.track_id AND m1.i = least(mi + 1, mm) WHERE o1.t > o0.t"""


def grid_pairs(spark, sf):
    g = v.grids(spark, sf)
    n = g.count()
    other = g.select(((F.col("track_id") - 1 + n) % n).alias("track_id"), F.col("anchors").alias("o_anchors"), F.col("duration_sec").alias("o_duration_sec"))
    return positions(spark, sf).join(other, "track_id")


for _name, _bar, _mine in (("phase_align", False, "coalesce(mi.i, 0)"),
                           ("phase_align_bar", True, "greatest(0, least(floor(coalesce(mi.i, 0) / 4 + 0.5)::BIGINT * 4, mnb.m - 4))")):
    @query(_name, oracle("beats", "WITH " + _ALIGN.replace("MINE", _mine)))
    def phase_align(spark, sf, bar=_bar):
        return bt.phase_align(grid_pairs(spark, sf), bar).select("event_id", round6(F.col("seek_sec")).alias("seek_sec"))


# --- structure --------------------------------------------------------------------------

def bar_rows(spark, sf):
    return st.bars(v.grids(spark, sf), v.curve(spark, sf))


@query("bars", oracle("bars", f"SELECT track_id, bar, {sql6('start_sec')} AS start_sec, {sql6('end_sec')} AS end_sec, {sql6('energy')} AS energy FROM bars"))
def bars(spark, sf):
    return bar_rows(spark, sf).select("track_id", "bar", *[round6(F.col(c)).alias(c) for c in ("start_sec", "end_sec", "energy")])


_SECT = """sh AS (SELECT track_id, bar, abs(avg(energy) OVER (PARTITION BY track_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
    - avg(energy) OVER (PARTITION BY track_id ORDER BY bar ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS d, max(bar) OVER (PARTITION BY track_id) + 1 AS n FROM bars),
cd AS (SELECT track_id, bar FROM sh WHERE bar >= 4 AND bar + 4 <= n AND d >= 0.25),
bd(track_id, section, bar) AS (SELECT DISTINCT track_id, 0, 0::BIGINT FROM bars
  UNION ALL SELECT b.track_id, b.section + 1, (SELECT min(c.bar) FROM cd c WHERE c.track_id = b.track_id AND c.bar >= b.bar + 8) FROM bd b
    WHERE (SELECT min(c.bar) FROM cd c WHERE c.track_id = b.track_id AND c.bar >= b.bar + 8) IS NOT NULL)"""
_SECTIONS = f"""{_SECT}, rg AS (SELECT b.track_id, section, x.start_sec AS s0, coalesce(lead(x.start_sec) OVER (PARTITION BY b.track_id ORDER BY section), x.duration_sec) AS s1, x.duration_sec AS dur
  FROM bd b JOIN bars x ON x.track_id = b.track_id AND x.bar = b.bar),
me AS (SELECT rg.track_id, section, any_value(s0) AS s0, any_value(s1) AS s1, any_value(dur) AS dur,
   sum(coalesce(energy, 0) * (least(s1, s.s + 1) - greatest(s0, s.s))) / sum(least(s1, s.s + 1) - greatest(s0, s.s)) AS e,
   sum(coalesce(vocal, 0) * (least(s1, s.s + 1) - greatest(s0, s.s))) / sum(least(s1, s.s + 1) - greatest(s0, s.s)) AS vo
   FROM rg JOIN range(500) s(s) ON s.s >= floor(s0) AND s.s < ceil(s1) LEFT JOIN curve c ON c.track_id = rg.track_id AND c.sec = s.s GROUP BY rg.track_id, section),
rel AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY track_id), 1e-9) AS en, count(*) OVER (PARTITION BY track_id) AS n, s0 / dur AS pos FROM me),
dl AS (SELECT *, coalesce(lead(en) OVER (PARTITION BY track_id ORDER BY section), en) - en AS d FROM rel),
sec AS (SELECT *, CASE WHEN n = 1 AND vo > 0.55 THEN 'Vocal' WHEN n = 1 AND vo < 0.25 THEN 'Instrumental' WHEN n = 1 THEN 'Verse'
   WHEN section = 0 AND en < 0.6 THEN 'Intro' WHEN section = n - 1 AND en < 0.7 THEN 'Outro' WHEN d > 0.22 AND en < 0.8 THEN 'Build' WHEN en > 0.78 THEN 'Drop'
   WHEN en < 0.3 THEN CASE WHEN vo > 0.45 THEN 'Breakdown' ELSE 'Sparse' END WHEN en < 0.55 AND d > -0.1 AND pos > 0.3 AND pos < 0.8 THEN 'Breakdown'
   WHEN vo > 0.55 THEN 'Verse' WHEN vo < 0.25 THEN 'Instrumental' WHEN pos > 0.55 THEN 'Bridge' ELSE 'Vocal' END AS label,
  least(1, CASE WHEN n = 1 AND (vo > 0.55 OR vo < 0.25) THEN 0.45 WHEN n = 1 THEN 0.3
   WHEN section = 0 AND en < 0.6 THEN 0.7 + (1 - en) * 0.2 WHEN section = n - 1 AND en < 0.7 THEN 0.65 + (1 - en) * 0.2 WHEN d > 0.22 AND en < 0.8 THEN least(0.85, 0.5 + d)
   WHEN en > 0.78 THEN least(0.9, 0.45 + en * 0.5) WHEN en < 0.3 THEN 0.55 + (0.3 - en) WHEN en < 0.55 AND d > -0.1 AND pos > 0.3 AND pos < 0.8 THEN 0.55
   WHEN vo > 0.55 THEN 0.5 + vo * 0.3 WHEN vo < 0.25 THEN 0.5 + (0.25 - vo) ELSE 0.4 END) AS conf FROM dl)"""


@query("section_boundaries", oracle("bars", f"WITH {_SECT} SELECT track_id, section, bar FROM bd", recursive=True))
def section_boundaries(spark, sf):
    return st.section_boundaries(bar_rows(spark, sf), chunk=32)


@query("sections", oracle("bars", f"WITH {_SECTIONS} SELECT track_id, section, {sql6('s0')} AS start_sec, {sql6('s1')} AS end_sec, {sql6('en')} AS energy, {sql6('vo')} AS vocal, {sql6('d')} AS energy_delta, {sql6('pos')} AS position, label, {sql6('conf')} AS confidence FROM sec", recursive=True))
def sections(spark, sf):
    s = st.sections(bar_rows(spark, sf), v.curve(spark, sf), chunk=32)
    return s.select("track_id", "section", "label", *[round6(F.col(c)).alias(c) for c in (
        "start_sec", "end_sec", "energy", "vocal", "energy_delta", "position", "confidence")])


@query("section_label", oracle("bars", f"WITH {_SECTIONS} SELECT label, count(*) AS n FROM sec GROUP BY 1", recursive=True))
def section_label(spark, sf):
    return st.sections(bar_rows(spark, sf), v.curve(spark, sf), chunk=32).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_PHR = """nb2 AS (SELECT track_id, max(bar) + 1 AS n, any_value(duration_sec) AS dur FROM bars GROUP BY 1),
ed AS (SELECT b.track_id, b.bar, lo.start_sec AS a, b.start_sec AS m, hi.start_sec AS z FROM bars b JOIN nb2 USING (track_id)
  JOIN bars lo ON lo.track_id = b.track_id AND lo.bar = b.bar - 4 JOIN bars hi ON hi.track_id = b.track_id AND hi.bar = least(b.bar + 4, n - 1) WHERE b.bar >= 4 AND b.bar + 4 <= n),
sd AS (SELECT track_id, bar, 0 AS side, a AS s0, m AS s1 FROM ed UNION ALL SELECT track_id, bar, 1, m, z FROM ed),
mn AS (SELECT sd.track_id, bar, side, sum(coalesce(energy, 0) * (least(s1, s.s + 1) - greatest(s0, s.s))) / sum(least(s1, s.s + 1) - greatest(s0, s.s)) AS e
  FROM sd JOIN range(500) s(s) ON s.s >= floor(s0) AND s.s < ceil(s1) LEFT JOIN curve c ON c.track_id = sd.track_id AND c.sec = s.s GROUP BY sd.track_id, bar, side),
de AS (SELECT track_id, bar, abs(sum(CASE WHEN side = 1 THEN e ELSE -e END)) AS d FROM mn GROUP BY ALL),
sc AS (SELECT t.track_id, k.k AS k, n, dur, CASE k.k WHEN 16 THEN 0.12 WHEN 8 THEN 0.08 ELSE 0.04 END AS prior,
   coalesce((SELECT avg(d) FROM de WHERE de.track_id = t.track_id AND bar % k.k = 0), 0) AS onm, coalesce((SELECT avg(d) FROM de WHERE de.track_id = t.track_id AND bar % k.k <> 0), 0) AS offm
  FROM nb2 t, (VALUES (8), (16), (32)) k(k) WHERE n >= k.k),
sv AS (SELECT *, prior + CASE WHEN n >= k + 4 THEN least(0.7, CASE WHEN offm > 1e-6 THEN onm / offm WHEN onm > 0 THEN 1.2 ELSE 0 END * 0.25) ELSE 0 END AS s FROM sc),
be AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, k) = 1)"""


@query("phrases", oracle("bars", f"""WITH {_PHR} SELECT be.track_id, b.bar, {sql6('b.start_sec')} AS start_sec, {sql6('coalesce(e.start_sec, be.dur)')} AS end_sec, be.k::INTEGER AS length_bars, {sql6('greatest(0, least(1, be.s))')} AS confidence
FROM be JOIN bars b ON b.track_id = be.track_id AND b.bar % be.k = 0 LEFT JOIN bars e ON e.track_id = be.track_id AND e.bar = b.bar + be.k"""))
def phrases(spark, sf):
    p = st.phrases(v.grids(spark, sf), v.curve(spark, sf))
    return p.select("track_id", "bar", "length_bars", *[round6(F.col(c)).alias(c) for c in ("start_sec", "end_sec", "confidence")])


# --- key -----------------------------------------------------------------------------

_PROFILE_ROWS = ",".join(f"('{m}','{name}',{i},{float(x)!r}::DOUBLE)" for name, p in ky.PROFILES.items() for m in ("major", "minor") for i, x in enumerate(p[m]))


def _key_sql(chroma, suffix=""):
    return f"""kc{suffix} AS (SELECT c.track_id, t.t AS tonic, p.mode, p.name, corr(c.c, p.w) AS r FROM {chroma} c, range(12) t(t), prof p WHERE p.i = (c.pc - t.t + 12) % 12 GROUP BY ALL),
ka{suffix} AS (SELECT track_id, tonic, mode, avg(r) AS s FROM kc{suffix} GROUP BY ALL),
kr{suffix} AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s DESC, tonic, mode) AS r FROM ka{suffix}),
key{suffix} AS (SELECT a.track_id, a.tonic::INTEGER AS tonic, a.mode, greatest(0, least(1, greatest(0, a.s) * 0.6 + (a.s - b.s) * 2)) AS confidence, a.s - x.s < 0.05 AS relative_ambiguous,
  (SELECT list({{'t': tonic, 'm': mode, 's': s}} ORDER BY r) FROM kr{suffix} z WHERE z.track_id = a.track_id AND r BETWEEN 2 AND 4) AS alts
  FROM kr{suffix} a JOIN kr{suffix} b ON b.track_id = a.track_id AND b.r = 2 JOIN ka{suffix} x ON x.track_id = a.track_id
   AND x.tonic = (a.tonic + CASE WHEN a.mode = 'major' THEN 9 ELSE 3 END) % 12 AND x.mode = CASE WHEN a.mode = 'major' THEN 'minor' ELSE 'major' END WHERE a.r = 1)"""


_KEY = f"{sq._CHROMA}, prof(mode, name, i, w) AS (VALUES {_PROFILE_ROWS}), {_key_sql('chroma')}"
_KEY_COLS = "array_to_string(list_transform(alts, lambda a: a.t || ' ' || a.m), ',') AS alternates"


def alternates_text():
    return F.array_join(F.transform("alternates", lambda a: F.concat_ws(" ", a["tonic"].cast("string"), a["mode"])), ",").alias("alternates")


@query("key_score", oracle("cells", f"WITH {_KEY} SELECT track_id, tonic, mode, {sql6('confidence')} AS confidence, relative_ambiguous, {_KEY_COLS} FROM key"))
def key_score(spark, sf):
    k = ky.key_score(sq.track_chroma(spark, sf))
    return k.select("track_id", "tonic", "mode", round6(F.col("confidence")).alias("confidence"), "relative_ambiguous", alternates_text())


_SUPPORT = f"""{_KEY}, bc0 AS (SELECT track_id, ((floor(69 + 12 * log2(hz / n / (440 * pow(2, cents / 1200))) + 0.5)::BIGINT % 12) + 12) % 12 AS pc, sum(ln(1 + mag) * w::DOUBLE) AS s
  FROM cells JOIN tune USING (track_id), har WHERE bin >= 1 AND hz >= 160 AND hz <= 900 AND hz / n >= 160 GROUP BY ALL),
bch AS (SELECT t.track_id, p.p AS pc, coalesce(s, 0) / sum(coalesce(s, 0)) OVER (PARTITION BY t.track_id) AS c FROM tune t CROSS JOIN range(12) p(p) LEFT JOIN bc0 ON bc0.track_id = t.track_id AND bc0.pc = p.p),
{_key_sql('bch', '2')},
sup AS (SELECT k.track_id, k.tonic, k.mode, k.relative_ambiguous, k.tonic = b.tonic AND k.mode = b.mode AS agreed,
  greatest(0, least(1, CASE WHEN k.tonic = b.tonic AND k.mode = b.mode THEN k.confidence + 0.08 WHEN k.tonic = b.tonic THEN k.confidence + 0.03 ELSE k.confidence * 0.9 END)) AS confidence,
  CASE WHEN (k.tonic = b.tonic AND k.mode = b.mode) OR len(list_filter(k.alts, lambda a: a.t = b.tonic AND a.m = b.mode)) > 0 THEN k.alts
   ELSE (SELECT list(u ORDER BY u.s DESC) FROM (SELECT unnest(list_append(k.alts, {{'t': b.tonic::BIGINT, 'm': b.mode, 's': b.confidence}})) AS u)) END AS alts FROM key k JOIN key2 b USING (track_id))"""


@query("key_support", oracle("cells", f"WITH {_SUPPORT} SELECT track_id, tonic, mode, {sql6('confidence')} AS confidence, relative_ambiguous, agreed, {_KEY_COLS} FROM sup"))
def key_support(spark, sf):
    tuning = sq.tuning(spark, sf)
    bass = ky.key_score(sp.chroma(v.frames(spark, sf), tuning, GEO, 160.0, 900.0))
    k = ky.key_support(ky.key_score(sq.track_chroma(spark, sf)), bass)
    return k.select("track_id", "tonic", "mode", round6(F.col("confidence")).alias("confidence"), "relative_ambiguous", "agreed", alternates_text())


# --- energy ------------------------------------------------------------------------------

_above = np.nonzero(mel_matrix(GEO, sq.BANDS)[1] > 140)[0]
_KICKS = max(1, int(_above[0]) if len(_above) else -1)
_FEAT = f"""{sq._FLUX}, {sq._NORM},
fs AS (SELECT track_id, sum(mag) FILTER (hz < 200) AS lo, sum(mag) FILTER (hz > 4000) AS hi, sum(mag) AS al FROM cells WHERE bin >= 1 GROUP BY 1),
fx AS (SELECT track_id, sum(greatest(mag - p, 0)) / 49 AS f FROM (SELECT *, lag(mag) OVER (PARTITION BY track_id, bin ORDER BY frame) AS p FROM cells WHERE bin >= 1) WHERE p IS NOT NULL GROUP BY 1),
kk AS (SELECT track_id, avg(m) AS k FROM (SELECT track_id, frame, greatest(0, max(v)) AS m FROM bands WHERE band < {_KICKS} GROUP BY ALL) GROUP BY 1),
od AS (SELECT track_id, count(*) FILTER (value > 0.15 AND value >= p AND value > n) / (count(*) / 21::DOUBLE) AS d FROM (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM env WINDOW w AS (PARTITION BY track_id ORDER BY frame)) GROUP BY 1),
feat AS (SELECT track_id, lo / al AS bass_ratio, hi / al AS high_activity, f AS spectral_flux, k AS kick_strength, d AS onset_density FROM fs JOIN fx USING (track_id) JOIN kk USING (track_id) JOIN od USING (track_id))"""
_FCOLS = ("bass_ratio", "high_activity", "spectral_flux", "kick_strength", "onset_density")


def features(spark, sf):
    frames = v.frames(spark, sf)
    env = sp.onset_envelope(frames, GEO, sq.BANDS, sq.CHUNK)
    return en.energy_features(frames, env, GEO, sq.BANDS, sq.CHUNK)


@query("energy_features", oracle("cells", f"WITH {_FEAT} SELECT track_id, {', '.join(f'{sql6(c)} AS {c}' for c in _FCOLS)} FROM feat"))
def energy_features(spark, sf):
    return features(spark, sf).select("track_id", *[round6(F.col(c)).alias(c) for c in _FCOLS])


_ES = """n7 AS (SELECT id, c01((lufs + 30) / 24) AS a, c01(kick / 6) AS b, c01((dens - 0.5) / 7.5) AS c, c01((bass - 0.05e0) / (0.45e0 - 0.05e0)) AS d, c01((high - 0.02e0) / (0.3e0 - 0.02e0)) AS e, c01(flux / 40) AS f, c01(flux / 40) AS g FROM src),
sc7 AS (SELECT *, a * 0.3 + b * 0.22 + c * 0.15 + d * 0.1 + e * 0.1 + f * 0.08 + g * 0.05 AS score, (a + b + c + d + e + f + g) / 7 AS m FROM n7)"""
for _x in ("(lufs + 30) / 24", "kick / 6", "(dens - 0.5) / 7.5", "(bass - 0.05e0) / (0.45e0 - 0.05e0)", "(high - 0.02e0) / (0.3e0 - 0.02e0)", "flux / 40"):
    _ES = _ES.replace(f"c01({_x})", f"greatest(0, least(1, {_x}))")


@query("energy_score", f"""WITH src AS (SELECT event_id AS id, value % 41::DOUBLE - 37 AS lufs, value % 6.7::DOUBLE AS kick, value % 9.1::DOUBLE AS dens, value % 0.53::DOUBLE AS bass,
  value % 0.37::DOUBLE AS high, value % 43::DOUBLE AS flux FROM events), {_ES}
SELECT id, {sql6('score')} AS raw_score, greatest(1, least(10, floor(1 + score * 9 + 0.5)))::INTEGER AS level,
  {sql6('greatest(0, least(1, 1 - 2 * sqrt((pow(a-m,2)+pow(b-m,2)+pow(c-m,2)+pow(d-m,2)+pow(e-m,2)+pow(f-m,2)+pow(g-m,2)) / 7)))')} AS confidence,
  {sql6('greatest(a * 0.3, b * 0.22, c * 0.15, d * 0.1, e * 0.1, f * 0.08, g * 0.05)')} AS top_points FROM sc7""")
def energy_score(spark, sf):
    f = v.table(spark, sf, "events").selectExpr(
        "event_id as id", "value % 41D - 37 as loudness_lufs", "value % 6.7D as kick_strength", "value % 9.1D as onset_density",
        "value % 0.53D as bass_ratio", "value % 0.37D as high_activity", "value % 43D as spectral_flux").withColumn(
        "percussive_ratio", en.normalise(F.col("spectral_flux"), 0.0, 40.0))
    s = en.energy_score(f)
    return s.select("id", round6(F.col("raw_score")).alias("raw_score"), "level", round6(F.col("confidence")).alias("confidence"),
                    round6(F.get("contributions", F.lit(0))["points"]).alias("top_points"))


@query("energy_curve", oracle("onsets", f"""WITH m AS (SELECT track_id, frame // 21 AS sec, avg(value) AS e FROM onsets WHERE frame // 21 < 500 // 21 GROUP BY track_id, frame // 21)
SELECT track_id, sec, {sql6('e / max(e) OVER (PARTITION BY track_id)')} AS energy FROM m"""))
def energy_curve(spark, sf):
    return en.energy_curve(v.onsets(spark, sf), 21.2).withColumn("energy", round6(F.col("energy")))


@query("library_energy_percentile", f"""WITH s AS (SELECT o_orderkey AS id, floor(o_totalprice / 100) AS r FROM orders),
p AS (SELECT id, (rank() OVER (ORDER BY r) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY r)) / count(*) OVER () AS p, count(*) OVER () AS n FROM s)
SELECT id, {sql6('p')} AS percentile, floor(p * 10 + 0.5)::BIGINT AS display_level, n AS sample_size FROM p""")
def library_energy_percentile(spark, sf):
    s = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("raw_score"))
    return en.library_energy_percentile(s).select("id", round6(F.col("percentile")).alias("percentile"), "display_level", "sample_size")
