"""Duplicate detection and merge queries."""

from pyspark.sql import functions as F

from cratewise.functions.numbers import round6
from cratewise.operators import duplicates as du
from cratewise.plans import views as v
from cratewise.plans.registry import Book
from cratewise.plans.views import VECTOR_GEOMETRY, oracle, sql6

BOOK = Book()
query = BOOK.query

# The vectors are unrelated, yet agree on about 0.7 of the bits; this threshold
# cuts through the middle of their similarities, so that groups exist.
NOISE_THRESHOLD = 0.7

_EXACT = """ex AS (SELECT content_hash FROM files_dup GROUP BY 1 HAVING count(*) >= 2),
e AS (SELECT 'exact-file' AS level, content_hash AS group_key, id, 1::DOUBLE AS confidence FROM files_dup WHERE content_hash IN (SELECT content_hash FROM ex)),
u AS (SELECT * FROM files_dup WHERE content_hash NOT IN (SELECT content_hash FROM ex)),
sa AS (SELECT audio_hash FROM u GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT 'same-audio' AS level, audio_hash AS group_key, id, 1::DOUBLE AS confidence FROM u WHERE audio_hash IN (SELECT audio_hash FROM sa))"""
_CUES = """cues AS (SELECT id, k.k * 10 + (id % 5) * 0.03::DOUBLE AS t FROM files_dup, range(1, 3) k(k) WHERE k.k <= cue_count)"""
_FACTS = """facts AS (SELECT *, (manual_bpm IS NOT NULL)::INTEGER + (manual_grid IS NOT NULL)::INTEGER + (manual_key_tonic IS NOT NULL)::INTEGER + (cue_count > 0)::INTEGER AS manual_edits FROM files_dup)"""
_RANKS = f"""{_FACTS}, g AS (SELECT * FROM e UNION ALL SELECT * FROM s),
ranks AS (SELECT g.level, group_key, g.id, manual_edits, size_bytes, row_number() OVER (PARTITION BY g.level, group_key ORDER BY manual_edits DESC, lossless DESC,
  coalesce(bitrate_kbps, 0) DESC, sample_rate DESC, size_bytes DESC, g.id) - 1 AS rank FROM g JOIN facts USING (id))"""


def files(spark, sf):
    cues = F.expr("""transform(filter(sequence(1, 2), k -> k <= cue_count), k -> named_struct('id', cast(k as string), 'name', 'Cue',
                     'time_sec', k * 10 + (id % 5) * 0.03D))""")
    f = v.files_dup(spark, sf).withColumn("cues", cues)
    return f.withColumn("manual_edits", du.manual_edit_count())


def hash_groups(spark, sf):
    f = files(spark, sf)
    return du.dup_exact_file(f).unionByName(du.dup_same_audio(f))


@query("dup_exact_file", oracle("files_dup", f"WITH {_EXACT} SELECT * FROM e"))
def dup_exact_file(spark, sf):
    return du.dup_exact_file(files(spark, sf))


@query("dup_same_audio", oracle("files_dup", f"WITH {_EXACT} SELECT * FROM s"))
def dup_same_audio(spark, sf):
    return du.dup_same_audio(files(spark, sf))


@query("manual_edit_count", oracle("files_dup", f"WITH {_FACTS} SELECT id, manual_edits FROM facts"))
def manual_edit_count(spark, sf):
    return files(spark, sf).select("id", "manual_edits")


@query("rank_copies", oracle("files_dup", f"WITH {_EXACT}, {_RANKS} SELECT * FROM ranks"))
def rank_copies(spark, sf):
    return du.rank_copies(hash_groups(spark, sf), files(spark, sf))


@query("copy_keepers", oracle("files_dup", f"WITH {_EXACT}, {_RANKS} SELECT level, group_key, id AS keeper_id FROM ranks WHERE rank = 0"))
def copy_keepers(spark, sf):
    return du.keepers(hash_groups(spark, sf), files(spark, sf))


def merge_pairs(spark, sf):
    ranked = du.rank_copies(hash_groups(spark, sf), files(spark, sf))
    keep = ranked.where("rank = 0").select("level", "group_key", F.col("id").alias("keeper_id"))
    give = ranked.where("rank > 0").select("level", "group_key", F.col("id").alias("donor_id"), "rank")
    return keep.join(give, ["level", "group_key"]).select("keeper_id", "donor_id", "rank")


# The fold over a keeper's offers is a recursive CTE; offers are the distinct cue times of its donors, in rank order.
_MERGE = f"""{_CUES}, pr AS (SELECT a.id AS keeper_id, b.id AS donor_id, b.rank FROM ranks a JOIN ranks b ON a.level = b.level AND a.group_key = b.group_key AND a.rank = 0 AND b.rank > 0),
offer AS (SELECT keeper_id, t, row_number() OVER (PARTITION BY keeper_id ORDER BY rank, t) AS o FROM
  (SELECT keeper_id, c.t, min(rank) AS rank FROM pr JOIN cues c ON c.id = donor_id GROUP BY ALL)),
own AS (SELECT k.keeper_id, coalesce(list(c.t ORDER BY c.t) FILTER (c.t IS NOT NULL), []) AS l FROM (SELECT DISTINCT keeper_id FROM pr) k LEFT JOIN cues c ON c.id = k.keeper_id GROUP BY 1),
fold AS (SELECT keeper_id, l, 0 AS o FROM own UNION ALL
  SELECT f.keeper_id, CASE WHEN len([x FOR x IN f.l IF abs(x - offer.t) <= 0.05]) > 0 THEN f.l ELSE list_append(f.l, offer.t) END, offer.o
  FROM fold f JOIN offer ON offer.keeper_id = f.keeper_id AND offer.o = f.o + 1),
folded AS (SELECT keeper_id, max_by(l, o) AS l FROM fold GROUP BY 1),
gv AS (SELECT keeper_id, count(*) AS donors, min_by(d.manual_bpm, rank) FILTER (d.manual_bpm IS NOT NULL) AS bpm, min_by(d.manual_grid, rank) FILTER (d.manual_grid IS NOT NULL) AS grid,
  min_by(d.manual_key_tonic, rank) FILTER (d.manual_key_tonic IS NOT NULL) AS tonic, min_by(d.manual_key_mode, rank) FILTER (d.manual_key_tonic IS NOT NULL) AS mode,
  min_by(d.reviewed_at, rank) FILTER (d.reviewed_at IS NOT NULL) AS reviewed FROM pr JOIN files_dup d ON d.id = donor_id GROUP BY 1),
plans AS (SELECT gv.keeper_id, donors, concat_ws(',', CASE WHEN k.manual_bpm IS NULL AND bpm IS NOT NULL THEN 'manual BPM' END,
    CASE WHEN k.manual_key_tonic IS NULL AND tonic IS NOT NULL THEN 'manual key' END,
    CASE WHEN k.manual_grid IS NULL AND grid IS NOT NULL THEN 'manual grid' END,
    CASE WHEN k.reviewed_at IS NULL AND reviewed IS NOT NULL THEN 'reviewed mark' END) AS fields,
  coalesce(k.manual_bpm, bpm) AS manual_bpm, coalesce(k.manual_grid, grid) AS manual_grid, coalesce(k.manual_key_tonic, tonic) AS manual_key_tonic,
  CASE WHEN k.manual_key_tonic IS NULL AND tonic IS NOT NULL THEN mode ELSE k.manual_key_mode END AS manual_key_mode,
  coalesce(k.reviewed_at, reviewed) AS reviewed_at, (len(folded.l) - len(own.l))::BIGINT AS added,
  nullif(array_to_string([printf('%.2f', x) FOR x IN list_sort(folded.l)], ','), '') AS cues
  FROM gv JOIN files_dup k ON k.id = gv.keeper_id JOIN folded ON folded.keeper_id = gv.keeper_id JOIN own ON own.keeper_id = gv.keeper_id)"""


def cue_text():
    return F.nullif(F.array_join(F.transform("cues", lambda c: F.format_string("%.2f", c["time_sec"])), ","), F.lit(""))


@query("plan_merge", oracle("files_dup", f"WITH {_EXACT}, {_RANKS}, {_MERGE} SELECT * FROM plans", True))
def plan_merge(spark, sf):
    p = du.plan_merge(merge_pairs(spark, sf), files(spark, sf))
    return p.withColumns({"fields": F.array_join("fields", ","), "added": F.size("added_cues").cast("bigint"),
                          "cues": cue_text()}).drop("added_cues")


@query("apply_merge", oracle("files_dup", f"""WITH {_EXACT}, {_RANKS}, {_MERGE}
SELECT f.id, coalesce(p.manual_bpm, f.manual_bpm) AS manual_bpm, coalesce(p.manual_grid, f.manual_grid) AS manual_grid, coalesce(p.reviewed_at, f.reviewed_at) AS reviewed_at,
  CASE WHEN p.keeper_id IS NOT NULL THEN p.cues ELSE (SELECT string_agg(printf('%.2f', t), ',' ORDER BY t) FROM cues c WHERE c.id = f.id) END AS cues
FROM files_dup f LEFT JOIN plans p ON p.keeper_id = f.id WHERE f.id NOT IN (SELECT donor_id FROM pr)""", True))
def apply_merge(spark, sf):
    f = files(spark, sf)
    pairs = merge_pairs(spark, sf)
    out = du.apply_merge(f, du.plan_merge(pairs, f), pairs)
    return out.select("id", "manual_bpm", "manual_grid", "reviewed_at", cue_text().alias("cues"))


@query("cluster_confidence", oracle("files_dup", f"WITH {_EXACT} SELECT level, group_key, count(*) AS members, min(confidence) AS confidence FROM (SELECT * FROM e UNION ALL SELECT * FROM s) GROUP BY ALL"))
def cluster_confidence(spark, sf):
    return du.cluster_confidence(hash_groups(spark, sf))


# --- fingerprints over the vector frames ------------------------------------

_WORDS = """pcs AS (SELECT track_id, frame, ((floor(69 + 12 * log2(hz / 440) + 0.5)::BIGINT % 12) + 12) % 12 AS pc, sum(mag) AS m
  FROM cells WHERE bin >= 1 AND hz >= 80 AND hz <= 4000 GROUP BY ALL),
full_pc AS (SELECT f.track_id, f.frame, p.p AS pc, coalesce(m, 0) / (SELECT sum(m) FROM pcs q WHERE q.track_id = f.track_id AND q.frame = f.frame) AS c
  FROM (SELECT DISTINCT track_id, frame FROM frames) f CROSS JOIN range(12) p(p) LEFT JOIN pcs x ON x.track_id = f.track_id AND x.frame = f.frame AND x.pc = p.p),
lagged AS (SELECT *, lag(c) OVER (PARTITION BY track_id, pc ORDER BY frame) AS prev,
  coalesce(lead(c) OVER (PARTITION BY track_id, frame ORDER BY pc), first_value(c) OVER (PARTITION BY track_id, frame ORDER BY pc)) AS nxt FROM full_pc),
words AS (SELECT track_id, frame - 1 AS pos, (sum(CASE WHEN c > prev THEN 1 << (2 * pc)::INTEGER ELSE 0 END) + sum(CASE WHEN c > nxt THEN 1 << (2 * pc + 1)::INTEGER ELSE 0 END))::INTEGER AS word
  FROM lagged WHERE prev IS NOT NULL GROUP BY ALL)"""
_SCORES = """lens AS (SELECT track_id, count(*) AS n FROM words GROUP BY 1),
agree AS (SELECT a.track_id AS i, b.track_id AS j, o.o AS o, count(*) AS ov, sum(bit_count(xor(a.word, b.word))) AS d
  FROM words a, words b, range(-200, 201, 2) o(o) WHERE a.track_id < b.track_id AND b.pos = a.pos - o.o GROUP BY ALL),
edges AS (SELECT i, j, max(CASE WHEN ov >= 40 THEN 1 - d / (ov * 24)::DOUBLE ELSE 0 END) AS score FROM agree GROUP BY ALL)"""
_GROUPS = f"""strong AS (SELECT * FROM edges WHERE score >= {NOISE_THRESHOLD}),
ids AS (SELECT track_id AS id, row_number() OVER (ORDER BY track_id) AS n FROM lens),
walk(n, claimed, seeds) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT w.n + 1,
    CASE WHEN list_contains(w.claimed, ids.id) THEN w.claimed ELSE list_concat(w.claimed, coalesce((SELECT list(j) FROM strong s WHERE s.i = ids.id AND NOT list_contains(w.claimed, j)), [])) END,
    CASE WHEN list_contains(w.claimed, ids.id) THEN w.seeds ELSE list_append(w.seeds, ids.id) END
  FROM walk w JOIN ids ON ids.n = w.n + 1),
seeds AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM walk ORDER BY n DESC LIMIT 1)),
members AS (SELECT j AS member, min(i) AS seed, arg_min(score, i) AS score FROM strong WHERE i IN (SELECT seed FROM seeds) AND j NOT IN (SELECT seed FROM seeds) GROUP BY 1)"""


def words(spark, sf):
    return du.fingerprint(v.frames(spark, sf), VECTOR_GEOMETRY, chunk=16)


def prints(spark, sf):
    return du.pack_fingerprints(words(spark, sf)).withColumnRenamed("track_id", "id")


@query("fingerprint", oracle("cells", f"WITH {_WORDS} SELECT * FROM words"))
def fingerprint(spark, sf):
    return words(spark, sf)


@query("dup_candidates", oracle("cells", f"WITH {_WORDS}, {_SCORES} SELECT i, j, {sql6('score')} AS score FROM edges WHERE score >= {NOISE_THRESHOLD}"))
def dup_candidates(spark, sf):
    e = du.similar_edges(prints(spark, sf), NOISE_THRESHOLD)
    return e.select("i", "j", round6(F.col("score")).alias("score"))


@query("fingerprint_similarity", oracle("cells", f"WITH {_WORDS}, {_SCORES} SELECT i, j, {sql6('score')} AS score FROM edges WHERE j = i + 1"))
def fingerprint_similarity(spark, sf):
    p = prints(spark, sf)
    a = p.select(F.col("id").alias("i"), F.col("words").alias("a_words"))
    b = p.select(F.col("id").alias("j"), F.col("words").alias("b_words"))
    return (du.fingerprint_similarity(a.join(b, F.col("j") == F.col("i") + 1))
            .select("i", "j", round6(F.col("score")).alias("score")))


@query("dup_similar_groups", oracle("cells", f"""WITH {_WORDS}, {_SCORES}, {_GROUPS}
SELECT 'similar-audio' AS level, seed AS group_key, member AS id, {sql6('score')} AS confidence FROM members
UNION ALL SELECT 'similar-audio', seed, seed, 1::DOUBLE FROM (SELECT DISTINCT seed FROM members)""", recursive=True))
def dup_similar_groups(spark, sf):
    g = du.dup_similar_groups(prints(spark, sf), NOISE_THRESHOLD)
    return g.withColumn("confidence", round6(F.col("confidence")))


_REST = "SELECT id FROM u WHERE audio_hash NOT IN (SELECT audio_hash FROM sa)"
_LEFT_GROUPS = (_GROUPS.replace(f"WHERE score >= {NOISE_THRESHOLD}", f"WHERE score >= {NOISE_THRESHOLD} AND i IN ({_REST}) AND j IN ({_REST})")
                .replace("FROM lens)", f"FROM lens WHERE track_id IN ({_REST}))"))


@query("find_duplicate_groups", oracle("files_dup cells", f"""WITH {_EXACT}, {_WORDS}, {_SCORES}, {_LEFT_GROUPS}
SELECT * FROM e UNION ALL SELECT * FROM s
UNION ALL SELECT 'similar-audio', seed::VARCHAR, member, {sql6('score')} FROM members
UNION ALL SELECT 'similar-audio', seed::VARCHAR, seed, 1::DOUBLE FROM (SELECT DISTINCT seed FROM members)""", recursive=True))
def find_duplicate_groups(spark, sf):
    """All three levels at once: exact files, same audio, and similar fingerprints of files that neither level has."""
    g = du.find_duplicate_groups(files(spark, sf), prints(spark, sf), NOISE_THRESHOLD)
    return g.withColumn("confidence", round6(F.col("confidence")))
