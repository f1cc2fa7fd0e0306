"""What fits next: pair scores, the exact all-sources top-k, transitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cratewise.functions import keys as ks
from cratewise.functions.numbers import half_up, log2, round6
from cratewise.operators import bounded_top
from cratewise.operators.edits import effective_bpm, effective_grid, effective_key
from cratewise.operators.ordered import with_position
from cratewise.session import cut_lineage

# Component weights, penalties and the tempo tolerance in octaves.
WEIGHTS = {"tempo": 0.34, "key": 0.30, "energy": 0.16, "section": 0.12, "vocals": 0.08}
TEMPO_TOLERANCE = 0.06
ARTIST_PENALTY = 0.12
RECENT_PENALTY = 0.25
SECTION_SCORES = {"Intro": 1.0, "Instrumental": 0.85, "Sparse": 0.85, "Build": 0.6, "Drop": 0.25}

# Target keys worth a look from a given key, as (wheel steps, letter change, score).
KEY_MOVES = [(0, 0, 1.0), (0, 1, 0.85), (1, 0, 0.8), (11, 0, 0.8), (2, 0, 0.45), (10, 0, 0.45)]
OTHER_KEY = 0.1


def tempo_distance(from_bpm: Column, to_bpm: Column) -> Column:
    """Octaves between two tempi, allowing half and double time."""
    return F.least(*[F.abs(log2(to_bpm / (from_bpm * F.lit(r)))) for r in (1.0, 2.0, 0.5)])


def tempo_score(from_bpm: Column, to_bpm: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - tempo_distance(from_bpm, to_bpm) / F.lit(TEMPO_TOLERANCE))


def harmonic_score(n1: Column, l1: Column, n2: Column, l2: Column) -> Column:
    """Camelot numbers 1..12 and letters; the wheel wraps at 12."""
    raw = F.abs(n1 - n2)
    d, same = F.least(raw, F.lit(12) - raw), l1 == l2
    return (F.when(same & (d == 0), 1.0).when(~same & (d == 0), 0.85).when(same & (d == 1), 0.8)
            .when(same & (d == 2), 0.45).otherwise(0.1))


def energy_score(from_level: Column, to_level: Column) -> Column:
    """A lift of one level is ideal; four off that scores nothing."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(to_level - from_level - 1) / F.lit(4.0))


def vocal_score(from_vocal: Column, to_vocal: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - from_vocal * to_vocal * F.lit(1.6))


def section_score(label: Column) -> Column:
    out = F.lit(0.5)
    for name, score in SECTION_SCORES.items():
        out = F.when(label == name, score).otherwise(out)
    return out


def rank_view(tracks: DataFrame, recent_ids: list | None = None) -> DataFrame:
    """The scoring attributes of each track that has a tempo and a key."""
    key = effective_key()
    out = tracks.select(
        "id", "name", F.col("tags.artist").alias("artist"), effective_bpm().alias("bpm"),
        key["tonic"].alias("_t"), key["mode"].alias("_m"),
        F.coalesce(F.col("analysis.energy.level"), F.lit(5)).alias("energy"),
        F.coalesce(F.col("analysis.vocal_coverage"), F.lit(0.4)).alias("vocal"),
        F.get(F.col("analysis.structure.sections"), F.lit(0))["label"].alias("section"),
        F.col("analysis").isNotNull().alias("analysed"))
    out = out.where((F.col("bpm") > 0) & F.col("_t").isNotNull())
    recent = F.col("id").isin(recent_ids) if recent_ids else F.lit(False)
    return out.select("id", "name", "artist", "bpm",
                      ks.camelot_number(F.col("_t"), F.col("_m")).alias("wheel"),
                      F.when(F.col("_m") == "major", "B").otherwise("A").alias("letter"),
                      "energy", "vocal", "section", section_score(F.col("section")).alias("section_score"),
                      recent.alias("recent"), "analysed")


def _scored(pairs: DataFrame, s, c, artist_penalty: float) -> DataFrame:
    """Adds the five component scores, penalties and the 0..100 score of a pair."""
    parts = {"tempo": tempo_score(s("bpm"), c("bpm")),
             "key": harmonic_score(s("wheel"), s("letter"), c("wheel"), c("letter")),
             "energy": energy_score(s("energy"), c("energy")), "section": c("section_score"),
             "vocals": vocal_score(s("vocal"), c("vocal"))}
    pairs = pairs.withColumns({f"{n}_score": e for n, e in parts.items()})
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.col(f"{name}_score") * F.lit(weight)
    same_artist = F.coalesce(s("artist") == c("artist"), F.lit(False))
    # one copy of the sum: penalties as terms, not as branches around it
    total = (total - F.when(same_artist, artist_penalty).otherwise(0.0)
             - F.when(c("recent"), RECENT_PENALTY).otherwise(0.0))
    return pairs.withColumns({
        "same_artist": same_artist, "total": total,
        "score": half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 100)})


def reason_order() -> Column:
    """Component names by weighted points, largest first."""
    rows = F.array(*[F.struct((-round6(F.col(f"{n}_score") * F.lit(w))).alias("p"), F.lit(i).alias("i"), F.lit(n).alias("n"))
                     for i, (n, w) in enumerate(WEIGHTS.items())])
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["n"]), ",")


def warnings() -> Column:
    return F.array_join(F.array_compact(F.array(
        F.when(F.col("tempo_score") < 0.3, "Tempo needs more than a comfortable pitch shift"),
        F.when(F.col("key_score") < 0.3, "Keys clash"),
        F.when(F.col("vocals_score") < 0.4, "Vocals will overlap"),
        F.when(F.col("same_artist"), "Same artist as the current track"),
        F.when(F.col("recent"), "Played recently"))), "; ")


def _by_name(prefix: str = "") -> list[Column]:
    return [F.collate(F.col(f"{prefix}name"), "UNICODE"), F.col(f"{prefix}id")]


def recommend(source: DataFrame, candidates: DataFrame, limit: int = 8,
              artist_penalty: float = ARTIST_PENALTY) -> DataFrame:
    """Top successors of one track: its attributes become constants of a single scan.

    The scan keeps a top-k per task and merges them; nothing is shuffled.
    """
    row = source.first()
    if row is None:
        return candidates.limit(0)
    pairs = candidates.where((F.col("id") != row["id"]) & F.col("analysed"))

    def constant(name):
        kind = source.schema[name].dataType
        return F.lit(row[name]).cast(kind)

    out = _scored(pairs, constant, F.col, artist_penalty)
    d = tempo_distance(constant("bpm"), F.col("bpm"))
    straight = F.abs(log2(F.col("bpm") / constant("bpm"))) == d
    double = F.abs(log2(F.col("bpm") / (constant("bpm") * 2.0))) == d
    start = F.concat(constant("wheel").cast("string"), constant("letter"))
    wheel = F.concat(F.col("wheel").cast("string"), F.col("letter"))
    steps = F.concat(F.lit(" ("), start, F.lit(" to "), wheel, F.lit(")"))
    delta = F.col("energy") - constant("energy")
    overlap = F.col("vocal") * constant("vocal")
    return out.orderBy(F.desc("score"), *_by_name()).limit(limit).select(
        "id", "name", "score", reason_order().alias("reasons"), warnings().alias("warnings"),
        F.concat(F.format_string("%.1f BPM, %.1f%% away", F.col("bpm"), (F.pow(F.lit(2.0), d) - 1) * 100),
                 F.when(straight, "").when(double, " at double time").otherwise(" at half time")).alias("tempo_text"),
        F.when(F.col("key_score") == 1.0, F.concat(F.lit("Same key ("), wheel, F.lit(")")))
        .when(F.col("key_score") == 0.85, F.concat(F.lit("Relative major/minor"), steps))
        .when(F.col("key_score") == 0.8, F.concat(F.lit("One step on the wheel"), steps))
        .when(F.col("key_score") == 0.45, F.concat(F.lit("Two steps on the wheel"), steps))
        .otherwise(F.concat(F.lit("Key contrast"), steps)).alias("key_text"),
        F.concat(F.lit("Energy "), F.col("energy").cast("string"), F.lit("/10 ("),
                 F.when(delta > 0, F.concat(F.lit("up "), delta.cast("string")))
                 .when(delta < 0, F.concat(F.lit("down "), (-delta).cast("string"))).otherwise("level"),
                 F.lit(")")).alias("energy_text"),
        F.when(F.col("section").isNull(), "No structure analysed")
        .when(F.col("section") == "Intro", "Opens with an intro")
        .when(F.col("section").isin("Instrumental", "Sparse"), F.concat(F.lit("Opens "), F.lower("section")))
        .when(F.col("section") == "Build", "Opens on a build")
        .when(F.col("section") == "Drop", "Opens straight into a drop")
        .otherwise(F.concat(F.lit("Opens on "), F.lower("section"))).alias("section_text"),
        F.when(overlap > 0.45, F.concat(F.lit("Both tracks are vocal-heavy ("), half_up(overlap * 100).cast("string"), F.lit("% overlap)")))
        .when(F.col("vocal") < 0.2, "Incoming track is largely instrumental")
        .otherwise("Vocal overlap is manageable").alias("vocal_text"))


_SIGNATURE = ["bpm", "wheel", "letter", "energy", "vocal", "artist"]
_ANCHORS_PER_CELL = 4


def _keys_and_scores() -> Column:
    """Rows (wheel, letter, h) of all 24 target keys of a source key."""
    def rows(steps: int, flip: int, score: float) -> Column:
        other = F.when(F.col("letter") == "A", "B").otherwise("A")
        return F.struct(((F.col("wheel") - 1 + steps) % 12 + 1).alias("to_wheel"),
                        (other if flip else F.col("letter")).alias("to_letter"), F.lit(score).alias("h"))
    listed = {(s, f): h for s, f, h in KEY_MOVES}
    return F.array(*[rows(s, f, listed.get((s, f), OTHER_KEY)) for f in (0, 1) for s in range(12)])


# Cells of more candidates are dense: they are read by bounds, in parts of so many candidates and sources.
CELL_ROWS = 32
DENSE_CANDIDATES = 1 << 18
DENSE_SOURCES = 1 << 14
ASKED_OF = 16  # one source in so many is counted to size these parts


def _dense_pairs(k: int, artist_penalty: float, columns: list[str]):
    """The pairs of one part of a dense cell that can be among the best ``k`` of a source."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: (left if c in left.column_names else right).column(c).slice(0, 0) for c in columns})

        def numbers(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).to_numpy().astype(float)

        artists = pa.concat_arrays([left.column("artist").combine_chunks(), right.column("c_artist").combine_chunks()]).dictionary_encode().indices
        codes = artists.fill_null(-1).to_numpy().astype(np.int64)
        cell = bounded_top.Cell({
            "log": np.log2(numbers(right, "c_bpm")), "energy": numbers(right, "c_energy"), "vocal": numbers(right, "c_vocal"),
            "section": numbers(right, "c_section_score"), "recent": numbers(right, "c_recent"), "artist": codes[len(left):],
            "name": right.column("c_name_pos").to_numpy().astype(np.int64)})
        asked = {"log": numbers(left, "_log"), "energy": numbers(left, "energy"), "vocal": numbers(left, "vocal"), "artist": codes[:len(left)],
                 "h": numbers(left, "h"), "floor": numbers(left, "floor")}
        rows, cols, _ = bounded_top.best_pairs(asked, cell, k, WEIGHTS, TEMPO_TOLERANCE, artist_penalty, RECENT_PENALTY)
        left, right = left.take(pa.array(rows)), right.take(pa.array(cols))
        return pa.table({c: (left if c in left.column_names else right).column(c) for c in columns})
    return work


def recommend_all(tracks: DataFrame, k: int = 8, artist_penalty: float = ARTIST_PENALTY) -> DataFrame:
    """The exact top ``k`` successors of every track, without scoring all pairs.

    ``tracks`` is a ``rank_view``. Four steps:

    1. *Signatures.* Tracks equal in every scored attribute score alike, so a
       group of copies is cut to its first ``k + 1`` names, and sources are
       ranked once per signature.
    2. *Floor.* Up to four good candidates of each (key, energy, tempo) cell and
       of each (key, energy) are broadcast and scored; the (k+1)-th best is a
       valid floor for the real one. They are taken from tempi of 20 to 400 BPM,
       which fall into 140 cells, and energies 1 to 10, so this is at most
       24 * 10 * 141 * 4 rows however large the library.
    3. *Probe.* From the floor follows, per target key, how far in tempo a
       candidate may be and still reach the floor. A source emits just those
       cells and equi-joins them; where even a tempo score of zero would do, it
       joins on the key alone. No candidate that could rank is skipped. In
       cells and keys of more than ``CELL_ROWS`` candidates, by their measured
       sizes, pairs are not joined: ``bounded_top`` reads candidates in the
       order of their bounds, in parts spread over many tasks.
    4. The pairs are scored and cut to ``k + 1`` per source signature (the row
       limit is applied before the shuffle), then a track is taken out of its
       own list.

    A source scores at most ``CELL_ROWS`` candidates of a cell, and in a dense
    cell those that its own bounds leave, so that its work does not follow the
    size of the library.
    """
    # Name order as a number: one distributed sort instead of collated string
    # comparisons in every later step.
    named = with_position(tracks, _by_name(), "name_pos")
    named = named.withColumn("_log", log2(F.col("bpm")))
    # A source row grows into many pairs, so rows are spread evenly by count;
    # sizes measured before the growth would put them into too few tasks.
    tasks = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = cut_lineage(named.groupBy(*_SIGNATURE, "_log").agg(F.count(F.lit(1)).alias("_n"))
                          .repartition(tasks).withColumn("sid", F.monotonically_increasing_id()).drop("_n"))
    c_cols = ["name_pos", "id", "artist", "bpm", "wheel", "letter", "energy", "vocal", "section_score", "recent"]
    same = Window.partitionBy(*_SIGNATURE, "section_score", "recent").orderBy("name_pos")
    pool = cut_lineage(named.where("analysed").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1)
                       .select("_log", *c_cols))
    width = 64

    def cell(col: str, per_octave: int) -> Column:
        return F.floor(F.col(col) * per_octave)

    # 2. floor
    good = ["recent", F.desc("section_score"), "vocal", "id"]
    a_cols = [F.col(c).alias(f"c_{c}") for c in c_cols]

    def anchors(per: list[str], rows: int) -> DataFrame:
        w = Window.partitionBy(*per).orderBy(*good)
        bounded = pool.where("bpm between 20 and 400 and energy between 1 and 10")
        return (bounded.withColumn("_cell", cell("_log", 32)).withColumn("_r", F.row_number().over(w))
                .where(F.col("_r") <= rows).select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(per)], *a_cols))

    def floor_from(probes: DataFrame, to: list[str], table: DataFrame) -> DataFrame:
        on = F.lit(True)
        for i, c in enumerate(to):
            on = on & (F.col(c) == F.col(f"_a{i}"))
        pairs = probes.repartition(tasks, "sid").join(F.broadcast(table), on)
        scored = _scored(pairs, F.col, lambda c: F.col(f"c_{c}"), artist_penalty).select("sid", "total")
        w = Window.partitionBy("sid").orderBy(F.desc("total"))
        # Whatever rounds to fewer points than this one cannot rank; steps 3 and 4 take off 0.01 again.
        points = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") - 1e-9)) * 100)
        return (scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k + 1)
                .select("sid", F.when(points > 0, (points + 0.5) / 100).otherwise(-1.0).alias("floor")))

    near = (sources.select("*", F.inline(F.filter(_keys_and_scores(), lambda x: x["h"] > 0.5)))
            .withColumn("to_energy", F.explode(F.sequence(F.col("energy") - 1, F.col("energy") + 2))))
    around = near.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell("_log", 32) + d)))
    keyed_on = ["to_wheel", "to_letter", "to_energy"]
    in_band = floor_from(around, [*keyed_on, "_cell"], anchors(["wheel", "letter", "energy", "_cell"], _ANCHORS_PER_CELL))
    # for sources with few tracks near their tempo
    any_tempo = floor_from(near, keyed_on, anchors(["wheel", "letter", "energy"], _ANCHORS_PER_CELL))
    sources = cut_lineage(
        sources.join(in_band, "sid", "left").join(any_tempo.withColumnRenamed("floor", "_wide"), "sid", "left")
        .withColumn("floor", F.greatest(F.coalesce("floor", F.lit(-1.0)), F.coalesce("_wide", F.lit(-1.0))))
        .drop("_wide").repartition(tasks, "sid"))

    # 3. probe; a result may round up by half a point, hence the 0.01
    probes = sources.select("*", F.inline(_keys_and_scores()))
    reach = F.col("h") * WEIGHTS["key"] + WEIGHTS["vocals"] + WEIGHTS["energy"] + WEIGHTS["section"]
    to_cols = ["to_wheel", "to_letter"]
    probes = probes.withColumn("_need", (F.col("floor") - 0.01 - 1e-9 - reach) / WEIGHTS["tempo"])
    span = (F.lit(1.0) - F.col("_need")) * TEMPO_TOLERANCE + 1e-9

    def cells_around(shift: int) -> Column:
        mid = F.col("_log") + shift
        return F.sequence(F.floor((mid - span) * width), F.floor((mid + span) * width))

    s_all = ["sid", "floor", "h", "_log", *_SIGNATURE]
    tight = (probes.where((F.col("_need") > 0) & (F.col("_need") <= 1))
             .select(*s_all, *to_cols, F.explode(F.concat(*[cells_around(r) for r in (-1, 0, 1)])).alias("_cell")))
    loose = probes.where(F.col("_need") <= 0).select(*s_all, *to_cols)
    targets = pool.select(F.col("wheel").alias("to_wheel"), F.col("letter").alias("to_letter"), cell("_log", width).alias("_cell"),
                          *[F.col(c).alias(f"c_{c}") for c in c_cols])

    def met(probing: DataFrame, keys: list[str]) -> DataFrame:
        """Candidate pairs on equal ``keys``: all pairs where few targets hold a key, the best by bounds elsewhere."""
        dense = cut_lineage(targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > CELL_ROWS))
        # The join multiplies rows, so its partition count is fixed by the work.
        columns = ["sid", "floor", *_SIGNATURE, *[f"c_{c}" for c in c_cols]]
        if dense.isEmpty():
            return probing.repartition(tasks, *keys).join(targets, keys).select(*columns)
        few = dense.limit(100_001).count() <= 100_000
        held = F.broadcast(dense) if few else dense
        sparse = (probing.join(held, keys, "left_anti").repartition(tasks, *keys)
                  .join(targets.join(held, keys, "left_anti"), keys).select(*columns))
        # An estimate, since it decides only how many tasks share the sources of a cell.
        counted = probing.where(F.pmod(F.xxhash64("sid"), F.lit(ASKED_OF)) == 0)
        asked = counted.join(held, keys).groupBy(*keys).agg((F.count(F.lit(1)) * ASKED_OF).alias("_ask"))
        blocks = cut_lineage(dense.join(asked, keys, "left").select(
            *keys, F.ceil(F.col("_held") / DENSE_CANDIDATES).cast("int").alias("_parts"),
            F.ceil(F.coalesce("_ask", F.lit(1)) / DENSE_SOURCES).cast("int").alias("_blocks")))
        blocks = F.broadcast(blocks) if few else blocks
        asking = (probing.join(blocks, keys).withColumn("_block", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("_blocks")).cast("int"))
                  .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
        offered = (targets.join(blocks, keys).withColumn("_part", F.pmod(F.xxhash64("c_id"), F.col("_parts")).cast("int"))
                   .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
        by = [*keys, "_part", "_block"]
        return sparse.unionByName(asking.select(*by, "sid", "floor", "h", "_log", *_SIGNATURE).groupBy(*by).cogroup(
            offered.select(*by, *[f"c_{c}" for c in c_cols]).groupBy(*by)).applyInArrow(
                _dense_pairs(k + 1, artist_penalty, columns), ", ".join(
                    f"{c} {(sources if c in sources.columns else targets).schema[c].dataType.simpleString()}" for c in columns)))

    near_pairs = met(tight, [*to_cols, "_cell"])
    far_pairs = met(loose, to_cols)
    pairs = near_pairs.unionByName(far_pairs)

    # 4. score, drop what is under the floor, cut
    scored = _scored(pairs, F.col, lambda c: F.col(f"c_{c}"), artist_penalty)
    scored = scored.where(F.col("total") > F.col("floor") - 0.01 - 1e-9)
    top = Window.partitionBy("sid").orderBy(F.desc("score"), "c_name_pos")
    lists = (scored.select("sid", "score", "c_name_pos", F.col("c_id").alias("to_id"), F.col("c_recent").alias("recent"),
                           "same_artist", *[f"{n}_score" for n in WEIGHTS])
             .withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
             .select("sid", "_r", "to_id", "score", reason_order().alias("reasons"), warnings().alias("warnings")))
    match = F.lit(True)
    for c in _SIGNATURE:
        match = match & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    keyed = named.alias("t").join(sources.alias("s"), match).select(F.col("t.id").alias("from_id"), "sid")
    own = Window.partitionBy("from_id").orderBy("_r")
    ranked = (keyed.join(lists, "sid").where(F.col("from_id") != F.col("to_id"))
              .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k))
    names = named.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return ranked.join(names, "to_id").select("from_id", "rank", "to_id", "to_name", "score", "reasons", "warnings")


def transition_window(pairs: DataFrame, bars: int = 16, crossfade_sec: float | None = None) -> DataFrame:
    """Start points and crossfade length for (from, to) pairs.

    ``pairs``: from_bpm, to_bpm, from_duration, to_duration, beats_per_bar.
    """
    def seconds(bpm: Column, n: int, beats: Column) -> Column:
        return F.lit(60.0) / bpm * beats * n
    beats = F.coalesce("beats_per_bar", F.lit(4))
    usable = (F.col("from_bpm") > 0) & (F.col("to_bpm") > 0) & (F.col("from_duration") > 0) & (F.col("to_duration") > 0)
    window = seconds(F.col("from_bpm"), bars, beats)
    incoming = seconds(F.col("to_bpm"), min(bars, 8), beats)
    fade = F.least(F.lit(8.0), window / 2, incoming, F.col("from_duration") / 4, F.col("to_duration") / 4)
    if crossfade_sec is not None:
        fade = F.lit(float(crossfade_sec))
    return (pairs.where(usable).withColumn("crossfade_sec", F.greatest(F.lit(1.0), fade))
            .withColumn("from_start_sec", F.greatest(F.lit(0.0), F.col("from_duration")
                                                     - F.greatest(F.col("crossfade_sec") * 2, window / 2)))
            .withColumn("to_start_sec", F.lit(0.0)))


def audition_sides(tracks: DataFrame, prefix: str) -> DataFrame:
    return tracks.select(F.col("id").alias(f"{prefix}_id"), effective_bpm().alias(f"{prefix}_bpm"),
                         F.col("duration_sec").alias(f"{prefix}_duration"),
                         effective_grid()["beats_per_bar"].alias(f"{prefix}_beats"))


def sync_ratio(from_bpm: Column, to_bpm: Column) -> Column:
    """to/from, halved while above 1.42 and then doubled while below 0.71, however far it lies outside."""
    ratio = to_bpm / from_bpm

    def steps(excess: Column) -> Column:
        """Least whole number of octaves that covers the excess; on the edge itself none more."""
        return F.greatest(F.lit(0.0), F.ceil(log2(excess) - 1e-12).cast("double"))

    halved = ratio / F.pow(F.lit(2.0), steps(ratio / 1.42))
    folded = halved * F.pow(F.lit(2.0), steps(F.lit(0.71) / halved))
    return F.when((from_bpm > 0) & (to_bpm > 0), folded).otherwise(1.0)
