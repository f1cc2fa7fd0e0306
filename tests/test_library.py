"""Groups, ranking, ordered helpers and streams against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.operators import duplicates as du, ranking as rk
from cratewise.operators.ordered import with_neighbour, with_position
from cratewise.plans import duplicate_queries as dq, views as v
from cratewise.sources.folders import scan_folder, scratch_folder
from cratewise.streaming import jobs as jb, projection as pj, replay as rp

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_greedy_groups_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    edges = [(i, j, rng.random()) for i, j in itertools.combinations(range(25), 2) if rng.random() < 0.12]
    claimed, want = set(), set()
    for i in range(25):
        if i in claimed:
            continue
        for a, b, s in edges:
            if a == i and b not in claimed:
                claimed.add(b)
                want.add((i, b, s))
    got = du.greedy_groups(spark.createDataFrame(edges, "i bigint, j bigint, score double"))
    assert {tuple(r) for r in got.select("seed", "member", "score").collect()} == want


def best_agreement(a, b, max_offset):
    """The best share of equal bits, offset by offset."""
    best = 0.0
    for offset in range(-max_offset, max_offset + 1, 2):
        lo, hi = max(0, offset), min(len(a), len(b) + offset)
        if hi - lo >= du.MIN_OVERLAP:
            differing = int(np.bitwise_count(a[lo:hi] ^ b[lo - offset:hi - offset]).sum())
            best = max(best, 1 - differing / ((hi - lo) * du.BITS_PER_WORD))
    return best


def test_similar_edges_equal_pairwise_comparison(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 24, 150, dtype=np.uint32)
    prints = {0: base, 1: base[10:], 2: base ^ (rng.random(150) < 0.3).astype(np.uint32) * 0x0F0F0F,
              3: rng.integers(0, 1 << 24, 120, dtype=np.uint32), 4: base[:39], 5: np.concatenate([np.zeros(20, np.uint32), base])}
    df = spark.createDataFrame([(k, w.astype(int).tolist()) for k, w in prints.items()], "id bigint, words array<int>")
    want = {(a, b): best_agreement(prints[a], prints[b], 200) for a, b in itertools.combinations(prints, 2)}
    want = {k: s for k, s in want.items() if s >= 0.6}
    for block in (2, 48):
        got = {(r["i"], r["j"]): r["score"] for r in du.similar_edges(df, 0.6, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_copies_of_one_fingerprint_form_one_group(spark):
    words = np.random.default_rng(0).integers(0, 1 << 24, 60).tolist()
    other = np.random.default_rng(9).integers(0, 1 << 24, 60).tolist()
    df = spark.createDataFrame([(i, words) for i in range(40)] + [(99, other), (98, words[:10])], "id bigint, words array<int>")
    got = du.dup_similar_groups(df).collect()
    assert sorted(r["id"] for r in got) == list(range(40))
    assert {r["group_key"] for r in got} == {0} and {r["confidence"] for r in got} == {1.0}


def brute_force(rows, k):
    def number(x):
        return float(x)
    out = {}
    for s in rows:
        scored = []
        for c in rows:
            if c["id"] == s["id"] or not c["analysed"]:
                continue
            d = min(abs(np.log2(number(c["bpm"]) / (s["bpm"] * r))) for r in (1, 2, 0.5))
            t = max(0, 1 - d / 0.06)
            steps = min(abs(s["wheel"] - c["wheel"]), 12 - abs(s["wheel"] - c["wheel"]))
            same = s["letter"] == c["letter"]
            h = 1 if same and steps == 0 else 0.85 if steps == 0 else 0.8 if same and steps == 1 else 0.45 if same and steps == 2 else 0.1
            e = max(0, 1 - abs(c["energy"] - s["energy"] - 1) / 4)
            total = t * 0.34 + h * 0.3 + e * 0.16 + c["section_score"] * 0.12 + max(0, 1 - s["vocal"] * c["vocal"] * 1.6) * 0.08
            total -= (0.12 if s["artist"] is not None and s["artist"] == c["artist"] else 0) + (0.25 if c["recent"] else 0)
            scored.append((-int(np.floor(max(0, min(1, total)) * 100 + 0.5)), c["name"], c["id"]))
        out[s["id"]] = [x[2] for x in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("cell", [4096, 8])
def test_recommend_all_with_a_third_of_copies(spark, monkeypatch, cell):
    """Copies, most of the library in one key and tempo cell, and energies outside 1..10; cells are split or not."""
    monkeypatch.setattr(rk, "CELL_ROWS", cell)
    rng = random.Random(4)
    rows = [(200 + i, f"hot {i:03d}", f"a{i}", 124 + i / 100, 3, "B", rng.choice([0, 5, 11]), rng.random(), 0.5, False, True) for i in range(150)]
    for i in range(150):
        if i % 3 == 0:
            rows.append((i, f"copy {i % 50:02d}", "x", 128.0, 8, "A", 5, 0.5, 1.0, False, True))
        else:
            rows.append((i, f"t{rng.randrange(40):02d}", rng.choice(["x", "y", None]), rng.uniform(60, 200), rng.randint(1, 12),
                         rng.choice("AB"), rng.randint(1, 10), rng.random(), rng.choice([1.0, 0.85, 0.6, 0.5, 0.25]),
                         rng.random() < 0.1, rng.random() < 0.95))
    df = spark.createDataFrame(rows, "id bigint, name string, artist string, bpm double, wheel int, letter string, energy int, "
                                     "vocal double, section_score double, recent boolean, analysed boolean")
    got = {}
    for r in rk.recommend_all(df.withColumn("section", F.lit(None).cast("string")), 5).orderBy("from_id", "rank").collect():
        got.setdefault(r["from_id"], []).append(r["to_id"])
    assert got == brute_force([r.asDict() for r in df.collect()], 5)


def test_dup_candidates_sends_a_print_to_few_cells(spark, tmp_path, monkeypatch):
    """Cells follow the tasks, not the prints: 160 prints are a few blocks, and all pairs are compared."""
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(160 * 50)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    sent = []
    kept = du.similar_edges

    def counted(prints, threshold, **how):
        cells = []
        monkeypatch.setattr(du.F, "inline", lambda c: cells.append(c) or inline(c))
        edges = kept(prints, threshold, **how)
        monkeypatch.setattr(du.F, "inline", inline)
        sent.append(prints.limit(1).select(F.lit(0).alias("_b")).select(F.size(cells[0])).first()[0])
        return edges

    inline = F.inline
    monkeypatch.setattr(du, "similar_edges", counted)
    got = {(r["i"], r["j"]): r["score"] for r in dq.dup_candidates(spark, str(tmp_path)).collect()}
    assert sent[0] <= 8
    prints = {r["id"]: np.array(r["words"], np.uint32) for r in dq.prints(spark, str(tmp_path)).collect()}
    some = sorted(prints)[:30]
    for i, j in itertools.combinations(some, 2):
        score = max(1 - np.bitwise_count(a ^ b).sum() / (24 * len(a)) for o in range(-8, 9, 2)
                    for a, b in [(prints[i][max(0, o):49 + min(0, o)], prints[j][max(0, -o):49 + min(0, -o)])])
        assert (round(score, 6) == round(got[i, j], 6)) if score >= dq.NOISE_THRESHOLD else (i, j) not in got


def test_ordered_helpers_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < 0.6 else rng.choice("abc")), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, t bigint, v bigint")
    by_group = {}
    for g, t, x in sorted(rows):
        by_group.setdefault(g, []).append((t, x))
    pos = {(r["g"], r["t"]): (r["pos"], r["run"]) for r in with_position(df, [F.col("t")], "pos", {"v": "run"}, ["g"], 7).collect()}
    nxt = {(r["g"], r["t"]): r["n"] for r in with_neighbour(df, ["g"], ["t"], {"v": "n"}, "next", 7).collect()}
    for g, items in by_group.items():
        total = 0
        for i, (t, x) in enumerate(items):
            assert pos[g, t] == (i, total)
            assert nxt[g, t] == (items[i + 1][1] if i + 1 < len(items) else None)
            total += x


def test_late_events_are_dropped_and_counted(spark):
    schema = "event_id bigint, job_id bigint, run_id bigint, at timestamp, status string, error_code string"
    rows = [(i, 1, 1, f"2024-01-{1 + i:02d} 00:00:00", "failed", "timeout") for i in range(9)]
    rows.append((9, 1, 1, "2024-01-01 00:30:00", "failed", "timeout"))  # far behind the watermark
    df = spark.createDataFrame(rows, "event_id bigint, job_id bigint, run_id bigint, at string, status string, error_code string")
    df = df.withColumn("at", F.col("at").cast("timestamp"))
    assert df.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    folder = scratch_folder(spark, "late")
    query = rp.run_to_table(jb.job_windows(rp.file_stream(spark, df, "event_id"), delay="1 day"), folder, "update")
    out = rp.latest_per_key(rp.read_batches(spark, folder), ["window_start"])
    assert out.agg(F.sum("events")).first()[0] == 9
    assert rp.dropped_late(query) == 1


def test_projection_merges_versions_and_compacts(spark):
    rows = [(i % 20, i, i % 7 == 0, f"n{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, deleted boolean, name string")
    folder, target = scratch_folder(spark, "proj"), scratch_folder(spark, "compact")
    pj.project_stream(rp.file_stream(spark, df, "seq"), folder, lambda d: d)
    want = {(i, s, n) for i, s, d, n in {r[0]: r for r in rows}.values() if not d}
    assert {tuple(r) for r in pj.read_projection(spark, folder).select("id", "seq", "name").collect()} == want
    pj.compact(spark, folder, target)
    assert {tuple(r) for r in pj.read_projection(spark, target).select("id", "seq", "name").collect()} == want


def test_scan_folder_rules(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    for name in ("one.mp3", "two.FLAC", "skip.txt", ".hidden.mp3"):
        (deep / name).write_bytes(b"12345")
    too_deep = tmp_path.joinpath(*"0123456789")
    too_deep.mkdir(parents=True)
    (too_deep / "x.wav").write_bytes(b"1")
    got = [(r["relative_path"], r["name"], r["size_bytes"]) for r in scan_folder(spark, str(tmp_path), max_depth=8).collect()]
    assert scan_folder(spark, str(tmp_path)).count() == 3
    assert got == [("a/b/one.mp3", "one.mp3", 5), ("a/b/two.FLAC", "two.FLAC", 5)]


def test_scan_folder_does_not_follow_links(spark, tmp_path):
    library, other = tmp_path / "library", tmp_path / "other"
    for folder in (library / "a b" / "_c%20é", library / ".cache", other):
        folder.mkdir(parents=True)
    (library / "a b" / "_c%20é" / "one.mp3").write_bytes(b"123")
    (library / ".cache" / "two.mp3").write_bytes(b"1")
    (other / "three.mp3").write_bytes(b"1")
    (library / "linked").symlink_to(other)
    (library / "linked.mp3").symlink_to(other / "three.mp3")
    (library / "a b" / "cycle").symlink_to(library)
    for k in range(30):
        (library / "many" / str(k)).mkdir(parents=True)
        (library / "many" / str(k) / f"{k}.wav").write_bytes(b"x" * k)
    rows = {r["relative_path"]: r for r in scan_folder(spark, str(library)).collect()}
    assert set(rows) == {"a b/_c%20é/one.mp3", *(f"many/{k}/{k}.wav" for k in range(30))}
    assert all(r["size_bytes"] == (3 if "one" in p else int(r["name"][:-4])) for p, r in rows.items())
    assert rows["a b/_c%20é/one.mp3"]["path"] == f"file:{library}/a b/_c%20é/one.mp3"
    assert scan_folder(spark, f"file://{library}", max_depth=1).count() == 0
    assert scan_folder(spark, str(tmp_path / "none")).count() == 0


def test_scans_prune_columns_and_push_filters(spark):
    from cratewise.operators.feedback import feedback_for
    df = feedback_for(v.feedback(spark, SF), 7).select("to_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_three_duplicate_levels_claim_once(spark):
    rng = np.random.default_rng(11)
    a, b = (rng.integers(0, 1 << 24, 80).tolist() for _ in range(2))
    near = [w ^ (1 if i % 2 else 0) for i, w in enumerate(a)]
    files = spark.createDataFrame(
        [(1, "h1", "x1"), (2, "h1", "x1"), (3, "h3", "x1"), (4, "h4", "y"), (5, "h5", "y"), (6, "h6", "z6"), (7, "h7", "z7"),
         (8, None, None), (9, "h9", "z9")], "id bigint, content_hash string, audio_hash string")
    prints = spark.createDataFrame([(i, w) for i, w in ((1, a), (3, b), (4, a), (6, a), (7, near), (8, near), (9, b))], "id bigint, words array<int>")
    got = {(r["level"], r["id"]) for r in du.find_duplicate_groups(files, prints).collect()}
    # 3 shares its audio hash only with claimed files; it matches 9 by sound
    assert got == {("exact-file", 1), ("exact-file", 2), ("same-audio", 4), ("same-audio", 5), ("similar-audio", 6),
                   ("similar-audio", 7), ("similar-audio", 8), ("similar-audio", 3), ("similar-audio", 9)}


@pytest.mark.parametrize("sort", ["added", "bpm", "name"])
@pytest.mark.parametrize("offset", [0, 35, 90, 10_000])
def test_pages_agree_whatever_way_they_are_read(spark, monkeypatch, sort, offset):
    from cratewise.operators import catalog as cat
    keys = cat.catalog_keys(v.tracks(spark, SF)).cache()
    whole = [r["id"] for r in keys.orderBy(*cat.sort_order(sort)).collect()]
    monkeypatch.setattr(cat, "TOP_K_LIMIT", 40)  # small, so that all three ways are taken
    page = cat.page_offset(keys, sort=sort, offset=offset, limit=30)
    start = min(offset, (len(whole) - 1) // 30 * 30)
    rows = page.collect()
    assert {r["offset"] for r in rows} == {start} and {r["total"] for r in rows} == {len(whole)}
    assert {r["id"] for r in rows} == set(whole[start:start + 30])


def test_keyset_pages_cover_the_list_once(spark):
    from cratewise.operators import catalog as cat
    keys = cat.catalog_keys(v.tracks(spark, SF)).cache()
    seen, after = [], None
    while True:
        page = (keys.orderBy(*cat.sort_order("bpm")).limit(60) if after is None else cat.page_keyset(keys, "bpm", after, 60)).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = (page[-1]["bpm"], page[-1]["id"])
    assert seen == [r["id"] for r in keys.orderBy("bpm", "id").collect()]


@pytest.mark.parametrize("name", ["phase_align", "phase_align_bar"])
def test_events_without_a_phase_are_kept(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from cratewise.plans import feature_queries as fq
    late = fq.grid_pairs(spark, SF).where("event_id <= 20").withColumn("o_position_sec", F.when(F.col("event_id") == 7, 1e9).otherwise(F.col("o_position_sec")))
    monkeypatch.setattr(fq, "grid_pairs", lambda spark, sf: late)  # past the last beat there is no phase
    rows = {r["event_id"]: r["seek_sec"] for r in entry.queries()[name](spark, SF).collect()}
    assert 7 in rows and len(rows) == late.count() > 10
    assert [e for e, x in rows.items() if x is None] == [7]


@pytest.mark.parametrize("sort", ["name", "bpm", "added"])
def test_middle_page_is_in_order(spark, monkeypatch, sort):
    from cratewise.operators import catalog as cat
    keys = cat.catalog_keys(v.tracks(spark, SF)).cache()
    whole = [r["id"] for r in keys.orderBy(*cat.sort_order(sort)).collect()]
    monkeypatch.setattr(cat, "TOP_K_LIMIT", 40)
    page = cat.page_offset(keys, sort=sort, offset=90, limit=30)
    assert [r["id"] for r in page.collect()] == whole[90:120]
    assert "Sort" in page._jdf.queryExecution().optimizedPlan().toString().split("Project")[1]  # stated by the plan, not left to how rows happen to lie
