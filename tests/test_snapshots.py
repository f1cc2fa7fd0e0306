"""The versioned table and the stored index."""

import time

import pytest
from pyspark.sql import functions as F

from cratewise.operators import catalog as cat, search_index as si
from cratewise.plans import views as v
from cratewise.sources.folders import scratch_folder
from cratewise.streaming import replay as rp, snapshots as sn


def rows(spark, values):
    return spark.createDataFrame(values, "id bigint, name string, seq bigint")


def state(spark, folder, version=None):
    return {r["id"]: (r["name"], r["seq"]) for r in sn.snapshot(spark, folder, version=version).collect()}


def test_edits_between_the_batches_of_a_backfill(spark):
    source = rows(spark, [(i, f"old {i}", 0) for i in range(9000)])
    folder = scratch_folder(spark, "upsert-test")
    place, seen = f"{folder}/version=a", []

    def project(batch):
        if len(sn.versions(spark, place)) == 1:  # one batch is in: edit a row it brought, one that comes later, and add one
            sn.upsert(rows(spark, [(5, "edited", 3), (8999, "edited", 3), (10_000, "new", 1)]), place)
            seen.append(state(spark, place))
        return batch

    sn.backfill(rp.file_stream(spark, source, "id"), folder, "a", project)
    got = state(spark, place)
    assert len(seen) == 1 and seen[0][5] == ("edited", 3) and 8998 not in seen[0]  # a whole version, without the rest
    assert len(got) == 9001 and got[5] == got[8999] == ("edited", 3) and got[10_000] == ("new", 1) and got[7] == ("old 7", 0)
    assert sn.snapshot(spark, place).count() == 9001
    before = len(sn.versions(spark, place))
    sn.backfill(rp.file_stream(spark, source.limit(0), "id", 1), folder, "b", lambda b: b)  # another projection has its own table
    assert len(sn.versions(spark, place)) == before


def test_versions_repeats_races_and_compaction(spark):
    folder = scratch_folder(spark, "versions-test")
    assert sn.snapshot(spark, folder) is None and sn.compact(spark, folder) == 0
    assert sn.upsert(rows(spark, [(1, "a", 0), (2, "b", 5)]), folder, "first") == 1
    assert sn.upsert(rows(spark, [(1, "never", 9)]), folder, "first") == 1  # a batch run again counts once
    assert sn.upsert(rows(spark, [(1, "c", 1), (2, "late", 4)]), folder, "second") == 2
    assert state(spark, folder) == {1: ("c", 1), 2: ("b", 5)} and state(spark, folder, 1) == {1: ("a", 0), 2: ("b", 5)}
    held = sn.manifest(spark, folder)
    assert sn._publish(spark, folder, held | {"version": 3, "parts": held["parts"]})
    assert not sn._publish(spark, folder, held | {"version": 3, "parts": {}})  # the second writer of a version loses
    assert sn.upsert(rows(spark, [(3, "d", 0)]), folder) == 4
    assert sn.compact(spark, folder) == 5 and len(set(sn.manifest(spark, folder)["parts"].values())) == 1
    assert sn.upsert(rows(spark, [(1, "never", 9)]), folder, "first") == 5
    assert state(spark, folder) == {1: ("c", 1), 2: ("b", 5), 3: ("d", 0)}


def scanned(df):
    """Rows that the scans of a plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


@pytest.mark.parametrize("text", ["red wid", "blu", "BLUE wire", "zzz", "  ", "12", "a,b"])
def test_index_finds_what_the_arrays_find(spark, text):
    keys = cat.catalog_keys(v.tracks(spark, "/root/testdata/sf0.01"))
    folder = scratch_folder(spark, "index-test")
    si.write_search_index(keys, folder)
    want = {r["id"] for r in cat.search_token_prefix(keys, text).select("id").collect()}
    assert {r["id"] for r in si.search_index(spark, folder, text).select("id").collect()} == want


def test_index_reads_few_row_groups(spark):
    keys = cat.catalog_keys(v.tracks(spark, "/root/testdata/sf0.1"))
    folder = scratch_folder(spark, "index-large")
    si.write_search_index(keys, folder)
    tokens = spark.read.parquet(f"{folder}/tokens")
    asked = si.token_range(tokens, "red wid")
    shown = asked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,red wid)" in shown and "LessThan(token,red wie)" in shown
    every, read = tokens.count(), scanned(asked)
    print(f"index rows read {read} of {every}")
    assert read < every / 10

    def timed(df):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            df().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    by_index = timed(lambda: si.search_index(spark, folder, "red wid"))
    by_scan = timed(lambda: cat.search_contains(cat.catalog_keys(v.tracks(spark, "/root/testdata/sf0.1")), "red wid"))
    print(f"stored index {by_index:.2f} s, substring scan {by_scan:.2f} s")
