"""Leases of a stream whose jobs are stepped in groups, against a plain reading of the rule."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cratewise.sources.folders import scratch_folder
from cratewise.streaming import jobs as jb, replay as rp

START = datetime(2024, 1, 1)


def log(n_jobs, n_events):
    """Events in order of time, a second apart; a fifth of them of one job, and some without a job."""
    rng = random.Random(5)
    ids = [*range(n_jobs - 3), None, -7, (1 << 60) + 1]
    return [(i, 11 if rng.random() < 0.2 else rng.choice(ids), START + timedelta(seconds=i), rng.choice(["running", "running", "done", "queued", None]))
            for i in range(n_events)]


def streamed(spark, rows, cuts, **more):
    df = spark.createDataFrame([(e, j, at.isoformat(sep=" "), s) for e, j, at, s in rows],
                               "event_id bigint, job_id bigint, at string, status string").withColumn("at", F.col("at").cast("timestamp"))
    folder = scratch_folder(spark, "leases")
    query = rp.run_to_table(jb.expired_leases(rp.file_stream(spark, df, "event_id", cuts=cuts), **more), folder, "append")
    found = rp.read_batches(spark, folder).withColumn("expired_at", F.col("expired_at").cast("string")).collect()
    return query, [(r["job_id"], datetime.fromisoformat(r["expired_at"]), r["attempts"], r["outcome"]) for r in found]


def plain(rows, lease, delay, most):
    """Each job's rows in turn; ``rows`` are in order, so none is late."""
    of, end = defaultdict(list), max(r[2] for r in rows) - timedelta(seconds=delay)
    for _, job, at, status in rows:
        of[job].append((at, status))
    for job, own in of.items():
        attempts, held = 0, None
        for at, status in [*own, (None, None)]:
            gone = held is not None and (at - held > lease if at else held + lease < end)
            if gone:
                yield job, held + lease, attempts, "failed" if attempts >= most else "requeued"
            attempts += status == "running" and (held is None or gone)
            held = at if status == "running" else None


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_jobs_of_all_groups_equal_a_plain_replay(spark):
    rows = log(400, 6000)
    want = in_order(plain(rows, timedelta(seconds=300), 600, 3))
    assert len(want) > 500 and {r[3] for r in want} == {"failed", "requeued"} and want[-1][0] is None
    for cuts, groups in (([1500, 4000], 512), ([], 3)):
        assert in_order(streamed(spark, rows, cuts, lease_sec=300, groups=groups)[1]) == want


def test_state_and_calls_follow_the_groups_not_the_jobs(spark):
    rows = [(i, i, START + timedelta(seconds=i), "running") for i in range(3000)]
    query, found = streamed(spark, rows, [1000, 2000], groups=16)
    assert len(found) == 3000 - 1 - 600 - 15  # those whose lease ended before the last row's time less the delay
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert 0 < max(state) <= 16


def test_late_rows_are_dropped_and_timers_fire_in_between(spark):
    at = lambda sec: START + timedelta(seconds=sec)
    rows = [(1, 1, at(0), "running"), (2, 2, at(0), "running"), (3, 2, at(5000), "done"),
            (4, 9, at(5500), "done"),  # job 1 has no row here; its timer fires
            (5, 1, at(10), "running"),  # behind the watermark of 4400 s: no second claim
            (6, 3, at(9000), "running")]
    found = in_order(streamed(spark, rows, [4, 5], groups=1)[1])
    assert found == [(1, at(15), 1, "requeued"), (2, at(15), 1, "requeued")]
