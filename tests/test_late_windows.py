"""Late rows counted apart, over three batches, against a plain reading of the rule."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cratewise.sources.folders import scratch_folder
from cratewise.streaming import jobs as jb, replay as rp


def test_late_rows_are_counted_by_window(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), "failed" if i % 3 == 0 else "done", "timeout" if i % 2 else "other", 0) for i in range(300)]
    rows += [(1000 + i, start + timedelta(minutes=5 * i), "failed", "timeout", 1) for i in range(500)]  # from far behind to beyond
    rows += [(2000 + i, start + timedelta(minutes=11 * i), "done", None, 2) for i in range(250)]
    df = spark.createDataFrame([(a, b.isoformat(sep=" "), c, d, e) for a, b, c, d, e in rows],
                               "event_id bigint, at string, status string, error_code string, slice int").withColumn("at", F.col("at").cast("timestamp"))
    out = jb.windows_with_late(rp.file_stream(spark, df, "slice", cuts=[1, 2]), scratch_folder(spark, "late"), "1 hour", "6 hours")
    want, top = {}, None
    for part in range(3):
        own = [r for r in rows if r[4] == part]
        for _, at, status, code, _ in own:
            window = at.replace(minute=0)
            c = want.setdefault(window, Counter())
            if top is not None and window + timedelta(hours=1) <= top - timedelta(hours=6):
                c["late_rows"] += 1
            else:
                c["events"] += 1
                c["failed"] += status == "failed"
                c["retryable"] += status == "failed" and code == "timeout"
        top = max([r[1] for r in own] + ([top] if top else []))
    got = {datetime.fromisoformat(r["w"]): r for r in out.withColumn("w", F.col("window_start").cast("string")).collect()}
    assert set(got) == set(want) and sum(r["late_rows"] for r in got.values()) > 100
    for w, c in want.items():
        assert all(got[w][k] == c[k] for k in ("events", "failed", "retryable", "late_rows")), w
