"""Streaming queries: the tables are replayed in three batches and end in a table."""

from pyspark.sql import functions as F

from cratewise.operators import catalog as cat, search_index as si
from cratewise.plans import views as v
from cratewise.plans.catalog_queries import _KEYS
from cratewise.plans.registry import Book
from cratewise.plans.views import oracle
from cratewise.sources.folders import scratch_folder
from cratewise.streaming import jobs as jb, projection as pj, replay as rp, snapshots as sn

BOOK = Book()
query = BOOK.query


def micros(name):
    return F.unix_micros(name).alias(name)


def job_stream(spark, sf):
    return rp.file_stream(spark, v.job_events(spark, sf), "event_id")


def run(spark, stream, mode, keys):
    folder = scratch_folder(spark, "stream-out")
    rp.run_to_table(stream, folder, mode)
    return rp.latest_per_key(rp.read_batches(spark, folder), keys)


_STATE = """state AS (SELECT job_id, run_id, arg_max(status, {'a': "at", 'e': event_id}) AS status, arg_max({'c': error_code}, {'a': "at", 'e': event_id}).c AS error_code,
  epoch_us(max("at")) AS updated_at, epoch_us(min("at")) AS queued_at FROM job_events GROUP BY ALL)"""


def state(spark, sf):
    return run(spark, jb.job_state(job_stream(spark, sf)), "update", ["job_id", "run_id"])


@query("job_state", oracle("job_events", f"WITH {_STATE} SELECT * FROM state"))
def job_state(spark, sf):
    return state(spark, sf).select("job_id", "run_id", "status", "error_code", micros("updated_at"), micros("queued_at"))


@query("jobs_view", oracle("job_events", f"WITH {_STATE} SELECT job_id, run_id, status, updated_at FROM state"))
def jobs_view(spark, sf):
    return jb.jobs_view(state(spark, sf)).select("job_id", "run_id", "status", micros("updated_at"))


@query("active_jobs", oracle("job_events", f"WITH {_STATE} SELECT job_id, run_id, status FROM state WHERE status IN ('queued', 'running')"))
def active_jobs(spark, sf):
    return jb.active_jobs(jb.job_state(v.job_events(spark, sf))).select("job_id", "run_id", "status")


@query("live_stats", oracle("eff", f"WITH {_KEYS} SELECT count(*) AS total, count(*) FILTER (stale) AS stale, count(*) FILTER (review) AS review FROM keys"))
def live_stats(spark, sf):
    rows = cat.catalog_keys(v.tracks(spark, sf)).select("id", "stale", "review")
    # every third track was written before, with other flags
    before = rows.where("id % 3 = 0").select("id", (-F.col("id") - 1).alias("seq"), (~F.col("stale")).alias("stale"), (~F.col("review")).alias("review"))
    versions = rows.select("id", F.col("id").alias("seq"), "stale", "review").unionByName(before)
    return jb.live_stats(run(spark, jb.latest_flags(rp.file_stream(spark, versions, "seq")), "update", ["id"]))


@query("job_windows", oracle("job_events", """SELECT epoch_us(date_trunc('hour', "at")) AS window_start, count(*) AS events, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'failed' AND error_code IN ('worker_crash','worker_message','timeout','service_unavailable')) AS retryable FROM job_events GROUP BY 1"""))
def job_windows(spark, sf):
    return run(spark, jb.job_windows(job_stream(spark, sf)), "update", ["window_start"]).withColumn("window_start", F.unix_micros("window_start"))


@query("job_windows_late", oracle("job_events", """WITH m AS (SELECT max("at") AS top FROM job_events),
r AS (SELECT "at", status, error_code, FALSE AS late FROM job_events
  UNION ALL SELECT "at", status, error_code, date_trunc('hour', "at") + INTERVAL 1 HOUR <= top - INTERVAL 1 DAY FROM job_events, m WHERE event_id % 40 = 0)
SELECT epoch_us(date_trunc('hour', "at")) AS window_start, count(*) FILTER (NOT late) AS events, count(*) FILTER (NOT late AND status = 'failed') AS failed,
  count(*) FILTER (NOT late AND status = 'failed' AND error_code IN ('worker_crash','worker_message','timeout','service_unavailable')) AS retryable,
  count(*) FILTER (late) AS late_rows FROM r GROUP BY 1"""))
def job_windows_late(spark, sf):
    """The log, and then one event in forty once more, most of them behind the watermark."""
    rows = v.job_events(spark, sf).withColumn("_slice", F.lit(0))
    rows = rows.unionByName(rows.where("event_id % 40 = 0").withColumn("_slice", F.lit(1)))
    out = jb.windows_with_late(rp.file_stream(spark, rows, "_slice", cuts=[1]), scratch_folder(spark, "late-windows"))
    return out.withColumn("window_start", F.unix_micros("window_start"))


_LEASE = 6 * 3600
_EXPIRED = f"""o AS (SELECT *, lead("at") OVER w AS nx, lag("at") OVER w AS bf, lag(status) OVER w AS was FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY "at", event_id)),
c AS (SELECT *, sum(CASE WHEN status = 'running' AND (was IS NULL OR was <> 'running' OR "at" > bf + INTERVAL {_LEASE} SECOND) THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS attempts FROM o)
SELECT job_id, epoch_us("at" + INTERVAL {_LEASE} SECOND) AS expired_at, attempts::INTEGER AS attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'requeued' END AS outcome FROM c
WHERE status = 'running' AND CASE WHEN nx IS NOT NULL THEN nx > "at" + INTERVAL {_LEASE} SECOND ELSE "at" + INTERVAL {_LEASE} SECOND < (SELECT max("at") FROM job_events) - INTERVAL 600 SECOND END"""


@query("expired_leases", oracle("job_events", f"WITH {_EXPIRED}"))
def expired_leases(spark, sf):
    folder = scratch_folder(spark, "leases")
    rp.run_to_table(jb.expired_leases(job_stream(spark, sf), _LEASE), folder, "append")
    return rp.read_batches(spark, folder).select("job_id", micros("expired_at"), "attempts", "outcome")


@query("expired_leases_batch", oracle("job_events", f"WITH {_EXPIRED}"))
def expired_leases_batch(spark, sf):
    return jb.expired_leases_batch(v.job_events(spark, sf), _LEASE).select("job_id", micros("expired_at"), "attempts", "outcome")


@query("retry_backoff", oracle("job_events", """SELECT event_id, CASE WHEN coalesce(error_code, 'analysis') IN ('worker_crash','worker_message','timeout','service_unavailable') AND 1 + event_id % 4 < 3 THEN 'queued' ELSE 'failed' END AS next_status,
  epoch_us("at") // 1000 + least(30000, 4000 * pow(2, event_id % 4))::BIGINT AS next_attempt_ms FROM job_events WHERE status = 'failed'"""))
def retry_backoff(spark, sf):
    failed = v.job_events(spark, sf).where("status = 'failed'").withColumn("attempts", F.expr("cast(1 + event_id % 4 as int)"))
    return jb.retry_plan(failed, F.unix_millis("at"), 4000).select("event_id", "next_status", "next_attempt_ms")


@query("queue_order", oracle("job_events", """SELECT event_id AS id, row_number() OVER (ORDER BY event_id % 5 DESC, "at", event_id) - 1 AS position FROM job_events WHERE status = 'queued' AND event_id % 1000 <= 700"""))
def queue_order(spark, sf):
    jobs = v.job_events(spark, sf).select(F.col("event_id").alias("id"), "status", (F.col("event_id") % 5).alias("priority"),
                                          F.col("at").alias("queued_at"), (F.col("event_id") % 1000).alias("next_attempt_ms"))
    return jb.queue_order(jobs, 700).select("id", "position")


@query("incremental_projection", """WITH e AS (SELECT event_id % 700 AS id, event_id AS seq, event_type = 'error' AS deleted, event_type AS name, value AS bpm FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, seq, name, bpm, bpm > 20 AS fast FROM l WHERE NOT deleted""")
def incremental_projection(spark, sf):
    versions = v.table(spark, sf, "events").selectExpr(
        "event_id % 700 as id", "event_id as seq", "event_type = 'error' as deleted", "event_type as name", "value as bpm")
    folder = scratch_folder(spark, "projection")
    pj.project_stream(rp.file_stream(spark, versions, "seq"), folder, lambda d: d.withColumn("fast", F.col("bpm") > 20))
    return pj.read_projection(spark, folder)


@query("backfill_projection", oracle("eff", f"WITH {_KEYS} SELECT id, name, bpm, search, added_at, review, failed, reviewed, stale FROM keys"))
def backfill_projection(spark, sf):
    stream = rp.file_stream(spark, v.tracks(spark, sf), "id")
    folder = scratch_folder(spark, "backfill")
    pj.backfill(spark, stream, folder, "v3", cat.catalog_keys)
    return rp.read_batches(spark, f"{folder}/version=v3").drop("tokens", "batch_id")


@query("backfill_upsert", oracle("eff", f"""WITH {_KEYS} SELECT id, CASE WHEN id % 7 = 0 THEN upper(name) ELSE name END AS name, bpm,
  CASE WHEN id % 7 = 0 THEN 2 WHEN id % 7 = 1 THEN 1 ELSE 0 END::BIGINT AS seq FROM keys WHERE id % 7 <> 1
  UNION ALL SELECT id, 'early ' || name, bpm, 1::BIGINT FROM keys WHERE id % 7 = 1"""))
def backfill_upsert(spark, sf):
    """A backfill in three batches; some tracks are edited before it comes to them, others between its batches."""
    rows = cat.catalog_keys(v.tracks(spark, sf)).select("id", "name", "bpm", F.lit(0).cast("bigint").alias("seq"))
    folder = scratch_folder(spark, "backfill-upsert")
    place = f"{folder}/version=v1"
    sn.upsert(rows.where("id % 7 = 1").withColumns({"name": F.concat(F.lit("early "), "name"), "seq": F.lit(1).cast("bigint")}), place, "early")
    edited = rows.where("id % 7 = 0").withColumns({"name": F.upper("name"), "seq": F.lit(2).cast("bigint")})

    def project(batch):
        if len(sn.versions(spark, place)) == 2:  # after the first batch
            sn.upsert(edited, place, "between")
        return batch

    sn.backfill(rp.file_stream(spark, rows, "id"), folder, "v1", project)
    return sn.snapshot(spark, place).select("id", "name", "bpm", "seq")


@query("search_stored_index", oracle("eff", f"""WITH {_KEYS} SELECT 'red wid' AS text, id, name, search FROM keys
  WHERE contains(search, 'red wid') AND regexp_matches(search, '(^|[^a-z0-9])red[^a-z0-9]+wid')
  UNION ALL SELECT 'blu', id, name, search FROM keys WHERE contains(search, 'blu') AND regexp_matches(search, '(^|[^a-z0-9])blu')"""))
def search_stored_index(spark, sf):
    """Two searches over an index of the whole catalogue, written first."""
    folder = scratch_folder(spark, "search-index")
    si.write_search_index(cat.catalog_keys(v.tracks(spark, sf)), folder)
    found = [si.search_index(spark, folder, text).select(F.lit(text).alias("text"), "id", "name", "search") for text in ("red wid", "blu")]
    return found[0].unionByName(found[1])
