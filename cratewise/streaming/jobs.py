"""Job event log as a stream: state, leases, windows, retries, views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cratewise.operators.ordered import with_neighbour, with_position

# Error codes that are tried again, and the retry timing in ms.
RETRYABLE = ["worker_crash", "worker_message", "timeout", "service_unavailable"]
MAX_RETRY_MS = 30_000
LEASE_SEC = 15
MAX_ATTEMPTS = 3


def job_state(events: DataFrame) -> DataFrame:
    """Latest event per job and run; batch or stream (update mode)."""
    last = F.max_by(F.struct("status", "error_code", "at"), F.struct("at", "event_id"))
    return events.groupBy("job_id", "run_id").agg(last.alias("s"), F.min("at").alias("queued_at")).select(
        "job_id", "run_id", "s.status", "s.error_code", F.col("s.at").alias("updated_at"), "queued_at")


def latest_flags(versions: DataFrame) -> DataFrame:
    """(id, seq, stale, review) versions reduced to the latest per id; batch or stream (update mode)."""
    return versions.groupBy("id").agg(F.max_by(F.struct("seq", "stale", "review"), "seq").alias("v")).select("id", "v.*")


def live_stats(latest: DataFrame) -> DataFrame:
    """Counts over the current row of each id, however often it was written."""
    return latest.groupBy().agg(F.count(F.lit(1)).alias("total"), F.count_if("stale").alias("stale"), F.count_if("review").alias("review"))


def job_windows(events: DataFrame, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events, failures and retryable failures per tumbling window; late rows are dropped."""
    failed = F.col("status") == "failed"
    source = events.withWatermark("at", delay) if events.isStreaming else events
    return source.groupBy(F.window("at", length).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("failed"),
        F.count_if(failed & F.col("error_code").isin(RETRYABLE)).alias("retryable")).select(
        F.col("w.start").alias("window_start"), "events", "failed", "retryable")


def windows_with_late(events: DataFrame, folder: str, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """``job_windows`` of a stream with ``late_rows``: rows whose window the watermark had passed are counted apart, not dropped.

    As in Spark's own rule, the watermark of a batch is the latest time of all
    earlier batches less the delay, and a row is late if its window ends by
    then. Each batch adds its partial counts per window, and its latest time, to
    the table in ``folder``; a batch run again replaces its own. Counts are
    summed on read, so a batch costs its own windows, and no state is kept.
    """
    spark = events.sparkSession
    failed = F.col("status") == "failed"
    counts = {"events": F.lit(True), "failed": failed, "retryable": failed & F.col("error_code").isin(RETRYABLE)}

    def save(batch: DataFrame, batch_id: int) -> None:
        done = None
        if batch_id:
            done = spark.read.parquet(f"{folder}/table").where(F.col("batch_id") < batch_id).agg(F.max("top")).first()[0]
        passed = F.lit(done) - F.expr(f"interval {delay}") if done is not None else F.lit(None).cast("timestamp")
        rows = batch.withColumn("w", F.window("at", length)).withColumn("late", F.coalesce(F.col("w.end") <= passed, F.lit(False)))
        (rows.groupBy("w").agg(*[F.count_if(e & ~F.col("late")).alias(n) for n, e in counts.items()], F.count_if("late").alias("late_rows"),
                               F.max("at").alias("top"))
         .select(F.col("w.start").alias("window_start"), *counts, "late_rows", "top")
         .write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}"))

    query = (events.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("window_start").agg(*[F.sum(c).alias(c) for c in (*counts, "late_rows")])


_LEASE_OUT = "job_id bigint, expired_at timestamp, attempts int, outcome string"
# What is kept of a job: whether its last status is running, that row's time, the claims so far, and the watermark (ms) past which its timer fires.
_JOB = np.dtype([("job", "i8"), ("running", "?"), ("last", "i8"), ("attempts", "i4"), ("due", "i8")])
_NEVER = np.iinfo(np.int64).max


def expired_leases(events: DataFrame, lease_sec: int = LEASE_SEC, max_attempts: int = MAX_ATTEMPTS,
                   delay: str = "10 minutes", groups: int = 512) -> DataFrame:
    """Running jobs without a sign of life for the lease: requeued, or failed when out of attempts.

    Streaming only. The state of a job is its last status, its time and the
    attempts so far; an event-time timer fires when the watermark passes the
    end of the lease. Jobs are dealt by hash into ``groups``, whose jobs are
    stepped together by arrays, as a call of the step costs far more than its
    rows; a group's timer is the earliest of its jobs. A checkpoint holds for
    the ``groups`` it was begun with.
    """
    lease = lease_sec * 1_000_000

    def outcomes(key, job, last, attempts) -> pd.DataFrame:
        return pd.DataFrame({"job_id": np.full(len(job), None) if key[0] < 0 else job, "expired_at": (last + lease).astype("datetime64[us]"),
                             "attempts": attempts.astype(np.int32), "outcome": np.where(attempts >= max_attempts, "failed", "requeued")})

    def step(key, batches, state: GroupState):
        known = np.frombuffer(state.get[0], _JOB) if state.exists else np.zeros(0, _JOB)
        rows = None if state.hasTimedOut else pd.concat(list(batches)).sort_values(["job", "at", "event_id"])
        ids = known["job"] if rows is None else np.union1d(known["job"], rows["job"].to_numpy())
        jobs = np.zeros(len(ids), _JOB)
        jobs["job"], jobs["due"] = ids, _NEVER
        jobs[np.searchsorted(ids, known["job"])] = known
        watermark, out = state.getCurrentWatermarkMs(), []
        if rows is not None:
            job = rows["job"].to_numpy()
            at = rows["at"].to_numpy("datetime64[us]").astype(np.int64)
            running = rows["running"].to_numpy(bool)
            first = np.append(True, job[1:] != job[:-1])
            final = np.append(first[1:], True)
            own = np.searchsorted(ids, job)
            # each row beside the one before it; a job's first beside its state
            before = np.where(first, jobs["last"][own], np.roll(at, 1))
            was = np.where(first, jobs["running"][own], np.roll(running, 1))
            expired = was & (at - before > lease)
            claim = running & (~was | expired)
            count = np.cumsum(claim)
            claims = jobs["attempts"][own] + count - (count - claim)[first][np.cumsum(first) - 1]
            out.append((job[expired], before[expired], (claims - claim)[expired]))
            own = own[final]
            jobs["running"][own], jobs["last"][own], jobs["attempts"][own] = running[final], at[final], claims[final]
            jobs["due"][own] = np.where(running[final], np.maximum((at[final] + lease) // 1000, watermark + 1), _NEVER)
        gone = jobs["due"] < watermark
        out.append((jobs["job"][gone], jobs["last"][gone], jobs["attempts"][gone]))
        if any(len(job) for job, _, _ in out):
            yield outcomes(key, *map(np.concatenate, zip(*out)))
        jobs["running"][gone], jobs["due"][gone] = False, _NEVER
        state.update((jobs.tobytes(),))
        if (jobs["due"] < _NEVER).any():
            state.setTimeoutTimestamp(int(jobs["due"].min()))

    # a job without an id is in a group of its own, so that ids stay whole numbers
    group = F.when(F.col("job_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(groups)).cast("int"))
    rows = events.withWatermark("at", delay).select(
        group.alias("group"), F.coalesce(F.col("job_id").cast("bigint"), F.lit(0)).alias("job"), "at", "event_id",
        F.coalesce(F.col("status") == "running", F.lit(False)).alias("running"))
    return rows.groupBy("group").applyInPandasWithState(
        step, _LEASE_OUT, "jobs binary", "append", GroupStateTimeout.EventTimeTimeout)


def expired_leases_batch(events: DataFrame, lease_sec: int = LEASE_SEC, max_attempts: int = MAX_ATTEMPTS,
                         delay_sec: int = 600) -> DataFrame:
    """The same over a finished log, by neighbours and a running count, for jobs of any size."""
    end = F.lit(events.agg(F.max("at")).first()[0]) - F.make_interval(secs=F.lit(delay_sec))
    rows = with_neighbour(events, ["job_id"], ["at", "event_id"], {"at": "_next"}, "next")
    rows = with_neighbour(rows, ["job_id"], ["at", "event_id"], {"at": "_before", "status": "_was"}, "previous")
    lease = F.make_interval(secs=F.lit(lease_sec))
    running = F.col("status") == "running"
    # A claim: running after anything else, or after a lease that ran out.
    claim = running & (F.col("_was").isNull() | (F.col("_was") != "running") | (F.col("at") > F.col("_before") + lease))
    counted = with_position(rows.withColumn("_claim", claim.cast("int")), [F.col("at"), F.col("event_id")], "_pos",
                            {"_claim": "_earlier"}, group=["job_id"])
    gone = running & F.when(F.col("_next").isNotNull(), F.col("_next") > F.col("at") + lease).otherwise(F.col("at") + lease < end)
    attempts = (F.col("_earlier") + F.col("_claim")).cast("int")
    return counted.where(gone).select("job_id", (F.col("at") + lease).alias("expired_at"), attempts.alias("attempts"),
                                      F.when(attempts >= max_attempts, "failed").otherwise("requeued").alias("outcome"))


def retry_delay_ms(attempts: Column, base_ms: int = 1000) -> Column:
    return F.least(F.lit(float(MAX_RETRY_MS)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1))).cast("bigint")


def retry_plan(jobs: DataFrame, now_ms: Column, base_ms: int = 1000, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``jobs(error_code, attempts)`` -> requeue with a next attempt time, or failed."""
    again = F.coalesce("error_code", F.lit("analysis")).isin(RETRYABLE) & (F.col("attempts") < max_attempts)
    return jobs.withColumns({"next_status": F.when(again, "queued").otherwise("failed"),
                             "next_attempt_ms": now_ms + retry_delay_ms(F.col("attempts"), base_ms)})


def queue_order(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Ready jobs numbered by priority, age and id; a report, nothing is claimed."""
    ready = jobs.where((F.col("status") == "queued") & (F.coalesce("next_attempt_ms", F.lit(0)) <= now_ms))
    return with_position(ready, [F.desc("priority"), F.col("queued_at"), F.col("id")], "position")


def active_jobs(state: DataFrame) -> DataFrame:
    return state.where(F.col("status").isin("queued", "running"))


def jobs_view(state: DataFrame) -> DataFrame:
    """All jobs, latest change first; a job that never changed counts from when it was queued."""
    return state.orderBy(F.coalesce("updated_at", "queued_at").desc(), "job_id", "run_id")
