"""Live progress of jobs. Every function takes a batch or a streaming frame of results (job_id, event_id, status, ts).

Those with state that expires or waits (live_state, silent_jobs) keep it by key with transformWithStateInPandas on streams, which needs the
RocksDB state store, and have batch twins of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed mapping of the event table's types to result statuses.
STATUS = {"purchase": "success", "view": "success", "error": "failed", "click": "processing", "signup": "pending"}


def results(events: DataFrame) -> DataFrame:
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    return events.select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), "value")


def job_state(rows: DataFrame) -> DataFrame:
    """Running counts per job; a streaming frame is written in update mode."""
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("status") == "success").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"))


def latest_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("event_id").alias("last_event"))


def terminal_jobs(state: DataFrame, totals: DataFrame) -> DataFrame:
    """Jobs all of whose documents have a result, given a static side of totals (job_id, total)."""
    return state.join(totals, "job_id").where(F.col("processed") + F.col("failed") >= F.col("total"))


def final_jobs(rows: DataFrame, totals: DataFrame, commands: DataFrame) -> DataFrame:
    """(job_id, outcome, processed, failed, seconds) of jobs that are over: told to end by a command (cancelled, failed), or all documents have a result.

    seconds lie between the first and the last result, or the command that ended the job. Results and commands (job_id, command, event_time)
    are unioned into one aggregation per job, so both may stream (in complete or update mode); totals (job_id, total) is static.
    """
    none = F.lit(None).cast("timestamp")
    told = commands.where(F.col("command").isin("cancelled", "failed"))
    both = rows.select("job_id", "status", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("command"), none.alias("told_at"))
    both = both.unionByName(told.select("job_id", F.lit(None).cast("string").alias("status"), none.alias("ts"), "command", F.col("event_time").cast("timestamp").alias("told_at")))
    state = both.groupBy("job_id").agg(
        F.count_if(F.col("status") == "success").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.max_by("command", F.struct("told_at", "command")).alias("command"), F.max("told_at").alias("told_at"),
    )
    joined = state.join(totals, "job_id", "left")
    outcome = F.coalesce("command", F.when(F.col("processed") + F.col("failed") >= F.col("total"), "completed"))
    end = F.coalesce("told_at", "end")
    seconds = F.round((F.unix_micros(end) - F.unix_micros(F.coalesce("start", end))) / 1e6, 2)
    return joined.select("job_id", outcome.alias("outcome"), "processed", "failed", seconds.alias("seconds")).where("outcome is not null")


def active_jobs(latest: DataFrame) -> DataFrame:
    return latest.where("status = 'processing'").select("job_id")


def stalled_jobs(rows: DataFrame, now: Column, seconds: int = 30, over: DataFrame | None = None) -> DataFrame:
    """Jobs whose last result is older than the limit, but for those that are over (job_id)."""
    last = rows.groupBy("job_id").agg(F.max("ts").alias("last_seen"))
    stalled = last.where(F.col("last_seen") < now - F.expr(f"interval {seconds} seconds"))
    return stalled if over is None else stalled.join(over.select("job_id"), "job_id", "left_anti")


def status_windows(rows: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and status; late results beyond the watermark are dropped by the stream."""
    timed = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counted = timed.groupBy(F.window("ts", size, slide or size), "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def expire_state(rows: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Job state that goes a day after the job's last result: sessions with that gap."""
    timed = rows.withWatermark("ts", ttl) if rows.isStreaming else rows
    return timed.groupBy(F.session_window("ts", ttl), "job_id").agg(F.count(F.lit(1)).alias("results")).select("job_id", F.col("session_window.start").alias("start"), "results")


def catch_up(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """The log so far and what follows, each result once."""
    both = snapshot.unionByName(live)
    return both.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["job_id", "event_id"]) if both.isStreaming else both.dropDuplicates(["job_id", "event_id"])


def append_results(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream of results to a table, exactly once per checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """One micro-batch as a partition of its own: written again, it replaces itself and nothing else."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def append_once(rows: DataFrame, path: str, checkpoint: str, write=write_batch):
    """Append a stream of results to any table that Spark can write, once: a batch that is replayed after a stop between its write and its
    commit overwrites the same partition. Unlike a file sink's, the table needs no log of its own to be read right."""
    return rows.writeStream.foreachBatch(lambda batch, k: write(batch, k, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_cancelled(docs: DataFrame, commands: DataFrame, late: str = "10 minutes", horizon: str = "24 hours") -> DataFrame:
    """docs (job_id, ts, ...) but those whose job was told to cancel at their time or up to `horizon` before it.

    On streams both sides carry watermarks of `late`, so a document leaves when no command can still stop it, and state goes after the horizon.
    commands has (job_id, command, event_time).
    """
    told = commands.where("command = 'cancel'").select(F.col("job_id").alias("_job"), F.col("event_time").cast("timestamp").alias("_told"))
    rows = docs.withWatermark("ts", late) if docs.isStreaming else docs
    told = told.withWatermark("_told", late) if told.isStreaming else told
    stops = (F.col("job_id") == F.col("_job")) & (F.col("_told") <= F.col("ts")) & (F.col("_told") >= F.col("ts") - F.expr(f"interval {horizon}"))
    return rows.join(told, stops, "leftOuter").where("_job is null").drop("_job", "_told")


def late_cancels(docs: DataFrame, commands: DataFrame, late: str = "10 minutes", horizon: str = "24 hours") -> DataFrame:
    """(job_id, event_id, ts, told) of documents that were processed up to `horizon` before their job was told to cancel: the command came too late for them."""
    told = commands.where("command = 'cancel'").select(F.col("job_id").alias("_job"), F.col("event_time").cast("timestamp").alias("told"))
    rows = docs.withWatermark("ts", late) if docs.isStreaming else docs
    told = told.withWatermark("told", late) if told.isStreaming else told
    after = (F.col("job_id") == F.col("_job")) & (F.col("told") > F.col("ts")) & (F.col("told") <= F.col("ts") + F.expr(f"interval {horizon}"))
    return rows.join(told, after).select("job_id", "event_id", "ts", "told")


class _Expiring(StatefulProcessor):
    """Counts of a job since its start; they go a fixed time after the start, whatever came since. Times are microseconds."""

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "start long, results long, processed long, failed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        start, *counts = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        out = {}
        for us, status in zip(pdf["us"].tolist(), pdf["status"], strict=True):
            if start is None or us >= start + self.wait:
                start, counts = us, [0, 0, 0]
            counts = [counts[0] + 1, counts[1] + (status == "success"), counts[2] + (status == "failed")]
            out[start] = (key[0], start, *counts)
        self.state.update((start, *map(int, counts)))
        yield pd.DataFrame(list(out.values()), columns=["job_id", "start", "results", "processed", "failed"])

    def close(self) -> None:
        pass


_STATE = "job_id long, start long, results long, processed long, failed long"


def live_state(rows: DataFrame, hours: float = 24) -> DataFrame:
    """(job_id, start, results, processed, failed): a job's counts since its start; a result that comes that many hours after the start or later starts it anew.

    A stream gives the changed states of each batch (update mode), of which the last for each (job_id, start) equals the batch form's row;
    rows of a job must not come out of order over batches. The batch form reads each job's rows in order, as a stream that holds none.
    """
    wait = int(hours * 3_600_000_000)
    timed = rows.select("job_id", "event_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    if rows.isStreaming:
        states = timed.groupBy("job_id").transformWithStateInPandas(_Expiring(wait), outputStructType=_STATE, outputMode="Update", timeMode="None")
        return states.withColumn("start", F.timestamp_micros("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, start = None, 0
        for pdf in batches:
            out, ids, us = [], pdf["job_id"].to_numpy(), pdf["us"].to_numpy()
            good, bad = (pdf["status"] == "success").to_numpy(), (pdf["status"] == "failed").to_numpy()
            bounds = [*np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist(), len(ids)] if len(ids) else []
            for at, end in zip(bounds, bounds[1:], strict=False):
                if ids[at] != job:
                    job, start = ids[at], us[at]
                while at < end:
                    to = at + int(np.searchsorted(us[at:end], start + wait))
                    if to > at:
                        out.append((job, start, to - at, int(good[at:to].sum()), int(bad[at:to].sum())))
                    at = to
                    start = us[at] if at < end else start
            yield pd.DataFrame(out, columns=["job_id", "start", "results", "processed", "failed"]).astype("int64")

    ordered = timed.repartition("job_id").sortWithinPartitions("job_id", "us", "event_id")
    parts = ordered.select("job_id", "us", "status").mapInPandas(run, _STATE)
    return parts.groupBy("job_id", F.timestamp_micros("start").alias("start")).agg(*[F.sum(c).alias(c) for c in ("results", "processed", "failed")])


class _Silent(StatefulProcessor):
    """Remembers when a job was last heard of, in microseconds, with a timer that fires when nothing more comes in time."""

    def __init__(self, wait: int, over: tuple[str, ...]) -> None:
        self.wait, self.over = wait, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        us, over = self.last.get() if self.last.exists() else (0, False)
        for pdf in rows:
            us, over = max(us, int(pdf["us"].max())), over or bool(pdf["status"].isin(self.over).any())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not over:
            self.handle.registerTimer((us + self.wait) // 1000)
        self.last.update((us, over))
        yield pd.DataFrame({"job_id": [], "us": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield pd.DataFrame({"job_id": [key[0]], "us": [self.last.get()[0]]})

    def close(self) -> None:
        pass


def silent_jobs(rows: DataFrame, seconds: float = 30, late: str = "0 seconds", over: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, last_seen) of jobs that nothing was heard of for so long, though no status of `over` has come.

    A stream reports a job when the watermark, which other jobs' rows move on, passes the limit: a timer fires without a row of its own; a job
    that speaks again may be reported again. The batch form gives each job's silences within the table, the last one against the table's latest time.
    """
    if rows.isStreaming:
        timed = rows.select("job_id", "status", F.unix_micros("ts").alias("us"), "ts").withWatermark("ts", late)
        silent = timed.groupBy("job_id").transformWithStateInPandas(_Silent(int(seconds * 1_000_000), over), outputStructType="job_id long, us long", outputMode="Append", timeMode="EventTime")
        return silent.select("job_id", F.timestamp_micros("us").alias("last_seen"))
    w = W.partitionBy("job_id").orderBy("ts", "event_id")
    ended = F.max(F.col("status").isin(*over) if over else F.lit(False)).over(w)
    seen = rows.withColumns({"_next": F.coalesce(F.lead("ts").over(w), rows.agg(F.max("ts")).scalar()), "_over": ended})
    return seen.where(~F.col("_over") & (F.col("_next") > F.col("ts") + F.expr(f"interval {seconds} seconds"))).select("job_id", F.col("ts").alias("last_seen"))
