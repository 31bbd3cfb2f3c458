"""Jobs held by lease: enqueue, claim, heartbeats, an end, and expiry where heartbeats stay away; a stream and its batch twin.

Events (job_id, event_id, worker, kind, ts) are taken job by job in order of (ts, event_id).  A claim takes a queued job and
starts a lease; heartbeats of the owner extend it; the owner may complete or fail the job.  A lease that nobody extends runs
out: the job fails at that moment, and may be enqueued anew.  Whatever does not fit is rejected and changes nothing; a
heartbeat of the owner that is no later than the last one is a duplicate.  A job that ended is forgotten after ``retention``.

The stream holds events until the watermark has passed them, so that late ones still come in order, and event-time timers
wake it for held events and for leases that run out.  Events older than the watermark are dropped by Spark.  The batch form
sees all events up to a given time and gives the same rows.

Results: null workers own nothing, unknown kinds are rejected, rows without job_id or ts are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE_SECONDS, RETENTION_SECONDS = 120, 3600
OUTPUT = "job_id long, event_id long, kind string, worker string, at long, outcome string, status string, until long"
FIELDS = ["job_id", "event_id", "kind", "worker", "at", "outcome", "status", "until"]


@dataclass(frozen=True)
class Job:
    """Times are milliseconds; ``until`` is the lease's end while running and the end of memory after the job's own."""

    status: str
    owner: str | None = None
    beat: int = 0
    until: int = 0


def lapsed(job_id: int, job: Job | None, now: int, retention: int) -> tuple[Job | None, list[tuple]]:
    """(job, rows) once time has come to ``now``: a lease that ended before has run out, an ended job may be forgotten."""
    rows = []
    if job is not None and job.status == "running" and job.until < now:
        rows.append((job_id, None, "expire", job.owner, job.until, "expired", "failed", None))
        job = Job("failed", until=job.until + retention)
    if job is not None and job.status in ("completed", "failed") and job.until < now:
        job = None
    return job, rows


def advance(job_id: int, job: Job | None, event: tuple[int, int, str, str | None], lease: int, retention: int) -> tuple[Job | None, list[tuple]]:
    """(job, rows) after an event (at, event_id, kind, worker), which nothing earlier follows."""
    at, event_id, kind, worker = event
    job, rows = lapsed(job_id, job, at, retention)
    owns = job is not None and job.status == "running" and worker is not None and worker == job.owner
    after, outcome = job, "rejected"
    if kind == "enqueue" and (job is None or job.status == "failed"):
        after, outcome = Job("queued"), "accepted"
    elif kind == "claim" and job is not None and job.status == "queued" and worker is not None:
        after, outcome = Job("running", worker, at, at + lease), "accepted"
    elif kind == "heartbeat" and owns:
        after, outcome = (job, "duplicate") if at <= job.beat else (replace(job, beat=at, until=at + lease), "accepted")
    elif kind in ("complete", "fail") and owns:
        after, outcome = Job("completed" if kind == "complete" else "failed", until=at + retention), "accepted"
    running = after is not None and after.status == "running"
    rows.append((job_id, event_id, kind, worker, at, outcome, after.status if after else None, after.until if running else None))
    return after, rows


def _millis(events: DataFrame) -> DataFrame:
    known = events.filter("job_id IS NOT NULL AND ts IS NOT NULL")
    return known.withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))


def history(events: DataFrame, until: int, lease: int = LEASE_SECONDS * 1000, retention: int = RETENTION_SECONDS * 1000) -> DataFrame:
    """What happened to each job up to ``until`` (milliseconds).  A job's events pass one task in order and are not held."""
    rows = _millis(events).filter(F.col("at") <= until).select(F.col("job_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), "kind", "worker", "at")
    schema = pa.schema([(n, pa.string() if n in ("kind", "worker", "outcome", "status") else pa.int64()) for n in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("job_id", "at", "event_id", "kind", "worker")), strict=True))
        out: list[tuple] = []
        for job_id, group in itertools.groupby(stream, lambda r: r[0]):
            job = None
            for _, *event in group:
                job, rows = advance(job_id, job, tuple(event), lease, retention)
                out += rows
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            out += lapsed(job_id, job, until, retention)[1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.repartition("job_id").sortWithinPartitions("job_id", "at", "event_id").mapInArrow(run, OUTPUT)


class Leases(StatefulProcessor):
    """One small state for each job, and its events that the watermark has not passed yet."""

    def __init__(self, lease: int, retention: int) -> None:
        self.lease, self.retention = lease, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, owner string, beat long, until long")
        self.held = handle.getListState("held", "at long, event_id long, kind string, worker string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at, event_id, kind, worker in zip(pdf["at"], pdf["event_id"], pdf["kind"], pdf["worker"], strict=True):
                self.held.appendValue((int(at), int(event_id), None if pd.isna(kind) else kind, None if pd.isna(worker) else worker))
        return self._passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._passed(key, timerValues.getCurrentWatermarkInMs())

    def _passed(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        """What the watermark has passed, in order; timers for what is to come."""
        job_id = int(key[0])
        job = Job(*self.job.get()) if self.job.exists() else None
        events = sorted(self.held.get(), key=lambda e: (e[0], e[1])) if self.held.exists() else []
        due, later = [e for e in events if e[0] < now], [e for e in events if e[0] >= now]
        out: list[tuple] = []
        for e in due:
            job, rows = advance(job_id, job, tuple(e), self.lease, self.retention)
            out += rows
        job, rows = lapsed(job_id, job, now, self.retention)
        out += rows
        if job is None:
            self.job.clear()
        else:
            self.job.update((job.status, job.owner, job.beat, job.until))
        if due:
            self.held.clear()
            if later:
                self.held.put([tuple(e) for e in later])
        wakes = {e[0] + 1 for e in later[:1]} | ({job.until + 1} if job is not None and job.until else set())
        for t in list(self.handle.listTimers()):
            if t not in wakes:
                self.handle.deleteTimer(t)
        for t in wakes:
            self.handle.registerTimer(max(t, now + 1))
        if out:
            frame = pd.DataFrame(out, columns=FIELDS)
            yield frame.astype({c: "Int64" for c in ("job_id", "event_id", "at", "until")})


def stream(events: DataFrame, late: str = "10 minutes", lease: int = LEASE_SECONDS * 1000, retention: int = RETENTION_SECONDS * 1000) -> DataFrame:
    """The same rows from a stream of events, each once the watermark, ``late`` behind the latest event, has passed it.

    The session's state store has to be RocksDB.
    """
    rows = _millis(events.withWatermark("ts", late)).select(F.col("job_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), "kind", "worker", "at", "ts")
    return rows.groupBy("job_id").transformWithStateInPandas(Leases(lease, retention), OUTPUT, "Append", "EventTime")
