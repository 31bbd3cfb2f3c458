"""Queries of jobs held by lease: each user's events as those of a job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import leases as L
from .catalog import Tables, query

LEASE, RETENTION, END = 12 * 3_600_000, 24 * 3_600_000, 1_800_000_000_000
KIND = "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'fail' ELSE 'heartbeat' END WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'complete' ELSE 'claim' END WHEN event_type = 'signup' THEN 'enqueue' WHEN event_type = 'view' THEN 'claim' ELSE 'heartbeat' END"


@query(
    "l16_lease_history",
    f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id, {KIND} AS kind, 'w' || (event_id % 2) AS worker, (epoch_us(ts) // 1000) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
    s AS (
        SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS kind, '' AS worker, CAST(0 AS BIGINT) AS tm, '' AS outcome, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS beat, CAST(0 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS ran_out, '' AS left_by FROM e
        UNION ALL
        SELECT job_id, n, event_id, kind, worker, tm, outcome, CASE WHEN outcome <> 'accepted' THEN st WHEN kind = 'enqueue' THEN 'queued' WHEN kind = 'complete' THEN 'completed' WHEN kind = 'fail' THEN 'failed' ELSE 'running' END,
               CASE WHEN outcome = 'accepted' AND kind = 'claim' THEN worker WHEN outcome = 'accepted' AND kind <> 'heartbeat' THEN NULL ELSE owner END, CASE WHEN outcome = 'accepted' THEN tm ELSE beat END,
               CASE WHEN outcome <> 'accepted' THEN un WHEN kind IN ('claim', 'heartbeat') THEN tm + {LEASE} WHEN kind = 'enqueue' THEN 0 ELSE tm + {RETENTION} END, ran_out, left_by
        FROM (SELECT *, CASE WHEN kind = 'enqueue' AND (st IS NULL OR st = 'failed') THEN 'accepted' WHEN kind = 'claim' AND st = 'queued' THEN 'accepted' WHEN kind = 'heartbeat' AND owns THEN CASE WHEN tm <= beat THEN 'duplicate' ELSE 'accepted' END
                               WHEN kind IN ('complete', 'fail') AND owns THEN 'accepted' ELSE 'rejected' END AS outcome
              FROM (SELECT *, coalesce(st = 'running' AND worker = owner, FALSE) AS owns
                    FROM (SELECT *, CASE WHEN st1 IN ('completed', 'failed') AND un1 < tm THEN NULL ELSE st1 END AS st, CASE WHEN st1 IN ('completed', 'failed') AND un1 < tm THEN 0 ELSE un1 END AS un
                          FROM (SELECT e.*, s.owner, s.beat, CASE WHEN s.status = 'running' AND s.until < e.tm THEN 'failed' ELSE s.status END AS st1, CASE WHEN s.status = 'running' AND s.until < e.tm THEN s.until + {RETENTION} ELSE s.until END AS un1,
                                       CASE WHEN s.status = 'running' AND s.until < e.tm THEN s.until END AS ran_out, s.owner AS left_by FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1))))
    ), z AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS back FROM s)
    SELECT job_id, event_id, kind, worker, tm AS "at", outcome, status, CASE WHEN status = 'running' THEN until END AS until FROM s WHERE n > 0
    UNION ALL SELECT job_id, NULL, 'expire', left_by, ran_out, 'expired', 'failed', NULL FROM s WHERE ran_out IS NOT NULL
    UNION ALL SELECT job_id, NULL, 'expire', owner, until, 'expired', 'failed', NULL FROM z WHERE back = 1 AND status = 'running' AND until < {END}""",
)
def _(t: Tables):
    e = t.events.select(F.col("user_id").alias("job_id"), "event_id", F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), F.expr(KIND).alias("kind"), "ts")
    return L.history(e, END, LEASE, RETENTION)
