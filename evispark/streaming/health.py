"""Provider health and job states: batch definitions and their streaming twins.

The batch form takes "now" as a value, so that results can be repeated; the streaming form uses event-time windows with a
watermark, and keeps one small state for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_SECONDS, LEAST_FAILURES, LEAST_RATE, COOLDOWN_SECONDS = 3600, 3, 0.3, 120
#: The states that a job may enter from each state.
TRANSITIONS = {"queued": ["running", "cancelled"], "running": ["completed", "failed", "cancelled", "queued"], "failed": ["queued"], "completed": [], "cancelled": ["queued"]}


def stats(calls: DataFrame, now: Column) -> DataFrame:
    """Successes, failures, success rate and mean latency of each provider (provider, ts, success, latency_ms) in the window."""
    recent = calls.filter((F.col("ts") <= now) & (F.col("ts") >= now - F.expr(f"INTERVAL {WINDOW_SECONDS} SECONDS")))
    return recent.groupBy("provider").agg(
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        (F.count_if("success") / F.count("*")).alias("rate"), F.avg("latency_ms").alias("latency_ms"), F.max(F.when(~F.col("success"), F.col("ts"))).alias("last_failure"),
    )


def should_skip(stats_: DataFrame, now: Column) -> DataFrame:
    """(provider, skip): many failures, a low rate, and the last failure is fresh."""
    fresh = F.col("last_failure") > now - F.expr(f"INTERVAL {COOLDOWN_SECONDS} SECONDS")
    return stats_.select("provider", ((F.col("failures") >= LEAST_FAILURES) & (F.col("rate") < LEAST_RATE) & F.coalesce(fresh, F.lit(False))).alias("skip"))


def reorder(plan: DataFrame, stats_: DataFrame) -> DataFrame:
    """plan (provider, pos) with unhealthy providers last, then by rate; unknown ones count as healthy."""
    j = plan.join(stats_, "provider", "left")
    bad = F.coalesce((F.col("failures") >= LEAST_FAILURES) & (F.col("rate") < 0.5), F.lit(False))
    return j.select("provider", "pos", F.coalesce("rate", F.lit(1.0)).alias("rate"), bad.alias("unhealthy")).orderBy("unhealthy", F.desc("rate"), "pos")


def sliding_rates(calls: DataFrame) -> DataFrame:
    """For each call: calls and failures of its provider in the window that ends with it."""
    w = Window.partitionBy("provider").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-WINDOW_SECONDS * 1_000_000, 0)
    return calls.withColumn("n", F.count("*").over(w)).withColumn("failures", F.count_if(~F.col("success")).over(w))


def streaming_stats(calls: DataFrame, slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rates in sliding event-time windows of a stream of calls."""
    win = F.window("ts", f"{WINDOW_SECONDS} seconds", slide).alias("win")
    return calls.withWatermark("ts", late).groupBy("provider", win).agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))


def violations(events: DataFrame, key: str, order: list[str], status: str, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """State changes (key, previous, status) that the table does not allow; staying in a state is allowed."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = [F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to]
    step = F.concat_ws(">", F.col("previous"), F.col(status))
    moved = events.withColumn("previous", F.lag(status).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))
    return moved.filter(~F.array_contains(F.array(*pairs), step)).select(key, *order, "previous", F.col(status))


def job_states(events: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """A stream (job_id, status, ts) to (job_id, status, accepted): each job's state machine, one state a job.

    An event that the table does not allow from the job's state is reported and changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        for pdf in frames:
            rows = []
            for status in pdf.sort_values("ts", kind="stable")["status"]:
                ok = current is None or status == current or status in allowed.get(current, ())
                current = status if ok else current
                rows.append((key[0], status, ok))
            yield pd.DataFrame(rows, columns=["job_id", "status", "accepted"])
        state.update((current,))

    out = "job_id long, status string, accepted boolean"
    return events.groupBy("job_id").applyInPandasWithState(step, out, "status string", "append", GroupStateTimeout.NoTimeout)
