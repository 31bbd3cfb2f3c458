"""Leases: worked cases, the stream against its batch twin over files in several orders, and the registered query."""

import random

import pytest

from evispark.streaming import leases as L

SCHEMA = "job_id long, event_id long, worker string, kind string, ts timestamp"


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


BASE = 1_704_067_200_000


def rows(frame):
    return sorted((r["job_id"], r["at"] - BASE, r["event_id"] or -1, r["kind"], r["worker"] or "", r["outcome"], r["status"] or "", (r["until"] or BASE) - BASE) for r in frame.collect())


def test_worked_cases(spark):
    events = [
        (1, 1, None, "enqueue", at(0)), (1, 2, "a", "claim", at(10)), (1, 3, "b", "claim", at(11)), (1, 4, "a", "heartbeat", at(60)), (1, 5, "a", "heartbeat", at(60)), (1, 6, "b", "heartbeat", at(70)),
        (1, 7, "a", "complete", at(180)), (1, 8, "a", "heartbeat", at(181)), (2, 9, None, "enqueue", at(0)), (2, 10, "a", "claim", at(5)), (2, 11, "a", "heartbeat", at(126)), (2, 12, None, "enqueue", at(130)),
        (2, 13, "b", "claim", at(140)), (3, 14, "a", "complete", at(1)), (None, 15, "a", "claim", at(1)), (3, 16, "a", "odd", at(2)),
    ]
    got = [(j, t // 1000, e, k, o, s) for j, t, e, k, _, o, s, _ in rows(L.history(spark.createDataFrame(events, SCHEMA), BASE + 300_000))]
    assert got == [
        (1, 0, 1, "enqueue", "accepted", "queued"), (1, 10, 2, "claim", "accepted", "running"), (1, 11, 3, "claim", "rejected", "running"), (1, 60, 4, "heartbeat", "accepted", "running"), (1, 60, 5, "heartbeat", "duplicate", "running"),
        (1, 70, 6, "heartbeat", "rejected", "running"), (1, 180, 7, "complete", "accepted", "completed"), (1, 181, 8, "heartbeat", "rejected", "completed"), (2, 0, 9, "enqueue", "accepted", "queued"),
        (2, 5, 10, "claim", "accepted", "running"), (2, 125, -1, "expire", "expired", "failed"), (2, 126, 11, "heartbeat", "rejected", "failed"), (2, 130, 12, "enqueue", "accepted", "queued"), (2, 140, 13, "claim", "accepted", "running"),
        (2, 260, -1, "expire", "expired", "failed"), (3, 1, 14, "complete", "rejected", ""), (3, 2, 16, "odd", "rejected", ""),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_its_batch_twin(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.randint(1, 6), i, rng.choice(["a", "a", "b", None]), rng.choice(["enqueue", "claim", "heartbeat", "heartbeat", "heartbeat", "complete", "fail"]), at(rng.randint(0, 1500))) for i in range(160)]
    # Files hold neighbours in time, shuffled within the ten minutes that the watermark allows.
    events.sort(key=lambda e: e[4].timestamp() + rng.uniform(0, 250))
    last = [(99, 1000, None, "enqueue", at(6000)), (99, 1001, None, "enqueue", at(6001))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, part in enumerate([events[:60], events[60:110], events[110:], last[:1], last[1:]]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = L.stream(source, "10 minutes", retention=300_000).writeStream.format("memory").queryName(f"leases{seed}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(240)
        got = [r for r in rows(spark.table(f"leases{seed}")) if r[0] != 99]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = rows(L.history(spark.createDataFrame(events, SCHEMA), BASE + 5_400_000, retention=300_000))
    assert got == want
    assert {"accepted", "rejected", "expired"} <= {r[5] for r in want}
