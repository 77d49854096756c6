"""Live guard against a self-join, replays, and orphans with an owner in time, late and never."""

import datetime
import random

from pyspark.sql import functions as F

from rookery.operators import windows
from rookery.streaming import jobs

T0 = 1_704_067_200_000_000  # 2024-01-01
HOUR = windows.HOUR


def brute(rows):
    """{id: (last_hour, running)} of (id, type, begin, end, skipped)."""
    live = [r for r in rows if not r[4]]
    return {
        i: (sum(k == kind and t - HOUR <= s <= t for _, k, s, _, _ in live), sum(k == kind and j != i and s <= t < e for j, k, s, e, _ in live)) for i, kind, t, _, _ in rows
    }


def some_runs(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + rng.randrange(6 * HOUR // 1_000_000) * 1_000_000  # whole seconds: ties happen
        rows.append((i, rng.choice("xxxy"), t, t + rng.choice([0, 1, 60, 1800, 3600, 9000]) * 1_000_000, rng.random() < 0.2))
    return rows


def test_rate_guard_equals_self_join(spark):
    rows = some_runs(400, 1)
    df = spark.createDataFrame([(i, k, "SKIPPED" if s else "DONE", t, e) for i, k, t, e, s in rows], "id long, agent_type string, status string, t long, e long")
    assert {r["id"]: (r["last_hour"], r["running"]) for r in windows.rate_guard(df).collect()} == brute(rows)


def test_sweep_equals_self_join():
    rows = some_runs(300, 2)
    for kind in "xy":
        own = [(t, e, i, s) for i, k, t, e, s in rows if k == kind]
        want = brute(rows)
        assert {i: (n, c) for i, n, c in jobs.swept(own, 0, 2 * T0)} == {i: want[i] for _, _, i, _ in own}


def test_live_guard_ignores_runs_that_come_again(spark, tmp_path):
    rows = some_runs(120, 3)
    schema = "ts timestamp, id long, event_type string, t long, e long, skipped boolean"
    data = [(datetime.datetime.fromtimestamp(t / 1e6), i, k, t, e, s) for i, k, t, e, s in rows]
    end = T0 + 40 * HOUR
    data.append((datetime.datetime.fromtimestamp(end / 1e6), 999, "z", end, end, False))  # moves the watermark on
    for name, part in (("a", data[:60]), ("b", data[:60] + data[60:])):  # the first half is delivered twice
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/*")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    got = jobs.run_once(jobs.live_guard(stream), "append").collect()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert len(got) == len(rows) and {r["id"]: (r["last_hour"], r["running"]) for r in got} == brute(rows)


def test_orphans(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    schema = "object_id long, ts timestamp"
    objects = [(1, day(0)), (2, day(0)), (3, day(0)), (4, day(1)), (5, day(50)), (6, day(80))]
    owners = [(1, day(3)), (2, day(31)), (4, day(31)), (9, day(90))]  # in time, too late, never, on the last day
    for name, rows in (("o", objects), ("w", owners)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    got = {r["object_id"] for r in jobs.run_once(jobs.orphan_expiry(read("o"), read("w")), "append").collect()}
    assert got == {2, 3}  # 5 and 6 still wait when the streams end at day 80
