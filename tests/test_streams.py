"""Streams over several batches, with duplicates, and against plain loops."""

import datetime as dt

from pyspark.sql import functions as F

from terraloom.sources.storage import shared_path
from terraloom.streaming import operators as St
from terraloom.streaming import stateful as Sf


def several_batches(spark, rows, schema, parts=3):
    path = shared_path(spark, "stream-in")
    df = spark.createDataFrame(rows, schema)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_anchored_limit_in_one_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, k, t0 + dt.timedelta(seconds=k * (7 + u) % 500)) for u in range(3) for k in range(40)]
    rows = [(u, u * 100 + k, t) for k, (u, _, t) in enumerate(rows)]
    got = {r.event_id: r.refused for r in St.drain(St.anchored_limit(several_batches(spark, rows, "user_id long, event_id long, ts timestamp", 1), 4, 60), "anchored").collect()}
    want = {}
    for user in range(3):
        begin, n = None, 0
        for _, e, t in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            if begin is None or (t - begin).total_seconds() >= 60:
                begin, n = t, 0
            n += 1
            want[e] = n > 4
    assert got == want and any(want.values())


def test_dedup_and_append_over_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 20, "a", t0 + dt.timedelta(minutes=k)) for k in range(60)]
    stream = several_batches(spark, rows, "event_id long, event_type string, ts timestamp")
    assert sorted(r.event_id for r in St.drain(St.dedup(stream).select("event_id"), "dedup").collect()) == list(range(20))
    path = shared_path(spark, "append-out")
    for _ in range(2):  # a second run adds nothing
        St.append_events(several_batches(spark, rows, "event_id long, event_type string, ts timestamp"), path)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == list(range(20))


def test_new_items_over_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(m, i, t0) for m in (1, 2) for i in (5, 6, 5, 7, 6, 30 + m)]
    found = St.new_items(several_batches(spark, rows, "monitor long, item_id long, ts timestamp"), "new", listed=2).collect()
    assert {m: sum(r.found for r in found if r.monitor == m) for m in (1, 2)} == {1: 4, 2: 4}
    assert all(len(r["items"]) == min(2, r.found) for r in found)


def test_completions_of_watched_jobs_and_again_after_a_retry(spark):
    t0 = dt.datetime(2024, 1, 1)
    digest = "aB" * 32
    way = ["queued", "running", "failed", "succeeded", "queued", "succeeded", "interrupted"]
    rows = [(j, s, t0 + dt.timedelta(seconds=4 * s), way[s] if j else "running", 7 if j == 1 else None, digest if j == 2 else "x") for s in range(7) for j in range(3)]
    rows += [(9, 0, t0, "succeeded", 7, digest), (8, 0, t0, "paused", 7, None), (8, 1, t0, "cancelled", 7, None)]
    schema = "job_id long, seq long, ts timestamp, status string, bytes long, sha256 string"
    for parts in (1, 7):  # in one batch, and a batch for each step
        ordered = sorted(rows, key=lambda r: r[1])
        path = shared_path(spark, "stream-in")
        for k in range(parts):
            own = [r for r in ordered if parts == 1 or r[1] == k]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        done = St.drain(Sf.completions(stream), "done", large_state=True).collect()
        if parts == 1:
            got = sorted((r.job_id, r.seq, r.name, r.result, r.duration, r.bytes, r.validated) for r in done if r.job_id == 1)
            assert got == [(1, 2, "download_failed", "error", "3_10s", "lt_1mib", False), (1, 5, "download_completed", "success", "3_10s", "lt_1mib", False)]
            assert sorted((r.seq, r.bytes, r.validated) for r in done if r.job_id == 2) == [(2, None, False), (5, None, True)]
        assert {r.job_id for r in done} == {1, 2}


def test_look_ups_over_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 2, k, t0 + dt.timedelta(days=k)) for k in range(20)]
    got = {r.seq: r.hit for r in St.drain(Sf.ttl_lookup(several_batches(spark, rows, "key long, seq long, ts timestamp", 1)), "ttl", large_state=True).collect()}
    assert got == {k: k // 2 % 4 != 0 for k in range(20)}


def test_retention_drops_days(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, "a", t0 + dt.timedelta(hours=12 * k)) for k in range(30)]
    schema = "event_id long, event_type string, ts timestamp"
    path = shared_path(spark, "kept")
    St.keep_events(several_batches(spark, rows, schema), path, t0 + dt.timedelta(days=10, hours=12), 4)
    kept = spark.read.parquet(path)
    assert sorted(r.event_id for r in kept.collect()) == list(range(13, 30))
    assert min(r.day for r in kept.select("day").distinct().collect()) == dt.date(2024, 1, 7)
    St.prune(spark, path, t0 + dt.timedelta(days=10, hours=12), 4)
    assert spark.read.parquet(path).count() == 17
    St.prune(spark, path, t0 + dt.timedelta(days=18, hours=12), 4)  # the last event is at the limit itself
    assert [r.event_id for r in spark.read.parquet(path).collect()] == [29]
    St.prune(spark, path, t0 + dt.timedelta(days=18, hours=12, seconds=1), 4)
    assert spark.read.schema(schema).parquet(path).count() == 0
    St.prune(spark, shared_path(spark, "nothing"), t0)


def test_update_mode_keeps_keys_of_earlier_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 3, t0 + dt.timedelta(seconds=k)) for k in range(9)] + [(7, t0)]
    stream = several_batches(spark, rows, "user_id long, ts timestamp", 5)
    got = {r.user_id: r.n for r in St.drain(St.minute_limit(stream, 1), "minutes", "update", ["user_id", "minute"]).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 7: 1}


def test_leases_end_by_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    work = [(1, 1, t0, "running"), (2, 2, t0, "running"), (2, 3, t0 + dt.timedelta(hours=30), "running"), (3, 4, t0, "done"), (4, 5, t0 + dt.timedelta(hours=31), "running"), (5, 6, t0 + dt.timedelta(hours=19), "running"), (6, 7, t0 + dt.timedelta(hours=19, milliseconds=1), "running")]
    got = St.drain(Sf.lease_releases(several_batches(spark, work, "job_id long, seq long, at timestamp, status string", 1)), "leases", large_state=True).collect()
    assert sorted(r.job_id for r in got) == [1, 5]  # 19 h plus the lease is the watermark itself
    ledger = [(1, 1, t0, "reserve", 10), (1, 2, t0, "consume", 70), (1, 3, t0, "consume", 9), (2, 4, t0, "reserve", 5), (3, 5, t0 + dt.timedelta(hours=5), "reserve", 4)]
    got = St.drain(St.settlements(several_batches(spark, ledger, "execution long, seq long, ts timestamp, kind string, micros long", 1)), "settled").collect()
    assert sorted(map(tuple, got)) == [(1, 10, "consume", 10), (2, 5, "expired", 0)]


def test_leases_and_settlement(spark):
    t0 = dt.datetime(2024, 1, 1)
    work = spark.createDataFrame([(1, 1, "running", t0), (2, 1, "running", t0 + dt.timedelta(hours=5)), (3, 1, "running", t0), (3, 2, "done", t0)], "job_id long, seq long, status string, at timestamp")
    assert [r.job_id for r in St.expired_leases(work, F.lit(t0 + dt.timedelta(hours=6)), "2 hours").collect()] == [1]
    assert sorted(r.job_id for r in St.expired_leases(work, F.lit(t0 + dt.timedelta(hours=7)), "2 hours").collect()) == [1, 2]
    ledger = spark.createDataFrame([(1, 1, "reserve", 10), (1, 2, "consume", 7), (1, 3, "consume", 9), (2, 1, "reserve", 5), (2, 2, "release", 0), (3, 1, "reserve", 4)], "execution long, seq long, kind string, micros long")
    assert sorted((r.execution, r.outcome, r.charged) for r in St.settle(ledger).collect()) == [(1, "consume", 7), (2, "release", 0), (3, "open", None)]


def test_settlements_by_shard_are_those_by_execution(spark):
    t0 = dt.datetime(2024, 1, 1)
    ledger = [(k % 60, k, t0 + dt.timedelta(minutes=k * 7 % 900 + (k % 3) * 200), ("reserve", "consume", "release", "consume")[k * 5 // 7 % 4], k * 31 % 100) for k in range(600)]
    schema = "execution long, seq long, ts timestamp, kind string, micros long"
    by = [sorted(map(tuple, St.drain(St.settlements(several_batches(spark, ledger, schema), late="2 hours", shards=n), "settled").collect())) for n in (1, 1_000_000)]
    assert by[0] == by[1] and {r[2] for r in by[0]} >= {"consume", "release"}
    alone = [(1, 1, t0, "reserve", 5), (2, 2, t0, "reserve", 6), (2, 3, t0, "consume", 9), (3, 4, t0 + dt.timedelta(hours=5), "consume", 1)]
    got = St.drain(St.settlements(several_batches(spark, alone, schema, 1), shards=1), "settled").collect()
    assert sorted(map(tuple, got)) == [(1, 5, "expired", 0), (2, 6, "consume", 6)]


def test_timed_states_by_shard_are_those_by_key(spark):
    """Keys share a call of Python and a state by shard; each still has its own end, a null key too."""
    t0 = dt.datetime(2024, 1, 1)
    way = ["queued", "running", "succeeded", "paused", "failed", "running", "cancelled"]
    rows = [(None if k // 20 == 3 else k // 20, k, t0 + dt.timedelta(hours=k // 4), way[k * 11 // 4 % 7], k, "ab" * 32) for k in range(800)]
    several = lambda: several_batches(spark, rows, "job_id long, seq long, ts timestamp, status string, bytes long, sha256 string")
    state = lambda d: sorted(map(str, St.drain(d, "shards", large_state=True).collect()))
    streams = [
        lambda n: Sf.completions(several(), "100 hours", 40 * 3_600_000, n),
        lambda n: Sf.lease_releases(several().withColumnRenamed("ts", "at").withColumn("status", F.expr("if(coalesce(job_id, 0) % 2 = 0, 'running', status)")), "20 hours", "100 hours", n),
        lambda n: Sf.ttl_lookup(several().withColumnRenamed("job_id", "key"), 1, "100 hours", n),
    ]
    for stream in streams:
        one = state(stream(1))
        assert one == state(stream(1_000_000)) and len(one) > 3 and any("=None" in r for r in one)
    alone = [(1, 1, t0), (2, 2, t0), (1, 3, t0 + dt.timedelta(hours=24) - dt.timedelta(milliseconds=1)), (2, 4, t0 + dt.timedelta(hours=24)), (None, 5, t0), (None, 6, t0 + dt.timedelta(hours=1))]
    got = St.drain(Sf.ttl_lookup(several_batches(spark, alone, "key long, seq long, ts timestamp", 1), 1, shards=1), "ttl", large_state=True)
    assert {r.seq: (r.key, r.hit) for r in got.collect()} == {1: (1, False), 2: (2, False), 3: (1, True), 4: (2, False), 5: (None, False), 6: (None, True)}
