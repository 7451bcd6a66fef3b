"""Streaming operators over events, polls and monitors, and runners that drain a stream.

State is keyed (installation, job, monitor and item, execution) and ends by a watermark on event time: windows close, and states of
single keys time out when nothing has come for their time to live. So state follows the live keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terraloom.sources.storage import shared_path, written


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a path as a stream; `ts` as an instant, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession, large: bool) -> Iterator[None]:
    """What starts within has the state store on disk that stateful processors need; the session's own setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    try:
        if large:
            spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def drain(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, large_state: bool = False) -> DataFrame:
    """Run a stream over all there is and return what it wrote.

    In `complete` mode the last batch's rows stand; in `update` mode the last row of each of the `keys`. large_state: for the
    operators of `stateful`.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    empty = spark.createDataFrame([], stream.schema)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:

        def put(batch: DataFrame, number: int) -> None:
            # a batch that is run again writes its own folder again
            batch.write.mode("overwrite").parquet(f"{out}/batch={number if mode == 'update' else 0}")

        writer = stream.writeStream.foreachBatch(put).outputMode(mode)
    with state_store(spark, large_state):
        query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        rows = spark.read.schema(stream.schema if mode == "append" else T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(out)
    except Exception as e:  # no batch ever ran
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    return rows.select(*stream.columns)


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over all there is, each batch through `each` (a batch operator), and return what that gave."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    schema = each(spark.createDataFrame([], stream.schema)).schema

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(schema).parquet(out)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def dedup(events: DataFrame, key: str = "event_id", late: str = "30 days") -> DataFrame:
    """Each id once, however often it is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def timely(events: DataFrame, now: Column, past: str = "30 days", ahead: str = "300 seconds") -> DataFrame:
    return events.where((F.col("ts") >= now - F.expr(f"interval {past}")) & (F.col("ts") <= now + F.expr(f"interval {ahead}")))


def daily_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def minute_limit(events: DataFrame, most: int = 60, late: str = "1 day") -> DataFrame:
    """Requests per user and clock minute, and how many of them are refused. A minute's state ends `late` after it."""
    d = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 minute").alias("_w")).agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("_w.start").alias("minute"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def anchored_limit(events: DataFrame, most: int = 120, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """Per client, windows that begin with its first request after the last window ended: user_id, event_id, refused.

    A client's state ends when its window has, by the watermark.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        refused = []
        for t in rows.ts.astype("datetime64[ns]").astype("int64") / 1e9:
            if n == 0 or t - begin >= seconds:
                begin, n = t, 0
            n += 1
            refused.append(n > most)
        state.update((begin, n))
        state.setTimeoutTimestamp(max(int((begin + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": rows.user_id, "event_id": rows.event_id, "refused": refused})

    d = events.withWatermark("ts", late).select("user_id", "event_id", "ts").groupBy("user_id")
    return d.applyInPandasWithState(step, "user_id long, event_id long, refused boolean", "begin double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, period: str = "1 day") -> DataFrame:
    """Approximate distinct users per period (exact ones need a batch)."""
    d = events.withWatermark("ts", period).groupBy(F.window("ts", period).alias("_w")).agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.count("*").alias("n"))
    return d.select(F.to_date("_w.start").alias("day"), "users", "n")


def first_sightings(sightings: DataFrame, keep: str = "90 days") -> DataFrame:
    """Each item of a monitor once, as long as it is seen again within `keep`. sightings: monitor, item_id, ts. State: one key an item."""
    return sightings.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["monitor", "item_id"]).select("monitor", "item_id")


def alerts(fresh: DataFrame, listed: int = 20) -> DataFrame:
    """New items of a batch by monitor: the count in full, and the first `listed` ids."""
    place = F.row_number().over(Window.partitionBy("monitor").orderBy("item_id"))
    first = fresh.withColumn("_n", place).where(F.col("_n") <= listed).groupBy("monitor").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return fresh.groupBy("monitor").agg(F.count("*").alias("found")).join(first, "monitor").select("monitor", "found", "items")


def new_items(sightings: DataFrame, name: str, listed: int = 20, keep: str = "90 days") -> DataFrame:
    """Alerts of all batches of a stream of sightings."""
    return drain_batches(first_sightings(sightings, keep), name, lambda batch: alerts(batch, listed))


def _alive(state: GroupState, last_ms: float, lease_ms: int) -> None:
    state.setTimeoutTimestamp(max(int(last_ms) + lease_ms, state.getCurrentWatermarkMs() + 1))


def download_progress(polls: DataFrame, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """Rate of every poll (job_id, seq, at, status, bytes): none after a restart or a change of status; a stalled one keeps its rate for 5 s.

    A job's state ends `keep_ms` after its last poll.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        old = state.get if state.exists else (None, 0, 0.0, 0.0, None)
        status = np.r_[np.array([old[0]], object), rows.status.to_numpy(object)]
        size = np.r_[old[1], rows.bytes.to_numpy(np.int64)]
        at = np.r_[old[2], rows["at"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e6]
        running = status[1:] == "running"
        going = running & (status[:-1] == "running") & (size[1:] >= size[:-1])
        advanced = going & (size[1:] > size[:-1])
        # last time that it moved, and the rate of the last advance since it began
        anchor = ~going | advanced
        last = np.maximum.accumulate(np.where(anchor, np.arange(1, len(at)), 0))
        moved = np.where(last > 0, at[last], old[3])
        idle = np.where(running, np.maximum(0.0, at[1:] - moved), 0.0)
        paid = advanced & (at[1:] > at[:-1])
        rate = np.full(len(going), np.nan)
        rate[paid] = (size[1:] - size[:-1])[paid] * 1000 / (at[1:] - at[:-1])[paid]
        kept = going & ~paid & (idle < 5000)  # these keep the rate before them, which stands at the last row of another kind
        own = np.maximum.accumulate(np.where(kept, 0, np.arange(1, len(at))))
        rate = np.where(own > 0, np.r_[np.nan, rate][own], np.nan if old[4] is None else old[4])
        rate[~running] = np.nan
        final = None if np.isnan(rate[-1]) else float(rate[-1])
        state.update((status[-1], int(size[-1]), float(at[-1]), float(moved[-1]), final))
        _alive(state, at[-1], keep_ms)
        yield pd.DataFrame({"job_id": key[0], "seq": rows.seq.to_numpy(), "idle_ms": idle, "rate": [None if np.isnan(x) else x for x in rate]})

    d = polls.withWatermark("at", late).groupBy("job_id")
    return d.applyInPandasWithState(step, "job_id long, seq long, idle_ms double, rate double", "status string, bytes long, at double, moved double, rate double", "append", GroupStateTimeout.EventTimeTimeout)


def settle(ledger: DataFrame) -> DataFrame:
    """Each execution settles once: the first of consume or release after its reserve stands. ledger: execution, seq, kind, micros."""
    first = ledger.where("kind in ('consume', 'release')").groupBy("execution").agg(F.min_by(F.struct("kind", "micros"), "seq").alias("_e"))
    reserved = ledger.where("kind = 'reserve'").groupBy("execution").agg(F.min_by("micros", "seq").alias("reserved"))
    j = reserved.join(first, "execution", "left")
    charged = F.when(F.col("_e.kind") == "consume", F.least("_e.micros", "reserved")).when(F.col("_e.kind") == "release", F.lit(0))
    return j.select("execution", "reserved", F.coalesce("_e.kind", F.lit("open")).alias("outcome"), charged.alias("charged"))


def settlements(ledger: DataFrame, lease: str = "1 hour", late: str = "0 seconds", shards: int = 1024) -> DataFrame:
    """settle() as a stream: a row when an execution is consumed or released, or when its lease runs out (expired, no charge).

    ledger: execution, seq, ts, kind, micros. After its end an execution is remembered for another lease, so that a second end counts for nothing.
    Rows without an execution are left out. State is kept by shard of executions, each with its own end, since a call of Python for each of them would cost more than its work:
    a shard holds the live executions divided by `shards`, and its timer is that of the first of them to end.
    """
    lease_ms = int(pd.Timedelta(lease).total_seconds() * 1000)
    names = ["execution", "reserved", "known", "done", "until"]
    out = ["execution", "reserved", "outcome", "charged"]

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        live = pd.DataFrame(dict(zip(names, (np.array(c, np.int64) for c in (state.get if state.exists else [[]] * 5)), strict=True))).set_index("execution")
        settled = []
        rows = None if state.hasTimedOut else pd.concat(list(parts))
        touched = live.index[:0] if rows is None else pd.Index(rows.execution.unique())
        # those that this batch leaves alone end by the watermark, as each would by a timer of its own
        due = (live.until < watermark) & ~live.index.isin(touched)
        gone = live[due & (live.known == 1) & (live.done == 0)]
        settled.append(pd.DataFrame({"execution": gone.index, "reserved": gone.reserved.to_numpy(), "outcome": "expired", "charged": 0}))
        live = live[~due]
        if rows is not None:
            rows = rows.sort_values(["execution", "seq"], kind="stable").reset_index(drop=True)
            old = live.reindex(rows.execution)
            known, done = (old.known == 1).to_numpy(), (old.done == 1).to_numpy()
            reserve = (rows.kind == "reserve").to_numpy()
            # the amount of the first reserve, earlier batches first, and from which row on it is there
            first = rows[reserve].drop_duplicates("execution")
            place = pd.Series(first.index, first.execution).reindex(rows.execution).to_numpy()
            amount = np.where(known, old.reserved.fillna(0).to_numpy(), first.set_index("execution").micros.reindex(rows.execution).fillna(0).to_numpy()).astype(np.int64)
            ends = rows[~reserve & ~done & (known | (np.arange(len(rows)) > np.where(np.isnan(place), np.inf, place)))].drop_duplicates("execution")
            paid = amount[ends.index]
            charged = np.where(ends.kind == "consume", np.minimum(ends.micros, paid), 0)
            settled.append(pd.DataFrame({"execution": ends.execution, "reserved": paid, "outcome": ends.kind, "charged": charged}))
            latest = rows.ts.astype("datetime64[ns]").astype("int64").groupby(rows.execution).max() // 1_000_000 + lease_ms
            at = rows.drop_duplicates("execution", keep="first").index
            seen = pd.DataFrame({"reserved": amount[at], "known": (known | ~np.isnan(place))[at].astype(np.int64), "done": done[at].astype(np.int64)}, index=rows.execution[at].to_numpy())
            seen.loc[ends.execution, "done"] = 1
            seen["until"] = np.maximum(latest.reindex(seen.index).to_numpy(), watermark + 1)
            live = pd.concat([live[~live.index.isin(touched)], seen])
        if len(live):
            state.update((live.index.tolist(), *[live[c].astype(np.int64).tolist() for c in names[1:]]))
            state.setTimeoutTimestamp(max(int(live.until.min()), watermark + 1))
        elif state.exists:
            state.remove()
        made = pd.concat(settled, ignore_index=True)[out]
        if len(made):
            yield made

    d = ledger.withWatermark("ts", late).where("execution is not null").select(F.pmod(F.xxhash64("execution"), F.lit(shards)).alias("_shard"), "execution", "seq", "ts", "kind", "micros").groupBy("_shard")
    kept = ", ".join(f"{c} array<long>" for c in names)
    return d.applyInPandasWithState(step, "execution long, reserved long, outcome string, charged long", kept, "append", GroupStateTimeout.EventTimeTimeout)


def expired_leases(work: DataFrame, now: Column, lease: str) -> DataFrame:
    """Running work whose lease, counted from its last sign of life, has ended by now: released at no charge."""
    last = work.groupBy("job_id").agg(F.max_by(F.struct("status", "at"), "seq").alias("_l"))
    return last.where((F.col("_l.status") == "running") & (F.col("_l.at") + F.expr(f"interval {lease}") <= now)).select("job_id", F.lit("released").alias("outcome"), F.lit(0).alias("charged"))


def ttl_valid(entries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return entries.where(F.col("at") > now - F.expr(f"interval {days} days"))


def append_events(stream: DataFrame, path: str, key: str = "event_id", ts: str = "ts", then: Callable[[DataFrame], None] | None = None) -> None:
    """Append valid events once per id to a table partitioned by `day`; a retried batch adds nothing.

    An id's event has one time, so a batch is compared with the table's partitions of its own days only. then: called after each batch.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("day", F.to_date(ts)).dropDuplicates([key])
        try:
            days = [r[0] for r in fresh.select("day").distinct().collect()]  # of one batch
            there = spark.read.parquet(path).where(F.col("day").isin(days)).select(key)
            fresh = fresh.join(there, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").partitionBy("day").parquet(path)
        if then is not None:
            then(batch)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_path(spark, "append-checkpoint")).trigger(availableNow=True).start().awaitTermination()


def prune(spark: SparkSession, path: str, now: dt.datetime, days: int = 90, ts: str = "ts") -> None:
    """Take events older than `days` before `now` off a table partitioned by `day`.

    Days that are wholly past are dropped as partitions; the day of the limit is written anew with the rows that stay, alone, by a dynamic
    overwrite. Events at the limit itself stay. Running it again changes nothing.
    """
    limit = now - dt.timedelta(days=days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    found = [(f.getPath(), f.getPath().getName()[4:]) for f in files.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("day=")]
    own = limit.date().isoformat()
    if own in {day for _, day in found}:
        events = spark.read.parquet(path)
        kept = written(events.where((F.col("day") == F.lit(own).cast("date")) & (F.col(ts) >= F.lit(limit))), "retained")
        if kept.take(1):
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        else:
            found = [(p, "" if day == own else day) for p, day in found]
    for place, day in found:
        if day < own and day[:2] != "__":  # a day without a date (null) stays
            files.delete(place, True)


def keep_events(stream: DataFrame, path: str, now: dt.datetime | None = None, days: int = 90, key: str = "event_id", ts: str = "ts") -> None:
    """append_events() with retention: after each batch, what is older than `days` before `now` (the batch's last event, if not given) is gone."""
    append_events(stream, path, key, ts, lambda batch: prune(batch.sparkSession, path, now or batch.agg(F.max(ts)).first()[0] or dt.datetime.min + dt.timedelta(days=days), days, ts))
