"""Streams whose keys hold state of their own and end by event-time timers: completions, leases, look-ups.

State is kept by shard of keys: a call of Python and a state of its own for each key cost more than the key's work. A shard holds its live keys, each
with its own end, and its timer is that of the first of them to end. Of many keys, `drain(..., large_state=True)` keeps the states on disk.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terraloom.functions import text as X

TERMINAL = ("succeeded", "failed", "cancelled", "interrupted")
WATCHED = ("queued", "running")
_DIGEST = re.compile("[0-9a-fA-F]{64}")
#: parts that the keys of a stream are dealt to
SHARDS = 1024


def _ms(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[ns]").astype("int64").to_numpy() // 1_000_000


def _sharded(rows: DataFrame, key: str, fields: str, out: str, turn, expired, shards: int) -> DataFrame:
    """Rows through `turn` with state for each key, kept by shard of keys, so that a call of Python serves many keys.

    fields: the state of a key, `name type, ...`, of which `until` is the last millisecond of its watermark's time. turn(rows, live): `rows` of
    whole keys of this batch with the key as text `_k`, `live` their states by `_k`; it returns their new states and a frame to emit. After that
    all states end whose `until` the watermark is past; expired(states) tells what that emits. `out` begins with `_k`, whose own type comes back.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    types = [f.split()[1] for f in fields.split(", ")]
    kinds = {"long": np.int64, "string": object}

    def step(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = state.get if state.exists else [[]] * (1 + len(names))
        live = pd.DataFrame({n: np.array(c, kinds[t]) for n, t, c in zip(names, types, held[1:], strict=True)}, index=pd.Index(held[0], dtype=object))
        batch = None if state.hasTimedOut else pd.concat(list(parts), ignore_index=True)
        made = []
        if batch is not None:
            touched = live.index.isin(batch["_k"].unique())
            now, emitted = turn(batch, live[touched])
            made.append(emitted)
            kept = [x for x in (live[~touched], now) if len(x)]
            live = pd.concat(kept) if kept else live[:0]
        due = (live.until < watermark).to_numpy()
        made.append(expired(live[due]))
        live = live[~due]
        if len(live):
            state.update((live.index.tolist(), *[live[n].tolist() for n in names]))
            state.setTimeoutTimestamp(max(int(live.until.min()), watermark, 1))
        elif state.exists:
            state.remove()
        for x in made:
            if x is not None and len(x):
                yield x

    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a null key is a key
    keyed = rows.select(text.alias("_k"), *[c for c in rows.columns if c != key]).withColumn("_shard", F.pmod(F.xxhash64("_k"), F.lit(shards)))
    kept = ", ".join(["_k array<string>", *[f"{n} array<{t}>" for n, t in zip(names, types, strict=True)]])
    done = keyed.groupBy("_shard").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    own = F.when(F.col("_k") != "", F.expr("substring(_k, 2)")).cast(rows.schema[key].dataType).alias(key)
    return done.select(own, *done.columns[1:])


def completions(changes: DataFrame, late: str = "1 day", keep_ms: int = 30 * 86_400_000, shards: int = SHARDS) -> DataFrame:
    """A row each time a watched job reaches a terminal status: job_id, seq, name, outcome, result, duration, bytes, validated.

    changes: job_id, seq, ts, status, bytes, sha256, and `kind` (a download where it is null or not there). A queued or running row begins a
    watch; its end forgets the job, and a retry, queued or running again, begins another. Ends without a watch count for nothing. `duration` and
    `bytes` are buckets, bytes null where they aren't known; a job that succeeded with a digest that is one is `validated`. What is watched
    is forgotten `keep_ms` after the last change.
    """
    kind = F.coalesce("kind", F.lit("download")) if "kind" in changes.columns else F.lit("download")
    rows = changes.withWatermark("ts", late).select("job_id", "seq", "ts", "status", F.col("bytes").cast("bigint").alias("bytes"), "sha256", kind.alias("kind"))

    def turn(d: pd.DataFrame, live: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        d = d.sort_values(["_k", "seq"], kind="stable").reset_index(drop=True)
        at, key = _ms(d.ts), d["_k"].to_numpy()
        ended, watched = d.status.isin(TERMINAL).to_numpy(), d.status.isin(WATCHED).to_numpy()
        opens = np.r_[True, key[1:] != key[:-1]]
        # a stretch of a job ends with its terminal row, and is watched from its first watched one, or from an earlier batch on
        begin = np.flatnonzero(opens | np.r_[False, ended[:-1]])
        stretch = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(d)]))
        known, since = np.zeros(len(begin), bool), np.zeros(len(begin), np.int64)
        seen = np.flatnonzero(watched)[::-1]
        known[stretch[seen]], since[stretch[seen]] = True, at[seen]
        old = live.reindex(key[opens])
        carried = old.since.notna().to_numpy()
        top = stretch[opens][carried]
        known[top], since[top] = True, old.since[carried].astype(np.int64)
        last = np.maximum(np.maximum.reduceat(at, np.flatnonzero(opens)), np.where(carried, old.until.fillna(0).astype(np.int64) - keep_ms + 1, at[opens]))
        done = np.flatnonzero(ended & known[stretch])
        e = d.iloc[done]
        whole = e.sha256.map(lambda s: isinstance(s, str) and _DIGEST.fullmatch(s) is not None).to_numpy(bool)
        made = {"_k": e["_k"], "seq": e.seq, "outcome": e.status, "duration_ms": at[done] - since[stretch[done]], "bytes": e.bytes.astype("Int64"), "validated": (e.status == "succeeded").to_numpy() & whole, "kind": e.kind}
        ends = np.r_[np.flatnonzero(opens)[1:], len(d)] - 1
        still = ~ended[ends] & known[stretch[ends]]
        now = pd.DataFrame({"since": since[stretch[ends]][still], "until": last[still] + keep_ms - 1}, index=key[ends][still])
        return now, pd.DataFrame(made)

    out = _sharded(rows, "job_id", "since long, until long", "_k string, seq long, outcome string, duration_ms long, bytes long, validated boolean, kind string", turn, lambda gone: None, shards)
    result = F.when(F.col("outcome") == "succeeded", "success").when(F.col("outcome") == "failed", "error").otherwise("cancelled")
    ending = F.when(F.col("outcome") == "succeeded", "_completed").when(F.col("outcome") == "failed", "_failed").otherwise("_cancelled")
    name = F.concat(F.when(F.col("kind") == "download", "download").otherwise("operation"), ending)
    return out.select("job_id", "seq", name.alias("name"), "outcome", result.alias("result"), X.bucket_duration(F.col("duration_ms")).alias("duration"), F.when(F.col("bytes") >= 0, X.bucket_bytes(F.col("bytes"))).alias("bytes"), "validated")


def lease_releases(work: DataFrame, lease: str = "12 hours", late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """Running work is released at no charge once the watermark reaches its last sign of life plus the lease: job_id, outcome, charged.

    work: job_id, seq, at, status; the row of the greatest seq is the last sign of life.
    """
    ms = int(pd.Timedelta(lease).total_seconds() * 1000)

    def turn(d: pd.DataFrame, live: pd.DataFrame) -> tuple[pd.DataFrame, None]:
        d = d.sort_values(["_k", "seq"], kind="stable").drop_duplicates("_k", keep="last")
        now = pd.DataFrame({"status": d.status.to_numpy(), "seq": d.seq.to_numpy(np.int64), "until": _ms(d["at"]) + ms - 1}, index=d["_k"].to_numpy())
        newer = live[live.seq > now.seq.reindex(live.index)]
        return pd.concat([now.drop(newer.index), newer]) if len(newer) else now, None

    def expired(gone: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_k": gone.index[gone.status == "running"], "outcome": "released", "charged": 0})

    rows = work.withWatermark("at", late).select("job_id", "seq", "at", "status")
    return _sharded(rows, "job_id", "status string, seq long, until long", "_k string, outcome string, charged int", turn, expired, shards)


def ttl_lookup(requests: DataFrame, days: int = 7, late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """Whether each request (key, seq, ts) finds an entry that is younger than `days`; a miss makes one, which ends by its timer."""
    keep = days * 86_400_000

    def turn(d: pd.DataFrame, live: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        d = d.sort_values(["_k", "ts", "seq"], kind="stable").reset_index(drop=True)
        at, key = _ms(d.ts).tolist(), d["_k"].to_numpy()
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
        old = dict(zip(live.index, live.made.tolist(), strict=True))
        misses, made = [], []
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            entry = old.get(key[begin])
            i = begin if entry is None else bisect_left(at, entry + keep, begin, end)
            while i < end:  # one turn per entry that is made
                misses.append(i)
                entry = at[i]
                i = bisect_left(at, entry + keep, i + 1, end)
            made.append(entry)
        hit = np.ones(len(d), bool)
        hit[misses] = False
        made = np.array(made, np.int64)
        return pd.DataFrame({"made": made, "until": made + keep - 1}, index=key[edge[:-1]]), pd.DataFrame({"_k": key, "seq": d.seq, "hit": hit})

    rows = requests.withWatermark("ts", late).select("key", "seq", "ts")
    return _sharded(rows, "key", "made long, until long", "_k string, seq long, hit boolean", turn, lambda gone: None, shards)
