"""Exact top-k search by distributed histogram selection.

All candidates are scored against a block of queries, again in every round, and no score is kept. In each round every
query has an interval of scores that holds its k-th highest one, cut into `BINS` bins; tasks count their scores into the
bins, the counts are summed, and the interval shrinks to the bin in which the k-th falls, until it is one whole number.
A task leaves out bins below the one in which its own k-th score falls, as the global k-th cannot lie there; so it sends
at most k + 1 counts a query. A last pass keeps scores above the k-th, and of those equal to it each task's k smallest ids;
a window per query breaks ties by id.

Vectors are turned into whole numbers floor(scale * x), so scores are exact. Products are taken in float64 where no sum can
pass 2**53, and in Python integers otherwise.

Queries come in blocks of `block` vectors, each sent to all tasks, so their number may grow without limit.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part; vectors of differing lengths are
padded with zeros; a query id that occurs on several rows stands for the least of its vectors; candidates that repeat a
row are each ranked; rows with a null id take no part; with fewer than k candidates all are returned;
a score beyond 2**62 in size is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import materialize

BINS = 1024


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """`vec_id`, `v`: floor(scale * x) of every component x as double."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # floor() gives a long, which a huge component would overflow: such values are whole already
    v = F.transform(x, lambda c: F.when(F.abs(c.cast("double")) * scale < 2.0**52, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _scores(queries: np.ndarray, cand: np.ndarray, exact: bool) -> np.ndarray:
    """Integer scores (Q, N) as int64."""
    if exact:
        return (queries @ cand.T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    out = ints(queries) @ ints(cand).T
    if out.size and max(out.max(), -out.min()) > 1 << 62:
        raise OverflowError("a score is beyond 2**62")
    return out.astype(np.int64)


def _search_block(cand: DataFrame, ids: np.ndarray, q: np.ndarray, top: float, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score) of a block: all above each k-th score, and enough of those equal to it."""
    spark, width = cand.sparkSession, q.shape[1]
    bound = math.ceil(np.abs(q).sum(axis=1).max() * top) + 1 if width else 1
    exact = bound < 2**53
    bound = min(bound, 1 << 62)
    low = np.full(len(ids), -bound, np.int64)  # the k-th score lies in [low, low + size)
    high = np.full(len(ids), bound + 1, np.int64)  # and below this, where the last bin of a round was cut short
    size, need = 2 * bound + 1, np.full(len(ids), k, np.int64)
    block = spark.sparkContext.broadcast((ids, q))

    def each(batches: Iterator[pa.RecordBatch], fn) -> Iterator[tuple]:
        ids, q = block.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                other = part.column(0).to_numpy()
                yield other, _scores(q, _matrix(part.column(1), width), exact), other[None, :] == ids[:, None]

    while size > 1:
        step = -(-size // BINS)
        state = spark.sparkContext.broadcast((low.copy(), high.copy(), need.copy()))

        def count(batches, step=step, state=state):
            low, high, need = state.value
            total = np.zeros((len(low), BINS + 1), np.int64)
            for _, s, own in each(batches, None):
                bins = np.maximum((s - low[:, None]) // step, -1)
                bins[s >= high[:, None]] = BINS  # above the interval: `need` allows for it already
                bins[own] = -1
                for r in range(len(low)):
                    total[r] += np.bincount(bins[r] + 1, minlength=BINS + 2)[1:]
            rows, cols, n = [], [], []
            for r in range(len(low)):
                above = np.cumsum(total[r, BINS - 1 :: -1])[::-1]  # scores in this bin or a higher one
                keep = np.flatnonzero((total[r, :BINS] > 0) & (above - total[r, :BINS] < need[r]))
                rows += [r] * len(keep)
                cols += keep.tolist()
                n += total[r, keep].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(n, pa.int64())], names=["r", "bin", "n"])

        counts = cand.mapInArrow(count, "r int, bin int, n long").groupBy("r", "bin").agg(F.sum("n").alias("n"))
        # of each query only the bin of its k-th score comes back
        over = Window.partitionBy("r").orderBy(F.desc("bin"))
        needs = spark.createDataFrame([(r, int(x)) for r, x in enumerate(need)], "r int, need long")  # one row per query of the block
        sums = counts.join(F.broadcast(needs), "r").withColumn("upto", F.sum("n").over(over))
        hit = sums.where("upto >= need and upto - n < need").select("r", "bin", (F.col("upto") - F.col("n")).alias("above")).collect()
        found = {x["r"]: x for x in hit}
        for r in range(len(low)):
            if r in found:
                low[r] += found[r]["bin"] * step
                need[r] -= found[r]["above"]
            else:  # fewer than k candidates: the interval stays at its lower end, and all are kept
                need[r] = max(1, need[r])
        high = np.minimum(high, low + step)
        size = step

    kth = spark.sparkContext.broadcast(low)

    def keep(batches):
        ids, _ = block.value
        low = kth.value
        ties: list[list[np.ndarray]] = [[] for _ in ids]
        for other, s, own in each(batches, None):
            up = (s > low[:, None]) & ~own
            r, c = np.nonzero(up)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(other[c]), pa.array(s[r, c])], names=["query_id", "vec_id", "score"])
            same = (s == low[:, None]) & ~own
            for r in np.flatnonzero(same.any(axis=1)).tolist():
                ties[r] = [np.sort(np.concatenate([*ties[r], other[same[r]]]))[:k]]
        n = [len(t[0]) if t else 0 for t in ties]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([t[0] for t in ties if t] or [np.empty(0, np.int64)])), pa.array(np.repeat(low, n))], names=["query_id", "vec_id", "score"])

    return cand.mapInArrow(keep, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048) -> DataFrame:
    """For every row where `is_query` holds, its k best other rows: query_id, rank (from 1), vec_id, score."""
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = whole_vectors(vectors.where(is_query), id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(queries, "topk-queries")
    stats = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not stats[0]:
        return empty
    cand = materialize(whole_vectors(vectors, id_col, vec_col, scale), "topk-vectors")
    top = cand.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0] or 0.0
    parts = -(-stats[0] // block)
    out = None
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).orderBy("vec_id").collect()
        if not rows:
            continue
        q = np.zeros((len(rows), max(1, stats[1])))
        for r, x in enumerate(rows):
            q[r, : len(x["v"])] = x["v"]
        found = _search_block(cand, np.array([x["vec_id"] for x in rows], np.int64), q, top, k)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
