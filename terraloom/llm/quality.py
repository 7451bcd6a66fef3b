"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

The sum-of-squares identity makes all pairwise interactions cost one pass over the non-zero features. Features come from
whole texts: counts of words hashed into `2**hash_bits` buckets (scaled to unit length), statistics of the text's
structure, and metadata columns that the caller names. Training runs on a bounded sample (`max_rows` labelled documents,
the same at every size, taken in the order of a hash of the id); scoring runs in Spark tasks.

Edge cases: null text is an empty one and gets a score like it; null metadata counts as its mean; ids with differing
labels are not learned from; with nothing to learn from, every score is 0.5; repeated rows and null ids stay (a null id is not
learned from).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import take_turn, utf8, with_computed

HASH_BITS = 14
FACTORS = 8
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum())
STATS = ("words", "word length", "distinct words", "commonest word", "upper case", "digits", "symbols", "symbol words", "lines", "distinct lines")


class _Buckets(dict):
    """Word -> bucket, remembered; bounded, so that a task's memory does not follow its input."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = k = zlib.crc32(word.lower()) & ((1 << HASH_BITS) - 1)
        return k


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    size, n = max(1, len(raw)), max(1, len(words))
    gone = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    lines = raw.split(b"\n")
    symbols = gone(_SYMBOL)
    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(raw) / n)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        gone(_UPPER) / size,
        gone(_DIGIT) / size,
        symbols / size,
        min(4.0, symbols / n),
        float(np.log1p(len(lines))),
        len(set(lines)) / len(lines),
    ]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and scaled count of every distinct word, the texts' number of them, and statistics (N, S)."""
    take_turn("quality", _CACHE.clear)
    buckets = _CACHE
    idx: list[int] = []
    val: list[int] = []
    count, stats = [], []
    for raw in texts:
        words = raw.split()
        counts = Counter(words)
        idx += map(buckets.__getitem__, counts)
        val += counts.values()
        count.append(len(counts))
        stats.append(statistics(raw, words, counts))
    n = np.array(count, np.int64)
    x = np.sqrt(np.array(val, np.float32))
    length = np.sqrt(_sums(x * x, n))
    return np.array(idx, np.int64), x / np.repeat(length, n).astype(np.float32), n, np.array(stats, np.float32).reshape(-1, len(STATS))


_CACHE = _Buckets()


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes; empty groups give 0."""
    out = np.zeros((len(n), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(n) - n)[full], axis=0)
    return out


@dataclass
class Model:
    bias: float
    w: np.ndarray  # words, then dense features
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        z = (np.where(np.isfinite(stats), stats, self.mean) - self.mean) / self.scale
        return np.clip(z, -4, 4).astype(np.float32) * np.float32(0.3)

    def raw_score(self, idx, x, n, dense):
        """y(x), with the factor sums that training needs again."""
        first = 1 << HASH_BITS
        vx = self.v[idx] * x[:, None]
        vs = self.v[first:]
        total = _sums(vx, n) + dense @ vs
        squares = _sums(vx * vx, n) + (dense * dense) @ (vs * vs)
        y = self.bias + _sums(self.w[idx] * x, n) + dense @ self.w[first:] + 0.5 * (total * total - squares).sum(axis=1)
        return y, total, vx


def train(idx, x, n, stats, label, epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 3) -> Model:
    """Logistic loss, Adagrad. Deterministic for a given input and seed."""
    rng = np.random.default_rng(seed)
    known = np.where(np.isfinite(stats), stats, np.nan)
    mean = np.nan_to_num(np.nanmean(np.vstack([known, np.zeros(stats.shape[1])]), axis=0)) if not len(known) else np.nan_to_num(np.nanmean(known, axis=0))
    scale = np.maximum(np.nan_to_num(np.nanstd(known, axis=0)), 1e-6)
    first, width = 1 << HASH_BITS, (1 << HASH_BITS) + stats.shape[1]
    m = Model(0.0, np.zeros(width, np.float32), (rng.standard_normal((width, FACTORS)) * 0.05).astype(np.float32), mean, scale)
    dense = m.dense(stats)
    begin = np.cumsum(n) - n
    gw, gv, gb = np.full(width, 1e-3, np.float32), np.full((width, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(n))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            size = n[rows]
            at = np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            i, xi, d = idx[at], x[at], dense[rows]
            y, total, vx = m.raw_score(i, xi, size, d)
            err = ((1 / (1 + np.exp(-np.clip(y, -30, 30)))) - label[rows]).astype(np.float32) / len(rows)
            each = np.repeat(err, size)
            used, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, each * xi, len(used)) + decay * m.w[used]
            part = (np.repeat(total, size, axis=0) - vx) * (each * xi)[:, None]
            dv = np.stack([np.bincount(back, part[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * m.v[used]
            dsw = err @ d
            dsv = d.T @ (total * err[:, None]) - m.v[first:] * ((d * d).T @ err)[:, None]
            for where, a, b in ((used, dw, dv), (np.arange(first, width), dsw, dsv)):
                gw[where] += a * a
                gv[where] += b * b
                m.w[where] -= rate * a / np.sqrt(gw[where])
                m.v[where] -= rate * 0.5 * b / np.sqrt(gv[where])
            gb += float(err.sum()) ** 2
            m.bias -= rate * float(err.sum()) / gb**0.5
    return m


def _meta(columns: list[str]) -> list[Column]:
    return [F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(f"_m{k}") for k, c in enumerate(columns)]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = ("n_chars",), max_rows: int = 6000) -> Model | None:
    """Learn from at most `max_rows` labelled documents among the rows of `labels` where `learn` holds."""
    kept = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    kept = kept.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    kept = kept.select("_id", F.col("_y").cast("int").alias("_y"), F.xxhash64(F.col("_id").cast("string")).alias("_h")).orderBy("_h", "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_raw"), *_meta(list(meta)))
    picked = rows.join(F.broadcast(kept), "_id")  # at most max_rows small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            idx, x, n, stats = features(raw)
            ends = np.cumsum(n)
            cut = lambda a, kind: pa.array([a[e - k : e].astype(kind).tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())
            dense = np.column_stack([stats, *[b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(meta))]]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.num_columns - 2), b.column(b.num_columns - 1), cut(idx, np.uint16), cut(x, np.float32), pa.array([r.tobytes() for r in dense], pa.binary())], names=["_id", "_y", "_h", "idx", "x", "dense"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = picked.select("_id", "_raw", *[f"_m{k}" for k in range(len(meta))], "_y", "_h").mapInArrow(run, f"_id {kind}, _y int, _h long, idx binary, x binary, dense binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["_h"], r["_id"], bytes(r["idx"]), bytes(r["x"])))
    n = np.array([len(r["x"]) // 4 for r in got], np.int64)
    join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in got), kind)
    return train(join("idx", np.uint16).astype(np.int64), join("x", np.float32), n, join("dense", np.float64).reshape(len(got), -1), np.array([r["_y"] for r in got], np.float32))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", meta: tuple[str, ...] = ("n_chars",), keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The `keep` columns of every document, its score (0 to 1) and the prediction (1 if the score is at least 0.5)."""

    def run(raw: pa.Array, *values: pa.Array) -> list[pa.Array]:
        p = np.full(len(raw), 0.5)
        for k in range(0, len(raw) if model is not None else 0, 1000):
            idx, x, n, stats = features([x or b"" for x in raw.slice(k, 1000).to_pylist()])
            dense = model.dense(np.column_stack([stats, *[v.slice(k, 1000).to_numpy(zero_copy_only=False) for v in values]]).astype(np.float64))
            p[k : k + 1000] = 1 / (1 + np.exp(-np.clip(model.raw_score(idx, x, n, dense)[0].astype(np.float64), -30, 30)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return with_computed(docs, list(keep), [text_col, *_meta(list(meta))], run, [(names[0], "double"), (names[1], "int")])
