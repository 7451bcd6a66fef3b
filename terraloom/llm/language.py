"""Language identification by a bidirectional gated recurrent network over bytes.

Training (numpy, back-propagation through time, on a bounded sample): two layers of gated recurrent units, one reading left to
right and one right to left, label every byte position with the document's language. Scoring runs inside Spark tasks:
each whole text is cut into windows of `WINDOW` bytes, every position gets a probability for each language, and the
document's probabilities are the mean over all its positions.

The cell has an update gate z and a reset gate r, both sigmoid(a + h U), and h' = h + z * (tanh(b + (r * h) V) - h).

Edge cases: null text, or one without a letter (Unicode category L), is `und` with score 0; with no labelled row to learn
from, all are `und`; null ids are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import take_turn, utf8, with_computed

WINDOW = 128
BLOCK = 1024
UNKNOWN = "und"
_MAYBE = re.compile(r"[^\W\d_]")
#: most languages that a model can tell apart
MOST = 1000


@dataclass
class Model:
    """E: rows 0-255 embed a byte for the forward layer, 256-511 for the backward one (z, r, state); U: both gates; V: state; C, b: labels."""

    langs: list[str]
    E: np.ndarray
    U: np.ndarray
    V: np.ndarray
    C: np.ndarray
    b: np.ndarray


def _run(m: Model, x: np.ndarray, keep: bool = False):
    """States (T, 2, B, H) of windows x (B, T); slot t of the backward half is position T-1-t. keep: also what training needs."""
    count, steps = x.shape
    size = m.V.shape[1]
    ids = np.empty((steps, 2, count), np.int64)
    ids[:, 0] = x.T
    ids[:, 1] = x.T[::-1]
    ids[:, 1] += 256
    h = np.zeros((2, count, size), np.float32)
    out = np.empty((steps, 2, count, size), np.float32)
    a = np.empty((2, count, 3 * size), np.float32)
    gates, n, q = np.empty((2, count, 2 * size), np.float32), np.empty_like(h), np.empty_like(h)
    saved = []
    for t in range(steps):
        np.take(m.E, ids[t], axis=0, out=a, mode="clip")
        np.matmul(h, m.U, out=gates)
        gates += a[:, :, : 2 * size]
        gates *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[:, :, size:], h, out=q)
        np.matmul(q, m.V, out=n)
        n += a[:, :, 2 * size :]
        np.tanh(n, out=n)
        if keep:
            saved.append((h.copy(), gates.copy(), q.copy(), n.copy()))
        n -= h
        n *= gates[:, :, :size]
        h += n
        out[t] = h
    return (out, ids, saved) if keep else out


def _label(m: Model, out: np.ndarray) -> np.ndarray:
    """Probabilities (T, B, K) of every position."""
    steps, _, count, size = out.shape
    p = np.matmul(out[:, 0].reshape(-1, size), m.C[:size])
    p += np.matmul(out[::-1, 1].reshape(-1, size), m.C[size:])
    p += m.b
    np.clip(p, -30, 30, out=p)
    np.exp(p, out=p)
    p /= p @ np.ones((p.shape[1], 1), np.float32)
    return p.reshape(steps, count, -1)


def _gradient(m: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean weighted cross-entropy over all positions, through time."""
    out, ids, saved = _run(m, x, keep=True)
    steps, _, count, size = out.shape
    p = _label(m, out)
    p[:, np.arange(count), y] -= 1
    p *= (weight / (steps * weight.sum())).astype(np.float32)[None, :, None]
    flat = p.reshape(steps * count, -1)
    dC = np.concatenate([out[:, 0].reshape(-1, size).T @ flat, out[::-1, 1].reshape(-1, size).T @ flat])
    dout = np.stack([p @ m.C[:size].T, (p @ m.C[size:].T)[::-1]], axis=1)
    dU, dV, dh = np.zeros_like(m.U), np.zeros_like(m.V), np.zeros((2, count, size), np.float32)
    da = np.empty((steps, 2, count, 3 * size), np.float32)
    U, V = m.U.transpose(0, 2, 1), m.V.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, gates, q, n = saved[t]
        z, r = gates[:, :, :size], gates[:, :, size:]
        dh += dout[t]
        dn = dh * z * (1 - n * n)
        dV += q.transpose(0, 2, 1) @ dn
        dq = dn @ V
        dg = np.concatenate([dh * (n - h), dq * h], axis=2) * gates * (1 - gates)
        dU += h.transpose(0, 2, 1) @ dg
        dh = dh * (1 - z) + dq * r + dg @ U
        da[t, :, :, : 2 * size], da[t, :, :, 2 * size :] = dg, dn
    cells, rows = ids.ravel(), da.reshape(-1, 3 * size)
    dE = np.stack([np.bincount(cells, rows[:, k], 512) for k in range(3 * size)], axis=1).astype(np.float32)
    return [dE, dU, dV, dC, flat.sum(axis=0)]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, rounds: int = 220, batch: int = 128, rate: float = 0.02, seed: int = 1) -> Model:
    """Fit on windows (N, WINDOW) of bytes with a language index each. Deterministic for a given input and seed."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    m = Model(langs, normal(512, 3 * hidden, s=0.5), normal(2, hidden, 2 * hidden, s=0.3), normal(2, hidden, hidden, s=0.3), normal(2 * hidden, len(langs), s=0.3), np.zeros(len(langs), np.float32))
    share = np.bincount(labels, minlength=len(langs)) / max(1, len(labels))
    params = [m.E, m.U, m.V, m.C, m.b]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        pick = rng.integers(0, len(windows), batch)
        grads = _gradient(m, windows[pick], labels[pick], 1 / np.maximum(share[labels[pick]], 1e-9))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        step = rate * min(1.0, 3 * (1 - k / rounds) + 0.05)
        for p, g, a, b in zip(params, grads, mean, square, strict=True):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= step * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return m


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with blanks, and each text's number of windows."""
    count = np.array([-(-len(x) // WINDOW) for x in texts], np.int64)
    flat = b"".join(x + b" " * (-len(x) % WINDOW) for x in texts)
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), count


def probabilities(m: Model, texts: list[bytes]) -> np.ndarray:
    """Pooled probabilities (N, K) of whole texts; every text has at least one byte."""
    x, count = _windows(texts)
    first = np.cumsum(count) - count
    sums = np.empty((len(x), len(m.langs)), np.float64)
    short = np.full(len(x), WINDOW)
    short[first + count - 1] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, count.tolist(), strict=True)]
    for k in range(0, len(x), BLOCK):
        p = _label(m, _run(m, x[k : k + BLOCK]))
        for i in np.flatnonzero(short[k : k + BLOCK] < WINDOW):
            p[short[k + i] :, i] = 0
        sums[k : k + BLOCK] = p.sum(axis=0)
    total = np.add.reduceat(sums, first, axis=0)
    return total / total.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern alone would also take numbers such as a superscript two."""
    return any(x[0].isalpha() for x in _MAYBE.finditer(text))


def predict(m: Model | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    take_turn("language", lambda: None)
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if m is None:
        return langs, scores
    known = [i for i, x in enumerate(texts) if x and has_letter(x.decode("utf-8", "replace"))]
    held, size = [], 0
    for i in [*known, None]:
        if held and (i is None or size >= BLOCK * WINDOW):
            p = probabilities(m, [texts[j] for j in held])
            for j, row in zip(held, p, strict=True):
                langs[j], scores[j] = m.langs[int(row.argmax())], float(min(1.0, row.max()))
            held, size = [], 0
        if i is not None:
            held.append(i)
            size += len(texts[i])
    return langs, scores


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All windows of at most `per_lang` documents of each language.

    Documents are taken by the hash of their ids: first all below a cut that some twice as many pass, then the least ones.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = rows.groupBy(F.col(lang_col).alias("_l")).count().limit(MOST + 1).collect()
    if len(share) > MOST:
        raise ValueError(f"more than {MOST} languages")
    names = sorted(r["_l"] for r in share)
    if not names:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), names
    cut = F.create_map(*[F.lit(x) for r in share for x in (r["_l"], min(1 << 30, (2 * per_lang << 30) // r["count"]))])
    # columns get names of their own, so that none can clash
    own = rows.select(F.col(id_col).alias("_id"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("_h"), F.col(lang_col).alias("_l"), utf8(text_col).alias("_t"))
    order = Window.partitionBy("_l").orderBy("_h", "_id", "_t")
    some = own.where(F.col("_h") < cut[F.col("_l")]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang)
    got = sorted((r["_l"], r["_n"], bytes(r["_t"])) for r in some.select("_l", "_n", "_t").collect())
    got = [x for x in got if x[2]]
    x, count = _windows([t for _, _, t in got])
    return x, np.repeat(np.array([names.index(k) for k, _, _ in got], np.int64), count), names


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, **how) -> Model | None:
    """Learn from rows where `learn` holds; the sample's bound (`per_lang` whole documents a language) is the same at every size."""
    x, y, names = sample(docs, learn, id_col, text_col, lang_col, per_lang)
    return train(x, y, names, **how) if len(x) else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The `keep` columns of every document, its predicted language and that one's probability. Only the text is looked at."""

    def run(raw: pa.Array) -> list[pa.Array]:
        langs, scores = predict(model, raw.to_pylist())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return with_computed(docs, list(keep), [text_col], run, [(names[0], "string"), (names[1], "double")])
