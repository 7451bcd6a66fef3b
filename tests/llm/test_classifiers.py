import numpy as np
from pyspark.sql import functions as F

from terraloom.llm import language, quality
from terraloom.llm.common import fold, table


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(fold("doc_id", 4) == 2).where("lang is not null").collect()
    assert len(got) > 100
    known = [r for r in got if r.text and any(c.isalpha() for c in r.text)]
    assert np.mean([r.lang_pred == r.lang for r in known]) > 0.9


def test_language_gradient():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 7)), rng.integers(0, 3, 5)
    m = language.train(x, y, ["a", "b", "c"], hidden=3, rounds=1)
    grads = language._gradient(m, x, y, np.ones(5))

    def loss():
        p = language._label(m, language._run(m, x))
        return -np.log(np.maximum(p[:, np.arange(5), y].astype(np.float64), 1e-30)).mean()

    for param, grad in zip([m.U, m.V, m.C, m.b], grads[1:]):
        at = tuple(rng.integers(0, s) for s in param.shape)
        old = param[at]
        param[at] = old + 1e-2
        up = loss()
        param[at] = old - 1e-2
        down = loss()
        param[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


def test_language_forward_pass_and_pooling_against_plain_loops():
    rng = np.random.default_rng(2)
    m = language.train(rng.integers(0, 256, (5, 9)), rng.integers(0, 3, 5), ["a", "b", "c"], hidden=4, rounds=2)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(window, layer):
        h, out = np.zeros(4), []
        for byte in window:
            a = m.E[int(byte) + 256 * layer].astype(float)
            g = sigmoid(a[:8] + h @ m.U[layer])
            n = np.tanh(a[8:] + (g[4:] * h) @ m.V[layer])
            h = (1 - g[:4]) * h + g[:4] * n
            out.append(h)
        return out

    def document(raw):
        total = np.zeros(3)
        for k in range(0, len(raw), language.WINDOW):
            part = raw[k : k + language.WINDOW]
            window = part.ljust(language.WINDOW)
            ahead, behind = states(window, 0), states(window[::-1], 1)[::-1]
            for t in range(len(part)):
                e = np.exp(ahead[t] @ m.C[:4] + behind[t] @ m.C[4:] + m.b)
                total += e / e.sum()
        return total / total.sum()

    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 100, 128, 129, 700)]
    assert np.allclose(language.probabilities(m, texts), [document(t) for t in texts], atol=1e-4)


def test_letters():
    assert language.has_letter("é") and language.has_letter("² ª") and not language.has_letter("²½①Ⅷ _9!")


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !!", None), (None, "hello there", None), (5, "x", None), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = language.fit(df, F.lit(False))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    m = language.train(np.full((4, 64), 97, np.uint8), np.array([0, 1, 0, 1]), ["aa", "bb"], rounds=2)
    got = [(r.doc_id, r.lang_pred == "und") for r in language.identify(df, m).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (2, True), (3, True), (None, False), (5, False), (5, False)], key=str)
    assert language.identify(df.limit(0), m).count() == 0
    long = "é" * 40_000
    p = language.probabilities(m, [long.encode(), b"a"])
    assert p.shape == (2, 2) and abs(p.sum() - 2) < 1e-6


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.fit(docs, labels, fold("doc_id", 3) != 1)
    got = quality.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1).collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    w, v = rng.standard_normal((1 << quality.HASH_BITS) + 2), rng.standard_normal(((1 << quality.HASH_BITS) + 2, quality.FACTORS))
    m = quality.Model(0.3, w, v, np.zeros(2), np.ones(2))
    idx, x, dense = np.array([5, 9, 11]), np.array([0.5, -1.0, 2.0]), np.array([[0.2, 0.4]])
    y = m.raw_score(idx, x, np.array([3]), dense)[0][0]
    at, val = [*idx, 1 << quality.HASH_BITS, (1 << quality.HASH_BITS) + 1], [*x, *dense[0]]
    plain = 0.3 + sum(w[i] * a for i, a in zip(at, val))
    plain += sum(v[at[i]] @ v[at[j]] * val[i] * val[j] for i in range(5) for j in range(i))
    assert abs(y - plain) < 1e-6


def test_quality_edges(spark):
    rows = [(1, None, None), (2, "", 3), (None, "some words", 4), (2, "", 3), (7, "w " * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(2, 0), (7, 1), (7, 1), (1, None)], "doc_id long, quality int")
    for model in (None, quality.fit(df, labels, F.lit(True))):
        got = quality.score(df, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.fit(df, labels.limit(0), F.lit(True)) is None
    assert quality.score(df.limit(0), None).count() == 0
