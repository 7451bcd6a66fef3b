import random

import corpus_pipeline as P
import numpy as np

from terraloom.llm import simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """Class of every text by all pairs."""
    own = [grams(t) for t in texts]
    label = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            both = len(own[i] & own[j])
            if label[i] != label[j] and 5 * both >= 4 * len(own[i] | own[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def made():
    """Texts around a similarity of 0.8 on either side, chains of them, common lines, short and empty ones."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, out = new(30), [None, "", " \t", "a b", "A  b", "a b c"]
    for size in (6, 14, 40, 120, 400):
        for _ in range(6):
            now = new(size) + (line if rng.random() < 0.5 else [])
            for _ in range(5):
                out.append(" ".join(now))
                now = list(now)
                at = rng.randrange(len(now))
                if rng.random() < 0.5:  # one stretch changed: about a tenth of the shingles
                    now[at : at + max(1, len(now) // rng.choice([8, 10, 12]))] = new(max(1, len(now) // 10))
                else:
                    for _ in range(max(1, len(now) // rng.choice([45, 50, 60]))):
                        now[rng.randrange(len(now))] = new(1)[0]
    return out


def recall(texts, got):
    """Of the pairs of different sets that link, the share whose ends are in one class; and no class joins what pairs don't."""
    own = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if own[i] != own[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    label = brute(texts)
    assert all(label[i] == label[got[i]] for i in range(len(texts)))
    return sum(got[i] == got[j] for i, j in pairs), len(pairs)


def test_production_stage_against_all_pairs(spark):
    texts = made()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar(rows, "doc_id", "text", P.SHINGLE, *P.SIMILARITY).collect()}
    found, pairs = recall(texts, got)
    assert pairs > 30 and found >= 0.9 * pairs, (found, pairs)
    exact = {}
    for i, t in enumerate(texts):
        exact.setdefault(grams(t), []).append(got[i])
    assert all(len(set(x)) == 1 for x in exact.values())
    kept = [r.doc_id for r in P.near_duplicate_stage(spark, rows, "").collect()]
    assert sorted(got[i] for i in kept) == sorted(set(got.values()))


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    texts = [r.text for r in docs.select("text").collect()]
    got = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text", P.SHINGLE, *P.SIMILARITY).collect()
    found, pairs = recall(texts, {r.k: r.component_id for r in got})
    assert pairs and found >= 0.9 * pairs, (found, pairs)


def test_family_of_one_template(spark):
    """Texts of one template, 0.75 alike, among them pairs at 0.82: those below must not crowd out those above."""
    rng = random.Random(21)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = new(430), []
    for _ in range(300):
        mine = new(22)
        texts += [" ".join(shared + mine + new(50)) for _ in range(2)]
    own = [grams(t) for t in texts]
    alike = lambda i, j: len(own[i] & own[j]) / len(own[i] | own[j])
    assert 0.8 < alike(0, 1) < 0.84 and 0.72 < alike(0, 2) < 0.78
    got = {r.k: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= 270
    assert all(got[got[k]] == got[k] and (got[k] == k or alike(k, got[k]) >= 0.8) for k in range(600))


def test_family_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Texts of one template, about 0.77 alike, with some pairs above 0.8: those below are not tested by all pairs, and no link is lost for it."""
    rng = random.Random(31)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = new(140), []
    for _ in range(150):
        mine = new(14)
        texts += [" ".join(shared + mine + new(7)) for _ in range(2)]
    own = [grams(t) for t in texts]
    alike = lambda i, j: len(own[i] & own[j]) / len(own[i] | own[j])
    assert alike(0, 1) > 0.85 and 0.75 < alike(0, 2) < 0.8
    tested = []
    real = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: (lambda d: (tested.append(d) if name == "similar-pairs" else None, d)[1])(real(df, name)))
    got = {r.k: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(150))
    assert len(set(got.values())) == 150
    assert sum(d.count() for d in tested) < 8 * len(texts)  # of 44,850


def test_parities_never_hide_a_link():
    rng = np.random.default_rng(8)
    for size in (1, 9, 100, 700, 5000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) << np.uint64(1))
            b = np.unique(np.r_[a[rng.random(len(a)) < rng.uniform(0.75, 1)], rng.integers(0, 1 << 63, int(size * rng.uniform(0, 0.25))).astype(np.uint64)])
            odd = [np.frombuffer(simhash.parities(x), np.uint64) for x in (a, b)]
            apart = int(np.bitwise_count(odd[0] ^ odd[1]).sum(dtype=np.int64))
            assert apart <= len(np.setxor1d(a, b))
            assert not simhash.alike(a, b, 4, 5) or 9 * apart <= len(a) + len(b)


def test_hot_ball_of_near_copies(spark):
    """Copies of one text with a word or two changed: one class, without all pairs."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(3000):
        now = list(base)
        for _ in range(rng.randrange(1, 3)):
            now[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    got = [r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()]
    assert max(got.count(c) for c in set(got)) > 0.98 * len(texts)


def test_sketches_that_share_a_word():
    """100,000 sketches with one and the same first word, close together: bounded memory, and few pairs."""
    rng = np.random.default_rng(6)
    n = 100_000
    wide = np.zeros((n, 8), np.uint64)
    for k in range(1, 8):
        wide[:, k] = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    zero = np.zeros(n, np.int64)
    i, j, d = simhash.trie_candidates(np.zeros(n, np.uint64), zero, zero, 9, wide, np.arange(n), zero, 100, 48, 4)
    assert len(i) == n - 1 and d.max() <= 14


def test_empty_and_null(spark):
    rows = [(5, None), (3, ""), (4, " \t"), (9, "a b"), (8, "long " * 200_000)]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {r.k: r.component_id for r in simhash.similar(df, "k").collect()} == {5: 3, 3: 3, 4: 3, 9: 9, 8: 8}
    assert simhash.similar(df.limit(0), "k").count() == 0
