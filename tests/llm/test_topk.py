import math
import random

from pyspark.sql import functions as F

from terraloom.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 10 == 0}):
        mine = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, k=3, block=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0, k=k, block=block).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.7]) for _ in range(3)], "x") for i in range(60)]
    rows += [(61, None, None), (62, [None, 1.0, 0.0], None), (63, [float("nan"), 0.0, 0.0], None), (70, [float("inf"), 0.0, 0.0], None), (None, [1.0, 1.0, 1.0], None), (7, rows[7][1], "y"), (20, [0.1, 0.1, 0.1], "z")]
    assert run(spark, rows) == brute(rows, 3)


def test_few_candidates_lengths_and_large_values(spark):
    rows = [(0, [1e6, -3e5, 7.0], None), (1, [9e5, 1.0], None), (2, [1.0], None)]
    assert run(spark, rows, k=10) == brute(rows, 10)
    assert run(spark, [(0, [1.0], None)]) == []
    assert run(spark, [(1, [1.0], None)]) == []


def test_kth_score_in_a_partial_last_bin(spark):
    # bound 3500000: steps 6836, 7 and 1; 608433 is in the bin 608432..608438, whose interval ends before 608436
    scores = [3499999, 608437, 608436, 608433, 608432, 5, -7]
    rows = [(0, [1 / 1024], None), *[(k + 1, [s / 1024], None) for k, s in enumerate(scores)]]
    assert run(spark, rows, k=4) == brute(rows, 4)
    assert [r[3] for r in run(spark, rows, k=4)] == scores[:4]
