import random

import numpy as np
import pytest
import xxhash

from terraloom.llm import simhash as S


def plain(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_against_plain():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = " ".join(rng.choice(["Ab", "é", "x\ty", "ZZ"]) for _ in range(n))
        assert int.from_bytes(S.sketch(text.encode(), 4), "big") == plain(text, 4)


@pytest.mark.parametrize("unit_rows", [200_000, 6])
def test_classes_against_all_pairs(spark, unit_rows):
    rng = random.Random(7)
    values = []
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 12])):
            x = base
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values))
    rows = [(int(np.uint64(x).astype(np.int64)), x.to_bytes(8, "big")) for x in values]
    edges = S.links(spark.createDataFrame(rows, "node long, sketch binary"), 4, unit_rows)
    got = {r.node: r.label for r in S.components(edges).collect()}
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    nodes = [r[0] for r in rows]
    by_label = {}
    for node, c in zip(nodes, want):
        by_label.setdefault(c, set()).add(node)
    for members in by_label.values():
        label = min(members)
        assert all(got.get(m, m) == label for m in members)


def test_wide_links(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    near = list(base)
    near[40] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"v{rng.randrange(10**6)}" for _ in range(150)))]
    out = S.similar(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}


def test_edges_and_nulls(spark):
    rows = [(5, None, 1), (3, "", 2), (3, "", 2), (None, " \t", 3), (9, "a b c d e f g", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = S.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in out) == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 9, 9), (True, 0, 3)]
    assert S.near_duplicates(df.limit(0)).count() == 0
