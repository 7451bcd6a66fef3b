"""Graphs, rings, ranges and pages against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from terraloom.operators import graph as Gr
from terraloom.operators import rings as Rg
from terraloom.operators import windows as W
from terraloom.operators.ranks import running


def plain_depths(edges, start):
    depth, todo = {start: 0}, [start]
    for a in todo:
        for x, b in edges:
            if x == a and b is not None and b not in depth:
                depth[b] = depth[a] + 1
                todo.append(b)
    return depth


def test_lineage_of_random_graphs(spark):
    rng = random.Random(1)
    for cyclic in (False, True):
        edges = [(a, b) for a in range(40) for b in rng.sample(range(40), 2) if cyclic or b < a] + [(50, None), (51, 51 if cyclic else 3)]
        df = spark.createDataFrame(edges, "id long, parent_id long")
        seeds = spark.createDataFrame([(7, 39), (8, 20), (8, 20), (9, 99), (9, None)], "output long, id long")
        got = {(r.output, r.id): r.depth for r in Gr.lineage(df, seeds).collect()}
        assert got == {(o, n): d for o, s in ((7, 39), (8, 20), (9, 99)) for n, d in plain_depths(edges, s).items()}
        ways = {a: set(plain_depths(edges, a)) for a in {x for e in edges for x in e if x is not None}}
        loops = {a for a in ways if any((a, b) in edges and (b == a or a in ways[b]) for b in ways[a] | {a})}
        want = {a: min(b for b in loops if b in ways[a] and a in ways[b]) for a in loops}
        assert {r.id: r.cycle for r in Gr.cycles(df).collect()} == want
        assert {r.id for r in Gr.cyclic_nodes(df).collect()} == {a for a in ways if ways[a] & loops}


def test_depth_of_a_long_chain(spark):
    chain = [(k, k - 1) for k in range(1, 300)] + [(299, 5), (400, 299)]
    df = spark.createDataFrame(chain, "id long, parent_id long")
    got = {r.id: r.depth for r in Gr.topological_depth(df).collect()}
    assert got == {**{k: k for k in range(300)}, 400: 300}
    with pytest.raises(ValueError, match="more than 100"):
        Gr.topological_depth(df, max_nodes=100)
    with pytest.raises(Gr.Cyclic, match=r"\[2, 3\]"):
        Gr.topological_depth(spark.createDataFrame([(2, 3), (3, 2), (9, 2)], "id long, parent_id long"))


def test_steps_with_parameters(spark):
    nodes = spark.createDataFrame([(k, f"op{k}", {"k": str(k)}) for k in range(4)], "id long, operation string, parameters map<string, string>")
    edges = spark.createDataFrame([(3, 2), (3, 1), (2, 0), (1, 0)], "id long, parent_id long")
    got = Gr.lineage_steps(nodes, edges, nodes.where("id = 3").select("id")).orderBy("place").collect()
    assert [(r.output, r.place, r.id, r.operation, r.parameters) for r in got] == [(3, p, i, f"op{i}", {"k": str(i)}) for p, i in enumerate((0, 1, 2, 3), 1)]
    with pytest.raises(ValueError, match="missing: 8"):
        Gr.lineage_steps(nodes, edges.union(spark.createDataFrame([(1, 8)], edges.schema)))


POINTS = "array<struct<node: bigint, x: double, y: double>>"


def test_rings_keep_direction_and_start(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for rel in range(6):
        cycle = list(range(rel * 1000, rel * 1000 + 3 + 40 * rel))
        cuts = sorted(rng.sample(range(len(cycle)), min(len(cycle), 1 + 5 * rel)))
        ways = [cycle[a : b + 1] if b > a else cycle[a:] + cycle[: b + 1] for a, b in zip(cuts, cuts[1:] + cuts[:1], strict=True)]
        order = rng.sample(range(len(ways)), len(ways))
        ways = [ways[k] if rng.random() < 0.5 else ways[k][::-1] for k in order]
        last = ways[-1]
        ring = cycle if cycle[(cycle.index(last[0]) + 1) % len(cycle)] == last[1] else cycle[::-1]
        at = ring.index(last[0])
        want[rel] = [*ring[at:], *ring[:at], last[0]]
        rows += [(rel, pos, [(n if rel % 2 else None, float(n), 0.0) for n in w]) for pos, w in enumerate(ways)]
    rows += [(10, 0, [(1, 0.0, 0.0), (2, 1.0, 0.0)]), (10, 1, [(2, 1.5, 0.0), (3, 1.0, 1.0), (1, 0.0, 0.0)]), (11, 0, None), (11, 1, [(1, 0.0, 0.0)])]
    got = Rg.ring_paths(spark.createDataFrame(rows, f"relation_id long, pos int, points {POINTS}")).collect()
    assert {r.relation_id: [int(p.x) for p in r.points] for r in got if r.error is None} == want
    assert {r.relation_id: r.error for r in got if r.error} == {10: "inconsistent", 11: "degenerate"}
    none = spark.createDataFrame([], f"relation_id long, pos int, type string, role string, points {POINTS}")
    assert Rg.ring_paths(none).count() == 0 and Rg.multipolygons(none).count() == 0


def test_polygons_with_their_holes(spark):
    def ring(x, y, a):
        return [(None, float(p), float(q)) for p, q in ((x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y))]

    rows = [(1, 0, "way", "outer", ring(0, 0, 10)), (1, 1, "way", None, ring(20, 0, 10)), (1, 2, "way", "inner", ring(22, 2, 3)), (1, 3, "way", "inner", ring(1, 1, 2)), (1, 4, "node", "label", None)]
    rows += [(2, 0, "way", "outer", ring(0, 0, 10)), (2, 1, "way", "outer", ring(1, 1, 8)), (2, 2, "way", "inner", ring(2, 2, 1))]
    got = {r.relation_id: r for r in Rg.multipolygons(spark.createDataFrame(rows, f"relation_id long, pos int, type string, role string, points {POINTS}"), 3.0).collect()}
    corner = lambda r: (r[0].x, r[0].y)
    assert [(corner(p.outer), [corner(h) for h in p.inners]) for p in got[1].polygons] == [((0.0, 0.0), [(1.0, 1.0)]), ((20.0, 0.0), [(22.0, 2.0)])]
    assert (got[2].polygons, got[2].error) == (None, "hole")


def test_collections_stop_at_eight_levels(spark):
    members = [(k, 0, "relation", k + 1) for k in range(12)] + [(12, 0, "way", 5)]
    relations = spark.createDataFrame([(k, False) for k in range(13)], "relation_id long, area boolean")
    got = Rg.collections(spark.createDataFrame(members, "relation_id long, pos int, type string, ref long"), relations).collect()
    assert {(r.root, r.type, r.error) for r in got} == {(k, "relation", "depth") for k in range(4)} | {(k, "way", None) for k in range(4, 13)}
    assert {len(r.path) for r in got if r.error} == {9}


def test_running_values_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", f"k{k % 9}"]), rng.randrange(50), rng.randrange(1 << 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    got = running(df, ["k"], ["o"], place="p", s=("sum", "v"), x=("bit_xor", "v"), m=("max", "v")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.p):
        s, x, m, p, o = by.get(r.k, (0, 0, 0, 0, -1))
        by[r.k] = (s + r.v, x ^ r.v, max(m, r.v), p + 1, r.o)
        assert (r.s, r.x, r.m, r.p) == by[r.k][:4] and r.o >= o
    assert len(got) == 3000
    assert running(df.limit(0), ["k"], ["o"], place="p").count() == 0


@pytest.mark.parametrize(("offset", "most"), [(0, 3), (7, 100)])
def test_pages_from_any_offset(spark, offset, most):
    rng = random.Random(4)
    rows = [(g, k, rng.choice([None, 1, 5, 30, 60])) for g in (None, "a", "b") for k in range({"a": 150, "b": 3}.get(g, 20))]
    got = W.pages(spark.createDataFrame(rows, "g string, k long, size long"), "g", "k", F.col("size"), 100, most, offset).collect()
    want = []
    for g in (None, "a", "b"):
        own = sorted(r for r in rows if r[0] == g)[offset:] if g else [r for r in rows if r[0] is None][offset:]
        pages, total = [], 0
        for r in own:
            if not pages or total + (r[2] or 0) > 100 or len(pages[-1]) == most:
                pages.append([])
                total = 0
            pages[-1].append(r)
            total += r[2] or 0
        at = offset
        for n, p in enumerate(pages, 1):
            want += [(*r, n, at, at + len(p) if n < len(pages) else None) for r in p]
            at += len(p)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with pytest.raises(Exception, match="exceeds the page"):
        W.pages(spark.createDataFrame([("a", 1, 101)], "g string, k long, size long"), "g", "k", F.col("size"), 100, 5).collect()


@pytest.mark.parametrize(("offset", "most"), [(0, 3), (5, 9), (6, 40)])
def test_pages_across_blocks(spark, monkeypatch, offset, most):
    """Pages shorter and longer than a block of rows; one is followed within blocks, and only what enters a block is jumped from."""
    monkeypatch.setattr(W, "_BLOCK", 8)
    entered = []
    real = W.written
    monkeypatch.setattr(W, "written", lambda df, name: (lambda d: (entered.append(d) if name == "page-ways" else None, d)[1])(real(df, name)))
    rng = random.Random(9)
    rows = [(g, k, rng.choice([0, 1, 3, 9]), f"{g}{k}") for g in (1, 2, 3, 4) for k in range({1: 333, 2: 8, 3: 5}.get(g, 64))]
    got = W.pages(spark.createDataFrame(rows, "g long, k long, size long, own string"), "g", "k", F.col("size"), 100, most, offset).collect()
    want = []
    for g in (1, 2, 3, 4):
        own, pages, total = sorted(r for r in rows if r[0] == g)[offset:], [], 0
        for r in own:
            if not pages or total + r[2] > 100 or len(pages[-1]) == most:
                pages.append([])
                total = 0
            pages[-1].append(r)
            total += r[2]
        at = offset
        for n, p in enumerate(pages, 1):
            want += [(*r, n, at, at + len(p) if n < len(pages) else None) for r in p]
            at += len(p)
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[:2])
    assert most >= 8 or entered[0].count() < len(rows) / 2
