"""Hand-made grids, edges and nulls, and invariants."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terraloom.functions import grid as G
from terraloom.functions import raster as R
from terraloom.functions import text as X
from terraloom.operators import aggregates as A
from terraloom.operators import checks as K
from terraloom.operators import filters as P
from terraloom.operators import graph as Gr
from terraloom.operators import joins as J
from terraloom.operators import mosaic as M
from terraloom.operators import resolve as Rs
from terraloom.operators import windows as W
from terraloom.sources import readers as S


def test_newest_usable_wins_and_counts_conserve(spark):
    px = spark.createDataFrame([(1, 0, 0, 5, True), (2, 0, 0, 7, False), (1, 1, 0, 6, False), (2, 1, 0, 9, True), (1, 2, 0, 0, True)], "scene int, x int, y int, v int, ok boolean")
    s = M.select_two(px, F.col("v") != 0, F.col("ok"), ["v"], ["scene"], "scene")
    got = {(r.x, r.y): (r.baseline, r.winner, r.v) for r in s.collect()}
    assert got == {(0, 0): (2, 1, 5), (1, 0): (2, 2, 9), (2, 0): (None, None, None)}
    c = M.selection_counters(s).first()
    assert (c.pixels, c.common, c.covered, c.rejected, c.removed, c.fallback) == (3, 2, 2, 1, 0, 1)
    assert sum(r.pixels for r in M.scene_contributions(s).collect()) == c.covered


def test_mosaic_does_not_depend_on_partitioning(spark):
    rng = random.Random(2)
    rows = [(s, x, 0, rng.randrange(4)) for s in range(9) for x in range(5)]
    df = spark.createDataFrame(rows, "scene int, x int, y int, v int")
    run = lambda d: sorted(map(tuple, M.mosaic_newest(d, "v", F.col("v") != 0, ["scene"], 0).collect()))
    assert run(df) == run(df.repartition(7))


def test_unfilled_flags_and_empty_input(spark):
    px = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 3)], "scene int, x int, y int, qa int")
    r = M.mosaic_flags(px, "qa", ~R.any_bit(F.col("qa"), 1), ["scene"]).first()
    assert (r.value, r.covered) == (3, False)
    assert M.mosaic_newest(px.limit(0), "qa", F.lit(True), ["scene"]).count() == 0


def test_alignment_and_unknown_class_are_errors(spark):
    with pytest.raises(Exception, match="not aligned"):
        spark.range(1).select(G.align_offset(F.lit(3.2))).collect()
    with pytest.raises(Exception, match="unknown scene class"):
        R.scl_class(spark.createDataFrame([(12,)], "scl long"), R.scene_classes(spark)).collect()


def test_utm_round_trip_and_known_point(spark):
    d = spark.createDataFrame([(9.0, 0.0), (11.9, 55.5), (6.1, -33.0)], "lon double, lat double")
    x, y = G.utm_forward(F.col("lon"), F.col("lat"), F.lit(32), F.col("lat") >= 0)
    d = d.withColumns({"x": x, "y": y})
    lon, lat = G.utm_inverse(F.col("x"), F.col("y"), F.lit(32), F.col("lat") >= 0)
    for r in d.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    first = d.first()
    assert abs(first.x - 500000) < 1e-6 and abs(first.y) < 1e-6


def test_tile_numbers_go_through_all_cells_once(spark):
    cells = [(z, x, y) for z in range(4) for x in range(1 << z) for y in range(1 << z)]
    d = spark.createDataFrame(cells, "z int, x long, y long").withColumn("id", G.tile_id(F.col("z"), F.col("x"), F.col("y")))
    d = d.withColumn("back", G.tile_coord(F.col("id"), 6))
    got = d.collect()
    assert sorted(r.id for r in got) == list(range(len(cells)))
    assert all((r.back.z, r.back.x, r.back.y) == (r.z, r.x, r.y) for r in got)


def test_greedy_cover_equals_a_plain_fold(spark):
    rng = random.Random(4)
    boxes = [(f"i{k}", k, *(lambda w, s: (w, s, w + rng.choice([1, 2, 4]), s + rng.choice([1, 3])))(float(rng.randrange(8)), float(rng.randrange(8)))) for k in range(14)]
    areas = spark.createDataFrame([(1, 1.0, 1.0, 8.0, 8.0)], "area_id int, w double, s double, e double, n double")
    scenes = spark.createDataFrame(boxes, "item_id string, rank int, w double, s double, e double, n double")
    pairs = J.scenes_in_areas(scenes, areas, 3.0)
    kept = [r.item_id for r in A.covering_selection(A.coverage_cells(areas, scenes, pairs), 100).orderBy("rank").collect()]
    covered, want = set(), []
    for item, _, w, s, e, n in boxes:
        cells = {(x, y) for x in range(1, 8) for y in range(1, 8) if w <= x and x + 1 <= e and s <= y and y + 1 <= n}
        if cells - covered:
            want.append(item)
            covered |= cells
    assert kept == want


def test_ranks_not_percentiles(spark):
    d = spark.createDataFrame([("a", v) for v in [5] * 50 + list(range(100, 151))], "k string, v int")
    r = A.stretch_range(d, ["k"], "v").first()
    s = sorted([5] * 50 + list(range(100, 151)))
    assert (r.low, r.high) == (s[100 * 2 // 100], s[100 * 98 // 100])


def test_graph_errors_and_nulls(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (5, 4)], "id long, parent_id long")
    assert sorted(r.id for r in Gr.cyclic_nodes(loop).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="cycle"):
        Gr.topological_depth(loop)
    assert Gr.closure(loop, loop.select("id").limit(0)).count() == 0


def test_rings_of_any_size_and_depth_limits(spark):
    big = [(1, k, k, (k + 1) % 1500) for k in range(1500)]
    two = [(2, 1, 10, 11), (2, 2, 11, 10), (2, 3, 12, 12)]
    broken = [(3, 1, 20, 21), (3, 2, 21, 22)]
    rows = spark.createDataFrame(big + two + broken, "relation_id long, way_id long, first_node long, last_node long")
    assert sorted(map(tuple, Gr.assemble_rings(rows).collect())) == [(1, 1, True), (2, 2, True), (3, 0, False)]
    assert Gr.assemble_rings(rows.limit(0)).count() == 0
    members = spark.createDataFrame([(k, "relation", k + 1) for k in range(5)] + [(5, "way", 7)], "relation_id long, type string, ref long")
    ways = spark.createDataFrame([(7,)], "way_id long")
    assert sorted(r.root for r in Gr.relation_geometry(members, ways).collect()) == list(range(6))
    with pytest.raises(ValueError, match="nested deeper"):
        Gr.relation_geometry(members, ways, 3)
    links = spark.createDataFrame([(f"n{k}", f"n{k + 1}", k == 4) for k in range(5)], "parent string, child string, is_item boolean")
    assert [r.url for r in S.catalog_tree(links, "n0").collect()] == ["n5"]
    with pytest.raises(ValueError, match="deeper"):
        S.catalog_tree(links, "n0", 3).collect()


def test_topological_depth_is_the_longest_way(spark):
    edges = [(2, 1), (3, 2), (3, 1), (4, 1), (5, 4), (5, 3), (6, None)]
    d = spark.createDataFrame(edges, "id long, parent_id long")
    assert sorted(map(tuple, Gr.topological_depth(d).collect())) == [(1, 0), (2, 1), (3, 2), (4, 1), (5, 3)]


def test_heights_in_strips(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIP", 8)
    grid = [[y * 5 + x if (x, y) != (1, 2) else -32768 for x in range(5)] for y in range(5)]
    raw = b"".join(v.to_bytes(2, "big", signed=True) for row in grid for v in row)
    got = S.hgt_grid(spark.createDataFrame([("a", raw)], "path string, content binary"), 5).collect()
    assert {(r.x, r.y): r.height for r in got} == {(x, y): (None if (x, y) == (1, 2) else y * 5 + x) for x in range(5) for y in range(5)}


def test_masks_that_retain_nothing_and_nested_collections(spark, tmp_path):
    px = spark.createDataFrame([(1, True, True), (1, False, True), (2, False, True)], "scene int, kept boolean, ok boolean")
    assert tuple(A.masked_covered(px.where("scene = 1"), ["scene"], F.col("kept"), F.col("ok")).first()) == (1, 1, 1)
    with pytest.raises(Exception, match="retains no sample"):
        A.masked_covered(px, ["scene"], F.col("kept"), F.col("ok")).collect()
    nest = lambda n: '{"type":"Point","coordinates":[1,2]}' if not n else f'{{"type":"GeometryCollection","geometries":[{nest(n - 1)}]}}'
    lines = [f'{{"type":"Feature","id":{n},"properties":null,"geometry":{nest(n)}}}' for n in (0, 1, 8, 9, 12)]
    (tmp_path / "f.json").write_text("\n".join(lines))
    assert {r.id: r.valid for r in S.geojson(spark, f"file://{tmp_path}/f.json").collect()} == {"0": True, "1": True, "8": True, "9": False, "12": False}


def test_folded_search(spark):
    d = spark.createDataFrame([(1, "Zürich", 1, "CH", ["Zurigo "]), (2, "Bern", 1, "CH", ["Zürich-Bern", None])], "id int, name string, level int, country string, aliases array<string>")
    assert [(r.id, r.rank) for r in W.region_search(d, " ZURICH", 5).collect()] == [(1, 0.0), (2, 1.0)]


def test_page_checks(spark):
    pages = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "c"), (None, "c")], "id int, body string")
    got = sorted(((r.id is None, r.id or 0, r.copies, r.conflict) for r in K.page_union(pages, "id", F.col("body")).collect()))
    assert got == [(False, 1, 2, False), (False, 2, 2, True), (True, 0, 1, False), (True, 0, 1, False)]
    with pytest.raises(ValueError, match="loops"):
        K.require_none(K.page_loops(pages, "body", "id"), "loops")


def test_filters_take_nulls_and_edges(spark):
    d = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)], "w double, s double, e double, n double")
    b = tuple(F.col(c) for c in "wsen")
    assert [r[0] for r in d.select(F.coalesce(P.valid_bounds(*b), F.lit(False))).collect()] == [True, False, False]
    touching = (1.0, 0.0, 2.0, 1.0)
    assert d.limit(1).select(P.bbox_closed(*b, touching), P.bbox_open(*b, touching)).first()[:] == (True, False)


def test_dedup_sides_and_fold(spark):
    d = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, o int, v string")
    assert sorted(map(tuple, W.dedup_first(d, ["k"], ["o"]).collect())) == [(1, 1, "a"), (2, 1, None)]
    assert sorted(map(tuple, W.dedup_last(d, ["k"], ["o"]).collect())) == [(1, 2, "b"), (2, 1, None)]
    t = spark.createDataFrame([("  ÉCOLE  ﬁn ",), (None,)], "t string")
    assert [r[0] for r in t.select(X.fold_text(F.col("t"))).collect()] == ["ecole fin", None]


def test_time_lists(spark):
    d = spark.createDataFrame([("2020-01-31/2021-01-01/P1M", dt.datetime(2020, 2, 29)), ("2020-01-31/2021-01-01/P1M", dt.datetime(2020, 2, 28)), ("bad,2020-05-01", dt.datetime(2020, 5, 1)), ("2020-01-01/2020-01-02/PT6H", dt.datetime(2020, 1, 1, 12))], "dims string, at timestamp")
    got = {(r.dims, r.at): r.supported for r in X.time_supported(d, "dims", "at").collect()}
    assert sorted(got.values()) == [False, True, True, True]
    assert got["2020-01-31/2021-01-01/P1M", dt.datetime(2020, 2, 28)] is False


def test_exact_and_sampled_envelopes(spark):
    boxes = spark.createDataFrame([(1, 10.0, -1.0, 20.0, 1.5), (1, 10.0, -1.0, 20.0, 1.5), (2, -20.0, 30.0, -10.0, 40.0)], "k int, w double, s double, e double, n double")
    radius = 6371007.181
    exact = sorted(map(tuple, G.sinusoidal_envelope(boxes, "k").collect()))
    assert len(exact) == 3 and abs(exact[0][3] - radius * math.radians(20)) < 1e-6  # the equator lies inside
    assert abs(exact[2][1] - radius * math.radians(-20) * math.cos(math.radians(30))) < 1e-6
    sampled = sorted(map(tuple, G.projected_envelope(boxes, "k", G.sinusoidal_forward).collect()))
    assert len(sampled) == 3 and all(s[3] <= x[3] for s, x in zip(sampled, exact, strict=True))


def test_boxes_beyond_the_mercator_limit_are_errors(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 80.0, 1.0, 86.0), (3, -180.0, -80.0, 180.0, 80.0)], "k int, w double, s double, e double, n double")
    with pytest.raises(Exception, match="Mercator"):
        G.lonlat_tiles(boxes, 1, 2).collect()
    got = G.tile_selection(boxes, "k", 0, 5).collect()
    assert {r.k: r.error for r in got if r.error} == {2: "outside", 3: "too many"}
    own = sorted((r.place, r.tile_id) for r in got if r.k == 1)
    assert [p for p, _ in own] == list(range(1, 7)) and [t for _, t in own] == sorted(t for _, t in own)


def test_repeated_instants_stay(spark):
    d = spark.createDataFrame([("2024-01-01", "2024-01-01")] * 2 + [(None, "2024-01-01"), ("2024-01-01", None)], "dims string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(str(r.supported) for r in X.time_supported(d, "dims", "at").collect()) == ["False", "False", "True", "True"]


def test_catalogue_pages(spark):
    rows = spark.createDataFrame([(f"d{k:02}", "Land Cover" if k % 2 else None, "raster") for k in range(30)], "id string, title string, category string")
    got = Rs.catalog_page(rows, "cover", 10, 4).collect()
    assert [(r.id, r.total, r.next_offset, r.complete) for r in got] == [(f"d{k}", 15, 14, False) for k in (21, 23, 25, 27)]
    assert Rs.catalog_page(rows, None, 28, 20).count() == 2
    for wrong in ({"limit": 0}, {"limit": 21}, {"offset": 10_001}, {"query": "é" * 51}):
        with pytest.raises(ValueError, match="page"):
            Rs.catalog_page(rows, **wrong)
