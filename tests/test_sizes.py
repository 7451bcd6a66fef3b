"""Plans and steps that hold at any size of the tables."""

from pyspark.sql import functions as F

from terraloom import queries as core
from terraloom.functions import grid as G
from terraloom.operators import graph as Gr
from terraloom.operators import joins as J
from terraloom.plans.registry import QUERIES
from terraloom.sources import readers as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_broadcast(spark):
    # a plan takes 1.2 million rows made of one for a few bytes
    px = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(1_199_999))).alias("p")).selectExpr("cast(p % 25 as int) as scene", "cast(p div 25 % 50 as int) as x", "cast(p div 1250 as int) as y", "p as qa_pixel", "p as qa_radsat")
    d = J.join_qa_pair(px.drop("qa_radsat"), px.drop("qa_pixel"))
    assert "BroadcastHashJoin" not in plan(d)
    points = spark.createDataFrame([(1, 0.5, -0.5), (2, 3.5, -2.5), (3, -7.0, 9.0)], "id long, px double, py double")
    d = J.coordinate_samples(px, points, 0.0, 0.0, 1.0, 1.0)
    assert "BroadcastHashJoin" not in plan(d)
    assert sorted((r.id, r.x, r.y, r.scene) for r in d.collect()) == [(1, 0, 0, s) for s in range(25)] + [(2, 3, 2, s) for s in range(25)]
    assert J.coordinate_samples(px, points.limit(0), 0.0, 0.0, 1.0, 1.0).count() == 0


def test_tile_number_is_worked_out_once(spark):
    cells = spark.range(50).selectExpr("cast(id % 12 as int) as z", "id % (1L << cast(id % 12 as int)) as x", "id * 7 % (1L << cast(id % 12 as int)) as y")
    d = cells.select("z", "x", "y", G.tile_coord(G.tile_id(F.col("z"), F.col("x"), F.col("y"))).alias("t"))
    assert all((r.t.z, r.t.x, r.t.y) == (r.z, r.x, r.y) for r in d.collect())
    assert d._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 2  # one for the number, one for its tile


def test_boundaries_are_checked_once(spark, sf_dir):
    text = QUERIES["fn_polygon_limits"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [boundary" in text


def test_polygon_coordinates(spark):
    nan = float("nan")
    rings = [
        ([(170.0, 0.0), (-170.0, 0.0), (0.0, 9.0), (170.0, 0.0)], "coordinates"), ([(0.0, 0.0), (None, 0.0), (0.0, 9.0), (0.0, 0.0)], "coordinates"), ([(0.0, 0.0), (9.0, nan), (0.0, 9.0), (0.0, 0.0)], "coordinates"),
        ([(0.0, -90.0), (9.0, 0.0), (0.0, 90.0), (0.0, -90.0)], None), ([(0.0, -90.5), (9.0, 0.0), (0.0, 9.0), (0.0, -90.5)], "coordinates"), ([(0.0, 0.0), (9.0, 0.0), None, (0.0, 0.0)], "coordinates"),
    ]
    d = spark.createDataFrame([(k, [[ring]]) for k, (ring, _) in enumerate(rings)], "k int, p array<array<array<struct<x: double, y: double>>>>")
    got = {r.k: r.e for r in d.select("k", G.polygon_error(F.col("p")).alias("e")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(rings)}


def test_small_height_grids_share_batches(spark):
    files = [(f"f{k}", b"".join(v.to_bytes(2, "big", signed=True) for v in (k, -32768, -k, 7))) for k in range(500)]
    d = spark.createDataFrame(files, "path string, content binary").coalesce(1)
    assert "MapInArrow" in plan(S.hgt_grid(d, 2))  # one frame a file before
    got = {(r.path, r.x, r.y): r.height for r in S.hgt_grid(d, 2).collect()}
    assert got == {(f"f{k}", x, y): [k, None, -k, 7][2 * y + x] for k in range(500) for x in (0, 1) for y in (0, 1)}
    large = b"".join((v % 30000).to_bytes(2, "big") for v in range(400 * 400))
    got = S.hgt_grid(spark.createDataFrame([("l", large)], "path string, content binary"), 400)
    assert got.where("height <> (y * 400 + x) % 30000 or height is null").count() == 0 and got.count() == 160_000


def test_height_cells_are_not_broadcast(spark, tmp_path):
    keys = [0, 3, 1205, 4006]  # most tiles have no cell, some rows of tiles have none at all
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    d = core.QUERIES["src_hgt_grid"](spark, str(tmp_path))
    assert "Broadcast" not in plan(d)  # a plan takes the cells for a few bytes, whatever they are
    want = {(f"S{n:03}", x, y): None for n in range(25) for x in range(7) for y in range(81)}
    for n in range(25):
        for p in keys:
            if (p * 31 + n * 17) % 9:
                want[f"S{n:03}", p % 50, p // 50] = (p * 97 + n * 211) % 20000 + 1 - 10000
    got = d.collect()
    assert {(r.path, r.x, r.y): r.height for r in got} == want and len(got) == len(want)


def test_graph_joins_are_not_broadcast(spark, monkeypatch):
    made = []
    real = Gr.written
    monkeypatch.setattr(Gr, "written", lambda df, name: (made.append(plan(df)), real(df, name))[1])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 8)], "id long, parent_id long")
    assert sorted(map(tuple, Gr.cycles(edges).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6)]
    assert made and not any("BroadcastHashJoin" in p for p in made)


def test_lineage_is_dealt_by_rows(spark):
    rows = spark.range(4000)
    assert Gr._tasks(rows, 100) == 40 and Gr._tasks(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = spark.range(40).selectExpr("id", "concat('op', id) as operation", "map('k', id) as parameters")
    edges = spark.range(1, 40).selectExpr("id", "(id - 1) div 2 as parent_id")
    got = {}
    for r in Gr.lineage_steps(nodes, edges).collect():
        got.setdefault(r.output, {})[r.place] = (r.id, r.operation, r.parameters["k"])
    for k in range(40):
        way = [k]
        while way[0]:
            way.insert(0, (way[0] - 1) // 2)
        assert got[k] == {n: (i, f"op{i}", i) for n, i in enumerate(way, 1)}
