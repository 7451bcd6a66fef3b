"""Queries of grids, covers, tiles and chains that need more than one step around their operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import grid as G
from terraloom.functions import raster as R
from terraloom.operators import aggregates as A
from terraloom.operators import checks as K
from terraloom.operators import graph as Gr
from terraloom.operators import mosaic as M
from terraloom.operators import resolve as Rs
from terraloom.operators import windows as W
from terraloom.plans.q_grid import _HILBERT, _TILES, _cells, _tiles
from terraloom.plans.registry import query
from terraloom.sources import readers as S
from terraloom.sources.storage import ranged

C = F.col


@query("SELECT scene, CAST(y // 8 AS BIGINT) AS block, sha256(string_agg(CAST(red AS VARCHAR), ',' ORDER BY y, x)) AS digest, count(*) AS n FROM px GROUP BY 1, 2")
def agg_ordered_digest(v):
    return A.ordered_digest(v.px, "red", 8, ("scene",))


@query(f"{_TILES} SELECT item_id, CAST(z AS INT) AS z, x, y FROM tiles")
def fn_lonlat_tiles(v):
    return _tiles(v)


@query(f"{_TILES} SELECT CAST(z AS INT) AS z, count(*) AS tiles, count(DISTINCT (x + y) % 17) AS contents FROM (SELECT DISTINCT z, x, y FROM tiles) t GROUP BY z")
def agg_tile_contents(v):
    t = _tiles(v).select("z", "x", "y").distinct()
    return A.tile_contents(t.withColumn("data", ((C("x") + C("y")) % 17).cast("string")))


@query(f"{_TILES} SELECT DISTINCT CAST(z AS INT) AS z, x, y FROM tiles WHERE (x + y) % 3 = 0")
def set_absent(v):
    t = _tiles(v).select("z", "x", "y").distinct()
    return K.absent(t, t.where("(x + y) % 3 <> 0"))


@query("""WITH b AS (SELECT item_id, CAST(floor(w / 5) AS BIGINT) * 5 AS w5, CAST(ceil(e / 5) AS BIGINT) * 5 AS e5, CAST(floor(s / 5) AS BIGINT) * 5 AS s5, CAST(ceil(n / 5) AS BIGINT) * 5 AS n5 FROM item),
x AS (SELECT item_id, s5, n5, unnest(range(w5, e5, 5)) AS a FROM b), y AS (SELECT item_id, a, unnest(range(s5, n5, 5)) AS b FROM x), z AS (SELECT *, unnest(['map', 'mask']) AS l FROM y)
SELECT item_id, concat(CASE WHEN b < 0 THEN 'S' ELSE 'N' END, lpad(CAST(abs(b) AS VARCHAR), 2, '0'), CASE WHEN a < 0 THEN 'W' ELSE 'E' END, lpad(CAST(abs(a) AS VARCHAR), 3, '0'), '_', l) AS source FROM z""")
def res_tiles(v):
    req = v.item.select("item_id", "w", "s", "e", "n", F.array(F.lit("map"), F.lit("mask")).alias("layers"))
    return Rs.tiles(req, 5).select("item_id", "source")


@query("SELECT x, y, coalesce(arg_max(qa_pixel, scene) FILTER (WHERE qa_pixel & 1 = 0), arg_max(qa_pixel, scene)) AS value, bool_or(qa_pixel & 1 = 0) AS covered FROM px GROUP BY x, y")
def mos_landsat_qa(v):
    return M.mosaic_flags(v.px, "qa_pixel", ~R.any_bit(C("qa_pixel"), 1), ["scene"])


@query("SELECT CAST(s_suppkey AS BIGINT) AS root, CAST(count(DISTINCT w) AS BIGINT) AS ways FROM (SELECT s_suppkey, unnest([s_suppkey, s_suppkey + 1, s_suppkey + 2]) AS r FROM supplier) t JOIN (SELECT s_suppkey AS r2, unnest([s_suppkey * 2, s_suppkey * 3]) AS w FROM supplier) u ON u.r2 = t.r JOIN part ON p_partkey = w WHERE r <= s_suppkey + 2 - s_suppkey % 3 GROUP BY 1")
def graph_osm_relation(v):
    i = C("s_suppkey").cast("bigint")
    own = v.supplier.select(i.alias("relation_id"), F.explode(F.array(i * 2, i * 3)).alias("ref")).select("relation_id", F.lit("way").alias("type"), "ref")
    sub = v.supplier.where("s_suppkey % 3 <> 2").select(i.alias("relation_id"), F.lit("relation").alias("type"), (i + 1).alias("ref"))
    d = Gr.relation_geometry(own.unionByName(sub), v.part.select(C("p_partkey").cast("bigint").alias("way_id")), 3)
    return d.groupBy("root").agg(F.count("*").alias("ways"))


@query("""WITH g AS (SELECT item_id, x, unnest(range((SELECT max(y) + 1 FROM px))) AS y FROM (SELECT item_id, unnest(range((SELECT max(x) + 1 FROM px))) AS x FROM (SELECT DISTINCT item_id FROM px) a) b)
SELECT g.item_id AS path, CAST(g.x AS INT) AS x, CAST(g.y AS INT) AS y, CASE WHEN red = 0 THEN NULL ELSE CAST(red - 10000 AS INT) END AS height FROM g LEFT JOIN px ON px.item_id = g.item_id AND px.x = g.x AND px.y = g.y""")
def src_hgt_grid(v):
    side = 16
    v.part = ranged(v.part.select("p_partkey"), "p_partkey")  # else each row group's pixels are one task's; a tile's cells stay in few ranges
    extent = v.px.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
    spans = [F.explode(F.sequence(F.lit(0), F.lit((n - 1) // side))).alias(c) for c, n in (("tx", extent.w), ("ty", extent.h))]
    bare = v.px.select("item_id").distinct().select("item_id", spans[0]).select("item_id", "tx", spans[1], F.lit(None).cast("int").alias("m"))
    # a cell is one number, its place and its word; tiles without cells come in by a union, as a join may broadcast all cells
    number = (C("y") % side * side + C("x") % side) * 65536 + (F.when(C("red") == 0, -32768).otherwise(C("red") - 10000) + 65536) % 65536
    cells = v.px.where("x >= 0 and y >= 0").select("item_id", F.floor(C("x") / side).cast("int").alias("tx"), F.floor(C("y") / side).cast("int").alias("ty"), number.cast("int").alias("m"))
    grid = bare.unionByName(cells).groupBy("item_id", "tx", "ty").agg(F.collect_list("m").alias("m"))
    lacks = F.array_except(F.sequence(F.lit(0), F.lit(side * side - 1)), F.transform("m", lambda m: F.shiftright(m, 16)))  # what a tile lacks is void
    words = F.transform(F.sort_array(F.concat("m", F.transform(lacks, lambda k: k * 65536 + 32768))), lambda m: F.lpad(F.hex(m % 65536), 4, "0"))
    files = grid.select(F.concat_ws("@", "item_id", "tx", "ty").alias("path"), F.unhex(F.array_join(words, "")).alias("content"))
    part = lambda k: F.split_part("path", F.lit("@"), F.lit(k))
    out = S.hgt_grid(files, side).select(part(1).alias("path"), (part(2).cast("int") * side + C("x")).alias("x"), (part(3).cast("int") * side + C("y")).alias("y"), "height")
    return out.where((C("x") < extent.w) & (C("y") < extent.h))


@query("WITH h AS (SELECT max(y) + 1 AS h FROM px), g AS (SELECT i.k AS i, j.k AS j, i.k * 50 // 20 AS x, j.k * h // 5 AS y FROM (SELECT unnest(range(20)) AS k) i, (SELECT unnest(range(5)) AS k) j, h) SELECT scene, CAST(i AS INT) AS i, CAST(j AS INT) AS j, red FROM px JOIN g USING (x, y)")
def smp_preview(v):
    height = v.px.agg(F.max("y") + 1).first()[0]
    return W.preview(v.px, 50, height, 20, 5).select("scene", "i", "j", "red")


@query(f"{_HILBERT}, r AS (SELECT p, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM h WHERE s = 0) SELECT p, row_number() OVER (ORDER BY tile_id, p) AS place FROM r")
def ord_tile_id(v):
    return W.ranked(_cells(v).select("p", G.tile_id(C("z"), C("x"), C("y")).alias("tile_id")), ["tile_id", "p"]).select("p", "place")


@query("""WITH RECURSIVE c AS (SELECT CAST(p_partkey AS BIGINT) AS output, CAST(p_partkey AS BIGINT) AS id, 0 AS depth FROM part UNION ALL SELECT output, parent_id, depth + 1 FROM c JOIN job_edge e ON e.id = c.id) SELECT output, string_agg(concat('op', CAST(id % 5 AS VARCHAR)), '>' ORDER BY depth DESC) AS operations FROM c GROUP BY output""")
def lin_steps(v):
    nodes = v.part.select(C("p_partkey").cast("bigint").alias("id"), F.concat(F.lit("op"), (C("p_partkey") % 5).cast("string")).alias("operation"))
    chain = Gr.lineage(v.job_edge, nodes.select(C("id").alias("output"), "id"))
    return Gr.steps(chain, nodes).select("output", F.array_join("operations", ">").alias("operations"))


_RECIPE = "SELECT CAST(p_partkey AS BIGINT) AS id, (CAST(p_partkey AS BIGINT) - 1) // 2 AS a, CASE WHEN p_partkey % 3 = 0 THEN (CAST(p_partkey AS BIGINT) - 1) // 3 END AS b FROM part"


@query(f"""WITH RECURSIVE n AS ({_RECIPE}), e AS (SELECT id, a AS parent_id FROM n WHERE id > 0 UNION SELECT id, b FROM n WHERE id > 0 AND b IS NOT NULL),
c AS (SELECT id AS output, id FROM n UNION SELECT output, parent_id FROM c JOIN e USING (id)), d AS (SELECT id, 0 AS depth FROM n WHERE id = 0 UNION SELECT e.id, depth + 1 FROM d JOIN e ON e.parent_id = d.id), l AS (SELECT id, max(depth) AS depth FROM d GROUP BY id)
SELECT output, CAST(row_number() OVER (PARTITION BY output ORDER BY depth, id) AS INTEGER) AS place, id, concat('op', CAST(id % 5 AS VARCHAR)) AS operation, concat('crs=', CAST(4326 + id % 3 AS VARCHAR)) AS parameters FROM c JOIN l USING (id)""")
def lin_step_parameters(v):
    p = C("p_partkey").cast("bigint")
    nodes = v.part.select(p.alias("id"), F.concat(F.lit("op"), (p % 5).cast("string")).alias("operation"), F.create_map(F.lit("crs"), (4326 + p % 3).cast("string")).alias("parameters"))
    two = F.array_distinct(F.array_compact(F.array(F.floor((p - 1) / 2), F.when(p % 3 == 0, F.floor((p - 1) / 3)))))
    edges = v.part.where("p_partkey > 0").select(p.alias("id"), F.explode(two).alias("parent_id"))
    found = Gr.lineage_steps(nodes, edges, max_nodes=1 << 40)
    return found.withColumn("parameters", F.concat(F.lit("crs="), C("parameters")["crs"]))


@query("""WITH b AS (SELECT scene, CAST(y // 8 AS BIGINT) AS block, sha256(string_agg(CAST(red AS VARCHAR), ',' ORDER BY y, x)) AS digest, count(*) AS n FROM px GROUP BY 1, 2)
SELECT scene, sha256(string_agg(digest, '' ORDER BY block)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY scene""")
def agg_grid_digest(v):
    return A.grid_digest(A.ordered_digest(v.px, "red", 8, ("scene",)), ["scene"])


_FAMILIES = {"rgb": "NOT (red = 0 AND green = 0 AND blue = 0)", "class": "scl <> 0", "elevation": "scl <> 3", "radar": "ndvi % 5 <> 0", "srtm": "evi % 7 <> 0", "aerial": "qc % 3 <> 0", "single": "red <> 0"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, x, y, max(scene) FILTER (WHERE {rule}) AS winner, bool_or({rule}) AS covered FROM px GROUP BY x, y" for k, rule in _FAMILIES.items()))
def mos_families(v):
    void = lambda c, bad: F.when(bad, -32768).otherwise(C(c))
    bands = {
        "rgb": [C("red"), C("green"), C("blue")],
        "class": [C("scl")],
        "elevation": [F.when(C("scl") == 3, float("nan")).otherwise(C("red").cast("double"))],
        "radar": [void("ndvi", C("ndvi") % 5 == 0)],
        "srtm": [void("evi", C("evi") % 7 == 0)],
        "aerial": [C("red")],
        "single": [C("red")],
    }
    out = None
    for family, own in bands.items():
        ok = M.has_data(family, own, 0, C("qc") % 3 != 0)
        part = M.mosaic_newest(v.px, "scene", ok, ["scene"]).select(F.lit(family).alias("family"), "x", "y", "winner", "covered")
        out = part if out is None else out.unionByName(part)
    return out
