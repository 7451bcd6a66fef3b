"""Queries of raster science and of the mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import raster as R
from terraloom.operators import mosaic as M
from terraloom.plans.registry import query


def _complete():
    return (F.col("red") != 0) & (F.col("green") != 0) & (F.col("blue") != 0)


_products = ", ".join(f"({k}, {scale}::DOUBLE, {offset}::DOUBLE, {nodata})" for k, (_, scale, offset, nodata) in enumerate(R.CALIBRATION))


@query(f"""SELECT scene, x, y, CASE WHEN v <> nodata THEN v * scale + off END AS reflectance FROM (SELECT scene, x, y, CASE WHEN (x + y) % 7 = 0 THEN nodata ELSE red END AS v, scale, off, nodata
FROM px JOIN (VALUES {_products}) c(k, scale, off, nodata) ON scene % {len(R.CALIBRATION)} = k) t""")
def fn_calibrate(v):
    k = (F.col("scene") % len(R.CALIBRATION) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in R.CALIBRATION]), k)
    px = v.px.select("scene", "x", "y", F.when((F.col("x") + F.col("y")) % 7 == 0, pick(3)).otherwise(F.col("red")).alias("value"), pick(0).alias("product"))
    return R.calibrate(px, R.calibration_table(v.spark)).select("scene", "x", "y", "reflectance")


_layers = " UNION ALL ".join(f"SELECT '{a}' AS layer, '{b}' AS data_type, {c} AS bits, {d}::DOUBLE AS scale, {e}::BIGINT AS fill, {f}::BIGINT AS low, {g}::BIGINT AS high, '{h}' AS kind" for a, b, c, d, e, f, g, h in R.BAND_LAYERS)


@query(f"""WITH l AS ({_layers}), k AS (SELECT CASE scene % 3 WHEN 0 THEN 'ndvi' WHEN 1 THEN 'vi_red' ELSE 'vi_doy' END AS layer, ndvi FROM px)
SELECT l.layer, l.data_type, l.bits, l.scale, l.kind, count(*) AS n, count(*) FILTER (WHERE ndvi BETWEEN low AND high AND ndvi <> fill) AS inside FROM k JOIN l USING (layer) GROUP BY ALL""")
def fn_band_layer(v):
    key = F.when(F.col("scene") % 3 == 0, "ndvi").when(F.col("scene") % 3 == 1, "vi_red").otherwise("vi_doy")
    joined = v.px.select(key.alias("layer"), "ndvi").join(F.broadcast(R.band_layers(v.spark)), "layer")
    return joined.groupBy("layer", "data_type", "bits", "scale", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("ndvi").between(F.col("low"), F.col("high")) & (F.col("ndvi") != F.col("fill"))).alias("inside"))


@query("""SELECT scene, x, y, (ndvi <> -1 AND ndvi BETWEEN 1 AND 366 AND ndvi <= CASE WHEN (1996 + scene) % 4 = 0 AND ((1996 + scene) % 100 <> 0 OR (1996 + scene) % 400 = 0) THEN 366 ELSE 365 END) AS ok FROM px""")
def fn_within_range(v):
    ok = R.within_range(F.col("ndvi"), F.lit(-1), F.lit(1), F.lit(366), F.lit("date"), F.col("scene") + 1996)
    return v.px.select("scene", "x", "y", ok.alias("ok"))


@query("""SELECT scene, x, y, CASE WHEN ndvi BETWEEN 1 AND CASE WHEN (1996 + scene) % 4 = 0 AND ((1996 + scene) % 100 <> 0 OR (1996 + scene) % 400 = 0) THEN 366 ELSE 365 END
THEN make_date(1996 + scene, 1, 1) + CAST(ndvi - 1 AS INT) END AS day FROM px""")
def fn_doy_to_date(v):
    return v.px.select("scene", "x", "y", R.doy_to_date(F.col("scene") + 1996, F.col("ndvi")).alias("day"))


@query("SELECT scene, x, y, CASE WHEN ndvi > 0 THEN round(10 * log10(CAST(ndvi AS DOUBLE)), 6) END AS db FROM px")
def fn_gamma0_db(v):
    return v.px.select("scene", "x", "y", F.round(R.gamma0_db(F.col("ndvi").cast("double")), 6).alias("db"))


def _field_sql(fields, column):
    rows = " UNION ALL ".join(f"SELECT scene, '{n}' AS field, ({column} >> {a}) & {(1 << (b - a + 1)) - 1} AS code, {'TRUE' if c is None else f'(({column} >> {a}) & {(1 << (b - a + 1)) - 1}) IN ({chr(44).join(map(str, c))})'} AS defined FROM px" for n, a, b, c in fields)
    return f"SELECT field, code, defined, count(*) AS n FROM ({rows}) t GROUP BY ALL"


def _field_hist(px, column, fields):
    d = px.select(F.explode(R.decode_bits(F.col(column), fields)).alias("f"))
    return d.groupBy(F.col("f.field").alias("field"), F.col("f.code").alias("code"), F.col("f.defined").alias("defined")).agg(F.count("*").alias("n"))


for _name, _col, _fields in (("fn_qc_modis_500m", "qc", R.QC_MODIS_500M), ("fn_qc_modis_state", "state", R.QC_MODIS_STATE), ("fn_qc_vi", "vi_quality", R.QC_VI), ("fn_qa_pixel", "qa_pixel", R.QA_PIXEL), ("fn_qa_radsat", "qa_radsat", R.QA_RADSAT)):

    def _run(v, column=_col, fields=_fields):
        return _field_hist(v.px, column, fields)

    _run.__name__ = _name
    query(_field_sql(_fields, _col))(_run)


@query("SELECT scene, x, y, lpad(bin(qa_pixel), 16, '0') AS bits, concat('0x', lpad(upper(hex(qa_pixel)), 4, '0')) AS hex FROM px")
def fn_bits_text(v):
    b, h = R.bits_text(F.col("qa_pixel"), 16)
    return v.px.select("scene", "x", "y", b.alias("bits"), h.alias("hex"))


@query("""SELECT CAST(CASE WHEN qa_pixel & 8 <> 0 THEN 3 WHEN qa_pixel & 2 <> 0 THEN 2 WHEN qa_pixel & 4 <> 0 THEN 4 WHEN qa_pixel & 16 <> 0 THEN 5 WHEN qa_pixel & 32 <> 0 THEN 6 WHEN qa_pixel & 128 <> 0 THEN 7 WHEN qa_pixel & 64 <> 0 THEN 1 ELSE 0 END AS INT) AS class,
count(*) AS n, CAST(sum(qa_pixel) AS BIGINT) AS total FROM px GROUP BY 1""")
def fn_qa_pixel_class(v):
    return v.px.groupBy(R.qa_pixel_class(F.col("qa_pixel")).alias("class")).agg(F.count("*").alias("n"), F.sum("qa_pixel").alias("total"))


@query("""SELECT CAST(CASE WHEN qa_radsat & 63104 <> 0 THEN 4 WHEN qa_radsat & 2048 <> 0 THEN 3 WHEN qa_radsat & 14 <> 0 THEN 1 WHEN qa_radsat & 369 <> 0 THEN 2 ELSE 0 END AS INT) AS class, count(*) AS n FROM px GROUP BY 1""")
def fn_radsat_class(v):
    return v.px.groupBy(R.radsat_class(F.col("qa_radsat")).alias("class")).agg(F.count("*").alias("n"))


_classes = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS class, '{a}' AS label, {r} AS r, {g} AS g, {b} AS b" for k, (a, r, g, b) in enumerate(R.SCENE_CLASSES))


@query(f"WITH c AS ({_classes}) SELECT scene, x, y, label, r, g, b FROM px JOIN c ON scl = class")
def fn_scl_class(v):
    return R.scl_class(v.px.select("scene", "x", "y", "scl"), R.scene_classes(v.spark)).select("scene", "x", "y", "label", "r", "g", "b")


@query(f"WITH c AS ({_classes}) SELECT class, label, count(scl) AS n FROM c LEFT JOIN px ON scl = class GROUP BY ALL")
def agg_class_hist(v):
    counts = v.px.groupBy(F.col("scl").alias("class")).agg(F.count("*").alias("n"))
    return R.scene_classes(v.spark).join(counts, "class", "left").select("class", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH c AS ({_classes}) SELECT scene, label, count(*) AS n, CAST(sum(r * 65536 + g * 256 + b) AS BIGINT) AS color_sum FROM px JOIN c ON scl = class GROUP BY ALL")
def join_dim_palette(v):
    joined = v.px.select("scene", F.col("scl").alias("class")).join(F.broadcast(R.scene_classes(v.spark)), "class")
    return joined.groupBy("scene", "label").agg(F.count("*").alias("n"), F.sum(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("color_sum"))


_CONSERVATIVE = "qa_pixel & 31 = 0 AND qa_radsat & 2062 = 0 AND qa_pixel & 32 = 0 AND qa_pixel & 64 <> 0 AND (qa_pixel >> 8) & 3 = 1 AND (qa_pixel >> 10) & 3 = 1 AND (qa_pixel >> 14) & 3 = 1 AND (qa_pixel >> 12) & 3 = 1 AND qa_radsat & 63104 = 0"


@query(f"SELECT scene, count(*) FILTER (WHERE qa_pixel & 31 = 0 AND qa_radsat & 2062 = 0) AS cloud_free, count(*) FILTER (WHERE qa_pixel & 63 = 0 AND qa_radsat & 2062 = 0) AS no_snow, count(*) FILTER (WHERE {_CONSERVATIVE}) AS conservative FROM px GROUP BY scene")
def fn_accept_landsat(v):
    p, r = F.col("qa_pixel"), F.col("qa_radsat")
    return v.px.groupBy("scene").agg(F.count_if(R.accept_landsat("cloud_free", False, p, r)).alias("cloud_free"), F.count_if(R.accept_landsat("cloud_free", True, p, r)).alias("no_snow"), F.count_if(R.accept_landsat("conservative", True, p, r)).alias("conservative"))


@query("""SELECT scene, count(*) FILTER (WHERE qc <> 4294967295 AND state <> 65535 AND state & 9991 = 0) AS clear, count(*) FILTER (WHERE qc <> 4294967295 AND state <> 65535 AND state & 46855 = 0 AND qc & 261183 = 0) AS best FROM px GROUP BY scene""")
def fn_accept_modis(v):
    q, s = F.col("qc"), F.col("state")
    return v.px.groupBy("scene").agg(F.count_if(R.accept_modis("clear", False, q, s)).alias("clear"), F.count_if(R.accept_modis("clear_best", True, q, s)).alias("best"))


_VI = "vi_quality <> 65535 AND (vi_quality >> 2) & 15 IN (0, 1, 2, 4, 8, 9, 10) AND (vi_quality >> 6) & 3 <> 3 AND vi_quality & 50432 = 0"


@query(f"SELECT scene, count(*) FILTER (WHERE {_VI} AND vi_rel = 0 AND vi_quality & 3 = 0) AS good, count(*) FILTER (WHERE {_VI} AND vi_rel IN (0, 1) AND vi_quality & 3 <= 1) AS usable FROM px GROUP BY scene")
def fn_accept_vi(v):
    q, r = F.col("vi_quality"), F.col("vi_rel")
    return v.px.groupBy("scene").agg(F.count_if(R.accept_vi("good", q, r)).alias("good"), F.count_if(R.accept_vi("usable", q, r)).alias("usable"))


def _ramp_sql(k):
    c = "greatest(-2000, least(10000, ndvi))"
    return "CAST(CASE " + " ".join(f"WHEN {c} <= {b[0]} THEN ({a[k]} * ({b[0]} - {c}) + {b[k]} * ({c} - ({a[0]})) + {(b[0] - a[0]) // 2}) // {b[0] - a[0]}" for a, b in zip(R.VEGETATION_RAMP, R.VEGETATION_RAMP[1:])) + " END AS INT)"


@query(f"SELECT scene, x, y, {_ramp_sql(1)} AS r, {_ramp_sql(2)} AS g, {_ramp_sql(3)} AS b FROM px")
def fn_vi_color(v):
    r, g, b = R.vi_color(F.col("ndvi"))
    return v.px.select("scene", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT scene, x, y, CAST(round(greatest(0, least(1, CAST(ndvi - 500 AS DOUBLE) / 7000)) * 255) AS INT) AS byte FROM px")
def fn_stretch_byte(v):
    return v.px.select("scene", "x", "y", R.stretch_byte(F.col("ndvi"), F.lit(500), F.lit(7500)).alias("byte"))


@query("SELECT scene, x, y, ndvi AS c1, red AS c2, green AS c3 FROM px")
def fn_band_view(v):
    view = R.band_view(F.array("red", "green", "blue", "ndvi"), "cir")
    return v.px.select("scene", "x", "y", view[0].alias("c1"), view[1].alias("c2"), view[2].alias("c3"))


@query("""WITH t AS (SELECT o, 2000 + o % 30 AS y, 1 + (o * 8) % 360 AS d FROM item),
u AS (SELECT o, CASE WHEN o % 2 = 0 THEN 7 ELSE 15 END AS len, make_date(y, 1, 1) + CAST(d - 1 AS INT) AS first, make_date(y, 12, 31) AS ends FROM t)
SELECT o, first, least(first + len, ends) AS last FROM u""")
def fn_item_period(v):
    name = F.format_string("%s.A%04d%03d.h18v04.061.2024001000000", F.when(F.col("o") % 2 == 0, "MOD09A1").otherwise("MOD13Q1"), 2000 + F.col("o") % 30, 1 + (F.col("o") * 8) % 360)
    first, last = R.item_period(name)
    return v.item.select("o", first.alias("first"), last.alias("last"))


@query("""SELECT o, CAST(o % 360 - 180 AS INT) AS lon, CAST(o % 180 - 90 AS INT) AS lat, CASE o % 6 WHEN 4 THEN FALSE WHEN 5 THEN FALSE ELSE TRUE END AS inside FROM item""")
def fn_item_cell(v):
    lon, lat = F.col("o") % 360 - 180, F.col("o") % 180 - 90
    name = F.format_string("%s%02d%s%03d", F.when(lat < 0, "S").otherwise("N"), F.abs(lat), F.when(lon < 0, "W").otherwise("E"), F.abs(lon))
    off = lambda k, by: F.when(F.col("o") % 6 == k, by).otherwise(0.0)
    # offsets on either side of the limit of 0.001
    w, s, e, n = lon - off(1, 0.0005) - off(4, 0.0015), lat - off(2, 0.0005), lon + 1 + off(2, 0.0005), lat + 1 + off(3, 0.0005) + off(5, 0.0015)
    a, b = R.item_cell(name)
    return v.item.select("o", a.alias("lon"), b.alias("lat"), R.in_cell(a, b, w, s, e, n).alias("inside"))


@query("SELECT o, CASE WHEN o % 5 = 0 THEN NULL ELSE dt END AS day FROM item")
def fn_landsat_date(v):
    text = F.when(F.col("o") % 5 == 0, "19991340").otherwise(F.date_format("dt", "yyyyMMdd"))
    return v.item.select("o", R.landsat_date(F.concat(F.lit("LC08_L2SP_195027_"), text, F.lit("_02_T1"))).alias("day"))


# --- mosaics


@query("SELECT x, y, coalesce(arg_max(red, scene) FILTER (WHERE red <> 0), 0) AS value, arg_max(scene, scene) FILTER (WHERE red <> 0) AS winner, bool_or(red <> 0) AS covered FROM px GROUP BY x, y")
def mos_newest_valid(v):
    return M.mosaic_newest(v.px, "red", F.col("red") != 0, ["scene"], fill=0)


@query("""SELECT CAST(2 AS BIGINT) AS col0, CAST(11 AS BIGINT) AS col1, CAST(0 AS BIGINT) AS row0, CAST(greatest(0, max(y) + 1 - 3) AS BIGINT) AS row1, TRUE AS agreed FROM px""")
def mos_grid_plan(v):
    grids = v.px.groupBy("scene").agg(F.min("x").cast("double").alias("left"), (F.max("x") + 1).cast("double").alias("right"), F.lit(0.0).alias("bottom"), (F.max("y") + 1).cast("double").alias("top"))
    grids = grids.withColumns({"dx": F.lit(1.0), "dy": F.lit(1.0), "crs": F.lit("EPSG:32632"), "bands": F.lit(1)})
    return M.plan_grid(grids, 2.0000000001, 3.0, 10.5, 1e6)


@query("""WITH m AS (SELECT x, y, coalesce(arg_max(red, scene) FILTER (WHERE red <> 0), 0) AS value FROM px GROUP BY x, y)
SELECT count(*) FILTER (WHERE NOT (x + 0.5 < 25 AND y + 0.5 < 20)) AS masked, count(*) FILTER (WHERE x + 0.5 < 25 AND y + 0.5 < 20) AS kept, CAST(sum(CASE WHEN x + 0.5 < 25 AND y + 0.5 < 20 THEN value ELSE 0 END) AS BIGINT) AS total FROM m""")
def mos_polygon_mask(v):
    m = M.polygon_mask(M.mosaic_newest(v.px, "red", F.col("red") != 0, ["scene"], fill=0), (F.col("x") + 0.5 < 25) & (F.col("y") + 0.5 < 20), "value", 0)
    return m.agg(F.count_if("masked").alias("masked"), F.count_if(~F.col("masked")).alias("kept"), F.sum("value").alias("total"))


@query("SELECT x, y, arg_max(qc, scene) FILTER (WHERE qc <> 4294967295) AS value, arg_max(scene, scene) FILTER (WHERE qc <> 4294967295) AS winner, bool_or(qc <> 4294967295) AS covered FROM px GROUP BY x, y")
def mos_modis_qa(v):
    return M.mosaic_newest(v.px, "qc", F.col("qc") != 4294967295, ["scene"])


_VIC = "ndvi BETWEEN -2000 AND 10000 AND evi BETWEEN -2000 AND 10000"
_VIG = f"{_VIC} AND {_VI} AND vi_rel IN (0, 1) AND vi_quality & 3 <= 1"
_VISEL = f"SELECT x, y, arg_max(scene, scene) FILTER (WHERE {_VIC}) AS baseline, arg_max(scene, scene) FILTER (WHERE {_VIG}) AS winner, arg_max(ndvi, scene) FILTER (WHERE {_VIG}) AS ndvi, arg_max(evi, scene) FILTER (WHERE {_VIG}) AS evi FROM px GROUP BY x, y"
_COUNTERS = """SELECT count(*) AS pixels, count(baseline) AS common, count(winner) AS covered, count(*) - count(winner) AS rejected, count(*) FILTER (WHERE baseline IS NOT NULL AND winner IS NULL) AS removed,
count(*) FILTER (WHERE baseline <> winner) AS fallback, CAST(coalesce(sum(winner + 1), 0) AS BIGINT) AS winner_sum FROM s"""


def _vi(v):
    inside = F.col("ndvi").between(-2000, 10000) & F.col("evi").between(-2000, 10000)
    return M.select_two(v.px, inside, R.accept_vi("usable", F.col("vi_quality"), F.col("vi_rel")), ["ndvi", "evi"], ["scene"], "scene")


@query(_VISEL)
def mos_vi_selection(v):
    return _vi(v)


@query(f"WITH s AS ({_VISEL}) {_COUNTERS}")
def mos_vi_counters(v):
    return M.selection_counters(_vi(v))


_RC = "red <> 0 AND green <> 0 AND blue <> 0"
_RG = f"{_RC} AND qa_pixel & 31 = 0 AND qa_radsat & 2062 = 0"
_RSEL = f"SELECT x, y, arg_max(scene, scene) FILTER (WHERE {_RC}) AS baseline, arg_max(scene, scene) FILTER (WHERE {_RG}) AS winner, arg_max(red, scene) FILTER (WHERE {_RG}) AS red, arg_max(green, scene) FILTER (WHERE {_RG}) AS green, arg_max(blue, scene) FILTER (WHERE {_RG}) AS blue FROM px GROUP BY x, y"


def _coupled(v):
    return M.select_two(v.px, _complete(), R.accept_landsat("cloud_free", False, F.col("qa_pixel"), F.col("qa_radsat")), ["red", "green", "blue"], ["scene"], "scene")


@query(_RSEL)
def mos_coupled_rgb(v):
    return _coupled(v)


@query(f"WITH s AS ({_RSEL}) {_COUNTERS}")
def mos_coupled_counters(v):
    return M.selection_counters(_coupled(v))


@query(f"WITH s AS ({_RSEL}) SELECT winner, count(*) AS pixels FROM s WHERE winner IS NOT NULL GROUP BY winner")
def agg_scene_contrib(v):
    return M.scene_contributions(_coupled(v))


@query("""SELECT scene, count(*) FILTER (WHERE NOT (qa_pixel & 31 = 0 AND qa_radsat & 2062 = 0)) AS rejected, count(*) FILTER (WHERE NOT (qa_pixel & 31 = 0 AND qa_radsat & 2062 = 0) AND red <> 0 AND green <> 0 AND blue <> 0) AS removed,
CAST(sum(CASE WHEN qa_pixel & 31 = 0 AND qa_radsat & 2062 = 0 THEN red ELSE 0 END) AS BIGINT) AS red FROM px GROUP BY scene""")
def mask_single_scene(v):
    m = M.mask_scene(v.px, ["red", "green", "blue"], R.accept_landsat("cloud_free", False, F.col("qa_pixel"), F.col("qa_radsat")))
    return m.groupBy("scene").agg(F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(~F.col("accepted") & F.col("was_valid")).alias("removed"), F.sum("red").alias("red"))


@query(_field_sql([(n, a, b, None) for n, a, b, _ in R.QA_PIXEL], "qa_pixel").replace(", defined,", ",").replace("GROUP BY ALL", "GROUP BY field, code"))
def agg_bitfield_hist(v):
    return _field_hist(v.px, "qa_pixel", R.QA_PIXEL).groupBy("field", "code").agg(F.sum("n").alias("n"))
