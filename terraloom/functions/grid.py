"""Column functions of grids, projections, tiles and rings. Angles are degrees; boxes are (w, s, e, n)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: sphere radii and limits of the projections
SINUSOIDAL_RADIUS = 6371007.181
MERCATOR_RADIUS = 6378137.0
MERCATOR_LIMIT = 85.0511287798066
HALF_WORLD = math.pi * MERCATOR_RADIUS
PIXEL_METRES = 0.00028


def snap(v: Column, tolerance: float = 1e-7) -> Column:
    return F.when(F.abs(v - F.round(v)) <= tolerance, F.round(v)).otherwise(v)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, v))


def georeference(grids: DataFrame) -> DataFrame:
    """Bounds and pixel size from `affine` (16 numbers) or `scale` (3) with `tiepoint` (6). A rotated, south-up or doubly given grid has `valid` false."""
    m, s, t = F.col("affine"), F.col("scale"), F.col("tiepoint")
    zero = F.lit(True)
    for i in (1, 2, 4, 6, 8, 9, 11, 12, 13, 14):
        zero = zero & (m[i] == 0)
    by_matrix = m.isNotNull() & s.isNull() & t.isNull() & (F.size(m) == 16) & (m[0] > 0) & (m[5] < 0) & zero & (m[15] == 1)
    by_tie = m.isNull() & (F.size(s) == 3) & (F.size(t) == 6) & (s[0] > 0) & (s[1] > 0) & (s[2] == 0) & (t[2] == 0) & (t[5] == 0)
    x = F.when(by_matrix, m[3]).when(by_tie, t[3] - t[0] * s[0])
    y = F.when(by_matrix, m[7]).when(by_tie, t[4] + t[1] * s[1])
    dx, dy = F.when(by_matrix, m[0]).when(by_tie, s[0]), F.when(by_matrix, -m[5]).when(by_tie, s[1])
    out = grids.withColumns({"left": x, "top": y, "dx": dx, "dy": dy})
    return out.withColumns({"right": F.col("left") + F.col("width") * F.col("dx"), "bottom": F.col("top") - F.col("height") * F.col("dy"), "valid": F.coalesce(by_matrix | by_tie, F.lit(False))})


def coord_to_pixel(x: Column, y: Column, left, top, right, bottom, dx, dy) -> tuple[Column, Column]:
    """Column and row of a coordinate, half-open on the right and bottom edges; null outside."""
    inside = (x >= left) & (x < right) & (y <= top) & (y > bottom)
    return F.when(inside, F.floor((x - left) / dx)), F.when(inside, F.floor((top - y) / dy))


def window(box: tuple, bounds: tuple, dx: Column, dy: Column, width: Column, height: Column, snapped: bool = False) -> dict[str, Column]:
    """Outward pixel window (col0, row0, cols, rows) of a box on a grid, with `clipped`; all null where they do not meet.

    snapped: round values within 1e-7 of a whole number first (coverage services do, crops do not).
    """
    w, s, e, n = (F.greatest(box[0], bounds[0]), F.greatest(box[1], bounds[1]), F.least(box[2], bounds[2]), F.least(box[3], bounds[3]))
    near = snap if snapped else (lambda v: v)
    x0, x1 = clamp(F.floor(near((w - bounds[0]) / dx)), 0, width), clamp(F.ceil(near((e - bounds[0]) / dx)), 0, width)
    y0, y1 = clamp(F.floor(near((bounds[3] - n) / dy)), 0, height), clamp(F.ceil(near((bounds[3] - s) / dy)), 0, height)
    meets = (w < e) & (s < n) & (x0 < x1) & (y0 < y1)
    whole = {"col0": x0, "row0": y0, "cols": x1 - x0, "rows": y1 - y0}
    out = {k: F.when(meets, v.cast("bigint")) for k, v in whole.items()}
    out["clipped"] = F.when(meets, (w != box[0]) | (s != box[1]) | (e != box[2]) | (n != box[3]))
    return out


def align_offset(v: Column, tolerance: float = 1e-5) -> Column:
    """Whole-pixel offset; a misaligned grid is an error."""
    return F.when(F.abs(v - F.round(v)) <= tolerance, F.round(v).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("grid is not aligned: "), v.cast("string"))).cast("bigint"))


def sinusoidal_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    valid = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(valid, F.when(F.abs(lat) == 90, F.lit(0.0)).otherwise(SINUSOIDAL_RADIUS * F.radians(lon) * F.cos(phi))), F.when(valid, SINUSOIDAL_RADIUS * phi)


def sinusoidal_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude; null off the globe."""
    phi = y / SINUSOIDAL_RADIUS
    inside = F.abs(phi) <= math.pi / 2 + 1e-12
    held = clamp(phi, -math.pi / 2, math.pi / 2)
    cos = F.cos(held)
    pole = F.abs(cos) < 1e-12
    lon = F.when(pole, F.when(F.abs(x) <= 1e-7, F.lit(0.0))).otherwise(x / (SINUSOIDAL_RADIUS * F.when(pole, 1.0).otherwise(cos)))
    ok = inside & (F.abs(lon) <= math.pi + 1e-12)
    return F.when(ok, F.degrees(clamp(lon, -math.pi, math.pi))), F.when(ok, F.degrees(held))


def mercator_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    ok = F.abs(lat) <= MERCATOR_LIMIT
    return F.when(ok, MERCATOR_RADIUS * F.radians(lon)), F.when(ok, MERCATOR_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)))


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def _kruger():
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return n, a, alpha, beta, delta


def utm_forward(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing on WGS84 (Krüger series of third order, millimetres within a zone)."""
    n, a, alpha, _, _ = _kruger()
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(phi)) - k * atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(al * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, al in enumerate(alpha, 1))
    up = xi + sum(al * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, al in enumerate(alpha, 1))
    return 500000 + 0.9996 * a * east, F.when(north, 0.0).otherwise(10000000.0) + 0.9996 * a * up


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    _, a, _, beta, delta = _kruger()
    xi = (y - F.when(north, 0.0).otherwise(10000000.0)) / (0.9996 * a)
    eta = (x - 500000) / (0.9996 * a)
    xi1 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta1 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def projected_envelope(boxes: DataFrame, key: str, project, samples: int = 65) -> DataFrame:
    """Envelope of each box's projected edges, `samples` points an edge (as many rows a box: bounded); repeated rows stay. Coverage services take 257.

    For the sinusoidal projection use sinusoidal_envelope(), which is exact.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    p = boxes.select(key, "w", "s", "e", "n").withColumn("_row", F.monotonically_increasing_id()).withColumn("_i", step)
    f = F.col("_i") / (samples - 1)
    lon, lat = F.col("w") + (F.col("e") - F.col("w")) * f, F.col("s") + (F.col("n") - F.col("s")) * f
    edges = F.explode(F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((lon, F.col("s")), (lon, F.col("n")), (F.col("w"), lat), (F.col("e"), lat))]))
    x, y = project(F.col("_p.lon"), F.col("_p.lat"))
    p = p.select("_row", key, edges.alias("_p")).select("_row", key, x.alias("_x"), y.alias("_y"))
    return p.groupBy("_row", key).agg(F.min("_x").alias("left"), F.min("_y").alias("bottom"), F.max("_x").alias("right"), F.max("_y").alias("top")).drop("_row")


def sinusoidal_envelope(boxes: DataFrame, key: str) -> DataFrame:
    """Exact envelope of each box on the sinusoidal projection: x is extreme at a corner or, where the box meets it, on the equator."""
    middle = F.greatest(F.col("s"), F.least(F.col("n"), F.lit(0.0)))
    points = [sinusoidal_forward(F.col(x), y) for x in ("w", "e") for y in (F.col("s"), F.col("n"), middle)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return boxes.select(key, F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"))


def lonlat_tiles(boxes: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """All tiles (z, x, y) of each box, half-open at the east and south edges. A box beyond the Mercator limit, or a null one, is an error."""
    fits = F.coalesce((F.col("s") >= -MERCATOR_LIMIT) & (F.col("n") <= MERCATOR_LIMIT) & F.col("w").isNotNull() & F.col("e").isNotNull(), F.lit(False))
    levels = F.when(fits, F.sequence(F.lit(zmin), F.lit(zmax))).otherwise(F.raise_error(F.lit("a box lies beyond the Web Mercator limit")).cast("array<int>"))
    d = boxes.withColumn("z", F.explode(levels))
    size = F.pow(F.lit(2.0), F.col("z"))
    x = lambda lon: (lon + 180) / 360 * size
    y = lambda lat: (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * size
    west, north = clamp(F.floor(x(F.col("w"))), 0, size - 1), clamp(F.floor(y(F.col("n"))), 0, size - 1)
    east, south = F.greatest(clamp(F.ceil(x(F.col("e"))) - 1, 0, size - 1), west), F.greatest(clamp(F.ceil(y(F.col("s"))) - 1, 0, size - 1), north)
    d = d.withColumn("x", F.explode(F.sequence(west.cast("bigint"), east.cast("bigint")))).withColumns({"_n": north.cast("bigint"), "_s": south.cast("bigint")})
    return d.withColumn("y", F.explode(F.sequence("_n", "_s"))).drop("_n", "_s")


def tile_selection(boxes: DataFrame, key: str, zmin: int, zmax: int, most: int = 512) -> DataFrame:
    """Tiles of each box in the order of their numbers: key, `place` (from 1), z, x, y, tile_id, `error`.

    A box beyond the Mercator limit, or with more than `most` tiles, has one row with an error ("outside", "too many") and no tile. The key names a box.
    """
    fits = F.coalesce((F.col("s") >= -MERCATOR_LIMIT) & (F.col("n") <= MERCATOR_LIMIT) & F.col("w").isNotNull() & F.col("e").isNotNull(), F.lit(False))
    none = lambda d, error: d.select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("z", "int"), ("x", "bigint"), ("y", "bigint"), ("tile_id", "bigint"))], F.lit(error).alias("error"))
    inside = boxes.where(fits)
    count = F.lit(0.0)
    for z in range(zmin, zmax + 1):
        count += _tile_count(z)
    d = lonlat_tiles(inside.where(count <= most).select(key, *"wsen"), zmin, zmax).select(key, "z", "x", "y").withColumn("tile_id", tile_id(F.col("z"), F.col("x"), F.col("y")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("tile_id"))  # at most `most` rows a box
    return d.select(key, place.alias("place"), "z", "x", "y", "tile_id", F.lit(None).cast("string").alias("error")).unionByName(none(boxes.where(~fits), "outside")).unionByName(none(inside.where(count > most), "too many"))


def _tile_count(z: int) -> Column:
    size = float(1 << z)
    x = lambda lon: (F.col(lon) + 180) / 360 * size
    y = lambda lat: (1 - F.asinh(F.tan(F.radians(F.col(lat)))) / math.pi) / 2 * size
    west, north = clamp(F.floor(x("w")), 0, size - 1), clamp(F.floor(y("n")), 0, size - 1)
    east, south = F.greatest(clamp(F.ceil(x("e")) - 1, 0, size - 1), west), F.greatest(clamp(F.ceil(y("s")) - 1, 0, size - 1), north)
    return (east - west + 1) * (south - north + 1)


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Cumulative Hilbert number of a tile: all tiles of coarser levels come first."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(acc, k):
        s = F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2), k).cast("bigint")
        rx = F.when(acc["x"].bitwiseAND(s) != 0, 1).otherwise(0)
        ry = F.when(acc["y"].bitwiseAND(s) != 0, 1).otherwise(0)
        d = acc["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        fx, fy = F.when(rx == 1, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(rx == 1, s - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(acc["x"]).alias("x"), F.when(ry == 0, fx).otherwise(acc["y"]).alias("y"), d.alias("d"))

    steps = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return ((F.pow(F.lit(4), z) - 1) / 3).cast("bigint") + F.aggregate(steps, start, step, lambda acc: acc["d"])


def tile_coord(id_: Column, max_zoom: int = 24) -> Column:
    """Struct z, x, y of a cumulative Hilbert number."""
    first = [(4**k - 1) // 3 for k in range(1, max_zoom + 1)]

    def step(acc, k):
        s = F.pow(F.lit(2), k).cast("bigint")
        rx = F.floor(acc["d"] / 2).bitwiseAND(F.lit(1).cast("bigint"))
        ry = acc["d"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("bigint"))
        fx, fy = F.when(rx == 1, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(rx == 1, s - 1 - acc["y"]).otherwise(acc["y"])
        x, y = F.when(ry == 0, fy).otherwise(acc["x"]), F.when(ry == 0, fx).otherwise(acc["y"])
        return F.struct((x + s * rx).alias("x"), (y + s * ry).alias("y"), F.shiftright(acc["d"], 2).alias("d"))

    def coord(t):
        d0 = t["id"] - ((F.pow(F.lit(4), t["z"]) - 1) / 3).cast("bigint")
        start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), d0.cast("bigint").alias("d"))
        steps = F.when(t["z"] > 0, F.sequence(F.lit(0), t["z"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: F.struct(t["z"].alias("z"), acc["x"].alias("x"), acc["y"].alias("y")))

    def level(i):
        z = F.lit(0)
        for k, low in enumerate(first, 1):
            z = F.when(i >= low, F.lit(k)).otherwise(z)
        return F.struct(i.alias("id"), z.alias("z"))

    # a number may be a long expression, and so is its level: each is worked out once
    return F.transform(F.transform(F.array(id_), level), coord)[0]


def _lat(y: Column, size) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / size))))


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    size = F.pow(F.lit(2.0), z)
    return x / size * 360 - 180, _lat(y + 1, size), (x + 1) / size * 360 - 180, _lat(y, size)


def quadkey_bounds(key: Column, digits: int = 9) -> tuple[Column, Column, Column, Column]:
    """Box of a quadkey of a fixed number of digits; anything else is an error."""
    ok = F.when(key.rlike(f"^[0-3]{{{digits}}}$"), key).otherwise(F.raise_error(F.concat(F.lit("invalid quadkey "), key)).cast("string"))
    fold = lambda bit: F.aggregate(F.split(ok, ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 2 + F.when(c.isin(*bit), 1).otherwise(0))
    x, y, size = fold(("1", "3")), fold(("2", "3")), float(2**digits)
    return x / size * 360 - 180, _lat(y + 1, size), (x + 1) / size * 360 - 180, _lat(y, size)


def tms_flip(z: Column, y: Column) -> Column:
    return F.pow(F.lit(2), z).cast("bigint") - 1 - y


def xyz_matrix(z: Column, tile_size: int = 256) -> tuple[Column, Column]:
    """Scale denominator and number of tiles a side of a zoom level."""
    n = F.pow(F.lit(2), z).cast("bigint")
    return 2 * HALF_WORLD / tile_size / n / PIXEL_METRES, n


def wmts_window(boxes: DataFrame, z: Column, tile_size: int = 256) -> DataFrame:
    """Pixel window and tile range of a box (degrees) in a zoom level of the Mercator tile grid."""
    x0, y1 = mercator_forward(F.col("w"), F.col("n"))
    x1, y0 = mercator_forward(F.col("e"), F.col("s"))
    denominator, n = xyz_matrix(z, tile_size)
    r = denominator * PIXEL_METRES
    c0, r0 = F.floor(snap((x0 + HALF_WORLD) / r)), F.floor(snap((HALF_WORLD - y1) / r))
    c1, r1 = F.ceil(snap((x1 + HALF_WORLD) / r)), F.ceil(snap((HALF_WORLD - y0) / r))
    d = boxes.withColumns({"col0": c0, "row0": r0, "cols": c1 - c0, "rows": r1 - r0})
    tile = lambda v: F.floor(v / tile_size)
    d = d.withColumns({"tile_col0": tile(F.col("col0")), "tile_col1": tile(F.col("col0") + F.col("cols") - 1), "tile_row0": tile(F.col("row0")), "tile_row1": tile(F.col("row0") + F.col("rows") - 1)})
    return d.where((F.col("col0") >= 0) & (F.col("row0") >= 0) & (F.col("cols") > 0) & (F.col("rows") > 0) & (F.col("tile_col1") < n) & (F.col("tile_row1") < n))


def tile_footprints(boxes: DataFrame, step: int) -> DataFrame:
    """Published tiles (lon0, lat0) of `step` degrees that cover each box; exact east and north edges add none."""
    at = lambda v, up: ((F.ceil if up else F.floor)(v / step) * step).cast("bigint")
    d = boxes.withColumns({"_w": at(F.col("w"), False), "_e": at(F.col("e"), True), "_s": at(F.col("s"), False), "_n": at(F.col("n"), True)}).where("_w < _e and _s < _n")
    d = d.withColumn("lon0", F.explode(F.sequence(F.col("_w"), F.col("_e") - step, F.lit(step).cast("bigint"))))
    return d.withColumn("lat0", F.explode(F.sequence(F.col("_s"), F.col("_n") - step, F.lit(step).cast("bigint")))).drop("_w", "_e", "_s", "_n")


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring (array of x, y structs), relative to its first vertex; the sign is the winding."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Crossing number; half-open, so a shared edge belongs to one ring."""
    hit = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
    crossings = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.coalesce(hit(a, b), F.lit(False)).cast("int"))
    return F.aggregate(crossings, F.lit(0), lambda s, v: s + v) % 2 == 1


def geometry_envelope(rings: Column) -> tuple[Column, Column, Column, Column]:
    """Box of an array of rings."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


# How large a polygon may be.
PARTS, RINGS, POSITIONS = 500, 1000, 30_000


def polygon_error(polygons: Column) -> Column:
    """What is wrong with a polygon of parts of rings of points (x, y), or null: "parts", "rings", "short" (a ring of fewer than four positions),

    "positions" (too many), "open", "coordinates" (not finite, out of range, or across the date line), "area" (none), "span" (over 180 degrees). Of
    several, the first in this order. A null polygon has no parts.
    """
    parts = F.coalesce(F.size(polygons), F.lit(0))
    rings = F.flatten(polygons)
    points = F.flatten(rings)
    xs, ys = points["x"], points["y"]
    known = lambda vs: F.forall(vs, lambda v: v.isNotNull())
    within = lambda vs, most: known(vs) & (F.array_min(vs) >= -most) & (F.array_max(vs) <= most)  # noqa: E731  (NaN is greater than all)
    wide = F.array_max(xs) - F.array_min(xs) > 180  # what is narrower has no jump
    pairs = lambda ring, of: F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), of)
    jumps = lambda ring: F.exists(pairs(ring, lambda a, b: F.abs(b["x"] - a["x"])), lambda d: d > 180)
    double = lambda ring: F.aggregate(pairs(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)
    return (
        F.when(~parts.between(1, PARTS), "parts")
        .when(F.exists(polygons, lambda p: ~F.coalesce(F.size(p), F.lit(0)).between(1, RINGS)), "rings")
        .when(F.exists(rings, lambda r: F.coalesce(F.size(r), F.lit(0)) < 4), "short")
        .when(F.size(points) > POSITIONS, "positions")
        .when(F.exists(rings, lambda r: ~F.element_at(r, 1).eqNullSafe(F.element_at(r, -1))), "open")
        .when(~F.coalesce(within(xs, 180.0) & within(ys, 90.0), F.lit(False)) | (wide & F.exists(rings, jumps)), "coordinates")
        .when(F.exists(rings, lambda r: F.abs(double(r)) < 1e-12), "area")
        .when(wide, "span")
    )


def round_out(w: Column, s: Column, e: Column, n: Column, digits: int = 6) -> tuple[Column, Column, Column, Column]:
    k = 10.0**digits
    return F.floor(w * k) / k, F.floor(s * k) / k, F.ceil(e * k) / k, F.ceil(n * k) / k


def clip_limitation(w: Column, s: Column, e: Column, n: Column, polygons: Column, rings: Column, positions: Column, jump: Column) -> Column:
    """Why a boundary can't be used for clipping: '' if it can. jump: greatest longitude step between neighbouring vertices."""
    return F.when((s < -80) | (n > 84), "polar").when(e - w > 180, "date-line").when((polygons > 500) | (rings > 1000) | (positions > 30000), "complex").when(jump > 180, "date-line").otherwise("")


def preview_index(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Preview size: the long side is at most `edge`, no side is 0."""
    long = F.greatest(width, height)
    side = lambda v: F.greatest(F.lit(1), F.floor(v * F.least(F.lit(edge), long) / long)).cast("bigint")
    return side(width), side(height)
