"""Joins of bands, points and polygons, map elements, and catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.polygons import points_in_polygons


def join_bands(px: DataFrame, bands: list[str], nodata: int = 0, asset: str = "asset", value: str = "value") -> DataFrame:
    """Long pixel rows -> one row per scene and pixel with a column per band; `valid` where every band has data.

    A conditional aggregate instead of a join per band: one shuffle, combined on the map side.
    """
    out = px.groupBy("scene", "x", "y").agg(*[F.max(F.when(F.col(asset) == b, F.col(value))).alias(b) for b in bands])
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(b) != nodata, F.lit(False)) for b in bands])
    return out.withColumn("valid", ok)


def join_qa_pair(pixel: DataFrame, radsat: DataFrame) -> DataFrame:
    """Saturation words take their validity from the quality word of the same scene and pixel.

    Either side may be all pixels, whatever a plan's estimate of its size, so neither is broadcast.
    """
    return radsat.join(pixel.hint("merge"), ["scene", "x", "y"]).withColumn("valid", F.col("qa_pixel").bitwiseAND(F.lit(1).cast("bigint")) == 0)


def _cells(d: DataFrame, w: str, s: str, e: str, n: str, cell: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / cell)
    return d.withColumn("_cx", F.explode(F.sequence(at(w), at(e)))).withColumn("_cy", F.explode(F.sequence(at(s), at(n))))


def scenes_in_areas(items: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(item_id, area_id) of overlapping boxes, touching not counted, by an equality join on grid cells.

    A pair is taken only in the cell that holds the lower-left corner of its intersection, so no distinct is needed.
    """
    a = _cells(items.select("item_id", "w", "s", "e", "n"), "w", "s", "e", "n", cell)
    b = _cells(areas.select("area_id", F.col("w").alias("aw"), F.col("s").alias("as_"), F.col("e").alias("ae"), F.col("n").alias("an")), "aw", "as_", "ae", "an", cell)
    j = a.join(b, ["_cx", "_cy"]).where("w < ae and e > aw and s < an and n > as_")
    own = (F.floor(F.greatest("w", "aw") / cell) == F.col("_cx")) & (F.floor(F.greatest("s", "as_") / cell) == F.col("_cy"))
    return j.where(own).select("item_id", "area_id")


def way_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (way_id, refs) with their nodes' coordinates in order: `points`, and `missing` references."""
    refs = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id"))
    j = refs.join(nodes, "node_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    return j.groupBy("way_id").agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"), F.count_if(F.col("x").isNull()).alias("missing"))


def relation_members(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Relation members (type, ref, role) with the element that each refers to."""
    m = relations.select("relation_id", F.posexplode("members").alias("pos", "_m")).select("relation_id", "pos", "_m.*")
    return m.join(elements, ["type", "ref"], "left")


def missing_refs(refs: DataFrame, elements: DataFrame, on: str) -> DataFrame:
    """References that no element answers."""
    return refs.join(elements.select(on), on, "left_anti")


def holes_to_shells(holes: DataFrame, shells: DataFrame, cell: float) -> DataFrame:
    """Each hole with its smallest enclosing shell: hole_id, `shell_id`, `error` ("no shell" where there is none).

    holes: hole_id, px, py (one of its vertices); shells: shell_id, area and their edges as poly_id, ax, ay, bx, by. Shells of
    equal area: the lesser id.
    """
    edges = shells.select(F.col("shell_id").alias("poly_id"), F.explode("edges").alias("_e")).select("poly_id", "_e.*")
    inside = points_in_polygons(holes.select(F.col("hole_id").alias("id"), "px", "py"), edges, cell)
    j = inside.join(shells.select(F.col("shell_id").alias("poly_id"), "area"), "poly_id")
    best = j.groupBy(F.col("id").alias("hole_id")).agg(F.min_by("poly_id", F.struct("area", "poly_id")).alias("shell_id"))
    found = holes.select("hole_id").join(best, "hole_id", "left")
    return found.withColumn("error", F.when(F.col("shell_id").isNull(), "no shell"))


def holes_with_shells(holes: DataFrame, shells: DataFrame, cell: float) -> DataFrame:
    """The same where every hole must have a shell: one without is an error, which ends the job."""
    found = holes_to_shells(holes, shells, cell)
    lost = F.raise_error(F.concat(F.lit("no shell around hole "), F.col("hole_id").cast("string"))).cast(found.schema["shell_id"].dataType)
    return found.select("hole_id", F.coalesce("shell_id", lost).alias("shell_id"))


def reusable_jobs(assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every wanted asset (scene, asset, href) with the newest job that can be used again, if any."""
    usable = jobs.where(F.col("status").isin("succeeded", "queued", "running"))
    last = usable.groupBy("scene", "asset", "href").agg(F.max("id").alias("job_id"), F.max_by("status", "id").alias("status"))
    return assets.join(last, ["scene", "asset", "href"], "left")


def merge_catalog(saved: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Saved pins win over the refreshed catalogue."""
    return saved.withColumnRenamed(value, "_a").join(fresh.withColumnRenamed(value, "_b"), keys, "full").select(*keys, F.coalesce("_a", "_b").alias(value))


def anti(rows: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner: excluded registries, items seen before, subdivisions that are countries."""
    return rows.join(excluded.select(*on), on, "left_anti")


def with_aliases(regions: DataFrame, aliases: DataFrame, on: str) -> DataFrame:
    return regions.join(aliases, on, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def snapshot_compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows that two passes do not share alike: key and `change` (added, removed, changed)."""
    h = lambda d: d.select(key, F.xxhash64(F.to_json(F.struct(*sorted(c for c in d.columns if c != key)), {"ignoreNullFields": "false"})).alias("h"), F.lit(True).alias("there"))
    a, b = h(before), h(after)
    j = a.alias("a").join(b.alias("b"), key, "full")
    change = F.when(F.col("a.there").isNull(), "added").when(F.col("b.there").isNull(), "removed").when(F.col("a.h") != F.col("b.h"), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def same_selection(a: DataFrame, b: DataFrame, fields: list[str]) -> Column:
    """Null-safe equality of all identity fields."""
    return reduce(lambda x, y: x & y, [a[f].eqNullSafe(b[f]) for f in fields])


def coordinate_samples(px: DataFrame, points: DataFrame, left: float, top: float, dx: float, dy: float) -> DataFrame:
    """Pixel values at coordinates: points (id, px, py) -> their cell -> an equality join.

    Only pixels in the points' box are shuffled; neither side is broadcast, whatever a plan's estimate of its size.
    """
    p = points.withColumns({"x": F.floor((F.col("px") - left) / dx).cast("int"), "y": F.floor((top - F.col("py")) / dy).cast("int")})
    reach = lambda c: F.col(c).between(p.agg(F.min(c)).scalar(), p.agg(F.max(c)).scalar())
    return p.join(px.where(reach("x") & reach("y")).hint("merge"), ["x", "y"])

