"""Closed rings from way segments, and the geometry of map relations.

A segment has two directions. Where exactly two segment ends meet, an arriving direction has one departing successor, so that directions
lie on cycles: each ring twice, once either way. Pointer jumping ranks them: in round k a direction knows the best-placed segment
among the next 2^k and how far away it is, so a ring of n segments takes log2(n) + 1 rounds, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.polygons import points_in_polygons
from terraloom.sources.storage import written

#: nesting of relations that is allowed
DEPTH = 8


def _end(p: Column, named: Column) -> Column:
    """What two ends must share: the node, or in relations with unnamed ends the place."""
    return F.when(named, F.struct(p["node"].alias("node"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))).otherwise(
        F.struct(F.lit(None).cast("bigint").alias("node"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    )


def ring_paths(segments: DataFrame, keys: tuple[str, ...] = ("relation_id",)) -> DataFrame:
    """Rings of each relation: keys, `ring`, `points` in order and closed, `error`.

    segments: keys, `pos` (once per relation), `points` (array of node, x, y; node may be null). A ring is named by its last segment, starts
    with it and keeps its direction; segments that lie the other way are turned. A relation with an error has one row without ring:
    "inconsistent" (a node with two places), "open" (an end that doesn't meet exactly one other), "degenerate" (a segment
    of fewer than two points, or a ring of fewer than four).
    """
    k = list(keys)
    rows = written(segments.select(*k, "pos", "points"), "ring-segments").withColumn("seg", F.monotonically_increasing_id())
    rows = written(rows, "ring-named")
    size = F.coalesce(F.size("points"), F.lit(0))
    short = rows.where(size < 2).select(*k).distinct().withColumn("error", F.lit("degenerate"))
    first, last = F.get("points", F.lit(0)), F.get("points", F.size("points") - 1)
    fit = rows.where(size >= 2).withColumns({"_a": first, "_b": last})
    named = fit.groupBy(*k).agg(F.bool_and(F.col("_a.node").isNotNull() & F.col("_b.node").isNotNull()).alias("_named"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("p")) for s, c in ((0, "_a"), (1, "_b"))]))
    ends = fit.join(named, k).select(*k, "seg", "_named", sides.alias("_s")).select(*k, "seg", F.col("_s.side").alias("side"), _end(F.col("_s.p"), F.col("_named")).alias("at"), F.col("_s.p.x").alias("x"), F.col("_s.p.y").alias("y"))
    end = F.struct("seg", "side")
    joints = ends.groupBy(*k, "at").agg(
        F.count("*").alias("n"), F.min(end).alias("a"), F.max(end).alias("b"), ((F.min("x") < F.max("x")) | (F.min("y") < F.max("y"))).alias("apart")
    )
    joints = written(joints, "ring-joints")
    states = joints.groupBy(*k).agg(F.bool_or(F.coalesce("apart", F.lit(False))).alias("apart"), F.bool_or(F.col("n") != 2).alias("open"))
    wrong = states.where("apart or open").select(*k, F.when(F.col("apart"), "inconsistent").otherwise("open").alias("error"))
    arrives = lambda e: F.col(f"{e}.seg") * 2 + 1 - F.col(f"{e}.side")
    departs = lambda e: F.col(f"{e}.seg") * 2 + F.col(f"{e}.side")
    both = F.explode(F.array(F.struct(arrives("a").alias("dart"), departs("b").alias("jump")), F.struct(arrives("b").alias("dart"), departs("a").alias("jump"))))
    good = joints.join(wrong.unionByName(short), k, "left_anti").select(both.alias("_d")).select("_d.*")
    own = fit.select("seg", F.col("pos").cast("bigint").alias("pos"))
    state = good.join(own, F.floor(F.col("dart") / 2) == own["seg"]).select("dart", "jump", (F.col("pos") * 2 + 1 - F.col("dart") % 2).alias("top"), F.lit(0).cast("bigint").alias("off"))
    state, step = written(state, "ring-jumps"), 1
    while True:
        ahead = state.select(F.col("dart").alias("jump"), F.col("jump").alias("_j"), F.col("top").alias("_t"), F.col("off").alias("_o"))
        met = written(state.join(ahead, "jump"), "ring-jumps")
        if not met.where("_t <> top").take(1):
            break
        further = F.col("_t") > F.col("top")
        state = met.select("dart", F.col("_j").alias("jump"), F.greatest("top", "_t").alias("top"), F.when(further, F.col("_o") + step).otherwise(F.col("off")).alias("off"))
        step *= 2
    chosen = state.where("top % 2 = 1").select(F.floor(F.col("dart") / 2).alias("seg"), (F.col("dart") % 2 == 1).alias("_back"), F.floor(F.col("top") / 2).alias("ring"), F.when(F.col("off") == 0, F.lit(-(1 << 62))).otherwise(-F.col("off")).alias("place"))
    placed = fit.join(chosen, "seg").withColumn("points", F.when(F.col("_back"), F.reverse("points")).otherwise(F.col("points")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "points"))), lambda s: s["points"])
    rings = placed.groupBy(*k, "ring").agg(parts.alias("_p"))
    whole = F.concat(F.slice(F.col("_p")[0], 1, 1), F.flatten(F.transform("_p", lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))))
    rings = written(rings.select(*k, "ring", whole.alias("points")), "rings")
    small = rings.where(F.size("points") < 4).select(*k).distinct().withColumn("error", F.lit("degenerate"))
    bad = wrong.unionByName(short).unionByName(small).groupBy(*k).agg(F.max("error").alias("error"))
    fine = rings.join(bad, k, "left_anti").withColumn("error", F.lit(None).cast("string"))
    return fine.unionByName(bad.select(*k, F.lit(None).cast(rings.schema["ring"].dataType).alias("ring"), F.lit(None).cast(rings.schema["points"].dataType).alias("points"), "error"))


def multipolygons(members: DataFrame, cell: float = 1.0) -> DataFrame:
    """Area relations as polygons: relation_id, `polygons` (array of `outer` and `inners`, by the outer ring's name), `error`.

    members: relation_id, pos, type, role, points. Ways are outer (or without a role) or inner, nodes may be labels or centres; anything else is an
    error ("member"), as are rings that don't close (see ring_paths), no outer ring ("no outer ring"), and an inner ring whose first point
    isn't inside exactly one outer ring of its relation ("hole").
    """
    role = F.coalesce("role", F.lit(""))
    way = (F.col("type") == "way") & role.isin("outer", "inner", "")
    known = F.coalesce(way | ((F.col("type") == "node") & role.isin("label", "admin_centre")), F.lit(False))
    errors = members.where(~known).select("relation_id", F.lit("member").alias("error"))
    ways = members.where(way).select("relation_id", F.when(role == "inner", "inner").otherwise("outer").alias("part"), "pos", "points")
    rings = written(ring_paths(ways, ("relation_id", "part")), "relation-rings")
    outer, inner = rings.where("part = 'outer' and error is null"), rings.where("part = 'inner' and error is null")
    errors = errors.unionByName(rings.where("error is not null").select("relation_id", "error"))
    lacking = members.select("relation_id").distinct().join(rings.where("part = 'outer'").select("relation_id"), "relation_id", "left_anti")
    errors = errors.unionByName(lacking.select("relation_id", F.lit("no outer ring").alias("error")))
    sides = F.explode(F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b"))))
    edges = outer.where(F.size("points") > 1).select("relation_id", F.col("ring").alias("poly_id"), sides.alias("_s"))
    edges = edges.select("relation_id", "poly_id", F.col("_s.a.x").alias("ax"), F.col("_s.a.y").alias("ay"), F.col("_s.b.x").alias("bx"), F.col("_s.b.y").alias("by"))
    points = inner.select(F.col("ring").alias("id"), "relation_id", F.col("points")[0]["x"].alias("px"), F.col("points")[0]["y"].alias("py"))
    owner = points_in_polygons(points, edges, cell, within=("relation_id",)).groupBy("relation_id", "id").agg(F.count("*").alias("n"), F.min("poly_id").alias("owner"))
    held = inner.join(owner.withColumnRenamed("id", "ring"), ["relation_id", "ring"], "left")
    errors = errors.unionByName(held.where("n is null or n <> 1").select("relation_id", F.lit("hole").alias("error")))
    bad = written(errors.groupBy("relation_id").agg(F.min_by("error", F.array_position(F.array(*[F.lit(e) for e in ("member", "inconsistent", "open", "degenerate", "no outer ring", "hole")]), F.col("error"))).alias("error")), "relation-errors")
    inners = held.where("n = 1").groupBy("relation_id", F.col("owner").alias("ring")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("inners"))
    whole = outer.join(inners, ["relation_id", "ring"], "left").select("relation_id", "ring", F.col("points").alias("outer"), F.coalesce("inners", F.array().cast(inners.schema["inners"].dataType)).alias("inners"))
    found = whole.groupBy("relation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "outer", "inners"))), lambda p: F.struct(p["outer"].alias("outer"), p["inners"].alias("inners"))).alias("polygons"))
    ids = members.select("relation_id").distinct().join(bad, "relation_id", "left")
    return ids.join(found, "relation_id", "left").select("relation_id", F.when(F.col("error").isNull(), F.col("polygons")).alias("polygons"), "error")


def collections(members: DataFrame, relations: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """Members of each relation with nested collections taken apart: root, `path` (positions from the root on), `type`, `ref`, `error`.

    members: relation_id, pos, type, ref; relations: relation_id, `area` (true for multipolygons and boundaries, which stay whole: type
    "area"). A reference to a relation that isn't there is "missing", one that is already on its own way from the root a "cycle", one
    that would be nested more than `max_depth` levels below the root "depth"; none of these is followed.
    """
    kinds = relations.select(F.col("relation_id").alias("ref"), F.lit("relation").alias("type"), F.coalesce("area", F.lit(False)).alias("_area"))
    steps = written(members.select("relation_id", "pos", "type", "ref").join(kinds, ["type", "ref"], "left"), "relation-steps")
    level = steps.join(relations.where("not coalesce(area, false)").select("relation_id"), "relation_id", "left_semi")
    level = level.select(F.col("relation_id").alias("root"), F.array("pos").alias("path"), F.array("relation_id").alias("_way"), "type", "ref", "_area")
    out = None
    for depth in range(1, max_depth + 2):
        level = written(level, "relation-level")
        nested = F.col("type") == "relation"
        error = F.when(nested & F.col("_area").isNull(), "missing").when(nested & F.array_contains("_way", F.col("ref")), "cycle").when(nested & F.lit(depth > max_depth), "depth")
        seen = level.withColumn("error", error)
        stays = seen.where(~nested | F.col("error").isNotNull() | F.col("_area"))
        part = stays.select("root", "path", F.when(nested & F.col("error").isNull(), "area").otherwise(F.col("type")).alias("type"), "ref", "error")
        out = part if out is None else out.unionByName(part)
        deeper = seen.where(nested & F.col("error").isNull() & ~F.col("_area"))
        if depth > max_depth or not deeper.take(1):
            return out
        below = deeper.select("root", F.col("path").alias("_p"), F.array_append("_way", F.col("ref")).alias("_way"), F.col("ref").alias("relation_id")).join(steps, "relation_id")
        level = below.select("root", F.array_append("_p", F.col("pos")).alias("path"), "_way", "type", "ref", "_area")
    return out
