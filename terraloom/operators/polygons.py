"""Points in polygons, by grid cells that know on which side they lie.

The rule is that of the horizontal ray: a point is inside if an odd number of edges crosses its height to the right of it. Every cell that an
edge touches gets the parity of one reference point, the middle of its east side. A point then meets only the edges of its own
cell: those between it and the east side at its height, and those that the east side meets between that height and the middle. The reference
parities of a row of cells are suffix sums over the crossings of its middle line; cells without edges are inside or outside as a whole.
Cells of many edges are split in four, again and again, where a sub-cell's reference is worked out like any other point.

Ties follow one shift (right by e, up by d, d much smaller than e), so that points, vertices and edges on cell borders
count like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.ranks import running
from terraloom.sources.storage import written

_EDGE = ["ax", "ay", "bx", "by"]
_PAD = 1e-9


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _at_height(y: Column) -> Column:
    """x where an edge meets a height; null for a level edge."""
    return (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax")


def _flips(x: Column, y: Column, east: Column, middle: Column) -> Column:
    """Whether an edge lies between a point and its cell's reference (1 or 0, or 2 if twice)."""
    over = (F.col("ay") > y) != (F.col("by") > y)
    meets = _at_height(y)
    level = F.coalesce(over & (x < meets) & (meets <= east), F.lit(False)).cast("int")
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    height = slope * (east - F.col("ax")) + F.col("ay")
    above = lambda h: (height > h) | ((height == h) & (slope > 0))
    side = F.coalesce(((F.col("ax") > east) != (F.col("bx") > east)) & (above(y) != above(middle)), F.lit(False)).cast("int")
    return level + side


def _spread(edges: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """Edges with each cell (cx, cy) that they may touch, borders included."""
    pad = cell * _PAD
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    d = edges.withColumn("cy", F.explode(F.sequence(F.floor((low - pad) / cell), F.floor((high + pad) / cell))))
    clipped = lambda y: F.least(F.greatest(y, low), high)
    one, two = F.coalesce(_at_height(clipped(F.col("cy") * cell)), F.col("ax")), F.coalesce(_at_height(clipped((F.col("cy") + 1) * cell)), F.col("bx"))
    wide = pad + F.abs(one) * _PAD * 1e-3
    return d.withColumn("cx", F.explode(F.sequence(F.floor((F.least(one, two) - wide) / cell), F.floor((F.greatest(one, two) + wide) / cell)))).select(*keys, *_EDGE, "cx", "cy")


def _first_cells(edges: DataFrame, near: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """All cells of each polygon that aren't outside as a whole: cx, cy, `inside` (of the reference, 1 or 0), `edges` (how many)."""
    size = F.lit(float(cell))
    d = edges.withColumn("cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size))))
    middle = (F.col("cy") + 0.5) * size
    crossing = d.where((F.col("ay") > middle) != (F.col("by") > middle)).select(*keys, "cy", (F.ceil(_at_height(middle) / size) - 2).alias("cx"), F.lit(1).alias("n"), F.lit(0).alias("e"))
    both = crossing.unionByName(near.select(*keys, "cy", "cx", F.lit(0).alias("n"), F.lit(1).alias("e")))
    events = both.groupBy(*keys, "cy", "cx").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).withColumn("_back", -F.col("cx"))
    events = written(running(events, [*keys, "cy"], ["_back"], place="_place", s=("sum", "n")), "cells")
    lower = events.select(*keys, "cy", (F.col("_place") - 1).alias("_place"), F.col("cx").alias("_next"))
    inside = (F.col("s") % 2).cast("int")
    own = events.where((F.col("e") > 0) | (inside == 1)).select(*keys, "cx", "cy", inside.alias("inside"), F.col("e").alias("edges"))
    runs = events.join(lower, [*keys, "cy", "_place"]).where((inside == 1) & (F.col("cx") - F.col("_next") > 1))
    whole = runs.withColumn("cx", F.explode(F.sequence(F.col("_next") + 1, F.col("cx") - 1))).select(*keys, "cx", "cy", F.lit(1).alias("inside"), F.lit(0).cast("bigint").alias("edges"))
    return own.unionByName(whole)


def points_in_polygons(points: DataFrame, edges: DataFrame, cell: float, most: int = 64, levels: int = 10, within: tuple[str, ...] = ()) -> DataFrame:
    """(point id, polygon id) of points inside polygons with holes; points: id, px, py; edges: poly_id, ax, ay, bx, by.

    Edges of a polygon close its rings. Cells of more than `most` edges are split, at most `levels` times. within: columns of both sides
    that must be equal, too. Edges with a null coordinate are left out, as are such points; repeated edges count twice.
    """
    keys = ["poly_id", *within]
    whole = F.lit(True)
    for c in _EDGE:
        whole &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    edges = edges.select(*keys, *[F.col(c).cast("double").alias(c) for c in _EDGE]).where(whole & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))))
    left = points.select("id", *within, F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).where("px is not null and py is not null and not isnan(px) and not isnan(py)")
    size = float(cell)
    near = written(_spread(edges, keys, F.lit(size)), "edges-0")
    cells = written(_first_cells(edges, near, keys, size), "cells-0")
    at = lambda c: F.floor(F.col(c) / F.lit(size))
    left = left.withColumns({"cx": at("px"), "cy": at("py")}).join(cells, ["cx", "cy", *within])
    out = None
    for level in range(levels + 1):
        last = level == levels
        now = written(left, f"points-{level}")
        hot = F.lit(False) if last else F.col("edges") > most
        plain = now.where((F.col("edges") == 0) & (F.col("inside") == 1)).select("id", *keys)
        east, middle = (F.col("cx") + 1) * F.lit(size), (F.col("cy") + 0.5) * F.lit(size)
        j = now.where((F.col("edges") > 0) & ~hot).join(near, [*keys, "cx", "cy"])
        count = j.groupBy("id", *keys, "inside").agg(F.sum(_flips(F.col("px"), F.col("py"), east, middle)).alias("_f"))
        part = plain.unionByName(count.where((F.col("inside") + F.col("_f")) % 2 == 1).select("id", *keys))
        out = part if out is None else out.unionByName(part)
        deeper = now.where(hot)
        if last or not deeper.take(1):
            break
        large = cells.where(hot).join(deeper.select(*keys, "cx", "cy").distinct(), [*keys, "cx", "cy"], "left_semi")
        own = written(large.join(near, [*keys, "cx", "cy"]), f"split-{level}")
        half = size / 2
        sub = F.explode(F.array(*[F.struct((F.col("cx") * 2 + a).alias("sx"), (F.col("cy") * 2 + b).alias("sy")) for a in (0, 1) for b in (0, 1)]))
        refs = own.withColumn("_s", sub).select("*", "_s.*")
        x, y = (F.col("sx") + 1) * F.lit(half), (F.col("sy") + 0.5) * F.lit(half)
        parity = refs.groupBy(*keys, "sx", "sy", "inside").agg(F.sum(_flips(x, y, east, middle)).alias("_f"))
        parity = parity.select(*keys, F.col("sx").alias("cx"), F.col("sy").alias("cy"), ((F.col("inside") + F.col("_f")) % 2).cast("int").alias("inside"))
        spread = _spread(own.select(*keys, *_EDGE, F.col("cx").alias("ox"), F.col("cy").alias("oy")), [*keys, "ox", "oy"], F.lit(half))
        near = written(spread.where((F.floor(F.col("cx") / 2) == F.col("ox")) & (F.floor(F.col("cy") / 2) == F.col("oy"))).select(*keys, *_EDGE, "cx", "cy"), f"edges-{level + 1}")
        counted = near.groupBy(*keys, "cx", "cy").agg(F.count("*").alias("edges"))
        cells = written(parity.join(counted, [*keys, "cx", "cy"], "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint"))), f"cells-{level + 1}")
        size = half
        left = deeper.drop("cx", "cy", "inside", "edges").withColumns({"cx": at("px"), "cy": at("py")}).join(cells, [*keys, "cx", "cy"])
    return out
