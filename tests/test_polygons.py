"""Points in polygons against the ray rule, edge by edge."""

import math
import random

import pytest

from terraloom.operators import joins as J
from terraloom.operators.polygons import points_in_polygons


def ring_edges(ring):
    return list(zip(ring, ring[1:] + ring[:1], strict=True))


def plain(points, polygons):
    out = set()
    for i, x, y in points:
        for k, rings in polygons.items():
            n = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ring in rings for (ax, ay), (bx, by) in ring_edges(ring))
            if n % 2:
                out.add((i, k))
    return out


def frames(spark, points, polygons):
    edges = [(k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, rings in polygons.items() for ring in rings for a, b in ring_edges(ring)]
    return spark.createDataFrame(points, "id long, px double, py double"), spark.createDataFrame(edges, "poly_id long, ax double, ay double, bx double, by double")


@pytest.mark.parametrize(("cell", "most"), [(1.0, 2), (3.0, 64), (0.7, 5)])
def test_whole_number_polygons(spark, cell, most):
    """Vertices, edges and points on cell borders and on each other; holes; steep, level and slanted edges."""
    rng = random.Random(3)
    polygons = {}
    for k in range(12):
        cx, cy = rng.randrange(-6, 7), rng.randrange(-6, 7)
        turn = sorted(rng.sample(range(360), rng.randrange(3, 9)))
        ring = [(cx + round(rng.randrange(1, 6) * math.cos(math.radians(a))), cy + round(rng.randrange(1, 6) * math.sin(math.radians(a)))) for a in turn]
        polygons[k] = [ring] + ([[(cx, cy), (cx + 1, cy), (cx, cy + 1)]] if k % 2 else [])
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-24, 25) for y in range(-24, 25))]
    p, e = frames(spark, points, polygons)
    assert {tuple(r) for r in points_in_polygons(p, e, cell, most).collect()} == plain(points, polygons)


def test_large_polygon_and_hot_cell(spark):
    """A jagged ring of thousands of edges, most of them in a few cells, with all points in one row of cells."""
    rng = random.Random(4)
    ring = [((5 if k % 2 else 4.9) * math.cos(2 * math.pi * k / 4000), (5 if k % 2 else 4.9) * math.sin(2 * math.pi * k / 4000)) for k in range(4000)]
    points = [(i, rng.uniform(-6, 6), rng.uniform(0.1, 0.9)) for i in range(2000)] + [(9999, None, 0.5)]
    p, e = frames(spark, points, {7: [ring]})
    got = [tuple(r) for r in points_in_polygons(p, e, 8.0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(points[:-1], {7: [ring]})


def test_nothing(spark):
    p, e = frames(spark, [(1, 0.5, 0.5)], {1: [[(0, 0), (1, 0), (1, 1), (0, 1)]]})
    assert points_in_polygons(p.limit(0), e, 1.0).count() == 0
    assert points_in_polygons(p, e.limit(0), 1.0).count() == 0


def test_hole_without_a_shell_is_an_error(spark):
    sides = [{"ax": 0.0, "ay": 0.0, "bx": 4.0, "by": 0.0}, {"ax": 4.0, "ay": 0.0, "bx": 4.0, "by": 4.0}, {"ax": 4.0, "ay": 4.0, "bx": 0.0, "by": 0.0}]
    shells = spark.createDataFrame([(1, 8.0, sides)], "shell_id long, area double, edges array<struct<ax: double, ay: double, bx: double, by: double>>")
    holes = spark.createDataFrame([(10, 3.0, 1.0), (11, 9.0, 9.0)], "hole_id long, px double, py double")
    assert sorted(map(tuple, J.holes_to_shells(holes, shells, 1.0).collect())) == [(10, 1, None), (11, None, "no shell")]
    with pytest.raises(Exception, match="no shell around hole 11"):
        J.holes_with_shells(holes, shells, 1.0).collect()
    assert J.holes_with_shells(holes.where("hole_id = 10"), shells, 1.0).first().shell_id == 1
