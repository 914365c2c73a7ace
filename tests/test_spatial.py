"""The spatial join against a nested loop and on boundaries."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from placetrend.functions.geo import wgs84_to_lv95, wgs84_to_lv95_rigorous
from placetrend.operators import spatial
from placetrend.plans.restaurants import restaurant_counts
from tests.helpers import frame, table

POLYGON = "name string, ring array<struct<x:double,y:double>>"
POINT = "id int, x double, y double"


@pytest.mark.parametrize("strategy", [None, "merge"])
def test_boundary_is_outside(spark, strategy):
    square = frame(spark, POLYGON, [("sq", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])])
    points = frame(spark, POINT, [(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 10.0, 5.0), (4, 0.0, 0.0), (5, None, 1.0)])
    got = spatial.points_in_polygons(points, square, strategy=strategy, cell=3.0)
    assert table(got, "id", "name") == [(1, "sq"), (2, None), (3, None), (4, None), (5, None)]


def ring(rng, cx, cy, size):
    """A star-shaped, mostly concave ring, open or closed."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 12)))
    corners = [(cx + rng.uniform(0.2, 1) * size * math.cos(a), cy + rng.uniform(0.2, 1) * size * math.sin(a)) for a in angles]
    return corners + corners[:1] if rng.random() < 0.5 else corners


def inside(x, y, corners):
    hit = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


@pytest.mark.parametrize("cell", [None, 0.7, 3.0, 1000.0])
@pytest.mark.parametrize("strategy", [None, "merge"])
def test_grid_join_equals_nested_loop(spark, cell, strategy):
    rng = random.Random(4)
    rings = [(f"p{i}", ring(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([1, 4, 15]))) for i in range(25)]
    rings.append(("none", []))
    points = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(300)]
    points += [points[0]] * 40
    want = []
    for i, x, y in points:
        names = [n for n, corners in rings if corners and inside(x, y, corners)]
        want += [(i, n) for n in names] or [(i, None)]
    got = spatial.points_in_polygons(
        frame(spark, POINT, points), frame(spark, POLYGON, rings), cell=cell, strategy=strategy
    )
    assert table(got, "id", "name") == sorted(want, key=lambda t: (t[0], t[1] is None, t[1]))


def test_cell_choice_bounds_the_cut(spark):
    wide = [("long", [(0.0, 0.0), (1e6, 0.0), (1e6, 1.0), (0.0, 1.0)])]
    small = [(f"s{i}", [(float(i), 0.0), (i + 0.5, 0.0), (i + 0.5, 0.5)]) for i in range(20)]
    shapes = spatial.polygon_edges(frame(spark, POLYGON, wide + small))
    cell = spatial.choose_cell(shapes)
    assert spatial.cut_into_cells(shapes, cell).count() < 21 * 4 * spatial.CELLS_PER_POLYGON


@pytest.mark.parametrize("strategy", [None, "merge"])
def test_restaurant_counts_keep_copies_and_drop_unmatched(spark, strategy):
    box = frame(spark, POLYGON, [("here", [(2.5e6, 1.1e6), (2.8e6, 1.1e6), (2.8e6, 1.3e6), (2.5e6, 1.3e6)])])
    node = "id bigint, lat double, lon double, amenity string, name string, year int"
    rows = [(i, 46.9, 7.4, "restaurant", "N", 2014) for i in range(5)]
    rows += [(9, 46.9, 7.4, "bank", "N", 2014), (10, 46.9, 7.4, "restaurant", None, 2014)]
    rows += [(11, 10.0, 7.4, "restaurant", "far", 2014), (12, 46.9, 7.5, "restaurant", "N", 2015)]
    counts = restaurant_counts(frame(spark, node, rows), box, strategy=strategy)
    assert [tuple(r) for r in counts.collect()] == [("here", 2015, 1), ("here", 2014, 5)]


def test_overlap_gives_a_row_per_polygon(spark):
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    two = frame(spark, POLYGON, [("a", box), ("b", box)])
    got = spatial.points_in_polygons(frame(spark, POINT, [(1, 2.0, 2.0)]), two)
    assert table(got, "id", "name") == [(1, "a"), (1, "b")]
    assert got.where(F.col("name") == "a").count() == 1


def test_holes_are_outside(spark):
    outer = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    schema = "name string, ring array<array<struct<x:double,y:double>>>"
    ringed = frame(spark, schema, [("town", [outer, hole]), ("enclave", [hole])])
    points = frame(spark, POINT, [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 4.0, 5.0)])
    got = spatial.points_in_polygons(points, ringed, cell=3.0)
    assert table(got, "id", "name") == [(1, "town"), (2, "enclave"), (3, None)]


def in_triangle(x, y, corners):
    signs = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True)]
    return all(v > 0 for v in signs) or all(v < 0 for v in signs)


def cells_and_rows(grid):
    cut = grid.cells.where(~F.col("_in")).groupBy("_cl", "_cx", "_cy").agg(F.count("*").alias("n"), F.sum(F.size("edges")).alias("e"))
    return cut.agg(F.max("n"), F.max("e"), F.count("*")).first()


def test_thousands_of_small_polygons_beside_giants(spark):
    rng = random.Random(8)
    small = []
    for k in range(10_000):
        cx, cy = (rng.gauss(300, 5), rng.gauss(400, 5)) if k % 3 else (rng.uniform(0, 1000), rng.uniform(0, 1000))
        small.append((f"s{k}", [(cx, cy), (cx + rng.uniform(0.1, 1), cy), (cx, cy + rng.uniform(0.1, 1))]))
    giants = []
    for name, cx, cy in (("g0", 400, 400), ("g1", 500, 600), ("g2", 450, 500)):
        turns = [2 * math.pi * k / 2000 for k in range(2000)]
        giants.append((name, [(cx + 390 * (1 + 0.02 * math.sin(40 * t)) * math.cos(t), cy + 390 * (1 + 0.02 * math.sin(40 * t)) * math.sin(t)) for t in turns]))
    points = [(k, rng.gauss(300, 5), rng.gauss(400, 5)) if k % 2 else (k, rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for k in range(1500)]
    want = []
    for i, x, y in points:
        names = [n for n, c in small if abs(x - c[0][0]) < 1.1 and abs(y - c[0][1]) < 1.1 and in_triangle(x, y, c)]
        names += [n for n, c in giants if inside(x, y, c)]
        want += [(i, n) for n in names] or [(i, None)]
    grid = spatial.polygon_grid(frame(spark, POLYGON, small + giants))
    most, edges, cells = cells_and_rows(grid)
    assert len(grid.splits) >= 2 and most <= 2 * spatial.MOST_POLYGONS and edges <= 2 * spatial.MOST_EDGES
    assert grid.cells.where("_in").count() < 4 * cells + 100
    for strategy in (None, "merge"):
        got = spatial.points_in_grid(frame(spark, POINT, points), grid, strategy=strategy)
        assert table(got, "id", "name") == sorted(want, key=lambda t: (t[0], t[1] is None, t[1]))


def test_polygons_that_lie_on_each_other_end_the_splits(spark):
    box = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]
    stack = frame(spark, POLYGON, [(f"p{k}", box) for k in range(200)])
    grid = spatial.polygon_grid(stack)
    assert len(grid.splits) <= 4 and grid.cells.count() < 200 * 40 * 40
    got = spatial.points_in_grid(frame(spark, POINT, [(1, 4.0, 4.0), (2, 8.0, 1.0), (3, 9.0, 1.0)]), grid)
    assert got.where("name IS NOT NULL").count() == 200 and got.count() == 202


def test_polygons_that_overlap_densely_have_few_pieces_each(spark):
    rng = random.Random(9)
    rings = []
    for _ in range(1000):
        cx, cy = rng.uniform(0, 7), rng.uniform(0, 7)
        rings.append([(cx - 0.7, cy), (cx, cy + 0.7), (cx + 0.7, cy), (cx, cy - 0.7)])
    layer = frame(spark, POLYGON, [(f"d{k}", ring) for k, ring in enumerate(rings)])
    assert spatial.polygon_grid(layer).cells.count() < 40 * len(rings)


def test_covered_cells_hold_no_edges(spark):
    grid = spatial.polygon_grid(frame(spark, POLYGON, [("big", [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)])]), cell=2.0)
    assert grid.cells.where("_in").count() >= 900
    assert grid.cells.where("_in AND size(edges) > 0").count() == 0


def test_nodes_near_a_border_change_sides_with_the_rigorous_projection(spark):
    """A border half-way between where the two projections put a node."""
    lat, lon = 46.2, 6.15
    near, true = (spark.range(1).select(p(F.lit(lat), F.lit(lon))[0].alias("x")).first().x for p in (wgs84_to_lv95, wgs84_to_lv95_rigorous))
    assert 0.02 < abs(near - true) < 2
    border, (west, east) = (near + true) / 2, (min(near, true), max(near, true))
    left = [(border - 5e4, 1.0e6), (border, 1.0e6), (border, 1.3e6), (border - 5e4, 1.3e6)]
    right = [(border, 1.0e6), (border + 5e4, 1.0e6), (border + 5e4, 1.3e6), (border, 1.3e6)]
    layer = frame(spark, POLYGON, [("left", left), ("right", right)])
    node = frame(spark, "id bigint, lat double, lon double, amenity string, name string, year int", [(1, lat, lon, "restaurant", "N", 2014)])
    for project, x in ((wgs84_to_lv95, near), (wgs84_to_lv95_rigorous, true)):
        side = "left" if x == west else "right"
        assert [tuple(r) for r in restaurant_counts(node, layer, project=project).collect()] == [(side, 2014, 1)]
