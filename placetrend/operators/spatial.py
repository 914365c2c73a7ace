"""Point-in-polygon join on a quadtree of grid cells.

Polygons are cut into the cells their boxes touch, and each cell keeps only the edges a test from inside
that cell can need; a cell that no edge enters is wholly inside or is dropped. Cells start at a quarter of
the largest polygon, and those where many polygons or edges meet are split, again and again, so that small
polygons beside a giant do not share one cell. Points follow the splits down to their cell and then meet
polygons by an equi-join on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from placetrend.functions.geo import ring_edges, strictly_inside
from placetrend.storage import materialise

#: Cells along the longest side of the largest polygon, before any is split, and most of one polygon then.
CELLS_ACROSS = 4
CELLS_PER_POLYGON = (CELLS_ACROSS + 1) ** 2
#: A cell is split while more polygons than this have edges in it, or more edges are kept for it.
MOST_POLYGONS = 32
MOST_EDGES = 512
#: Halvings of a cell in one round, and the share of its polygons' mean edge that a cell never falls below.
#: Polygons that lie on each other cannot be told apart by any split; where many overlap, a point in a cell of
#: about their size is in a good part of those that meet there, while finer cells multiply each polygon's pieces.
MOST_HALVINGS = 4
FINEST = 1 / 2
BOX = ("x_min", "x_max", "y_min", "y_max", "grain")


def _total(rings: Column) -> Column:
    """Length of all edges, each by its longer side."""
    edges = F.flatten(F.transform(rings, ring_edges))
    sides = F.transform(edges, lambda e: F.greatest(F.abs(e["x2"] - e["x1"]), F.abs(e["y2"] - e["y1"])))
    return F.aggregate(sides, F.lit(0.0), lambda a, b: a + b)


def polygon_edges(polygons: DataFrame, name: str = "name", ring: str = "ring") -> DataFrame:
    """(name, ring) -> name, edges and bounding box. Several rows may share a name.

    ``ring`` is one ring of points, or an array of rings: the outer one and its holes.
    """
    nested = isinstance(polygons.schema[ring].dataType.elementType, ArrayType)
    rings = F.col(ring) if nested else F.array(F.col(ring))
    corners = F.flatten(rings)
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return polygons.where(F.size(corners) > 0).select(
        name,
        F.flatten(F.transform(rings, ring_edges)).alias("edges"),
        (_total(rings) / F.size(corners)).alias("grain"),
        F.array_min(xs).alias("x_min"),
        F.array_max(xs).alias("x_max"),
        F.array_min(ys).alias("y_min"),
        F.array_max(ys).alias("y_max"),
    )


def choose_cell(shapes: DataFrame) -> float:
    """Grid step that cuts the largest polygon into few cells; crowded cells are split later."""
    wide, high = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    side = shapes.agg(F.max(F.greatest(wide, high)).alias("side")).first().side
    return (side or CELLS_ACROSS) / CELLS_ACROSS


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def _step(cell: float, level: Column) -> Column:
    """Side of a cell after ``level`` halvings. Powers of two divide exactly, so cells nest exactly."""
    return F.lit(cell) / _power(level).cast("double")


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low), F.floor(high)))


def _needed(tiled: DataFrame, cell: float, name: str) -> DataFrame:
    """Of each piece ``(name, _cl, _cx, _cy, edges, _in, box)`` the edges that matter inside its cell."""
    step = _step(cell, F.col("_cl"))
    # what rounding can move a coordinate by, and a little more
    slack = step * 1e-9 + F.greatest(F.abs("_cx"), F.abs("_cy")) * step * 1e-12
    left, right = F.col("_cx") * step - slack, (F.col("_cx") + 1) * step + slack
    low, high = F.col("_cy") * step - slack, (F.col("_cy") + 1) * step + slack
    near = F.filter(
        "edges",
        lambda e: (F.greatest(e["y1"], e["y2"]) >= low)
        & (F.least(e["y1"], e["y2"]) <= high)
        & (F.greatest(e["x1"], e["x2"]) >= left),
    )
    placed = tiled.withColumn("edges", near).withColumn("_r", right).withColumn("_m", (F.col("_cy") + 0.5) * step)
    entered = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= F.col("_r"))
    beyond = F.size(F.filter("edges", lambda e: (e["y1"] > F.col("_m")) != (e["y2"] > F.col("_m"))))
    inside = F.col("_in") | (~entered & (beyond % 2 == 1))
    kept = placed.withColumn("_cut", entered & ~F.col("_in")).withColumn("_in", inside).where(F.col("_cut") | F.col("_in"))
    return kept.withColumn("edges", F.when(F.col("_cut"), F.col("edges")).otherwise(F.array().cast(tiled.schema["edges"].dataType))).select(
        name, "_cl", "_cx", "_cy", "edges", "_in", *BOX
    )


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as a shuffle has: its rows are about to be multiplied, and few files or rows
    would leave that to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_into_cells(shapes: DataFrame, cell: float, name: str = "name") -> DataFrame:
    """One row per polygon and touched cell, with the edges that matter inside the cell."""
    step = F.lit(cell)
    tiled = (
        _dealt(shapes).withColumn("_cx", _cells(F.col("x_min") / step, F.col("x_max") / step))
        .withColumn("_cy", _cells(F.col("y_min") / step, F.col("y_max") / step))
        .withColumns({"_cl": F.lit(0), "_in": F.lit(False)})
    )
    return _needed(tiled, cell, name)


def crowded_cells(pieces: DataFrame, cell: float) -> DataFrame:
    """``_cl, _cx, _cy, _next``: the cells to split, and the level of their children."""
    counted = pieces.where(~F.col("_in")).groupBy("_cl", "_cx", "_cy").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("edges")).alias("e"), F.avg("grain").alias("grain")
    )
    crowding = F.greatest(F.col("n") / MOST_POLYGONS, F.col("e") / MOST_EDGES)
    room = F.floor(F.log2(_step(cell, F.col("_cl")) / (F.greatest("grain", F.lit(1e-300)) * FINEST)))
    wanted = F.ceil(F.log2(crowding * 2) / 2)
    halvings = F.least(F.greatest(wanted, F.lit(1)), room, F.lit(MOST_HALVINGS)).cast("int")
    return counted.where((crowding > 1) & (room >= 1)).select("_cl", "_cx", "_cy", (F.col("_cl") + halvings).alias("_next"))


def split_cells(pieces: DataFrame, crowded: DataFrame, cell: float, name: str = "name") -> DataFrame:
    """The pieces of ``crowded`` cells in the children that they touch; the others as they are."""
    keys = ["_cl", "_cx", "_cy"]
    fan = _power(F.col("_next") - F.col("_cl"))
    step = _step(cell, F.col("_next"))

    def span(at: str, low: str, high: str) -> Column:
        first, last = F.col(at) * fan, (F.col(at) + 1) * fan - 1
        own_first, own_last = F.floor(F.col(low) / step), F.floor(F.col(high) / step)
        begin = F.when(F.col("_in"), first).otherwise(F.greatest(first, own_first))
        end = F.when(F.col("_in"), last).otherwise(F.least(last, own_last))
        return F.explode(F.sequence(begin, end))

    opened = _dealt(pieces.join(crowded, keys))
    children = (
        opened.withColumn("_x", span("_cx", "x_min", "x_max"))
        .withColumn("_y", span("_cy", "y_min", "y_max"))
        .withColumns({"_cx": F.col("_x"), "_cy": F.col("_y"), "_cl": F.col("_next")})
    )
    return pieces.join(crowded, keys, "left_anti").unionByName(_needed(children, cell, name))


@dataclass(frozen=True)
class PolygonGrid:
    """Polygons cut into cells, written once, so that the planner knows their true size.

    ``splits`` has the cells that were split in each round, few beside the pieces.
    """

    cells: DataFrame
    cell: float
    name: str
    splits: tuple[DataFrame, ...] = ()


def polygon_grid(polygons: DataFrame, name: str = "name", ring: str = "ring", cell: float | None = None) -> PolygonGrid:
    """The cells of all polygons; every round of splits is written. A cell has ``MOST_POLYGONS`` polygons
    with edges in it at most, but where it is as fine as their edges; beside them, polygons that cover it."""
    shapes = polygon_edges(polygons, name, ring)
    cell = cell or choose_cell(shapes)
    pieces = materialise(cut_into_cells(shapes, cell, name), "polygon-cells")
    splits: list[DataFrame] = []
    while not (crowded := materialise(crowded_cells(pieces, cell), "polygon-splits")).isEmpty():
        splits.append(crowded)
        pieces = materialise(split_cells(pieces, crowded, cell, name), "polygon-cells")
    return PolygonGrid(pieces.select(name, "_cl", "_cx", "_cy", "edges", "_in"), cell, name, tuple(splits))


def points_in_grid(points: DataFrame, grid: PolygonGrid, x: str = "x", y: str = "y", strategy: str | None = None) -> DataFrame:
    """Left join: every point with each polygon that strictly contains it, else with NULL.

    The join is on the cell. The planner broadcasts a small grid, and the points are not shuffled; with a
    large one both sides are shuffled, and the adaptive skew join splits a hot cell by its actual size.
    ``strategy`` is a join hint, for trials; count copies of a point together first.
    """
    cells = grid.cells.hint(strategy) if strategy else grid.cells

    def place(df: DataFrame, step: Column) -> DataFrame:
        return df.withColumns({"_px": F.floor(F.col(x) / step), "_py": F.floor(F.col(y) / step)})

    located = place(points.withColumn("_pl", F.lit(0)), F.lit(grid.cell))
    for crowded in grid.splits:
        here = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & (F.col("_pl") == F.col("_cl"))
        deeper = located.join(crowded, here, "left").withColumn("_pl", F.coalesce("_next", "_pl"))
        located = place(deeper.drop("_cl", "_cx", "_cy", "_next"), _step(grid.cell, F.col("_pl")))
    meet = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & (F.col("_pl") == F.col("_cl"))
    inside = F.col("_in") | strictly_inside(F.col(x), F.col(y), F.col("edges"))
    return located.join(cells, meet & inside, "left").select(*points.columns, grid.name)


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", strategy: str | None = None, **grid
) -> DataFrame:
    """``points_in_grid`` on polygons given as (name, ring)."""
    return points_in_grid(points, polygon_grid(polygons, **grid), x, y, strategy)
