"""Restaurants: counts per locality and year from node snapshots, and their Poisson trend."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.geo import wgs84_to_lv95
from placetrend.operators.clean import nonnegative, normalise_header, rank_by_score, year_range
from placetrend.operators.panel import min_years_gate, to_panel
from placetrend.operators.poisson import poisson_trend
from placetrend.operators.spatial import points_in_grid, polygon_grid
from placetrend.sources.contract import require_columns

log = logging.getLogger(__name__)

COUNT = "num_restaurants"
SHOWN_FAILURES = 50


def restaurant_counts(
    nodes: DataFrame,
    polygons: DataFrame,
    amenity: str = fv.AMENITY,
    strategy: str | None = None,
    project: Callable[[Column, Column], tuple[Column, Column]] = wgs84_to_lv95,
    **grid_options,
) -> DataFrame:
    """Amenity nodes and (name, ring) polygons in LV95 -> locality, year, num_restaurants.

    Nodes at one place and year are counted first, so that copies of a node are tested once. ``project``
    takes latitude and longitude to the polygons' plane: the approximation is good to a metre, so a node
    that close to a border may land beyond it; ``wgs84_to_lv95_rigorous`` is good to a centimetre.
    """
    grid = polygon_grid(polygons, **grid_options)
    named = nodes.where(F.col("amenity") == amenity).dropna(subset=["name"])
    places = named.groupBy("year", "lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    east, north = project(F.col("lat"), F.col("lon"))
    located = places.select("year", "_n", east.alias("x"), north.alias("y"))
    matched = points_in_grid(located, grid, strategy=strategy).withColumnRenamed(grid.name, "locality")
    counts = (
        matched.dropna(subset=["locality"])
        .groupBy("locality", "year")
        .agg(F.sum("_n").alias(COUNT))
    )
    return counts.orderBy(F.asc("locality"), F.desc("year"))


def restaurant_panel(
    counts: DataFrame,
    low: int = fv.RESTAURANT_YEAR_MIN,
    high: int = fv.RESTAURANT_YEAR_MAX,
    exclude: Sequence[int] = (),
    min_years: int = fv.RESTAURANT_MIN_YEARS,
) -> DataFrame:
    """Checked, filtered counts, duplicates added up, short series removed."""
    df = require_columns(normalise_header(counts), ["locality", "year", COUNT])
    kept = nonnegative(year_range(df, low, high, exclude), COUNT)
    return min_years_gate(to_panel(kept, [COUNT]), min_years)


def fitted_trends(
    counts: DataFrame,
    low: int = fv.RESTAURANT_YEAR_MIN,
    high: int = fv.RESTAURANT_YEAR_MAX,
    exclude: Sequence[int] = (),
    min_years: int = fv.RESTAURANT_MIN_YEARS,
) -> DataFrame:
    """Eight report columns plus ``fit_status`` per locality."""
    return poisson_trend(restaurant_panel(counts, low, high, exclude, min_years), COUNT)


def restaurant_trend(counts: DataFrame, **options) -> DataFrame:
    """The report of eight columns, best trend first.

    A global sort samples its input before it shuffles it; the narrow report is exchanged first so
    that the sample does not run every fit a second time.
    """
    return rank_by_score(fitted_trends(counts, **options).drop("fit_status").repartition("locality"))


def tell_failures(report: DataFrame, shown: int = SHOWN_FAILURES) -> None:
    """Logs the series of a written report that have no score, the first of them by name."""
    failed = report.where(F.col("trend_score").isNull())
    names = [r.locality for r in failed.select("locality").orderBy("locality").limit(shown).collect()]
    if names:
        n, total = failed.count(), report.count()
        log.warning("%d of %d series have no fit; their scores are missing in the report: %s%s", n, total, names, " ..." if n > len(names) else "")


def restaurant_score(counts: DataFrame, **options) -> DataFrame:
    return fitted_trends(counts, **options).select("locality", "trend_score")


def constant_series(counts: DataFrame, **options) -> DataFrame:
    """How many kept localities report the same count on every row."""
    df = normalise_header(counts)
    low = options.get("low", fv.RESTAURANT_YEAR_MIN)
    high = options.get("high", fv.RESTAURANT_YEAR_MAX)
    kept = nonnegative(year_range(df, low, high, options.get("exclude", ())), COUNT)
    spread = kept.where(F.col("locality").isNotNull()).groupBy("locality").agg(
        F.countDistinct("year").alias("n_years"), F.min(COUNT).alias("lo"), F.max(COUNT).alias("hi")
    )
    flat = (F.col("n_years") >= options.get("min_years", fv.RESTAURANT_MIN_YEARS)) & (F.col("lo") == F.col("hi"))
    return spread.agg(F.count_if(flat).alias("n_constant"))
