"""Demography score: five population slopes, standardised, weighted and scaled to 0..100."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import share_pct, weighted_sum
from placetrend.functions.text import strip_dotted_code
from placetrend.operators.clean import drop_aggregate_rows, rank_by_score, segment_sums
from placetrend.operators.scale import minmax, zscore
from placetrend.operators.trend import slope
from placetrend.storage import settled

SLOPE_OF = {
    "slope_jeunes_actifs": "jeunes_actifs_20_34",
    "slope_actifs_35_49": "actifs_35_49",
    "slope_pop_totale": fv.TOTAL_POPULATION,
    "slope_enfants": "enfants_0_19",
    "slope_seniors": "seniors_50_plus",
}


def population_segments(sheet: DataFrame) -> DataFrame:
    """Tidy sheet -> year, locality, total and the four age segments, localities only."""
    named = sheet.withColumn("locality", strip_dotted_code(F.col("locality")))
    summed = segment_sums(drop_aggregate_rows(named))
    return summed.select("year", "locality", fv.TOTAL_POPULATION, *fv.AGE_SEGMENTS)


def population_trends(
    segments: DataFrame,
    min_rows: int = fv.DEMOGRAPHY_MIN_ROWS,
    snapshot_year: int = fv.DEMOGRAPHY_SNAPSHOT_YEAR,
) -> DataFrame:
    """Slopes, latest snapshot and row gate in one aggregate, so a hot locality is combined
    on the map side. The snapshot is one whole row of the year, the most populous if several."""
    total, young, active = (F.col(f"`{c}`") for c in (fv.TOTAL_POPULATION, "jeunes_actifs_20_34", "actifs_35_49"))
    row = F.struct(total.alias("total"), young.alias("young"), active.alias("active"))
    trends = segments.groupBy("locality").agg(
        *[slope(F.col(f"`{m}`"), F.col("year")).alias(out) for out, m in SLOPE_OF.items()],
        F.max(F.when(F.col("year") == snapshot_year, row)).alias("_now"),
        F.count(F.lit(1)).alias("_rows"),
    )
    now = F.col("_now")
    return trends.where(F.col("_rows") >= min_rows).select(
        "locality",
        *SLOPE_OF,
        now["total"].alias(f"pop_totale_{snapshot_year}"),
        now["young"].alias(f"jeunes_actifs_{snapshot_year}"),
        share_pct([now["young"], now["active"]], now["total"]).alias(f"ratio_attractivite_{snapshot_year}"),
    )


def score_population(
    trends: DataFrame, weights: Mapping[str, float] = fv.DEMOGRAPHY_WEIGHTS, write_first: bool = True
) -> DataFrame:
    """z-scores -> weighted sum -> 0..100 over all localities; a flat table has no score."""
    scaled = zscore(settled(trends, "population-trends", write_first), list(weights))
    raw = scaled.withColumn("_raw", weighted_sum({f"{c}_norm": w for c, w in weights.items()}))
    return minmax(raw, {"trend_score": "_raw"})


def demography_detail(segments: DataFrame, write_first: bool = True, **options) -> DataFrame:
    """Score with its explanatory columns, ten in all."""
    trends = population_trends(segments, **options)
    extras = [c for c in trends.columns if c != "locality"]
    scored = score_population(trends, write_first=write_first)
    return scored.select("locality", "trend_score", *extras)


def demography_score(segments: DataFrame, **options) -> DataFrame:
    return demography_detail(segments, **options).select("locality", "trend_score")


def ranked_demography(sheet: DataFrame, **options) -> DataFrame:
    """Tidy population sheet -> ranked score table."""
    return rank_by_score(demography_score(population_segments(sheet), **options))
