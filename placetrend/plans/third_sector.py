"""Third-sector scores: decayed mean of yearly growth, shrunk towards the overall mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import decay_weight
from placetrend.functions.text import map_labels, sentinel_to_null, strip_numeric_code
from placetrend.operators.clean import rank_by_score
from placetrend.operators.panel import (
    drop_first_obs,
    interpolate_gaps,
    recency_gate,
    to_panel,
    with_group_extremes,
    yoy_growth,
)
from placetrend.operators.scale import shrink
from placetrend.operators.trend import weighted_mean
from placetrend.storage import settled

MEASURES = ("establishments", "jobs")


def third_sector_rows(raw: DataFrame, sector: int = fv.THIRD_SECTOR_CODE) -> DataFrame:
    """Establishments file -> year, locality, establishments, jobs of one sector."""
    df = raw.withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)
    df = df.where(
        (F.col("locality") != fv.NATIONAL_LABEL) & ~F.col("sector").contains(fv.SECTOR_TOTAL_WORD)
    )
    return df.where(map_labels(F.col("sector")) == sector).select(
        "year",
        strip_numeric_code(F.col("locality")).alias("locality"),
        *[sentinel_to_null(F.col(m)).alias(m) for m in MEASURES],
    )


def filled_panel(
    rows: DataFrame, measure: str, last_year: int = fv.THIRD_SECTOR_LAST_YEAR
) -> DataFrame:
    """One measure with inner gaps filled, open ends dropped and stale series removed."""
    panel = to_panel(rows, [measure])
    return recency_gate(interpolate_gaps(panel, measure).dropna("any"), last_year)


def growth_panel(filled: DataFrame, measure: str) -> DataFrame:
    """Growth over the previous row; the first row of each series is dropped."""
    grown = yoy_growth(filled, measure)
    return drop_first_obs(grown).select("locality", "year", "growth")


def bayes_score(
    growth: DataFrame,
    value: str = "growth",
    decay: float = fv.TIME_DECAY,
    prior_weight: float = fv.PRIOR_WEIGHT,
    write_first: bool = True,
) -> DataFrame:
    """Recent growth weighs most; localities with little weight lean on the overall mean."""
    aged = with_group_extremes(growth)
    weighted = aged.withColumn("weight", decay_weight(F.col("year"), F.col("max_year"), decay))
    means = settled(weighted_mean(weighted, value, "weight"), "growth-means", write_first)
    return shrink(means, prior_weight).select("locality", "trend_score")


def third_sector_score(
    rows: DataFrame, measure: str, last_year: int = fv.THIRD_SECTOR_LAST_YEAR, **options
) -> DataFrame:
    """All steps share one shuffle on the locality, after the panel's own."""
    return bayes_score(growth_panel(filled_panel(rows, measure, last_year), measure), **options)


def ranked_third_sector(raw: DataFrame, measure: str, **options) -> DataFrame:
    """Establishments file -> ranked score table of one measure."""
    return rank_by_score(third_sector_score(third_sector_rows(raw), measure, **options))
