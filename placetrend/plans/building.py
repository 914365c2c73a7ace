"""Building score: acceleration, momentum, recent slope and growth of new buildings, 0..100."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import weighted_sum
from placetrend.functions.text import strip_dotted_code
from placetrend.operators.clean import drop_aggregate_rows, rank_by_score, unpivot_years
from placetrend.operators.panel import to_panel
from placetrend.operators.scale import minmax
from placetrend.operators.trend import trend_features
from placetrend.sources.sheet import year_columns
from placetrend.storage import settled

SCALED = ("slope", "acceleration", "recent_slope", "taux_croissance", "max_logements")


def building_panel(wide: DataFrame, building_type: str = fv.BUILDING_TYPE) -> DataFrame:
    """Wide sheet -> (locality, year, value) for one building type, localities only."""
    years = year_columns(wide)
    chosen = wide.where(F.col("type_batiment") == building_type).select(
        strip_dotted_code(F.col("nom_commune")).alias("locality"), *years
    )
    return to_panel(unpivot_years(drop_aggregate_rows(chosen), ["locality"], years))


def add_momentum(features: DataFrame) -> DataFrame:
    """Scaled features plus momentum: the lead of the recent slope over the whole slope, rescaled.

    Two global passes, the second over a result of the first; a flat feature scales to 0.
    """
    scaled = minmax(features, {f"{c}_scaled": c for c in SCALED}, flat=0.0)
    lead = F.col("recent_slope_scaled") - F.col("slope_scaled")
    return minmax(scaled.withColumn("momentum", lead), {"momentum_scaled": "momentum"}, flat=0.0)


def building_score(
    panel: DataFrame, weights: Mapping[str, float] = fv.BUILDING_WEIGHTS, write_first: bool = True
) -> DataFrame:
    features = settled(trend_features(panel), "building-features", write_first)
    scored = add_momentum(features).withColumn("trend_score", weighted_sum(weights))
    return scored.select("locality", "trend_score")


def ranked_building(wide: DataFrame, building_type: str = fv.BUILDING_TYPE, **options) -> DataFrame:
    """Wide new-building sheet -> ranked score table."""
    return rank_by_score(building_score(building_panel(wide, building_type), **options))
