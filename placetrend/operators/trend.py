"""Trend statistics per locality, each computed in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrend.functions.numeric import cagr_pct, smoothed_growth_pct
from placetrend.operators.panel import KEY, VALUE, YEAR, with_row_ranks


def slope(value: Column, year: Column) -> Column:
    """Least-squares slope; 0 where all years are the same."""
    return F.coalesce(F.regr_slope(value, year), F.lit(0.0))


def ols_slopes(
    df: DataFrame, measures: Mapping[str, str], key: str = KEY, year: str = YEAR
) -> DataFrame:
    """Output name -> measure; all slopes come from one partial aggregate."""
    return df.groupBy(key).agg(
        *[slope(F.col(f"`{m}`"), F.col(year)).alias(out) for out, m in measures.items()]
    )


def first_last(panel: DataFrame, value: str = VALUE, key: str = KEY, year: str = YEAR) -> DataFrame:
    """Ends of each series and the rates that need only these."""
    ends = panel.groupBy(key).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by(value, year).alias("first_value"),
        F.max_by(value, year).alias("last_value"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
    )
    first, last = F.col("first_value"), F.col("last_value")
    flat = F.col("_low") == F.col("_high")
    grown = cagr_pct(first, last, F.col("last_year") - F.col("first_year"))
    return ends.withColumns(
        {
            "absolute_change": last - first,
            "growth_pct": smoothed_growth_pct(first, last),
            "cagr_pct": F.when(flat & (first > 0) & (F.col("last_year") > F.col("first_year")), 0.0)
            .when(flat, F.lit(None))
            .otherwise(grown),
            "years_covered": F.concat_ws("-", "first_year", "last_year"),
        }
    ).drop("_low", "_high")


def trend_features(
    panel: DataFrame,
    value: str = VALUE,
    key: str = KEY,
    year: str = YEAR,
    ends: int = 3,
    min_for_ends: int = 6,
    recent: int = 5,
) -> DataFrame:
    """The nine series features of the building score in one window pass and one aggregate.

    A feature is NULL if a row it rests on has no value, as array arithmetic would have it.
    """
    ranked = with_row_ranks(panel, key, year)
    v, at, back, n = F.col(value), F.col("from_start"), F.col("from_end"), F.max("n_obs")

    def known(measure: Column, rows: Column = F.lit(True)) -> Column:
        return F.when(F.count_if(rows & v.isNull()) == 0, measure)

    last_rows = back <= recent
    whole_slope = known(slope(v, F.col(year)))
    late_slope = known(
        slope(F.when(last_rows, v), F.when(last_rows, F.col(year))), last_rows
    )
    first_value = F.max(F.when(at == 1, v))
    last_value = F.max(F.when(back == 1, v))
    shift = F.avg(F.when(back <= ends, v)) - F.avg(F.when(at <= ends, v))
    return ranked.groupBy(key).agg(
        n.alias("n_obs"),
        whole_slope.alias("slope"),
        F.when(n >= 2, last_value - first_value).otherwise(0).alias("croissance_totale"),
        F.when(n >= 2, smoothed_growth_pct(first_value, last_value))
        .otherwise(0.0)
        .alias("taux_croissance"),
        F.when(n >= min_for_ends, known(shift, (at <= ends) | (back <= ends)))
        .otherwise(0.0)
        .alias("acceleration"),
        known(F.sum(v)).alias("total_logements"),
        known(F.avg(v)).alias("avg_logements"),
        known(F.stddev_pop(v)).alias("volatilite"),
        F.when(n >= recent, late_slope).otherwise(whole_slope).alias("recent_slope"),
        known(F.max(v)).alias("max_logements"),
    )


def weighted_mean(df: DataFrame, value: str, weight: str, key: str = KEY) -> DataFrame:
    """Weight total and weighted mean per locality."""
    weights = F.sum(weight)
    return df.groupBy(key).agg(
        weights.alias("weight_sum"), (F.sum(F.col(weight) * F.col(value)) / weights).alias("raw_score")
    )
