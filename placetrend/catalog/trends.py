"""Aggregates, per-group statistics, scaling and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.catalog import analogues as an
from placetrend.catalog import oracle_parts as op
from placetrend.catalog.registry import q6, query, r6, rounded, with_ctes
from placetrend.operators import poisson, profile, scale, trend
from placetrend.operators.panel import to_panel, with_group_extremes
from placetrend.functions.numeric import decay_weight
from placetrend.plans import demography, third_sector
from placetrend.plans.building import add_momentum
from placetrend.plans.restaurants import constant_series, restaurant_panel

SERIES = {"low": an.YEARS[0], "high": an.YEARS[-1]}


# --- aggregates -----------------------------------------------------------------------------------


@query(
    "count_by_locality_year",
    "SELECT CAST(o_custkey AS VARCHAR) AS locality, CAST(year(o_orderdate) AS INT) AS year, count(*) AS value"
    " FROM orders GROUP BY 1, 2",
)
def count_by_locality_year(spark, sf_dir):
    return an.customer_panel(spark, sf_dir)


@query(
    "merge_duplicates",
    "SELECT CAST(l_suppkey AS VARCHAR) AS locality, CAST(year(l_shipdate) AS INT) AS year,"
    " CAST(sum(l_quantity) AS BIGINT) AS value, count(*) AS n_rows FROM lineitem GROUP BY 1, 2",
)
def merge_duplicates(spark, sf_dir):
    rows = an.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("locality"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").cast("bigint").alias("value"),
    )
    return to_panel(rows, rows="n_rows")


@query(
    "distinct_per_group",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, count(DISTINCT year) AS n_years, count(DISTINCT value) AS n_values FROM customer_panel GROUP BY 1",
)
def distinct_per_group(spark, sf_dir):
    return (
        an.customer_panel(spark, sf_dir)
        .groupBy("locality")
        .agg(F.countDistinct("year").alias("n_years"), F.countDistinct("value").alias("n_values"))
    )


@query(
    "constant_series_census",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT count(*) AS n_constant FROM (SELECT locality FROM customer_panel GROUP BY 1"
    " HAVING count(DISTINCT year) >= 3 AND count(DISTINCT value) = 1)",
)
def constant_series_census(spark, sf_dir):
    counts = an.customer_panel(spark, sf_dir).withColumnRenamed("value", "num_restaurants")
    return constant_series(counts, **SERIES)


@query(
    "first_last_year",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, min(year) AS first_year, max(year) AS last_year FROM customer_panel GROUP BY 1",
)
def first_last_year(spark, sf_dir):
    return trend.first_last(an.customer_panel(spark, sf_dir)).select("locality", "first_year", "last_year")


def _weighted(spark, sf_dir):
    aged = with_group_extremes(an.customer_panel(spark, sf_dir))
    weight = decay_weight(F.col("year"), F.col("max_year"), fv.TIME_DECAY)
    return trend.weighted_mean(aged.withColumn("weight", weight), "value", "weight")


WEIGHTED_SQL = """weighted AS (
  SELECT *, exp(-0.4 * (max(year) OVER (PARTITION BY locality) - year)) AS w FROM customer_panel),
means AS (SELECT locality, sum(w) AS weight_sum, sum(w * value) / sum(w) AS raw_score FROM weighted GROUP BY 1)"""


@query(
    "weighted_mean",
    with_ctes(an.CUSTOMER_SQL, WEIGHTED_SQL)
    + f" SELECT locality, {q6('weight_sum')} AS weight_sum, {q6('raw_score')} AS raw_score FROM means",
)
def weighted_mean(spark, sf_dir):
    return rounded(_weighted(spark, sf_dir), "weight_sum", "raw_score")


@query(
    "mean_of_means",
    with_ctes(an.CUSTOMER_SQL, WEIGHTED_SQL)
    + f" SELECT {q6('avg(raw_score)')} AS global_mean, count(*) AS n_localities FROM means",
)
def mean_of_means(spark, sf_dir):
    return rounded(scale.mean_of_means(_weighted(spark, sf_dir)), "global_mean")


SLOPE_NAMES = [name for name, _, _ in op.SLOPES]


@query(
    "ols_slopes",
    with_ctes(an.AGE_SQL, op.slopes("segments", "s"))
    + " SELECT locality, " + ", ".join(f"{q6(n)} AS {n}" for n in SLOPE_NAMES) + " FROM s",
)
def ols_slopes(spark, sf_dir):
    segments = demography.population_segments(an.age_table(spark, sf_dir))
    return rounded(trend.ols_slopes(segments, demography.SLOPE_OF), *demography.SLOPE_OF)


@query(
    "total_growth",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, arg_min(value, year) AS first_value, arg_max(value, year) AS last_value,"
    " arg_max(value, year) - arg_min(value, year) AS absolute_change FROM customer_panel GROUP BY 1",
)
def total_growth(spark, sf_dir):
    ends = trend.first_last(an.customer_panel(spark, sf_dir))
    return ends.select("locality", "first_value", "last_value", "absolute_change")


def _features(spark, sf_dir):
    return trend.trend_features(an.customer_panel(spark, sf_dir))


FEATURES_SQL = (an.CUSTOMER_SQL, op.features("customer_panel", "f"))


@query(
    "recent_slope",
    with_ctes(*FEATURES_SQL) + f" SELECT locality, {q6('slope')} AS slope, {q6('recent_slope')} AS recent_slope FROM f",
)
def recent_slope(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("locality", "slope", "recent_slope"), "slope", "recent_slope")


@query("acceleration", with_ctes(*FEATURES_SQL) + f" SELECT locality, {q6('acceleration')} AS acceleration FROM f")
def acceleration(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("locality", "acceleration"), "acceleration")


@query(
    "volume_stats",
    with_ctes(*FEATURES_SQL)
    + f" SELECT locality, total_logements, {q6('avg_logements')} AS avg_logements,"
    f" {q6('volatilite')} AS volatilite, max_logements FROM f",
)
def volume_stats(spark, sf_dir):
    stats = _features(spark, sf_dir).select("locality", "total_logements", "avg_logements", "volatilite", "max_logements")
    return rounded(stats, "avg_logements", "volatilite")


@query(
    "cagr",
    with_ctes(an.PART_SQL, op.poisson("part_panel", "num_restaurants", "p"))
    + f" SELECT locality, years_covered, {q6('cagr_pct')} AS cagr_pct FROM p",
)
def cagr(spark, sf_dir):
    ends = trend.first_last(an.part_panel(spark, sf_dir), "num_restaurants")
    return rounded(ends.select("locality", "years_covered", "cagr_pct"), "cagr_pct")


@query(
    "snapshot_values",
    with_ctes(an.AGE_SQL)
    + f" SELECT locality, max(total) FILTER (WHERE year = {an.LAST_YEAR}) AS pop_totale_2001,"
    f" max(jeunes_actifs_20_34) FILTER (WHERE year = {an.LAST_YEAR}) AS jeunes_actifs_2001,"
    + q6(f"max(100.0 * (jeunes_actifs_20_34 + actifs_35_49) / nullif(total, 0)) FILTER (WHERE year = {an.LAST_YEAR})")
    + " AS ratio_attractivite_2001 FROM segments GROUP BY 1 HAVING count(*) >= 5",
)
def snapshot_values(spark, sf_dir):
    segments = demography.population_segments(an.age_table(spark, sf_dir))
    trends = demography.population_trends(segments, snapshot_year=an.LAST_YEAR)
    kept = trends.select("locality", "pop_totale_2001", "jeunes_actifs_2001", "ratio_attractivite_2001")
    return rounded(kept, "ratio_attractivite_2001")


MOMENTUM_COLUMNS = ("slope_scaled", "recent_slope_scaled", "momentum", "momentum_scaled")


@query(
    "momentum",
    with_ctes(*FEATURES_SQL, op.momentum("f", "m"))
    + " SELECT locality, " + ", ".join(f"{q6(c)} AS {c}" for c in MOMENTUM_COLUMNS) + " FROM m",
)
def momentum(spark, sf_dir):
    scored = add_momentum(_features(spark, sf_dir)).select("locality", *MOMENTUM_COLUMNS)
    return rounded(scored, *MOMENTUM_COLUMNS)


# --- Poisson trend ---------------------------------------------------------------------------------

POISSON_NUMBERS = ("annual_growth_pct_poisson", "cagr_pct", "p_value_year", "deviance_explained", "trend_score")
POISSON_SQL = (
    an.PART_SQL,
    "part_kept AS (SELECT * FROM part_panel WHERE locality IN"
    " (SELECT locality FROM part_panel GROUP BY 1 HAVING count(DISTINCT year) >= 3))",
    op.poisson("part_kept", "num_restaurants", "p"),
)
ENDS_SQL = (
    *POISSON_SQL[:2],
    "part_ends AS (SELECT locality, year, CASE WHEN year = "
    f"{an.LAST_YEAR} THEN num_restaurants ELSE 0 END AS num_restaurants FROM part_kept)",
    op.poisson("part_ends", "num_restaurants", "p"),
)
REPORT_COLUMNS = "locality, years_covered, n_obs, " + ", ".join(f"{q6(c)} AS {c}" for c in POISSON_NUMBERS)
POISSON_COLUMNS = f"fit_status, {REPORT_COLUMNS}"


def _poisson(spark, sf_dir):
    counts = restaurant_panel(an.part_panel(spark, sf_dir), **SERIES)
    return poisson.poisson_trend(counts, "num_restaurants")


@query("poisson_trend", with_ctes(*POISSON_SQL) + f" SELECT {POISSON_COLUMNS} FROM p")
def poisson_trend(spark, sf_dir):
    return rounded(_poisson(spark, sf_dir), *POISSON_NUMBERS)


@query(
    "significant_trends",
    with_ctes(*POISSON_SQL) + f" SELECT locality, {q6('p_value_year')} AS p_value_year FROM p WHERE p_value_year < 0.10",
)
def significant_trends(spark, sf_dir):
    kept = poisson.significant(_poisson(spark, sf_dir)).select("locality", "p_value_year")
    return rounded(kept, "p_value_year")


@query(
    "fit_failures",
    with_ctes(*ENDS_SQL) + " SELECT locality, years_covered, n_obs, fit_status FROM p WHERE fit_status = 'not_converged'",
)
def fit_failures(spark, sf_dir):
    """Counts of the last year alone: a part with any then has no finite fit."""
    counts = restaurant_panel(an.part_panel(spark, sf_dir), **SERIES)
    ends = counts.withColumn("num_restaurants", F.when(F.col("year") == an.LAST_YEAR, F.col("num_restaurants")).otherwise(0))
    failed = poisson.fit_failures(poisson.poisson_trend(ends, "num_restaurants"))
    return failed.select("locality", "years_covered", "n_obs", "fit_status")


# --- scaling ---------------------------------------------------------------------------------------


@query(
    "global_scalar_broadcast",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, year, value, (SELECT min(value) FROM customer_panel) AS lowest,"
    " (SELECT max(value) FROM customer_panel) AS highest, "
    + q6("(SELECT avg(value) FROM customer_panel)") + " AS mean FROM customer_panel",
)
def global_scalar_broadcast(spark, sf_dir):
    panel = an.customer_panel(spark, sf_dir)
    g = scale.global_stats(panel, lowest=F.min("value"), highest=F.max("value"), mean=F.avg("value"))
    return panel.select(
        "*", g["lowest"].alias("lowest"), g["highest"].alias("highest"), r6(g["mean"]).alias("mean")
    )


def _customer_slopes(spark, sf_dir):
    return trend.ols_slopes(an.customer_panel(spark, sf_dir), {"slope": "value"})


CUSTOMER_SLOPES_SQL = (
    an.CUSTOMER_SQL,
    "slopes AS (SELECT locality, CASE WHEN count(DISTINCT year) = 1 THEN 0 ELSE regr_slope(value, year) END AS slope"
    " FROM customer_panel GROUP BY 1)",
)


@query(
    "zscore",
    with_ctes(*CUSTOMER_SLOPES_SQL)
    + f" SELECT locality, {q6('(slope - avg(slope) OVER ()) / stddev_pop(slope) OVER ()')} AS slope_norm FROM slopes",
)
def zscore(spark, sf_dir):
    scaled = scale.zscore(_customer_slopes(spark, sf_dir), ["slope"])
    return rounded(scaled.select("locality", "slope_norm"), "slope_norm")


@query(
    "minmax_scale",
    with_ctes(*CUSTOMER_SLOPES_SQL)
    + " SELECT locality, "
    + q6("100 * (slope - min(slope) OVER ()) / (max(slope) OVER () - min(slope) OVER ())")
    + " AS slope_scaled FROM slopes",
)
def minmax_scale(spark, sf_dir):
    scaled = scale.minmax(_customer_slopes(spark, sf_dir), {"slope_scaled": "slope"})
    return rounded(scaled.select("locality", "slope_scaled"), "slope_scaled")


@query(
    "sign_preserving_scale",
    with_ctes(*CUSTOMER_SLOPES_SQL, op.sign_scale("slopes", "scaled", "slope"))
    + f" SELECT locality, {q6('slope')} AS slope FROM scaled",
)
def sign_preserving_scale(spark, sf_dir):
    return rounded(scale.sign_preserving(_customer_slopes(spark, sf_dir), "slope"), "slope")


@query(
    "bayes_shrinkage",
    with_ctes(an.CUSTOMER_SQL, op.bayes("customer_panel", "value", "b", an.YEARS[0]))
    + f" SELECT locality, {q6('trend_score')} AS trend_score FROM b",
)
def bayes_shrinkage(spark, sf_dir):
    growth = third_sector.growth_panel(an.customer_panel(spark, sf_dir), "value")
    return rounded(third_sector.bayes_score(growth), "trend_score")


# --- profiles --------------------------------------------------------------------------------------


@query(
    "null_profile",
    with_ctes(an.ESTABLISHMENTS_SQL)
    + " SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in ("year", "locality", "establishments", "jobs"))
    + " FROM sector_rows",
)
def null_profile(spark, sf_dir):
    return profile.null_profile(third_sector.third_sector_rows(an.establishments_file(spark, sf_dir)))


@query(
    "row_profile",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT count(*) AS n_rows, count(DISTINCT locality) AS n_locality, count(DISTINCT year) AS n_year FROM customer_panel",
)
def row_profile(spark, sf_dir):
    return profile.row_profile(an.customer_panel(spark, sf_dir), "locality", "year")


@query(
    "score_describe",
    with_ctes(*CUSTOMER_SLOPES_SQL)
    + f" SELECT count(slope) AS n, count(*) - count(slope) AS n_missing, {q6('avg(slope)')} AS mean,"
    f" {q6('stddev_samp(slope)')} AS std, {q6('min(slope)')} AS min, {q6('quantile_cont(slope, 0.25)')} AS q25,"
    f" {q6('quantile_cont(slope, 0.5)')} AS q50, {q6('quantile_cont(slope, 0.75)')} AS q75, {q6('max(slope)')} AS max FROM slopes",
)
def score_describe(spark, sf_dir):
    described = profile.describe_score(_customer_slopes(spark, sf_dir), "slope")
    return rounded(described, "mean", "std", "min", "q25", "q50", "q75", "max")
