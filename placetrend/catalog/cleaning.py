"""Projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.catalog import analogues as an
from placetrend.catalog.registry import q6, query, r6, rounded, with_ctes
from placetrend.functions import numeric, text
from placetrend.functions.geo import wgs84_to_lv95, wgs84_to_lv95_rigorous
from placetrend.operators import clean
from placetrend.operators.panel import with_group_extremes
from placetrend.operators.trend import first_last
from placetrend.plans.demography import population_segments
from placetrend.plans.third_sector import third_sector_rows

WIDE_COLUMNS = ", ".join(fv.COMPOSITE_SCORES)


@query(
    "rename_columns",
    with_ctes(an.ESTABLISHMENTS_SQL) + " SELECT year, locality, sector, establishments, jobs FROM establishments_file",
)
def rename_columns(spark, sf_dir):
    return an.establishments_file(spark, sf_dir).withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)


@query(
    "normalise_header",
    with_ctes(an.CUSTOMER_SQL) + " SELECT locality, year, value AS num_restaurants FROM customer_panel",
)
def normalise_header(spark, sf_dir):
    messy = an.customer_panel(spark, sf_dir).toDF(" Locality", "YEAR ", " Num_Restaurants ")
    return clean.normalise_header(messy)


@query("select_reorder", with_ctes(an.NATION_SQL) + " SELECT value, locality FROM nation_panel")
def select_reorder(spark, sf_dir):
    return an.nation_panel(spark, sf_dir).select("value", "locality")


@query(
    "strict_cast",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_linenumber AS VARCHAR) AS TINYINT) AS code, "
    "CAST(CAST(year(l_shipdate) AS VARCHAR) AS INT) AS year, "
    "CAST(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS BIGINT) AS quantity FROM lineitem",
)
def strict_cast(spark, sf_dir):
    as_text = an.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linenumber").cast("string").alias("code"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.col("l_quantity").cast("bigint").cast("string").alias("quantity"),
    )
    return as_text.withColumns(
        {
            "code": numeric.strict(F.col("code"), "tinyint"),
            "year": numeric.strict(F.col("year"), "int"),
            "quantity": numeric.strict(F.col("quantity"), "bigint"),
        }
    )


@query(
    "lenient_cast",
    "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view', 'click') THEN value END AS score FROM events",
)
def lenient_cast(spark, sf_dir):
    kind = F.col("event_type")
    written = (
        F.when(kind == "error", "abc").when(kind == "view", "NaN").when(kind == "click", "").otherwise(
            F.col("value").cast("string")
        )
    )
    return an.table(spark, sf_dir, "events").select("event_id", numeric.to_number(written).alias("score"))


@query(
    "sentinel_to_null",
    with_ctes(an.ESTABLISHMENTS_SQL)
    + """ SELECT year, locality, sector,
  CASE WHEN establishments NOT IN ('X', '0') THEN CAST(establishments AS BIGINT) END AS establishments,
  CASE WHEN jobs NOT IN ('X', '0') THEN CAST(jobs AS BIGINT) END AS jobs FROM establishments_file""",
)
def sentinel_to_null(spark, sf_dir):
    raw = an.establishments_file(spark, sf_dir).withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)
    return raw.withColumns({m: text.sentinel_to_null(F.col(m)) for m in ("establishments", "jobs")})


@query(
    "map_labels",
    with_ctes(an.ESTABLISHMENTS_SQL)
    + """ SELECT year, locality, CAST(CASE sector WHEN 'Secteur primaire' THEN 1
  WHEN 'Secteur secondaire' THEN 2 WHEN 'Secteur tertiaire' THEN 3 END AS TINYINT) AS sector
  FROM establishments_file WHERE sector NOT LIKE '%total%'""",
)
def map_labels(spark, sf_dir):
    raw = an.establishments_file(spark, sf_dir).withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)
    named = raw.where(~F.col("sector").contains(fv.SECTOR_TOTAL_WORD))
    return named.select("year", "locality", text.map_labels(F.col("sector")).alias("sector"))


@query("strip_dotted_code", "SELECT c_custkey, c_name AS locality FROM customer")
def strip_dotted_code(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    coded = F.concat(F.lit("......"), key, F.lit(" "), F.col("c_name"))
    return an.table(spark, sf_dir, "customer").select("c_custkey", text.strip_dotted_code(coded).alias("locality"))


@query("strip_numeric_code", "SELECT c_custkey, c_name AS locality FROM customer")
def strip_numeric_code(spark, sf_dir):
    coded = F.concat(F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_name"))
    return an.table(spark, sf_dir, "customer").select("c_custkey", text.strip_numeric_code(coded).alias("locality"))


SEGMENT_COLUMNS = "locality, year, " + ", ".join(fv.AGE_SEGMENTS)


@query("segment_sums", with_ctes(an.AGE_SQL) + f" SELECT {SEGMENT_COLUMNS} FROM segments")
def segment_sums(spark, sf_dir):
    summed = clean.segment_sums(an.age_table(spark, sf_dir))
    return summed.select("locality", "year", *fv.AGE_SEGMENTS)


@query(
    "fill_null_zero",
    with_ctes(an.WIDE_SQL)
    + " SELECT locality, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in fv.COMPOSITE_SCORES)
    + " FROM customer_wide",
)
def fill_null_zero(spark, sf_dir):
    return an.customer_wide(spark, sf_dir).fillna(0, subset=list(fv.COMPOSITE_SCORES))


WIDE_WEIGHTS = dict(zip(fv.COMPOSITE_SCORES, fv.DEMOGRAPHY_WEIGHTS.values()))


@query(
    "weighted_sum",
    with_ctes(an.WIDE_SQL)
    + " SELECT locality, "
    + q6(" + ".join(f"{w} * coalesce({c}, 0)" for c, w in WIDE_WEIGHTS.items()))
    + " AS score FROM customer_wide",
)
def weighted_sum(spark, sf_dir):
    wide = an.customer_wide(spark, sf_dir).fillna(0, subset=list(fv.COMPOSITE_SCORES))
    return wide.select("locality", r6(numeric.weighted_sum(WIDE_WEIGHTS)).alias("score"))


@query(
    "total_score",
    with_ctes(an.WIDE_SQL)
    + " SELECT locality, "
    + " + ".join(f"coalesce({c}, 0)" for c in fv.COMPOSITE_SCORES)
    + " AS total FROM customer_wide",
)
def total_score(spark, sf_dir):
    return clean.total_score(an.customer_wide(spark, sf_dir)).select("locality", "total")


@query(
    "attractiveness_ratio",
    with_ctes(an.AGE_SQL)
    + " SELECT locality, year, "
    + q6("100.0 * (jeunes_actifs_20_34 + actifs_35_49) / nullif(total, 0)")
    + " AS ratio FROM segments",
)
def attractiveness_ratio(spark, sf_dir):
    segments = population_segments(an.age_table(spark, sf_dir))
    share = numeric.share_pct(
        [F.col("jeunes_actifs_20_34"), F.col("actifs_35_49")], F.col(f"`{fv.TOTAL_POPULATION}`")
    )
    return segments.select("locality", "year", r6(share).alias("ratio"))


@query(
    "decay_weight",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, year, "
    + q6("exp(-0.4 * (max(year) OVER (PARTITION BY locality) - year))")
    + " AS weight FROM customer_panel",
)
def decay_weight(spark, sf_dir):
    dated = with_group_extremes(an.customer_panel(spark, sf_dir))
    weight = numeric.decay_weight(F.col("year"), F.col("max_year"), fv.TIME_DECAY)
    return dated.select("locality", "year", r6(weight).alias("weight"))


@query(
    "years_covered",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, CAST(min(year) AS VARCHAR) || '-' || CAST(max(year) AS VARCHAR) AS years_covered "
    "FROM customer_panel GROUP BY 1",
)
def years_covered(spark, sf_dir):
    return first_last(an.customer_panel(spark, sf_dir)).select("locality", "years_covered")


@query(
    "smoothed_growth",
    with_ctes(an.PART_SQL)
    + " SELECT locality, "
    + q6("100.0 * (arg_max(num_restaurants, year) - arg_min(num_restaurants, year)) / (arg_min(num_restaurants, year) + 1)")
    + " AS growth_pct FROM part_panel GROUP BY 1",
)
def smoothed_growth(spark, sf_dir):
    ends = first_last(an.part_panel(spark, sf_dir), "num_restaurants")
    return rounded(ends.select("locality", "growth_pct"), "growth_pct")


P, L = "((lat * 3600 - 169028.66) / 10000)", "((lon * 3600 - 26782.5) / 10000)"
EAST_SQL = f"2600072.37 + 211455.93 * {L} - 10938.51 * {L} * {P} - 0.36 * {L} * {P} * {P} - 44.54 * {L} * {L} * {L}"
NORTH_SQL = (
    f"1200147.07 + 308807.95 * {P} + 3745.25 * {L} * {L} + 76.63 * {P} * {P}"
    f" - 194.56 * {L} * {L} * {P} + 119.79 * {P} * {P} * {P}"
)


@query(
    "reproject_points",
    with_ctes(an.NODES_SQL) + f" SELECT id, {q6(EAST_SQL, 3)} AS east, {q6(NORTH_SQL, 3)} AS north FROM nodes",
)
def reproject_points(spark, sf_dir):
    east, north = wgs84_to_lv95(F.col("lat"), F.col("lon"))
    return an.node_table(spark, sf_dir).select("id", r6(east, 3).alias("east"), r6(north, 3).alias("north"))


# By sub-selects, and with the latitude from a closed form instead of rounds.
RIGOROUS_SQL = """space AS (
  SELECT id, radians(lat) AS f, radians(lon) AS l, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(lat)) ** 2) AS n FROM nodes),
shifted AS (
  SELECT id, n * cos(f) * cos(l) - 674.374 AS x, n * cos(f) * sin(l) - 15.056 AS y, n * (1 - 0.0066943799901413165) * sin(f) - 405.346 AS z FROM space),
axes AS (SELECT 6377397.155 AS a, 0.006674372230614 AS e2, 6377397.155 * sqrt(1 - 0.006674372230614) AS b),
angles AS (
  SELECT id, atan2(y, x) AS l, z, sqrt(x * x + y * y) AS p, atan2(z * a, sqrt(x * x + y * y) * b) AS t, a, b, e2 FROM shifted, axes),
bessel AS (
  SELECT id, l, atan2(z + e2 / (1 - e2) * b * sin(t) ** 3, p - e2 * a * cos(t) ** 3) AS f, sqrt(e2) AS e FROM angles),
sphere AS (
  SELECT id, 2 * (atan(exp(1.000729138430378 * (ln(tan(pi() / 4 + f / 2)) - e / 2 * ln((1 + e * sin(f)) / (1 - e * sin(f)))) + 0.0030667323772733505)) - pi() / 4) AS b,
         1.000729138430378 * (l - radians(7 + 26 / 60.0 + 22.5 / 3600.0)) AS l, radians(46.90773145790536) AS c FROM bessel),
plane AS (
  SELECT id, atan(sin(l) / (sin(c) * tan(b) + cos(c) * cos(l))) AS u, asin(cos(c) * sin(b) - sin(c) * cos(b) * cos(l)) AS v FROM sphere),
lv95 AS (SELECT id, 2600000.0 + 6378815.903647575 * u AS east, 1200000.0 + 6378815.903647575 * atanh(sin(v)) AS north FROM plane)"""


@query(
    "reproject_points_rigorous",
    with_ctes(an.NODES_SQL, RIGOROUS_SQL) + f" SELECT id, {q6('east', 2)} AS east, {q6('north', 2)} AS north FROM lv95",
)
def reproject_points_rigorous(spark, sf_dir):
    east, north = wgs84_to_lv95_rigorous(F.col("lat"), F.col("lon"))
    return an.node_table(spark, sf_dir).select("id", r6(east, 2).alias("east"), r6(north, 2).alias("north"))


# --- filters ----------------------------------------------------------------------------------------


@query(
    "filter_eq",
    with_ctes(an.NODES_SQL) + " SELECT id, name FROM nodes WHERE amenity = 'restaurant'",
)
def filter_eq(spark, sf_dir):
    return an.node_table(spark, sf_dir).where(F.col("amenity") == fv.AMENITY).select("id", "name")


@query(
    "drop_aggregate_rows",
    "SELECT CAST(c_custkey AS VARCHAR) AS locality, c_mktsegment FROM customer "
    "WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0",
)
def drop_aggregate_rows(spark, sf_dir):
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    label = (
        F.when(segment == "BUILDING", F.concat(F.lit("- "), key))
        .when(segment == "MACHINERY", F.concat(F.lit(">> "), key))
        .when(F.col("c_acctbal") <= 0, fv.NATIONAL_LABEL)
        .otherwise(key)
    )
    labelled = an.table(spark, sf_dir, "customer").select(label.alias("locality"), "c_mktsegment")
    return clean.drop_aggregate_rows(labelled, national=fv.NATIONAL_LABEL)


@query(
    "filter_not_contains",
    with_ctes(an.ESTABLISHMENTS_SQL) + " SELECT year, locality, sector FROM establishments_file WHERE sector NOT LIKE '%total%'",
)
def filter_not_contains(spark, sf_dir):
    raw = an.establishments_file(spark, sf_dir).withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)
    return raw.where(~F.col("sector").contains(fv.SECTOR_TOTAL_WORD)).select("year", "locality", "sector")


@query(
    "year_range_filter",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT * FROM customer_panel WHERE year BETWEEN 1996 AND 2000 AND year NOT IN (1998)",
)
def year_range_filter(spark, sf_dir):
    return clean.year_range(an.customer_panel(spark, sf_dir), 1996, 2000, exclude=[1998])


@query("nonnegative_guard", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def nonnegative_guard(spark, sf_dir):
    accounts = an.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return clean.nonnegative(accounts, "c_acctbal")


@query(
    "drop_nulls_subset",
    with_ctes(an.NODES_SQL) + " SELECT id, amenity, name FROM nodes WHERE name IS NOT NULL",
)
def drop_nulls_subset(spark, sf_dir):
    return an.node_table(spark, sf_dir).select("id", "amenity", "name").dropna(subset=["name"])


@query(
    "drop_nulls_any",
    with_ctes(an.ESTABLISHMENTS_SQL)
    + " SELECT * FROM sector_rows WHERE establishments IS NOT NULL AND jobs IS NOT NULL",
)
def drop_nulls_any(spark, sf_dir):
    return third_sector_rows(an.establishments_file(spark, sf_dir)).dropna("any")
