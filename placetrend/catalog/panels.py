"""Gates, windows along a series, sorting and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.catalog import analogues as an
from placetrend.catalog.oracle_parts import filled
from placetrend.catalog.registry import q6, query, rounded, with_ctes
from placetrend.operators import clean, panel
from placetrend.plans.building import building_panel
from placetrend.plans.third_sector import third_sector_rows
from placetrend.sources.sheet import fill_down, promote_year_header, year_columns


@query(
    "min_rows_gate",
    with_ctes(an.CUSTOMER_SQL) + " SELECT * FROM customer_panel QUALIFY count(*) OVER (PARTITION BY locality) >= 5",
)
def min_rows_gate(spark, sf_dir):
    return panel.min_rows_gate(an.customer_panel(spark, sf_dir), 5)


@query(
    "min_years_gate",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT * FROM customer_panel WHERE locality IN "
    "(SELECT locality FROM customer_panel GROUP BY 1 HAVING count(DISTINCT year) >= 3)",
)
def min_years_gate(spark, sf_dir):
    return panel.min_years_gate(an.customer_panel(spark, sf_dir), 3)


@query(
    "excluded_localities",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, count(DISTINCT year) AS n_years FROM customer_panel GROUP BY 1 HAVING count(DISTINCT year) < 3",
)
def excluded_localities(spark, sf_dir):
    return panel.excluded_keys(an.customer_panel(spark, sf_dir), 3)


@query(
    "recency_gate",
    with_ctes(an.CUSTOMER_SQL)
    + f" SELECT * FROM customer_panel QUALIFY max(year) OVER (PARTITION BY locality) >= {an.LAST_YEAR}",
)
def recency_gate(spark, sf_dir):
    return panel.recency_gate(an.customer_panel(spark, sf_dir), an.LAST_YEAR)


@query(
    "lag_prev_year",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT *, lag(value) OVER (PARTITION BY locality ORDER BY year) AS previous FROM customer_panel",
)
def lag_prev_year(spark, sf_dir):
    return panel.with_previous(an.customer_panel(spark, sf_dir))


@query(
    "yoy_growth",
    with_ctes(an.PART_SQL)
    + " SELECT locality, year, "
    + q6(
        "(num_restaurants - lag(num_restaurants) OVER (PARTITION BY locality ORDER BY year)) * 1.0"
        " / nullif(lag(num_restaurants) OVER (PARTITION BY locality ORDER BY year), 0)"
    )
    + " AS growth FROM part_panel",
)
def yoy_growth(spark, sf_dir):
    grown = panel.yoy_growth(an.part_panel(spark, sf_dir), "num_restaurants")
    return rounded(grown, "growth").select("locality", "year", "growth")


@query(
    "drop_first_obs",
    with_ctes(an.CUSTOMER_SQL) + " SELECT * FROM customer_panel QUALIFY year > min(year) OVER (PARTITION BY locality)",
)
def drop_first_obs(spark, sf_dir):
    return panel.drop_first_obs(an.customer_panel(spark, sf_dir))


@query(
    "group_max_over",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT *, min(year) OVER (PARTITION BY locality) AS min_year, max(year) OVER (PARTITION BY locality) AS max_year"
    " FROM customer_panel",
)
def group_max_over(spark, sf_dir):
    return panel.with_group_extremes(an.customer_panel(spark, sf_dir))


@query(
    "first_last_k",
    with_ctes(an.CUSTOMER_SQL)
    + """ SELECT * FROM (SELECT locality, year, value,
  CAST(row_number() OVER (PARTITION BY locality ORDER BY year) AS INT) AS from_start,
  count(*) OVER (PARTITION BY locality) AS n_obs,
  count(*) OVER (PARTITION BY locality) - row_number() OVER (PARTITION BY locality ORDER BY year) + 1 AS from_end
  FROM customer_panel) WHERE from_start <= 3 OR from_end <= 3""",
)
def first_last_k(spark, sf_dir):
    ranked = panel.with_row_ranks(an.customer_panel(spark, sf_dir))
    return ranked.where((F.col("from_start") <= 3) | (F.col("from_end") <= 3))


@query(
    "interpolate_gaps",
    with_ctes(an.ESTABLISHMENTS_SQL, filled("sector_rows", "jobs", "j", an.LAST_YEAR))
    + f" SELECT locality, year, {q6('v')} AS jobs FROM j_i",
)
def interpolate_gaps(spark, sf_dir):
    rows = third_sector_rows(an.establishments_file(spark, sf_dir))
    return rounded(panel.interpolate_gaps(panel.to_panel(rows, ["jobs"]), "jobs"), "jobs")


SECTIONS_SQL = f"""grid AS (
  SELECT (year - {an.SHEET_EPOCH}) * {an.ROW_STRIDE} + CAST(locality AS BIGINT) + 1 AS row_idx, locality,
         CAST(NULL AS INT) AS section FROM customer_panel
  UNION ALL
  SELECT DISTINCT (year - {an.SHEET_EPOCH}) * {an.ROW_STRIDE}, NULL, year FROM customer_panel WHERE year > 1995)"""


@query(
    "fill_down_section",
    with_ctes(an.CUSTOMER_SQL, SECTIONS_SQL)
    + " SELECT row_idx, locality, CAST(last_value(section IGNORE NULLS) OVER "
    "(ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS section FROM grid",
)
def fill_down_section(spark, sf_dir):
    rows = an.customer_panel(spark, sf_dir)
    start = (F.col("year") - an.SHEET_EPOCH).cast("bigint") * an.ROW_STRIDE
    body = rows.select(
        (start + F.col("locality").cast("bigint") + 1).alias("row_idx"), "locality", F.lit(None).cast("int").alias("section")
    )
    heads = (
        an.table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)))
        .where(F.col("year") > 1995)
        .select(start.alias("row_idx"), F.lit(None).cast("string").alias("locality"), F.col("year").alias("section"))
    )
    return fill_down(body.unionByName(heads), "section")


@query(
    "fill_down_blocks",
    with_ctes(an.CUSTOMER_SQL)
    + f""", grid AS (
  SELECT (year - {an.SHEET_EPOCH}) * {an.ROW_STRIDE} + CAST(locality AS BIGINT) AS row_idx,
         CASE WHEN value >= 3 THEN value END AS section FROM customer_panel)
  SELECT row_idx, last_value(section IGNORE NULLS) OVER
  (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM grid""",
)
def fill_down_blocks(spark, sf_dir):
    """Many section rows: the fill runs block by block."""
    start = (F.col("year") - an.SHEET_EPOCH).cast("bigint") * an.ROW_STRIDE
    rows = an.customer_panel(spark, sf_dir).select(
        (start + F.col("locality").cast("bigint")).alias("row_idx"),
        F.when(F.col("value") >= 3, F.col("value")).alias("section"),
    )
    return fill_down(rows, "section", block_rows=128)


# --- sorts, limits, set operations, reshaping ---------------------------------------------------------


@query(
    "rank_by_score",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, CAST(sum(value) AS BIGINT) AS trend_score FROM customer_panel GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1",
)
def rank_by_score(spark, sf_dir):
    totals = an.customer_panel(spark, sf_dir).groupBy("locality").agg(F.sum("value").alias("trend_score"))
    return clean.rank_by_score(totals)


@query(
    "mixed_sort",
    with_ctes(an.NATION_SQL) + " SELECT * FROM nation_panel ORDER BY locality, year DESC",
)
def mixed_sort(spark, sf_dir):
    return an.nation_panel(spark, sf_dir).orderBy(F.asc("locality"), F.desc("year"))


@query(
    "top_k",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, CAST(sum(value) AS BIGINT) AS trend_score FROM customer_panel GROUP BY 1"
    " ORDER BY 2 DESC NULLS LAST, 1 LIMIT 30",
)
def top_k(spark, sf_dir):
    totals = an.customer_panel(spark, sf_dir).groupBy("locality").agg(F.sum("value").alias("trend_score"))
    return clean.top_k(totals, 30)


@query(
    "union_snapshots",
    with_ctes(an.CUSTOMER_SQL, an.NATION_SQL)
    + " SELECT locality, year, value FROM customer_panel UNION ALL SELECT locality, year, value FROM nation_panel",
)
def union_snapshots(spark, sf_dir):
    return an.customer_panel(spark, sf_dir).unionByName(an.nation_panel(spark, sf_dir))


@query("distinct_values", with_ctes(an.ESTABLISHMENTS_SQL) + " SELECT DISTINCT locality, sector FROM establishments_file")
def distinct_values(spark, sf_dir):
    raw = an.establishments_file(spark, sf_dir).withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)
    return raw.select("locality", "sector").distinct()


@query("unpivot_years", with_ctes(an.BUILDING_SQL) + " SELECT locality, year, value FROM building_panel")
def unpivot_years(spark, sf_dir):
    wide = promote_year_header(an.building_sheet(spark, sf_dir))
    total = wide.where(F.col("type_batiment").endswith("Total"))
    named = total.withColumn("locality", F.concat(F.lit("S"), "code_commune"))
    return clean.unpivot_years(named, ["locality"], year_columns(wide))


@query("building_rows", with_ctes(an.BUILDING_SQL) + " SELECT locality, year, value FROM building_panel")
def building_rows(spark, sf_dir):
    return building_panel(promote_year_header(an.building_sheet(spark, sf_dir)))
