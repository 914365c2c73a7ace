"""Fusion, key-list joins and the spatial join."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.catalog import analogues as an
from placetrend.catalog.registry import query, with_ctes
from placetrend.operators import fuse
from placetrend.operators.panel import excluded_keys, min_rows_gate, min_years_gate, recency_gate
from placetrend.operators.spatial import points_in_polygons

# One order count per customer and score name, each with a different coverage of the customers
COVERAGE_SQL = f"""covered AS (
  SELECT locality, CAST(sum(value) AS BIGINT) AS total, max(value) AS top, min(value) AS low,
         count(*) AS n_years, max(year) AS last_year
  FROM customer_panel GROUP BY 1),
fused AS (
  SELECT locality, total AS third_sector_job_score, j2.top AS building_score, j3.low AS demographie_score,
         j4.n_years AS restau_score, j5.last_year AS third_sector_establishment_score
  FROM (SELECT locality, total FROM covered WHERE last_year >= {an.LAST_YEAR})
  FULL JOIN (SELECT locality, top FROM covered WHERE n_years >= 3) j2 USING (locality)
  FULL JOIN (SELECT locality, low FROM covered WHERE n_years >= 5) j3 USING (locality)
  FULL JOIN (SELECT locality, n_years FROM covered WHERE n_years >= 6) j4 USING (locality)
  FULL JOIN (SELECT locality, last_year FROM covered WHERE n_years < 3) j5 USING (locality))"""


def covered_scores(spark, sf_dir):
    panel = an.customer_panel(spark, sf_dir)

    def score(df, measure):
        return df.groupBy("locality").agg(measure.alias("trend_score"))

    count = F.count(F.lit(1))
    tables = (
        score(recency_gate(panel, an.LAST_YEAR), F.sum("value")),
        score(min_years_gate(panel, 3), F.max("value")),
        score(min_rows_gate(panel, 5), F.min("value")),
        score(min_rows_gate(panel, 6), count),
        score(fuse.anti_join_keys(panel, min_years_gate(panel, 3)), F.max("year")),
    )
    return dict(zip(fv.COMPOSITE_SCORES, tables))


@query("full_outer_fusion", with_ctes(an.CUSTOMER_SQL, COVERAGE_SQL) + " SELECT * FROM fused")
def full_outer_fusion(spark, sf_dir):
    return fuse.full_outer_chain(covered_scores(spark, sf_dir))


@query(
    "one_shuffle_fusion",
    with_ctes(an.CUSTOMER_SQL, COVERAGE_SQL)
    + " SELECT locality, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in fv.COMPOSITE_SCORES) + " FROM fused",
)
def one_shuffle_fusion(spark, sf_dir):
    return fuse.fuse_scores(covered_scores(spark, sf_dir))


@query(
    "anti_join_keys",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT * FROM customer_panel WHERE locality NOT IN"
    " (SELECT locality FROM customer_panel GROUP BY 1 HAVING count(DISTINCT year) < 3)",
)
def anti_join_keys(spark, sf_dir):
    panel = an.customer_panel(spark, sf_dir)
    return fuse.anti_join_keys(panel, excluded_keys(panel, 3))


@query(
    "top_n_series",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT * FROM customer_panel WHERE locality IN (SELECT locality FROM customer_panel GROUP BY 1"
    " ORDER BY sum(value) DESC, locality LIMIT 5)",
)
def top_n_series(spark, sf_dir):
    panel = an.customer_panel(spark, sf_dir)
    scores = panel.groupBy("locality").agg(F.sum("value").alias("trend_score"))
    return fuse.top_n_series(panel, scores, 5)


@query(
    "point_in_polygon",
    with_ctes(an.POINTS_SQL, an.HOUSE_SQL)
    + f" SELECT event_id, x, y, name FROM points LEFT JOIN houses ON {an.HOUSE_INSIDE_SQL}",
)
def point_in_polygon(spark, sf_dir):
    return points_in_polygons(an.event_points(spark, sf_dir), an.houses(spark, sf_dir))


@query(
    "point_in_polygon_shuffled",
    with_ctes(an.POINTS_SQL, an.HOUSE_SQL)
    + f" SELECT event_id, x, y, name FROM points LEFT JOIN houses ON {an.HOUSE_INSIDE_SQL}",
)
def point_in_polygon_shuffled(spark, sf_dir):
    """The same join as it runs when the polygons are too large to broadcast."""
    return points_in_polygons(an.event_points(spark, sf_dir), an.houses(spark, sf_dir), strategy="merge")


@query(
    "point_in_uneven_polygons",
    with_ctes(an.POINTS_SQL, an.DIAMOND_SQL)
    + f" SELECT event_id, x, y, name FROM points LEFT JOIN diamonds ON {an.DIAMOND_INSIDE_SQL}",
)
def point_in_uneven_polygons(spark, sf_dir):
    """Thousands of small polygons among giants: the cells are split where many meet."""
    return points_in_polygons(an.event_points(spark, sf_dir), an.diamonds(spark, sf_dir))
