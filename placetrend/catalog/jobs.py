"""The end-to-end jobs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from placetrend import fixed_values as fv
from placetrend.catalog import analogues as an
from placetrend.catalog import oracle_parts as op
from placetrend.catalog.cleaning import EAST_SQL, NORTH_SQL
from placetrend.catalog.registry import q6, query, rounded, with_ctes
from placetrend.catalog.trends import POISSON_NUMBERS, POISSON_SQL, REPORT_COLUMNS, SERIES
from placetrend.operators.panel import to_panel
from placetrend.plans import building, composite, demography, restaurants, third_sector
from placetrend.sources.nodes import amenity_nodes
from placetrend.sources.polygons import read_polygons
from placetrend.sources.sheet import promote_year_header, tidy_sheet
from placetrend.storage import scratch_path

SCORE = f" SELECT locality, {q6('trend_score')} AS trend_score FROM s"


@query("demography_score", with_ctes(an.AGE_SQL, op.demography("segments", "s")) + SCORE)
def demography_score(spark, sf_dir):
    sheet = tidy_sheet(an.population_sheet(spark, sf_dir))
    return rounded(demography.ranked_demography(sheet, snapshot_year=an.LAST_YEAR), "trend_score")


DETAIL_SLOPES = ", ".join(f"{q6(n)} AS {n}" for n, _, _ in op.SLOPES)


@query(
    "demography_detail",
    with_ctes(an.AGE_SQL, op.demography("segments", "s"))
    + f" SELECT locality, {q6('trend_score')} AS trend_score, {DETAIL_SLOPES}, total AS pop_totale_2001,"
    " jeunes_actifs_20_34 AS jeunes_actifs_2001, "
    + q6("100.0 * (jeunes_actifs_20_34 + actifs_35_49) / nullif(total, 0)") + " AS ratio_attractivite_2001"
    f" FROM s JOIN s_sl USING (locality) LEFT JOIN (SELECT * FROM segments WHERE year = {an.LAST_YEAR}) USING (locality)",
)
def demography_detail(spark, sf_dir):
    sheet = tidy_sheet(an.population_sheet(spark, sf_dir))
    segments = demography.population_segments(sheet)
    detail = demography.demography_detail(segments, snapshot_year=an.LAST_YEAR)
    return rounded(detail, "trend_score", *demography.SLOPE_OF, "ratio_attractivite_2001")


@query("building_score", with_ctes(an.BUILDING_SQL, op.building("building_panel", "s")) + SCORE)
def building_score(spark, sf_dir):
    wide = promote_year_header(an.building_sheet(spark, sf_dir))
    return rounded(building.ranked_building(wide), "trend_score")


COUNTS_SQL = with_ctes(
    an.NODES_SQL,
    an.HEXAGON_SQL,
    "kept AS (SELECT * FROM nodes WHERE amenity = 'restaurant' AND name IS NOT NULL)",
    f"placed AS (SELECT CAST(2000 + CAST(snapshot[9:10] AS INT) AS INT) AS year, {EAST_SQL} AS x, {NORTH_SQL} AS y"
    " FROM kept)",
) + (
    " SELECT name AS locality, year, count(*) AS num_restaurants"
    f" FROM placed JOIN hexagons ON {an.HEXAGON_INSIDE_SQL} GROUP BY 1, 2 ORDER BY 1, 2 DESC"
)


@query("restaurant_counts", COUNTS_SQL)
def restaurant_counts(spark, sf_dir):
    nodes = amenity_nodes(an.tagged_nodes(spark, sf_dir))
    return restaurants.restaurant_counts(nodes, an.hexagons(spark, sf_dir))


@query("restaurant_counts_layer", COUNTS_SQL)
def restaurant_counts_layer(spark, sf_dir):
    """The same job on a polygon layer read from parquet."""
    path = scratch_path(spark, "polygon-layer")
    an.hexagons(spark, sf_dir).withColumnRenamed("name", "NAME").write.parquet(path)
    return restaurants.restaurant_counts(amenity_nodes(an.tagged_nodes(spark, sf_dir)), read_polygons(spark, path))


@query("restaurant_counts_shuffled", COUNTS_SQL)
def restaurant_counts_shuffled(spark, sf_dir):
    """The same job as it runs when the polygons are too large to broadcast."""
    nodes = amenity_nodes(an.tagged_nodes(spark, sf_dir))
    return restaurants.restaurant_counts(nodes, an.hexagons(spark, sf_dir), strategy="merge")


@query("restaurant_trend", with_ctes(*POISSON_SQL) + f" SELECT {REPORT_COLUMNS} FROM p")
def restaurant_trend(spark, sf_dir):
    return rounded(restaurants.restaurant_trend(an.part_panel(spark, sf_dir), **SERIES), *POISSON_NUMBERS)


@query(
    "restaurant_score",
    with_ctes(*POISSON_SQL) + f" SELECT locality, {q6('trend_score')} AS trend_score FROM p",
)
def restaurant_score(spark, sf_dir):
    return rounded(restaurants.restaurant_score(an.part_panel(spark, sf_dir), **SERIES), "trend_score")


def _third_sector(spark, sf_dir, measure: str) -> DataFrame:
    raw = an.establishments_file(spark, sf_dir)
    return rounded(third_sector.ranked_third_sector(raw, measure, last_year=an.LAST_YEAR), "trend_score")


@query(
    "third_sector_jobs_score",
    with_ctes(an.ESTABLISHMENTS_SQL, op.bayes("sector_rows", "jobs", "s", an.LAST_YEAR)) + SCORE,
)
def third_sector_jobs_score(spark, sf_dir):
    return _third_sector(spark, sf_dir, "jobs")


@query(
    "third_sector_estab_score",
    with_ctes(an.ESTABLISHMENTS_SQL, op.bayes("sector_rows", "establishments", "s", an.LAST_YEAR)) + SCORE,
)
def third_sector_estab_score(spark, sf_dir):
    return _third_sector(spark, sf_dir, "establishments")


# --- the five indicators on the same customers ------------------------------------------------------


def five_scores(spark, sf_dir) -> dict[str, DataFrame]:
    """The five indicators do not depend on each other, so their jobs are submitted side by side."""
    five = an.five_measures(spark, sf_dir)
    makers = {
        "third_sector_job_score": lambda: third_sector.third_sector_score(five, "jobs", last_year=an.LAST_YEAR),
        "building_score": lambda: building.building_score(to_panel(an.customer_panel(spark, sf_dir))),
        "demographie_score": lambda: demography.demography_score(five, snapshot_year=an.LAST_YEAR),
        "restau_score": lambda: restaurants.restaurant_score(five, **SERIES),
        "third_sector_establishment_score": lambda: third_sector.third_sector_score(
            five, "establishments", last_year=an.LAST_YEAR
        ),
    }
    run = inheritable_thread_target(spark)(lambda make: make())
    with ThreadPoolExecutor(len(makers)) as pool:
        return dict(zip(makers, pool.map(run, makers.values())))


SOURCES = {
    "third_sector_job_score": op.bayes("five", "jobs", "s1", an.LAST_YEAR),
    "building_score": op.building("customer_panel", "s2"),
    "demographie_score": op.demography("five_segments", "s3"),
    "restau_score": "five_kept AS (SELECT * FROM five WHERE locality IN"
    " (SELECT locality FROM five GROUP BY 1 HAVING count(DISTINCT year) >= 3)),\n"
    + op.poisson("five_kept", "num_restaurants", "s4"),
    "third_sector_establishment_score": op.bayes("five", "establishments", "s5", an.LAST_YEAR),
}
SCALED = [op.sign_scale(f"s{i}", f"z{i}") for i in range(1, 6)]
FIVE_CTES = (an.CUSTOMER_SQL, an.FIVE_SQL, *SOURCES.values(), *SCALED)


@query(
    "normalised_scores",
    with_ctes(*FIVE_CTES)
    + " UNION ALL ".join(
        f" SELECT '{name}' AS indicator, locality, {q6('trend_score')} AS trend_score FROM z{i}"
        for i, name in enumerate(SOURCES, 1)
    ),
)
def normalised_scores(spark, sf_dir):
    return rounded(composite.normalised_scores(five_scores(spark, sf_dir)), "trend_score")


FUSED_SQL = "fused AS (SELECT locality, " + ", ".join(
    f"coalesce(z{i}.trend_score, 0) AS {name}" for i, name in enumerate(SOURCES, 1)
) + " FROM z1 FULL JOIN z2 USING (locality) FULL JOIN z3 USING (locality) FULL JOIN z4 USING (locality)" + (
    " FULL JOIN z5 USING (locality))"
)


@query(
    "composite_score",
    with_ctes(*FIVE_CTES, FUSED_SQL)
    + " SELECT locality AS commune, "
    + ", ".join(f"{q6(n)} AS {n}" for n in fv.COMPOSITE_SCORES)
    + ", " + q6(" + ".join(fv.COMPOSITE_SCORES)) + " AS total FROM fused ORDER BY total DESC, commune",
)
def composite_score(spark, sf_dir):
    ranked = composite.composite_score(five_scores(spark, sf_dir))
    return rounded(ranked, *fv.COMPOSITE_SCORES, "total")
