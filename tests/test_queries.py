"""Every registered query against its SQL, the shape of the plans, and a hot key."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placetrend.catalog import analogues, registry
from placetrend.operators import panel
from placetrend.operators.fuse import fuse_scores
from placetrend.operators.poisson import poisson_trend, significant
from placetrend.plans import third_sector
from tests.helpers import plan_of
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

# the corpus operators have tests of their own
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
JOBS = (
    "demography_score", "building_score", "restaurant_counts", "restaurant_trend",
    "third_sector_jobs_score", "third_sector_estab_score", "normalised_scores", "composite_score",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", JOBS)
def test_jobs_stay_in_the_jvm_and_never_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


@pytest.mark.parametrize("name", ["zscore", "minmax_scale", "sign_preserving_scale", "bayes_shrinkage", "global_scalar_broadcast"])
def test_global_statistics_move_only_partial_aggregates(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    singles = re.findall(r"Exchange SinglePartition.*\n(.*)", plan)
    assert singles, "the statistic needs one final aggregate"
    assert all("HashAggregate(keys=[]" in below for below in singles), singles


def exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_windows_of_a_series_share_one_shuffle(spark):
    rows = spark.range(1000).select(
        (F.col("id") % 50).cast("string").alias("locality"), (2000 + F.col("id") % 20).cast("int").alias("year"),
        F.col("id").alias("jobs"),
    )
    growth = third_sector.growth_panel(third_sector.filled_panel(rows, "jobs", 2001), "jobs")
    assert exchanges(plan_of(growth)) == 2  # the panel's own, then one on the locality


def test_small_polygons_leave_the_points_where_they_are(spark):
    plan = plan_of(QUERIES["point_in_polygon"](spark, SF_DIR))
    assert "BroadcastHashJoin" in plan and exchanges(plan) == 0


def test_large_polygons_meet_points_in_a_merge_join(spark):
    plan = plan_of(QUERIES["point_in_polygon_shuffled"](spark, SF_DIR))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert re.search(r"Exchange hashpartitioning\(_px#\S+ _py#", plan)


def test_a_filter_on_the_report_does_not_repeat_the_fit(spark):
    rows = spark.range(30).select(
        (F.col("id") % 3).cast("string").alias("locality"), (2011 + F.col("id") % 10).cast("int").alias("year"),
        (F.col("id") * 7 % 11).alias("value"),
    )
    plan = significant(poisson_trend(rows))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("lambdafunction" in line for line in filters)


def test_fusion_needs_one_shuffle_of_scores(spark):
    tables = {n: spark.range(10).select(F.col("id").cast("string").alias("locality"), F.lit(1.0).alias("trend_score")) for n in "abc"}
    assert exchanges(plan_of(fuse_scores(tables))) == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["nonnegative_guard"](spark, SF_DIR))
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_a_hot_locality_is_combined_before_it_is_shuffled(spark):
    """A third of all rows belongs to one locality: its panel rows stay bounded by the years."""
    rows = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1000).cast("string")).alias("locality"),
        (2011 + F.col("id") % 7).cast("int").alias("year"),
        F.lit(1).cast("bigint").alias("value"),
    )
    plan = plan_of(panel.to_panel(rows))
    assert re.search(r"HashAggregate\(keys=\[locality.*partial_sum", plan)
    counted = panel.to_panel(rows)
    hot = counted.where(F.col("locality") == "hot").agg(F.count("*"), F.sum("value")).first()
    assert tuple(hot) == (7, 100_000)
    assert poisson_trend(counted).where(F.col("locality") == "hot").first().n_obs == 7


def test_every_query_has_sql_and_reads_the_tables(spark, monkeypatch):
    assert set(QUERIES) == set(ORACLE)
    read = []
    original = analogues.table
    monkeypatch.setattr(analogues, "table", lambda s, d, n: read.append(n) or original(s, d, n))
    for name, fn in QUERIES.items():
        read.clear()
        fn(spark, SF_DIR)
        assert read, name


@pytest.mark.parametrize("name", ["fit_failures", "restaurant_counts_layer", "node_table_scan"])
def test_checks_compare_rows(con, name):
    assert con.sql(f"SELECT count(*) FROM ({ORACLE[name].rstrip(';')})").limit(1).fetchall()[0][0] > 0
