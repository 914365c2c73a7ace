"""Sources and sinks: each writes a copy of a derived table below the shared folder and reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.catalog import analogues as an
from placetrend.catalog.registry import query, r6, with_ctes
from placetrend.functions.numeric import to_number
from placetrend.functions.text import age_label, year_from_name
from placetrend.operators import panel
from placetrend.operators.profile import column_profile
from placetrend.plans.composite import read_scores
from placetrend.sources import contract, delimited, nodes, scores, sheet, typed
from placetrend.storage import scratch_path, stored_by_key


@query(
    "scan_latin1_csv",
    with_ctes(an.ESTABLISHMENTS_SQL) + " SELECT year, locality, sector, establishments, jobs FROM establishments_file",
)
def scan_latin1_csv(spark, sf_dir):
    path = scratch_path(spark, "establishments")
    delimited.write_delimited(an.establishments_file(spark, sf_dir), path, ";", "ISO-8859-1")
    return delimited.read_establishments(spark, path).withColumnsRenamed(fv.THIRD_SECTOR_COLUMNS)


@query(
    "scan_csv",
    with_ctes(an.CUSTOMER_SQL) + " SELECT locality, year, value AS num_restaurants FROM customer_panel",
)
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "counts")
    counts = an.customer_panel(spark, sf_dir).withColumnRenamed("value", "num_restaurants")
    delimited.write_delimited(counts, path)
    return delimited.read_delimited(spark, path, delimited.COUNT_FILE_SCHEMA)


@query(
    "multi_file_scan",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, year, value AS num_restaurants, TRUE AS from_csv FROM customer_panel",
)
def multi_file_scan(spark, sf_dir):
    path = scratch_path(spark, "many")
    counts = an.customer_panel(spark, sf_dir).withColumnRenamed("value", "num_restaurants")
    delimited.write_delimited(counts.repartition(4, "locality"), path)
    counts.write.mode("append").json(path)  # files of another kind in the same folder are no input
    read = delimited.read_delimited(
        spark, path, delimited.COUNT_FILE_SCHEMA, glob="*.csv", source_column="source"
    )
    return read.withColumn("from_csv", F.col("source").endswith(".csv")).drop("source")


@query(
    "csv_sink_roundtrip",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, round(CAST(avg(value) AS DOUBLE), 6) + 0.0 AS trend_score FROM customer_panel GROUP BY 1",
)
def csv_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scores = an.customer_panel(spark, sf_dir).groupBy("locality").agg(F.avg("value").alias("trend_score"))
    delimited.write_delimited(scores, path)
    back = read_scores(spark, {"score": path})["score"]
    return back.select("locality", r6("trend_score").alias("trend_score"))


YEARLY = ("orders_1996", "orders_1997", "orders_1998")


@query(
    "score_folder_scan",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT 'orders_' || CAST(year AS VARCHAR) AS indicator, locality, CAST(value AS DOUBLE) AS trend_score"
    " FROM customer_panel WHERE year BETWEEN 1996 AND 1998",
)
def score_folder_scan(spark, sf_dir):
    """Score tables of two headers in one folder, beside a table without the columns and one without rows."""
    folder = scratch_path(spark, "score-folder")
    counts = an.customer_panel(spark, sf_dir).select("locality", "year", F.col("value").alias("trend_score"))
    for name in YEARLY:
        own = counts.where(F.col("year") == int(name[-4:]))
        columns = ("locality", "trend_score") if name == YEARLY[0] else ("trend_score", "year", "locality")
        delimited.write_delimited(own.select(*columns), f"{folder}/{name}")
    delimited.write_delimited(counts.groupBy("year").count(), f"{folder}/by_year")
    delimited.write_delimited(counts.where("year < 0").select("locality", "trend_score"), f"{folder}/no_rows")
    return scores.read_score_folder(spark, folder).stacked


@query(
    "csv_sink_replaced",
    with_ctes(an.CUSTOMER_SQL) + " SELECT locality, max(year) AS last_year, count(*) AS n FROM customer_panel GROUP BY 1",
)
def csv_sink_replaced(spark, sf_dir):
    """A result written over an earlier one that it is itself computed from."""
    path = scratch_path(spark, "replaced")
    counts = an.customer_panel(spark, sf_dir)
    delimited.write_delimited(counts, path)
    earlier = delimited.read_delimited(spark, path, "locality STRING, year INT, value BIGINT")
    latest = earlier.groupBy("locality").agg(F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n"))
    delimited.write_delimited(latest, path)
    return delimited.read_delimited(spark, path, "locality STRING, last_year INT, n BIGINT")


@query(
    "partitions_replaced",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT locality, value + CASE WHEN year > 1998 THEN 1 ELSE 0 END AS value, year FROM customer_panel",
)
def partitions_replaced(spark, sf_dir):
    """Years that a second run has rows for are replaced, others stay."""
    path = scratch_path(spark, "partitions")
    counts = an.customer_panel(spark, sf_dir).select("locality", "value", "year")
    delimited.write_by_partition(counts, path, "year")
    delimited.write_by_partition(counts.where("year > 1998").withColumn("value", F.col("value") + 1), path, "year")
    return spark.read.schema("locality STRING, value BIGINT, year INT").option("header", True).csv(path)


@query(
    "typed_csv_scan",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value, value >= 100 AS large, event_type AS kind,"
    " lpad(CAST(user_id AS VARCHAR), 9, '0') AS code FROM events",
)
def typed_csv_scan(spark, sf_dir):
    """A file whose types nobody declared: whole numbers, days, numbers, truth values, text, labels of digits."""
    path = scratch_path(spark, "untyped")
    large = F.when(F.col("value") >= 100, "true").otherwise("False")
    code = F.lpad(F.col("user_id").cast("string"), 9, "0")
    text = an.table(spark, sf_dir, "events").select(
        "event_id", F.to_date("ts").alias("day"), "value", large.alias("large"), F.col("event_type").alias("kind"), code.alias("code")
    )
    delimited.write_delimited(text, path)
    read = typed.read_typed(spark, path)
    return read.withColumn("day", F.date_format("day", "yyyy-MM-dd")).select("event_id", "day", "value", "large", "kind", "code")


CONTRACT = {"orders": ("o_custkey", "o_orderdate"), "lineitem": ("l_orderkey", "l_shipdate"), "customer": ("c_custkey", "no_such_column")}


@query(
    "contract_checks",
    "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
)
def contract_checks(spark, sf_dir):
    """Tables that have their columns are counted; one that lacks a column is logged and left out, and the
    strict check refuses it."""
    tables = {name: an.table(spark, sf_dir, name) for name in CONTRACT}
    met = {}
    for name, needed in CONTRACT.items():
        met |= contract.usable_tables({name: tables[name]}, needed)
    try:
        contract.require_columns(tables["customer"], CONTRACT["customer"])
    except ValueError:
        pass
    else:
        raise AssertionError("a lacking column was not seen")
    counts = [contract.require_columns(df, CONTRACT[n]).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in met.items()]
    return counts[0].unionByName(counts[1])


@query(
    "column_profile",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate((("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"))))
    + ") AS c(position, name, kind), (SELECT count(*) AS n_rows FROM events) JOIN (SELECT 0::BIGINT AS n_missing) ON true",
)
def profile_of_columns(spark, sf_dir):
    return column_profile(an.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))


@query(
    "stored_panel_windows",
    with_ctes(an.CUSTOMER_SQL)
    + " SELECT *, CAST(value - lag(value) OVER w AS DOUBLE) / lag(value) OVER w AS growth,"
    " min(year) OVER (PARTITION BY locality) AS min_year, max(year) OVER (PARTITION BY locality) AS max_year"
    f" FROM customer_panel QUALIFY max(year) OVER (PARTITION BY locality) >= {an.LAST_YEAR}".replace(
        " QUALIFY", " WINDOW w AS (PARTITION BY locality ORDER BY year) QUALIFY"
    ),
)
def stored_panel_windows(spark, sf_dir):
    """Gate, growth and extremes on a panel stored by locality, without an exchange."""
    stored = stored_by_key(an.customer_panel(spark, sf_dir), "panel", "locality", "year")
    grown = panel.yoy_growth(panel.with_group_extremes(panel.recency_gate(stored, an.LAST_YEAR)))
    return grown.select("locality", "year", "value", "growth", "min_year", "max_year")


@query(
    "lenient_score_scan",
    "SELECT CAST(event_id AS VARCHAR) AS locality, CASE WHEN event_type <> 'error' THEN value END AS trend_score FROM events",
)
def lenient_score_scan(spark, sf_dir):
    path = scratch_path(spark, "dirty-scores")
    dirty = an.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("locality"),
        F.when(F.col("event_type") == "error", "n.a.").otherwise(F.col("value").cast("string")).alias("trend_score"),
    )
    delimited.write_delimited(dirty, path)
    scanned = delimited.read_delimited(spark, path, delimited.SCORE_FILE_SCHEMA)
    return scanned.withColumn("trend_score", to_number(F.col("trend_score")) + F.lit(0.0))


AGE_COLUMNS = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE age = {a}), 0) AS BIGINT) AS age_{a}" for a in an.AGES
)


@query(
    "tidy_sheet_grid",
    with_ctes(an.AGE_SQL)
    + f" SELECT locality, year, CAST(sum(n) AS BIGINT) AS total, {AGE_COLUMNS} FROM age_counts GROUP BY 1, 2"
    " UNION ALL SELECT '- Total', year, CAST(sum(n) AS BIGINT), "
    + ", ".join("0" for _ in an.AGES) + " FROM age_counts GROUP BY 2",
)
def tidy_sheet_grid(spark, sf_dir):
    tidy = sheet.tidy_sheet(an.population_sheet(spark, sf_dir))
    name = F.regexp_replace("locality", r"^\.+\d+ ", "").alias("locality")
    return tidy.select(
        name,
        "year",
        F.col(f"`{fv.TOTAL_POPULATION}`").alias("total"),
        *[F.coalesce(F.col(f"`{age_label(a)}`"), F.lit(0)).alias(f"age_{a}") for a in an.AGES],
    )


BUILDING_YEARS = ", ".join(
    f"count(*) FILTER (WHERE year(l_shipdate) = {y}) AS n{y}, "
    f"count(*) FILTER (WHERE year(l_shipdate) = {y} AND l_returnflag = 'R') AS r{y}"
    for y in an.YEARS
)


def _building_select(kind: str, prefix: str) -> str:
    years = ", ".join(f'{prefix}{y} AS "{y}"' for y in an.YEARS)
    return (
        f"SELECT CAST(l_suppkey AS VARCHAR) AS code_commune, '......' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')"
        f" || ' S' || CAST(l_suppkey AS VARCHAR) AS nom_commune, '{kind}' AS type_batiment, {years} FROM counts"
    )


@query(
    "promote_year_header",
    f"WITH counts AS (SELECT l_suppkey, {BUILDING_YEARS} FROM lineitem GROUP BY 1) "
    + _building_select(fv.BUILDING_TYPE, "n")
    + " UNION ALL "
    + _building_select("Bâtiments exclusivement à usage d''habitation", "r"),
)
def promote_year_header(spark, sf_dir):
    return sheet.promote_year_header(an.building_sheet(spark, sf_dir))


@query(
    "year_from_filename",
    "SELECT event_id, CAST(2000 + day(ts) AS INT) AS year FROM events WHERE event_type <> 'error'",
)
def year_from_filename(spark, sf_dir):
    stem = F.when(F.col("event_type") == "error", "extract").otherwise("extract-")
    name = F.concat(stem, F.lpad(F.dayofmonth("ts").cast("string"), 2, "0"), F.lit("0101.osm"))
    named = an.table(spark, sf_dir, "events").select("event_id", year_from_name(name).alias("year"))
    return named.where(F.col("year").isNotNull())


@query(
    "node_table_scan",
    with_ctes(an.NODES_SQL)
    + " SELECT id, lat, lon, amenity, name, CAST(2000 + CAST(snapshot[9:10] AS INT) AS INT) AS year"
    " FROM nodes WHERE amenity IS NOT NULL",
)
def node_table_scan(spark, sf_dir):
    path = scratch_path(spark, "node-table")
    an.tagged_nodes(spark, sf_dir).write.partitionBy("snapshot").parquet(path)
    return nodes.amenity_nodes(nodes.checked_snapshots(nodes.read_node_table(spark, path, "snapshot")))


@query(
    "osm_amenity_nodes",
    with_ctes(an.NODES_SQL)
    + " SELECT id, lat, lon, amenity, name, CAST(2000 + CAST(snapshot[9:10] AS INT) AS INT) AS year"
    " FROM nodes WHERE amenity IS NOT NULL",
)
def osm_amenity_nodes(spark, sf_dir):
    path = scratch_path(spark, "nodes")
    tags = F.transform(
        F.map_entries("tags"), lambda t: F.struct(F.lit("").alias("_VALUE"), t["key"].alias("_k"), t["value"].alias("_v"))
    )
    written = an.tagged_nodes(spark, sf_dir).select(
        F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tags.alias("tag"), "snapshot"
    )
    writer = written.write.partitionBy("snapshot").format("xml")
    writer.option("rootTag", "osm").option("rowTag", "node").option("declaration", "").save(path)
    return nodes.amenity_nodes(nodes.read_node_xml(spark, path, snapshot="snapshot"))
