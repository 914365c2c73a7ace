"""Panels, sheets, nodes and polygons that the given tables stand in for.

Every builder derives from whole tables. The SQL next to it defines the same rows as a CTE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.text import age_label
from placetrend.storage import materialise

YEARS = tuple(range(1995, 2002))
LAST_YEAR = YEARS[-1]
AGES = tuple(range(1, 51))
ROW_STRIDE = 1 << 40
SHEET_EPOCH = 1990


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(value: Column | str, values: tuple[int, ...]) -> Column:
    """The value, which must be one of ``values``: a sheet has one column for each."""
    column = F.col(value) if isinstance(value, str) else value
    missing = F.raise_error(F.concat(F.lit("no column for "), column.cast("string"))).cast("int")
    return F.when(column.isin(*values) | column.isNull(), column).otherwise(missing)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


# --- panels -------------------------------------------------------------------------------------

CUSTOMER_SQL = """customer_panel AS (
  SELECT CAST(o_custkey AS VARCHAR) AS locality, CAST(year(o_orderdate) AS INT) AS year,
         count(*) AS value
  FROM orders GROUP BY 1, 2)"""


def _customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer and year: many sparse series."""
    return _customer_years(spark, sf_dir).select(_text("o_custkey").alias("locality"), "year", "value")


NATION_SQL = """nation_panel AS (
  SELECT n_name AS locality, CAST(year(o_orderdate) AS INT) AS year, count(*) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation and year; orders are counted per customer before they meet a join."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counted = _customer_years(spark, sf_dir)
    return (
        counted.join(customers, counted.o_custkey == customers.c_custkey)
        .groupBy("c_nationkey", "year")
        .agg(F.sum("value").alias("value"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("locality"), "year", "value")
    )


PART_SQL = """part_panel AS (
  SELECT CAST(l_partkey AS VARCHAR) AS locality, CAST(year(l_shipdate) AS INT) AS year,
         count(*) FILTER (WHERE l_returnflag = 'R') AS num_restaurants
  FROM lineitem GROUP BY 1, 2)"""


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines per part and year: short count series with zeros."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.year("l_shipdate").alias("year"))
        .agg(F.count_if(F.col("l_returnflag") == "R").alias("num_restaurants"))
        .select(_text("l_partkey").alias("locality"), "year", "num_restaurants")
    )


# --- establishments file ------------------------------------------------------------------------

# Cells this small are published suppressed ('X') or as '0'
SMALL_LINES, TINY_LINES = 22, 18
SMALL_QUANTITY, TINY_QUANTITY = 520, 440

_SECTOR_SQL = """CASE l_returnflag WHEN 'R' THEN 'Secteur primaire' WHEN 'A' THEN 'Secteur secondaire'
  ELSE 'Secteur tertiaire' END"""

ESTABLISHMENTS_SQL = f"""sector_counts AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, l_suppkey, {_SECTOR_SQL} AS sector,
         count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY 1, 2, 3),
sector_cells AS (
  SELECT year, CAST(l_suppkey AS VARCHAR) || ' S' || CAST(l_suppkey AS VARCHAR) AS locality, sector, n, q
  FROM sector_counts
  UNION ALL
  SELECT year, CAST(l_suppkey AS VARCHAR) || ' S' || CAST(l_suppkey AS VARCHAR), 'Secteur - total',
         CAST(sum(n) AS BIGINT), CAST(sum(q) AS BIGINT)
  FROM sector_counts GROUP BY year, l_suppkey
  UNION ALL
  SELECT year, 'Suisse', sector, CAST(sum(n) AS BIGINT), CAST(sum(q) AS BIGINT)
  FROM sector_counts GROUP BY year, sector),
establishments_file AS (
  SELECT year, locality, sector,
         CASE WHEN n < {TINY_LINES} THEN '0' WHEN n < {SMALL_LINES} THEN 'X'
              ELSE CAST(n AS VARCHAR) END AS establishments,
         CASE WHEN q < {TINY_QUANTITY} THEN '0' WHEN q < {SMALL_QUANTITY} THEN 'X'
              ELSE CAST(q AS VARCHAR) END AS jobs
  FROM sector_cells),
sector_rows AS (
  SELECT year, regexp_replace(locality, '^\\d+\\s*', '') AS locality,
         CASE WHEN establishments NOT IN ('X', '0') THEN CAST(establishments AS BIGINT) END AS establishments,
         CASE WHEN jobs NOT IN ('X', '0') THEN CAST(jobs AS BIGINT) END AS jobs
  FROM establishments_file WHERE locality <> 'Suisse' AND sector = 'Secteur tertiaire')"""


def establishments_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantity per supplier, year and sector as the raw file publishes them: text with
    suppressed cells, sector totals and national rows."""
    sector = (
        F.when(F.col("l_returnflag") == "R", "Secteur primaire")
        .when(F.col("l_returnflag") == "A", "Secteur secondaire")
        .otherwise("Secteur tertiaire")
    )
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"), "l_suppkey", sector.alias("sector"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    )
    sets = [
        [F.col("year"), F.col("l_suppkey"), F.col("sector")],
        [F.col("year"), F.col("l_suppkey")],
        [F.col("year"), F.col("sector")],
    ]
    cells = counts.groupingSets(sets, "year", "l_suppkey", "sector").agg(
        F.sum("n").alias("n"), F.sum("q").alias("q")
    )

    def published(value: str, small: int, tiny: int) -> Column:
        v = F.col(value)
        return F.when(v < tiny, "0").when(v < small, "X").otherwise(v.cast("string"))

    supplier = F.concat(_text("l_suppkey"), F.lit(" S"), _text("l_suppkey"))
    return cells.select(
        F.col("year").alias("Année"),
        F.coalesce(supplier, F.lit(fv.NATIONAL_LABEL)).alias("Commune"),
        F.coalesce("sector", F.lit("Secteur - total")).alias("Secteur économique"),
        published("n", SMALL_LINES, TINY_LINES).alias("Etablissements"),
        published("q", SMALL_QUANTITY, TINY_QUANTITY).alias("Emplois"),
    )


# --- population sheet ---------------------------------------------------------------------------

AGE_SQL = """age_counts AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS locality, CAST(year(l_shipdate) AS INT) AS year,
         p_size AS age, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
segments AS (
  SELECT locality, year, CAST(sum(n) AS BIGINT) AS total,
         CAST(coalesce(sum(n) FILTER (WHERE age <= 19), 0) AS BIGINT) AS enfants_0_19,
         CAST(coalesce(sum(n) FILTER (WHERE age BETWEEN 20 AND 34), 0) AS BIGINT) AS jeunes_actifs_20_34,
         CAST(coalesce(sum(n) FILTER (WHERE age BETWEEN 35 AND 49), 0) AS BIGINT) AS actifs_35_49,
         CAST(coalesce(sum(n) FILTER (WHERE age >= 50), 0) AS BIGINT) AS seniors_50_plus
  FROM age_counts GROUP BY 1, 2)"""


def _ages_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, year and one count per age; counted per age first, then pivoted."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", F.year("l_shipdate").alias("year")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", _listed("p_size", AGES).alias("p_size"))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "year")
        .pivot("p_size", list(AGES))
        .agg(F.count(F.lit(1)))
    )


def age_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy population table: year, locality, total and one column per age."""
    wide = _ages_wide(spark, sf_dir)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{a}`"), F.lit(0)) for a in AGES])
    return wide.select(
        "year",
        F.concat(F.lit("S"), _text("l_suppkey")).alias("locality"),
        total.alias(fv.TOTAL_POPULATION),
        *[F.col(f"`{a}`").alias(age_label(a)) for a in AGES],
    )


def _cells(*parts: Column) -> Column:
    return F.array(*[p.cast("string") for p in parts]).alias("cells")


def population_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw sheet, landed: a header row, then per year a section row and its localities."""
    blank = F.lit(None)
    ages = [f"`{age_label(a)}`" for a in AGES]
    header = [None] * fv.SHEET_FIRST_MEASURE_CELL + [fv.TOTAL_POPULATION, *map(age_label, AGES)]
    top = spark.range(1).select(
        F.lit(fv.SHEET_HEADER_ROW).cast("bigint").alias("row_idx"), _cells(*map(F.lit, header))
    )
    start = (F.col("year") - SHEET_EPOCH).cast("bigint") * ROW_STRIDE
    sections = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            start.alias("row_idx"),
            _cells(F.col("year"), blank, blank, F.lit("- Total"), blank, blank, blank, blank, F.col("n")),
        )
    )
    people = age_table(spark, sf_dir)
    key = F.substring("locality", 2, 20).cast("bigint")
    label = F.concat(F.lit("......"), F.lpad(key.cast("string"), 9, "0"), F.lit(" "), F.col("locality"))
    body = people.select(
        (start + key + 1).alias("row_idx"),
        _cells(
            blank, blank, blank, label, blank, blank, blank, blank,
            F.col(f"`{fv.TOTAL_POPULATION}`"), *map(F.col, ages),
        ),
    )
    return materialise(top.unionByName(sections).unionByName(body), "population-sheet")


# --- new-building sheet -------------------------------------------------------------------------

BUILDING_SQL = """building_panel AS (
  SELECT locality, CAST(year AS INT) AS year, coalesce(n, 0) AS value
  FROM (SELECT DISTINCT l_suppkey, 'S' || CAST(l_suppkey AS VARCHAR) AS locality FROM lineitem) s
  CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) y
  LEFT JOIN (SELECT l_suppkey, year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2) c
  USING (l_suppkey, year))"""


def building_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw wide sheet, landed: years in the header row, two building types per locality."""
    blank = F.lit(None)
    header = [None] * fv.BUILDING_FIRST_YEAR_CELL + [str(y) for y in YEARS]
    top = spark.range(1).select(
        F.lit(fv.BUILDING_HEADER_ROW).cast("bigint").alias("row_idx"), _cells(*map(F.lit, header))
    )
    ship_year = _listed(F.year("l_shipdate"), YEARS)
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            *[F.count_if(ship_year == y).alias(f"n{y}") for y in YEARS],
            *[F.count_if((ship_year == y) & (F.col("l_returnflag") == "R")).alias(f"r{y}") for y in YEARS],
        )
    )
    key = _text("l_suppkey")
    name = F.concat(F.lit("......"), F.lpad(key, 9, "0"), F.lit(" S"), key)
    total = _cells(key, name, F.lit(fv.BUILDING_TYPE), *[F.col(f"n{y}") for y in YEARS])
    other = _cells(key, name, F.lit("Bâtiments exclusivement à usage d'habitation"), *[F.col(f"r{y}") for y in YEARS])
    body = counts.select(
        (F.col("l_suppkey") * 2 + 10).alias("_at"), F.posexplode(F.array(total, other)).alias("_i", "cells")
    ).select((F.col("_at") + F.col("_i")).alias("row_idx"), "cells")
    return materialise(top.unionByName(body), "building-sheet")


# --- map nodes and polygons ---------------------------------------------------------------------

NODES_SQL = """nodes AS (
  SELECT event_id AS id, 46.0 + value / 400.0 AS lat, 6.0 + (user_id % 150) / 40.0 AS lon,
         CASE event_type WHEN 'purchase' THEN 'restaurant' WHEN 'view' THEN 'restaurant'
              WHEN 'error' THEN NULL ELSE event_type END AS amenity,
         CASE WHEN value >= 2 THEN 'N' || CAST(event_id AS VARCHAR) END AS name,
         'extract-' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '0101.osm' AS snapshot
  FROM events)"""


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as map nodes: place from user and value, tag from the type, one snapshot per day."""
    kind = F.col("event_type")
    amenity = (
        F.when(kind.isin("purchase", "view"), fv.AMENITY).when(kind != "error", kind)
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (46.0 + F.col("value") / 400.0).alias("lat"),
        (6.0 + (F.col("user_id") % 150) / 40.0).alias("lon"),
        amenity.alias("amenity"),
        F.when(F.col("value") >= 2, F.concat(F.lit("N"), _text("event_id"))).alias("name"),
        F.concat(F.lit("extract-"), F.lpad(F.dayofmonth("ts").cast("string"), 2, "0"), F.lit("0101.osm")).alias("snapshot"),
    )


def tagged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with their tags in a map, as a node source yields them."""
    n = node_table(spark, sf_dir)
    pairs = F.array(
        F.struct(F.lit("amenity").alias("key"), F.col("amenity").alias("value")),
        F.struct(F.lit("name").alias("key"), F.col("name").alias("value")),
    )
    tags = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return n.select("id", "lat", "lon", tags.alias("tags"), "snapshot")


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


HEXAGON_SQL = """hexagons AS (
  SELECT n_name AS name, 2510000.0 + (n_nationkey % 5) * 65000.0 AS cx,
         1110000.0 + (n_nationkey // 5) * 35000.0 AS cy FROM nation)"""
HEXAGON_INSIDE_SQL = "abs(y - cy) < 17000.0 AND abs(x - cx) + abs(y - cy) < 34000.0"


def hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hexagon per nation in LV95 metres; neighbours overlap, some land is uncovered."""
    k = F.col("n_nationkey")
    cx = 2510000.0 + (k % 5) * 65000.0
    cy = 1110000.0 + F.floor(k / 5) * 35000.0
    ring = _ring(
        (cx - 34000, cy), (cx - 17000, cy + 17000), (cx + 17000, cy + 17000),
        (cx + 34000, cy), (cx + 17000, cy - 17000), (cx - 17000, cy - 17000),
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ring.alias("ring"))


HOUSE_SQL = """houses AS (
  SELECT n_name AS name, 15 + 30 * (n_nationkey % 5) AS cx, 50 + 98 * (n_nationkey // 5) AS cy
  FROM nation)"""
HOUSE_INSIDE_SQL = "abs(x - cx) < 15 AND y > cy - 44 AND y < cy + 44.0037 - 1.6 * abs(x - cx)"


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One house-shaped pentagon per nation; side walls are shared and run through points."""
    k = F.col("n_nationkey")
    cx, cy = 15 + 30 * (k % 5), 50 + 98 * F.floor(k / 5)
    ring = _ring(
        (cx - 15, cy - 44), (cx + 15, cy - 44), (cx + 15, cy + F.lit(20.0037)),
        (cx, cy + F.lit(44.0037)), (cx - 15, cy + F.lit(20.0037)),
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ring.alias("ring"))


# Diamonds: a small one per customer, and one per region that holds thousands of them. No sum of
# coordinates of three places comes near their edges.
DIAMOND_SMALL, DIAMOND_GIANT = 0.70013, 40.00013
DIAMOND_SQL = f"""diamonds AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS name, (c_custkey * 7919 % 150000) / 1000.0 AS cx,
         (c_custkey * 104729 % 490000) / 1000.0 AS cy, CAST({DIAMOND_SMALL} AS DOUBLE) AS r FROM customer
  UNION ALL
  SELECT r_name, 20.0 + 25.0 * r_regionkey, 60.0 + 90.0 * r_regionkey, CAST({DIAMOND_GIANT} AS DOUBLE) FROM region)"""
DIAMOND_INSIDE_SQL = "abs(x - cx) + abs(y - cy) < r"


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of very unequal size."""
    k, g = F.col("c_custkey"), F.col("r_regionkey")
    small = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), _text("c_custkey")).alias("name"), ((k * 7919 % 150000) / 1000.0).alias("cx"),
        ((k * 104729 % 490000) / 1000.0).alias("cy"), F.lit(DIAMOND_SMALL).alias("r"),
    )
    giant = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("name"), (20.0 + 25.0 * g).alias("cx"), (60.0 + 90.0 * g).alias("cy"), F.lit(DIAMOND_GIANT).alias("r")
    )
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    return small.unionByName(giant).select("name", _ring((cx - r, cy), (cx, cy + r), (cx + r, cy), (cx, cy - r)).alias("ring"))


POINTS_SQL = """points AS (
  SELECT event_id, CAST(user_id % 150 AS DOUBLE) AS x, value AS y FROM events)"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 150).cast("double").alias("x"), F.col("value").alias("y")
    )


# --- five measures of the same customers ----------------------------------------------------------

FIVE_SQL = """five AS (
  SELECT CAST(o_custkey AS VARCHAR) AS locality, CAST(year(o_orderdate) AS INT) AS year,
         CAST(sum(l_quantity) AS BIGINT) AS jobs, count(DISTINCT l_suppkey) AS establishments,
         count(*) AS total,
         count(*) FILTER (WHERE l_returnflag = 'R') AS num_restaurants,
         count(*) FILTER (WHERE l_returnflag = 'A') AS jeunes_actifs_20_34,
         count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS actifs_35_49,
         count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS seniors_50_plus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
five_segments AS (SELECT *, num_restaurants AS enfants_0_19 FROM five)"""


def five_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly measures of each customer that feed the five indicators.

    The join and aggregate run once; the small panel is written, and each indicator then reads
    only its own columns of it.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    panel = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "year")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("jobs"),
            F.countDistinct("l_suppkey").alias("establishments"),
            F.count(F.lit(1)).alias(fv.TOTAL_POPULATION),
            F.count_if(flag == "R").alias("num_restaurants"),
            F.count_if(flag == "A").alias("jeunes_actifs_20_34"),
            F.count_if((flag == "N") & (status == "F")).alias("actifs_35_49"),
            F.count_if((flag == "N") & (status == "O")).alias("seniors_50_plus"),
        )
        .select(_text("o_custkey").alias("locality"), "*")
        .drop("o_custkey")
        .withColumn("enfants_0_19", F.col("num_restaurants"))
    )
    return materialise(panel, "five-measures")


# --- one row per customer, one column per year -----------------------------------------------------

WIDE_SQL = """customer_wide AS (
  SELECT CAST(o_custkey AS VARCHAR) AS locality,
         nullif(count(*) FILTER (WHERE year(o_orderdate) % 5 = 0), 0) AS third_sector_job_score,
         nullif(count(*) FILTER (WHERE year(o_orderdate) % 5 = 1), 0) AS building_score,
         nullif(count(*) FILTER (WHERE year(o_orderdate) % 5 = 2), 0) AS demographie_score,
         nullif(count(*) FILTER (WHERE year(o_orderdate) % 5 = 3), 0) AS restau_score,
         nullif(count(*) FILTER (WHERE year(o_orderdate) % 5 = 4), 0) AS third_sector_establishment_score
  FROM orders GROUP BY 1)"""


def customer_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the five score names, every fifth year together; NULL for a column without."""
    year = F.year("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            *[
                F.nullif(F.count_if(year % len(fv.COMPOSITE_SCORES) == k), F.lit(0)).alias(name)
                for k, name in enumerate(fv.COMPOSITE_SCORES)
            ]
        )
        .select(_text("o_custkey").alias("locality"), *fv.COMPOSITE_SCORES)
    )
