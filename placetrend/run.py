"""Jobs from source paths to result paths, for ``spark-submit``.

    spark-submit --py-files placetrend.zip -m placetrend.run third-sector --file F --measure jobs --out O

Results are CSV folders with a header; a second run replaces them, and one that fails leaves them as they
are. Sheets and polygon layers are landed parquet. Tables between stages are deleted at the end.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from placetrend import fixed_values as fv
from placetrend.functions import geo
from placetrend.operators.clean import rank_by_score
from placetrend.plans import building, composite, demography, restaurants, third_sector
from placetrend.sources import delimited, nodes, polygons, scores, sheet
from placetrend.storage import scratch_of_a_job


def _demography(spark, a) -> None:
    segments = demography.population_segments(sheet.tidy_sheet(spark.read.parquet(a.sheet)))
    options = {"min_rows": a.min_rows, "snapshot_year": a.snapshot_year}
    score = demography.demography_detail if a.detail else demography.demography_score
    delimited.write_delimited(rank_by_score(score(segments, **options)), a.out)


def _building(spark, a) -> None:
    wide = sheet.promote_year_header(spark.read.parquet(a.sheet))
    delimited.write_delimited(building.ranked_building(wide, a.type), a.out)


def _restaurant_counts(spark, a) -> None:
    kind = a.node_format or nodes.node_format(spark, a.nodes)
    read = nodes.read_node_table if kind == "parquet" else nodes.read_node_xml
    loaded, check = nodes.watched_snapshots(read(spark, a.nodes, a.snapshot_column))
    layer = polygons.read_polygons(spark, a.polygons)
    project = geo.wgs84_to_lv95_rigorous if a.rigorous else geo.wgs84_to_lv95
    counts = restaurants.restaurant_counts(nodes.amenity_nodes(loaded), layer, a.amenity, project=project)
    delimited.write_delimited(counts, a.out, check=check)


def _restaurant_trend(spark, a) -> None:
    counts = delimited.read_delimited(spark, a.counts, delimited.COUNT_FILE_SCHEMA)
    report = restaurants.restaurant_trend(
        counts, low=a.first_year, high=a.last_year, exclude=a.exclude, min_years=a.min_years
    )
    if a.scores_only:
        report = report.select("locality", "trend_score")
    delimited.write_delimited(report, a.out)
    restaurants.tell_failures(delimited.read_with_header(spark, a.out))


def _third_sector(spark, a) -> None:
    raw = delimited.read_establishments(spark, a.file)
    ranked = third_sector.ranked_third_sector(
        raw, a.measure, last_year=a.last_year, decay=a.decay, prior_weight=a.prior_weight
    )
    delimited.write_delimited(ranked, a.out)


def _scores(spark, a) -> scores.ScoreTables:
    if a.folder:
        return scores.read_score_folder(spark, a.folder, exclude=[a.out])
    return scores.read_score_tables(spark, dict(pair.split("=", 1) for pair in a.scores))


def _normalise(spark, a) -> None:
    tables = _scores(spark, a)
    if tables.names:  # reported otherwise
        delimited.write_by_partition(composite.normalised_tables(tables), a.out, "indicator")


def _final(spark, a) -> None:
    delimited.write_delimited(composite.composite_of_tables(_scores(spark, a)), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="placetrend")
    jobs = top.add_subparsers(required=True)

    def job(name, run, *inputs):
        p = jobs.add_parser(name)
        p.set_defaults(run=run)
        for flag in (*inputs, "--out"):
            p.add_argument(flag, required=True)
        return p

    p = job("demography", _demography, "--sheet")
    p.add_argument("--detail", action="store_true")
    p.add_argument("--min-rows", type=int, default=fv.DEMOGRAPHY_MIN_ROWS)
    p.add_argument("--snapshot-year", type=int, default=fv.DEMOGRAPHY_SNAPSHOT_YEAR)
    p = job("building", _building, "--sheet")
    p.add_argument("--type", default=fv.BUILDING_TYPE)
    p = job("restaurant-counts", _restaurant_counts, "--nodes", "--polygons")
    p.add_argument("--node-format", choices=("parquet", "xml"), help="parquet unless the files are named .osm or .xml")
    p.add_argument("--amenity", default=fv.AMENITY)
    p.add_argument("--snapshot-column")
    p.add_argument("--rigorous", action="store_true", help="project to a centimetre, not to a metre")
    p = job("restaurant-trend", _restaurant_trend, "--counts")
    p.add_argument("--first-year", type=int, default=fv.RESTAURANT_YEAR_MIN)
    p.add_argument("--last-year", type=int, default=fv.RESTAURANT_YEAR_MAX)
    p.add_argument("--exclude", type=int, nargs="*", default=[])
    p.add_argument("--min-years", type=int, default=fv.RESTAURANT_MIN_YEARS)
    p.add_argument("--scores-only", action="store_true")
    p = job("third-sector", _third_sector, "--file")
    p.add_argument("--measure", choices=third_sector.MEASURES, required=True)
    p.add_argument("--last-year", type=int, default=fv.THIRD_SECTOR_LAST_YEAR)
    p.add_argument("--decay", type=float, default=fv.TIME_DECAY)
    p.add_argument("--prior-weight", type=float, default=fv.PRIOR_WEIGHT)
    for name, run in (("normalise", _normalise), ("final", _final)):
        p = job(name, run)
        given = p.add_mutually_exclusive_group(required=True)
        given.add_argument("--scores", nargs="+", metavar="NAME=PATH")
        given.add_argument("--folder", help="every CSV file or folder in it, by its name")
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("placetrend").getOrCreate()
    with scratch_of_a_job(spark):
        a.run(spark, a)


if __name__ == "__main__":
    main()
