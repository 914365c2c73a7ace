"""Score files, however many and however mixed: one bad file costs its own scores only.

A census reads the header of every score table, one line of it. Tables with the same header are then one
scan, whose rows are told apart by the file they come from. What cannot be read, is empty or lacks the
score columns is logged, kept in the report, and left out.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Collection, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend.functions.numeric import finite, to_number
from placetrend.sources.contract import lacking_columns
from placetrend.storage import file_system, materialise

log = logging.getLogger(__name__)

SCORE_COLUMNS = ("locality", "trend_score")
STACKED_SCHEMA = "indicator STRING, locality STRING, trend_score DOUBLE"
#: Names of score files in a folder; folders in it are taken for tables of several files.
FILE_PATTERN = r"(.+)\.csv(\.gz|\.bz2)?"
#: A file so named, or a folder that is split by indicator, is a result of the scaling.
OWN_SUFFIX = "_norma"
OWN_PARTITION = "indicator="
#: What a read that fails raises.
FAULTS = (PySparkException, Py4JJavaError)
#: Headers that are read at the same time.
READERS = 8


@dataclass(frozen=True)
class ScoreTables:
    """Scores, one table below the other, and why others are not among them."""

    stacked: DataFrame
    names: list[str]
    left_out: dict[str, str] = field(default_factory=dict)


def _own_result(system, status) -> bool:
    return status.isDirectory() and any(x.getPath().getName().startswith(OWN_PARTITION) for x in system.listStatus(status.getPath()))


def list_scores(spark: SparkSession, folder: str, exclude: Collection[str] = ()) -> dict[str, str]:
    """Name -> path of the score tables in ``folder``: its CSV files, and folders of CSV files.

    Hidden names, names with the suffix of scaled scores, folders that the scaling wrote and the paths
    of ``exclude`` are no input. A name that a file and a folder share is given to neither alone: the
    second keeps its ending.
    """
    system, place = file_system(spark, folder)
    if not system.exists(place):
        raise ValueError(f"there is no folder {folder}")
    apart = {file_system(spark, x)[1].toString() for x in exclude}
    found: dict[str, str] = {}
    for status in sorted(system.listStatus(place), key=lambda s: s.getPath().getName()):
        path = status.getPath()
        full = path.getName()
        match = re.fullmatch(FILE_PATTERN, full)
        name = match[1] if match else full
        if full.startswith(("_", ".")) or path.toString() in apart or name.endswith(OWN_SUFFIX):
            continue
        if status.isDirectory() and not _own_result(system, status) or match and not status.isDirectory():
            found[full if name in found else name] = path.toString()
    return found


def _reader(spark: SparkSession):
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")


def _reason(error: Exception) -> str:
    """What the engine says first, without where it was called from."""
    lines = [x for x in str(error).strip().split("\n") if not x.startswith("An error occurred while calling")]
    return lines[0].strip(": ")[:200] if lines else type(error).__name__


def _header(spark: SparkSession, path: str) -> tuple[list[str] | None, str]:
    """The columns of a table, or why there are none."""
    try:
        system, place = file_system(spark, path)
        statuses = system.globStatus(place)
        if not statuses:
            return None, "there is no such file"
        if not sum(system.getContentSummary(s.getPath()).getLength() for s in statuses):
            return None, "it is empty"
        return _reader(spark).csv(path).columns, ""
    except Exception as error:  # any fault of one table is that table's
        return None, f"its header cannot be read: {_reason(error)}"


def _named(spark: SparkSession, paths: Mapping[str, str]) -> Column:
    """The name of the table that a row's file belongs to."""
    file = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^[^:/]+:(?://[^/]*)?(/.*)$", 1)
    name = None
    for indicator, path in paths.items():
        system, place = file_system(spark, path)
        for status in system.globStatus(place):
            at = status.getPath().toUri().getPath()
            hit = (file == at) | file.startswith(at.rstrip("/") + "/")
            name = F.when(hit, indicator) if name is None else name.when(hit, indicator)
    return name


def _scan(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One scan of tables that have the same header."""
    rows = _reader(spark).csv(list(paths.values()))
    score = finite(to_number(F.col("trend_score"))).alias("trend_score")
    return rows.select(_named(spark, paths).alias("indicator"), "locality", score)


def read_score_tables(
    spark: SparkSession, paths: Mapping[str, str], needed: Iterable[str] = SCORE_COLUMNS, report: Callable[[str], None] = log.warning
) -> ScoreTables:
    """Name -> path of CSV files or folders to their scores, written once and stacked.

    Scores that are no finite number are missing. A scan that fails on one of its tables is repeated
    table by table, so that a file that breaks off costs no other its scores. Every table that is
    left out is reported, and no table at all as well.
    """
    run = inheritable_thread_target(spark)(lambda path: _header(spark, path))
    with ThreadPoolExecutor(READERS) as pool:
        headers = dict(zip(paths, pool.map(run, paths.values()), strict=True))
    left_out: dict[str, str] = {}
    groups: dict[tuple[str, ...], dict[str, str]] = {}
    for name, (columns, fault) in headers.items():
        if columns is None:
            left_out[name] = fault
        elif lacking := lacking_columns(columns, needed):
            left_out[name] = f"it lacks the columns {lacking}"
        else:
            groups.setdefault(tuple(columns), {})[name] = paths[name]
    tables: list[DataFrame] = []
    names: list[str] = []

    def take(group: Mapping[str, str]) -> None:
        tables.append(materialise(_scan(spark, group), "score-tables"))
        names.extend(group)

    for group in groups.values():
        try:
            take(group)
        except FAULTS as error:
            if len(group) == 1:
                left_out |= {name: f"it cannot be read: {_reason(error)}" for name in group}
                continue
            for name, path in group.items():
                try:
                    take({name: path})
                except FAULTS as own:
                    left_out[name] = f"it cannot be read: {_reason(own)}"
    for name, fault in left_out.items():
        report(f"{name} ({paths[name]}) is left out: {fault}")
    if not names:
        report("no score table was found")
    stacked = reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], STACKED_SCHEMA)
    return ScoreTables(stacked, [n for n in paths if n in names], left_out)


def read_score_folder(spark: SparkSession, folder: str, exclude: Collection[str] = (), **options) -> ScoreTables:
    """``read_score_tables`` of all score tables in a folder."""
    return read_score_tables(spark, list_scores(spark, folder, exclude), **options)
