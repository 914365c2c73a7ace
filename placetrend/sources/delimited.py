"""Delimited text with a declared schema: one distributed scan, no inference pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend.storage import replace_partitions, replace_with

SCORE_FILE_SCHEMA = "locality STRING, trend_score STRING"
COUNT_FILE_SCHEMA = "locality STRING, year INT, num_restaurants BIGINT"
ESTABLISHMENT_FILE_SCHEMA = (
    "`Année` INT, `Commune` STRING, `Secteur économique` STRING, "
    "`Etablissements` STRING, `Emplois` STRING"
)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str,
    sep: str = ",",
    encoding: str = "UTF-8",
    glob: str | None = None,
    source_column: str | None = None,
) -> DataFrame:
    """A file, a directory or the files in it that match ``glob``; bad cells raise.

    The header must carry the declared names. ``source_column`` adds the name of the file each row
    came from. Nothing to read is an error, not an empty table.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.csv(path)
    if not df.inputFiles():
        raise ValueError(f"no input file under {path}" + (f" matches {glob}" if glob else ""))
    if source_column is not None:
        df = df.select("*", F.col("_metadata.file_name").alias(source_column))
    return df


def read_establishments(spark: SparkSession, path: str) -> DataFrame:
    """The semicolon-separated Latin-1 file of establishments and jobs; counts stay text."""
    return read_delimited(spark, path, ESTABLISHMENT_FILE_SCHEMA, sep=";", encoding="ISO-8859-1")


def read_with_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose columns are not known beforehand: names from the header, every cell text."""
    return spark.read.option("header", True).csv(path)


def write_delimited(
    df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", check: Callable[[], None] | None = None
) -> None:
    """CSV with a header, written by all tasks in parallel; the folder is created or replaced.

    An earlier result stays until the new one is whole, and if the job or ``check`` fails.
    """
    writer = df.write.option("header", True).option("sep", sep).option("encoding", encoding)
    replace_with(df.sparkSession, path, writer.csv, check)


def write_by_partition(df: DataFrame, path: str, *partitions: str) -> None:
    """CSV folders by the values of ``partitions``; those the table has rows for are replaced, others stay."""
    replace_partitions(df.write.option("header", True).partitionBy(*partitions), path, lambda w, p: w.csv(p))
