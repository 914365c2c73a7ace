"""Polygon layers landed as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend.sources.contract import require_columns


def read_polygons(spark: SparkSession, path: str, name: str = "NAME", ring: str = "ring") -> DataFrame:
    """(name, ring): one ring of ``STRUCT<x, y>``, or an array of rings with holes, in LV95."""
    layer = require_columns(spark.read.parquet(path), [name, ring])
    return layer.select(F.col(name).alias("name"), F.col(ring).alias("ring"))
