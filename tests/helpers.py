"""Small helpers shared by the tests."""

from __future__ import annotations


def frame(spark, schema: str, rows):
    return spark.createDataFrame(list(rows), schema)


def table(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is None, v) for v in t))


def by_key(df, key="locality"):
    return {r[key]: r for r in df.collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
