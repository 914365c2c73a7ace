"""Types of columns that nobody declared, from all their cells or from the first rows.

Every cell is text. A column's type is the narrowest that takes all its cells, of whole number, number,
truth value, day and text; what each cell allows is found for all columns by one partial aggregate. Empty
cells are missing and allow every type. Cells are then cast strictly: one that breaks the type, which
only rows behind those that were looked at can do, ends the job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend.sources.delimited import read_with_header

#: The lattice, narrowest first, as (type, what a cell looks like). Text takes everything; a whole number is a
#: number too, and no other type is both. Numbers with leading zeros are labels, so they stay text.
KINDS: tuple[tuple[str, str], ...] = (
    ("bigint", r"^[+-]?(0|[1-9][0-9]{0,17})$"),
    ("double", r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"),
    ("boolean", r"^(true|false|True|False|TRUE|FALSE)$"),
    ("date", r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"),
)
TEXT = "string"


def _cell(column: str) -> Column:
    trimmed = F.trim(F.col(f"`{column}`"))
    return F.when(trimmed != "", trimmed)


def column_kinds(df: DataFrame, first_rows: int | None = None) -> dict[str, str]:
    """Column -> type of a table of text columns, from all rows, or the first ``first_rows`` that the reader
    gives. A column without a cell is text."""
    looked_at = df if first_rows is None else df.limit(first_rows)
    tests = []
    for k, name in enumerate(df.columns):
        cell = _cell(name)
        tests.append(F.count(cell).alias(f"n{k}"))
        for kind, pattern in KINDS:
            fits = cell.rlike(pattern)
            if kind == "date":
                fits = F.when(fits, cell.try_cast("date").isNotNull()).otherwise(fits)
            tests.append(F.coalesce(F.bool_and(fits), F.lit(True)).alias(f"{kind}{k}"))
    found = looked_at.agg(*tests).first()
    kinds = {}
    for k, name in enumerate(df.columns):
        fitting = [kind for kind, _ in KINDS if found[f"{kind}{k}"]]
        kinds[name] = fitting[0] if found[f"n{k}"] and fitting else TEXT
    return kinds


def with_kinds(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The columns as the given types; a cell that does not fit raises with its column and its text."""
    patterns = dict(KINDS)

    def typed(name: str, kind: str) -> Column:
        if kind == TEXT:
            return F.col(f"`{name}`").alias(name)
        cell = _cell(name)
        if kind not in patterns:
            return cell.cast(kind).alias(name)
        wrong = F.raise_error(F.concat(F.lit(f"column {name} is {kind}, but a cell is "), cell)).cast(kind)
        return F.when(~cell.rlike(patterns[kind]), wrong).otherwise(cell.cast(kind)).alias(name)

    return df.select(*[typed(name, kinds.get(name, TEXT)) for name in df.columns])


def read_typed(spark: SparkSession, path: str, first_rows: int | None = None, declared: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header, its columns typed; ``declared`` types are taken as they are and not looked for."""
    text = read_with_header(spark, path)
    declared = dict(declared or {})
    open_columns = [c for c in text.columns if c not in declared]
    kinds = column_kinds(text.select(*[f"`{c}`" for c in open_columns]), first_rows) if open_columns else {}
    return with_kinds(text, kinds | declared)

