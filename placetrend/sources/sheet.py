"""Statistical sheets landed as a grid ``(row_idx BIGINT, cells ARRAY<STRING>)``.

``row_idx`` is the sheet row, given at ingestion. The one header row is read on the driver (its
length is the sheet's width); the body is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import strict
from placetrend.functions.text import is_year_cell

FILL_BLOCK_ROWS = 1 << 16
FILL_LEVELS = 2


def header_cells(grid: DataFrame, row: int) -> list[str | None]:
    found = grid.where(F.col("row_idx") == row).select("cells").first()
    if found is None:
        raise ValueError(f"the sheet has no row {row}")
    return list(found.cells)


def _value_before(df: DataFrame, order: str, value: str, out: str, block_rows: int, levels: int) -> DataFrame:
    """Last non-null value in earlier rows, by blocks of consecutive rows.

    A window covers one block only. What a block inherits comes from a table with one row per
    block, filled the same way one level up; after ``levels`` rounds that table has
    rows / block_rows^levels rows, few enough for a single task.
    """
    before = (Window.unboundedPreceding, -1)
    if levels == 0:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.orderBy(order).rowsBetween(*before)))
    block = f"_block{levels}"
    blocked = df.withColumn(block, F.floor(F.col(order) / block_rows).cast("bigint"))
    last_seen = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    ends = blocked.groupBy(block).agg(last_seen.alias("_end"))
    inherited = _value_before(ends, block, "_end", f"_from{levels}", block_rows, levels - 1)
    inside = Window.partitionBy(block).orderBy(order).rowsBetween(*before)
    return (
        blocked.join(inherited.select(block, f"_from{levels}"), block)
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), f"_from{levels}"))
        .drop(block, f"_from{levels}")
    )


def fill_down(
    df: DataFrame,
    value: str,
    order: str = "row_idx",
    block_rows: int = FILL_BLOCK_ROWS,
    levels: int = FILL_LEVELS,
) -> DataFrame:
    """Replace NULL by the last value above, block by block; ``order`` must be unique."""
    seen = _value_before(df, order, value, "_above", block_rows, levels)
    return seen.withColumn(value, F.coalesce(value, "_above")).drop("_above")


def tidy_sheet(
    grid: DataFrame,
    header_row: int = fv.SHEET_HEADER_ROW,
    year_cell: int = fv.SHEET_YEAR_CELL,
    locality_cell: int = fv.SHEET_LOCALITY_CELL,
    first_measure: int = fv.SHEET_FIRST_MEASURE_CELL,
    block_rows: int = FILL_BLOCK_ROWS,
) -> DataFrame:
    """Sheet with year sections -> (year, locality, one BIGINT column per measure).

    Rows above the first year and rows without a locality are dropped. Named measures take the
    cells from ``first_measure`` on in header order; short rows are padded with NULL.
    """
    names = [h for h in header_cells(grid, header_row)[first_measure:] if h]
    cell = F.col("cells")
    year = F.get(cell, F.lit(year_cell))
    body = grid.where(F.col("row_idx") > header_row).withColumn("_year", F.when(is_year_cell(year), year))
    label = F.get(cell, F.lit(locality_cell))
    measures = [
        strict(F.get(cell, F.lit(first_measure + i)), "bigint").alias(n) for i, n in enumerate(names)
    ]
    return (
        fill_down(body, "_year", block_rows=block_rows)
        .where(F.col("_year").isNotNull() & (label != ""))
        .select(F.col("_year").cast("int").alias("year"), label.alias("locality"), *measures)
    )


def promote_year_header(
    grid: DataFrame,
    header_row: int = fv.BUILDING_HEADER_ROW,
    first_year: int = fv.BUILDING_FIRST_YEAR_CELL,
    ids: tuple[str, ...] = fv.BUILDING_ID_COLUMNS,
) -> DataFrame:
    """Sheet whose header row holds years -> id columns plus one BIGINT column per year."""
    years = [str(int(y)) for y in header_cells(grid, header_row)[first_year:]]
    cell = F.col("cells")
    return grid.where(F.col("row_idx") > header_row).select(
        *[F.get(cell, F.lit(i)).alias(name) for i, name in enumerate(ids)],
        *[strict(F.get(cell, F.lit(first_year + i)), "bigint").alias(y) for i, y in enumerate(years)],
    )


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.isdigit()]
