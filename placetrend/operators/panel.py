"""Yearly panels: one row per (locality, year).

``to_panel`` establishes that contract with a pre-aggregated group-by, which spreads a hot
locality over all map tasks. From there on a locality owns at most one row per calendar year, so
the windows below can never gather an unbounded group in one task, however skewed the raw rows are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetrend.functions.numeric import growth_rate, ratio

KEY, YEAR, VALUE = "locality", "year", "value"


def to_panel(
    df: DataFrame,
    values: Sequence[str] = (VALUE,),
    key: str = KEY,
    year: str = YEAR,
    duplicates: str = "sum",
    rows: str | None = None,
) -> DataFrame:
    """One row per (locality, year); rows without a locality are dropped.

    Several rows for one locality and year are added up, and a total with an unknown part is
    unknown. ``duplicates="reject"`` raises instead. ``rows`` names a column for the row count.
    """
    if duplicates not in ("sum", "reject"):
        raise ValueError(f"duplicates must be 'sum' or 'reject', not {duplicates!r}")
    one = F.count(F.lit(1))
    aggregates = []
    for name in values:
        total = F.when(F.count(name) == one, F.sum(name))
        if duplicates == "reject":
            message = F.lit(f"more than one row per {key} and {year}")
            total = F.when(one > 1, F.raise_error(message)).otherwise(total)
        aggregates.append(total.alias(name))
    if rows is not None:
        aggregates.append(one.alias(rows))
    return df.where(F.col(key).isNotNull()).groupBy(key, year).agg(*aggregates)


def _series(key: str, year: str):
    return Window.partitionBy(key).orderBy(year)


def _whole(key: str):
    return Window.partitionBy(key)


# --- gates: keep or drop whole series -----------------------------------------------------------


def _gate(panel: DataFrame, measure: Column, keep) -> DataFrame:
    return panel.withColumn("_gate", measure).where(keep(F.col("_gate"))).drop("_gate")


def min_rows_gate(
    panel: DataFrame, min_rows: int, rows: str | None = None, key: str = KEY
) -> DataFrame:
    """Series with at least ``min_rows`` rows; ``rows`` holds the raw rows behind a panel row."""
    counted = F.sum(rows) if rows else F.count(F.lit(1))
    return _gate(panel, counted.over(_whole(key)), lambda n: n >= min_rows)


def min_years_gate(panel: DataFrame, min_years: int, key: str = KEY, year: str = YEAR) -> DataFrame:
    """Series with at least ``min_years`` distinct years, of a panel or of raw rows."""
    return _gate(panel, F.size(F.collect_set(year).over(_whole(key))), lambda n: n >= min_years)


def recency_gate(panel: DataFrame, last_year: int, key: str = KEY, year: str = YEAR) -> DataFrame:
    """Series whose latest year is ``last_year`` or later."""
    return _gate(panel, F.max(year).over(_whole(key)), lambda y: y >= last_year)


def excluded_keys(panel: DataFrame, min_years: int, key: str = KEY, year: str = YEAR) -> DataFrame:
    """Localities that ``min_years_gate`` drops, with their distinct years."""
    counted = panel.groupBy(key).agg(F.count_distinct(year).alias("n_years"))
    return counted.where(F.col("n_years") < min_years)


def _once_a_year(value: Column, key: str, year: str) -> Column:
    """The value of a row whose year is not that of the row before it in the series."""
    again = F.lag(year).over(_series(key, year)).eqNullSafe(F.col(year)) & F.col(year).isNotNull()
    message = F.concat(F.lit(f"a {key} has more than one row of the {year} "), F.col(year).cast("string"))
    return F.when(again, F.raise_error(message).cast("double")).otherwise(value)


# --- windows along a series ---------------------------------------------------------------------


def with_previous(
    panel: DataFrame, value: str = VALUE, out: str = "previous", key: str = KEY, year: str = YEAR
) -> DataFrame:
    """Value of the previous row of the series, whatever year that is."""
    return panel.withColumn(out, F.lag(value).over(_series(key, year)))


def yoy_growth(
    panel: DataFrame, value: str = VALUE, out: str = "growth", key: str = KEY, year: str = YEAR
) -> DataFrame:
    """Relative growth over the previous row; the first row of a series has none, and a year on two rows
    of one series raises: which of them comes first is not known (``to_panel`` merges them)."""
    stepped = with_previous(panel, value, "_previous", key, year)
    growth = growth_rate(F.col(value), F.col("_previous"))
    return stepped.withColumn(out, _once_a_year(growth, key, year)).drop("_previous")


def drop_first_obs(panel: DataFrame, key: str = KEY, year: str = YEAR) -> DataFrame:
    return _gate(panel, F.min(year).over(_whole(key)), lambda first: F.col(year) > first)


def with_group_extremes(panel: DataFrame, key: str = KEY, year: str = YEAR) -> DataFrame:
    """First and last year of the series on each of its rows."""
    return panel.withColumns(
        {"min_year": F.min(year).over(_whole(key)), "max_year": F.max(year).over(_whole(key))}
    )


def with_row_ranks(panel: DataFrame, key: str = KEY, year: str = YEAR) -> DataFrame:
    """Position of a row from the start and from the end, and the length of its series."""
    ranked = panel.withColumns(
        {
            "from_start": F.row_number().over(_series(key, year)),
            "n_obs": F.count(F.lit(1)).over(_whole(key)),
        }
    )
    return ranked.withColumn("from_end", F.col("n_obs") - F.col("from_start") + 1)


def interpolate_gaps(
    panel: DataFrame, value: str = VALUE, key: str = KEY, year: str = YEAR
) -> DataFrame:
    """Fill inner gaps on a straight line by row position; gaps at either end stay.

    Years are not weighted and no row is added. The result is DOUBLE. A year on two rows of one series
    raises, as for growth.
    """
    along = _series(key, year)
    before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    number = F.col(value).cast("double")
    placed = panel.withColumn("_at", F.row_number().over(along))
    known = F.when(F.col(value).isNotNull(), F.struct("_at", number.alias("v")))
    framed = placed.withColumns(
        {
            "_lo": F.last(known, ignorenulls=True).over(before),
            "_hi": F.first(known, ignorenulls=True).over(after),
        }
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    line = lo["v"] + ratio((hi["v"] - lo["v"]) * (F.col("_at") - lo["_at"]), hi["_at"] - lo["_at"])
    return framed.withColumn(value, _once_a_year(F.coalesce(number, line), key, year)).drop("_at", "_lo", "_hi")
