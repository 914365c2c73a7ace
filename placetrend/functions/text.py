"""Text cleaning of locality labels, sector names and suppressed cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import strict


def strip_dotted_code(label: Column) -> Column:
    """``......0001 Name`` -> ``Name``."""
    return F.regexp_replace(label, fv.DOTTED_CODE_PATTERN, "")


def strip_numeric_code(label: Column) -> Column:
    """``261 Name`` -> ``Name``."""
    return F.regexp_replace(label, fv.NUMERIC_CODE_PATTERN, "")


def is_aggregate_label(label: Column, prefixes: Sequence[str] = fv.AGGREGATE_PREFIXES) -> Column:
    """True for labels of regions, districts and other groups of localities."""
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | label.startswith(prefix)
    return hit


def sentinel_to_null(
    cell: Column, sentinels: Sequence[str] = fv.SUPPRESSION_SENTINELS, to: str = "bigint"
) -> Column:
    """Suppressed cells become NULL, the rest is cast strictly (junk raises)."""
    return strict(F.when(~cell.isin(*sentinels), cell), to)


def map_labels(label: Column, codes: Mapping[str, int] = fv.SECTOR_CODES) -> Column:
    """Label -> TINYINT code. An unknown label must itself be a number, or the cast raises."""
    mapped = None
    for text, code in codes.items():
        hit = label == text
        value = F.lit(code).cast("tinyint")
        mapped = F.when(hit, value) if mapped is None else mapped.when(hit, value)
    return mapped.otherwise(strict(label, "tinyint"))


def year_from_name(name: Column) -> Column:
    """Year of a snapshot from the first ``-NN`` in its name; NULL if there is none."""
    digits = F.regexp_extract(name, fv.SNAPSHOT_YEAR_PATTERN, 1)
    return F.when(digits != "", F.lit(2000) + digits.cast("int"))


def is_year_cell(cell: Column) -> Column:
    """True for a cell of exactly four digits."""
    return (F.length(cell) == 4) & cell.rlike("^[0-9]{4}$")


def age_label(age: int) -> str:
    """Header of the column that counts people of one age."""
    return f"{age} an" if age <= 1 else f"{age} ans"
