"""Row and column cleaning on messy statistical tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import null_safe_sum, plain_sum
from placetrend.functions.text import age_label, is_aggregate_label


def normalise_header(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def drop_aggregate_rows(
    df: DataFrame,
    column: str = "locality",
    prefixes: Sequence[str] = fv.AGGREGATE_PREFIXES,
    national: str | None = None,
) -> DataFrame:
    """Drop rows that stand for a group of localities, and the national row if it is named."""
    keep = ~is_aggregate_label(F.col(column), prefixes)
    if national is not None:
        keep = keep & (F.col(column) != national)
    return df.where(keep)


def year_range(
    df: DataFrame,
    low: int = fv.RESTAURANT_YEAR_MIN,
    high: int = fv.RESTAURANT_YEAR_MAX,
    exclude: Sequence[int] = (),
    year: str = "year",
) -> DataFrame:
    """Keep low..high inclusive, less the excluded years."""
    keep = F.col(year).between(low, high)
    if exclude:
        keep = keep & ~F.col(year).isin(*exclude)
    return df.where(keep)


def nonnegative(df: DataFrame, value: str = "value") -> DataFrame:
    """Keep values of at least zero; missing values go too."""
    return df.where(F.col(value) >= 0)


def segment_sums(
    df: DataFrame, segments: Mapping[str, tuple[int, int]] = fv.AGE_SEGMENTS
) -> DataFrame:
    """One total per age segment over the age columns that exist; NULL counts as 0."""
    present = set(df.columns)
    totals = {
        name: null_safe_sum(
            F.col(f"`{label}`") for label in map(age_label, range(first, last + 1)) if label in present
        )
        for name, (first, last) in segments.items()
    }
    return df.withColumns(totals)


def unpivot_years(
    df: DataFrame, ids: Sequence[str], years: Sequence[str], year: str = "year", value: str = "value"
) -> DataFrame:
    """Wide year columns -> long rows; empty cells stay as rows."""
    long = df.unpivot(list(ids), list(years), year, value)
    return long.withColumn(year, F.col(year).cast("int"))


def total_score(
    df: DataFrame, scores: Sequence[str] = fv.COMPOSITE_SCORES, out: str = "total"
) -> DataFrame:
    """Missing scores count as 0, then all are added up."""
    return df.fillna(0.0, subset=list(scores)).withColumn(out, plain_sum(scores))


def rank_by_score(df: DataFrame, score: str = "trend_score", key: str = "locality") -> DataFrame:
    """Best first, missing last, ties in key order."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(key))


def top_k(df: DataFrame, k: int, score: str = "trend_score", key: str = "locality") -> DataFrame:
    return rank_by_score(df, score, key).limit(k)
