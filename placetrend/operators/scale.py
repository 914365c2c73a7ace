"""Scaling against the whole table.

A global statistic enters as a one-row scalar subquery: it is computed from partial aggregates,
reuses the shuffle of the table it describes, and is inlined as a literal. No row is moved to a
single partition and nothing is cross joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import finite, ratio
from placetrend.operators.panel import KEY


def global_stats(df: DataFrame, **measures: Column) -> Column:
    """Aggregates over all rows of ``df``, as one struct usable in any expression."""
    return df.agg(F.struct(*[m.alias(name) for name, m in measures.items()]).alias("g")).scalar()


def with_global(df: DataFrame, **measures: Column) -> DataFrame:
    """``df`` with the statistics in a struct column ``_g``; the subquery is planned once."""
    return df.withColumn("_g", global_stats(df, **measures))


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - mean) / population std; 0 where the column does not vary."""
    measures = {}
    for i, c in enumerate(columns):
        measures[f"m{i}"] = F.avg(c)
        measures[f"s{i}"] = F.stddev_pop(c)

    def scaled(i: int, c: str) -> Column:
        mean, std = F.col(f"_g.m{i}"), F.col(f"_g.s{i}")
        return F.when(std == 0, F.col(c) * 0.0).otherwise(ratio(F.col(c) - mean, std))

    columns_out = {f"{c}{suffix}": scaled(i, c) for i, c in enumerate(columns)}
    return with_global(df, **measures).withColumns(columns_out).drop("_g")


def minmax(
    df: DataFrame, columns: dict[str, str], top: float = 100.0, flat: float | None = None
) -> DataFrame:
    """Output name -> column, scaled to 0..top; a column with one value becomes ``flat``."""
    measures = {}
    for i, c in enumerate(columns.values()):
        measures[f"lo{i}"] = F.min(F.col(c).cast("double"))
        measures[f"hi{i}"] = F.max(F.col(c).cast("double"))

    def scaled(i: int, c: str) -> Column:
        lo, hi = F.col(f"_g.lo{i}"), F.col(f"_g.hi{i}")
        level = F.lit(flat).cast("double")
        return F.when(F.col(c).isNotNull() & (lo == hi), level).otherwise(ratio(F.col(c) - lo, hi - lo) * top)

    columns_out = {out: scaled(i, c) for i, (out, c) in enumerate(columns.items())}
    return with_global(df, **measures).withColumns(columns_out).drop("_g")


def _to_bound(x: Column, top: Column, bottom: Column, bound: float) -> Column:
    return F.when(x > 0, bound * x / top).when(x < 0, -bound * x / bottom).otherwise(x)


def sign_preserving(
    df: DataFrame, column: str = "trend_score", bound: float = fv.SCORE_BOUND
) -> DataFrame:
    """Positive values to (0, bound], negative to [-bound, 0); zero and missing stay, and a value that
    is no finite number is missing."""
    x = finite(F.col(column).cast("double"))
    ends = with_global(df, top=F.max(F.when(x > 0, x)), bottom=F.min(F.when(x < 0, x)))
    scaled = _to_bound(x, F.col("_g.top"), F.col("_g.bottom"), bound)
    return ends.withColumn(column, scaled).drop("_g")


def sign_preserving_stacked(
    stacked: DataFrame, names: Sequence[str], column: str = "trend_score", bound: float = fv.SCORE_BOUND
) -> DataFrame:
    """The same for stacked score tables, each by its own extremes, which one aggregate finds."""
    x, tag = finite(F.col(column).cast("double")), F.col("indicator")
    measures = {}
    for i, name in enumerate(names):
        measures[f"top{i}"] = F.max(F.when((tag == name) & (x > 0), x))
        measures[f"bottom{i}"] = F.min(F.when((tag == name) & (x < 0), x))

    def own(end: str) -> Column:
        return F.coalesce(*[F.when(tag == name, F.col(f"_g.{end}{i}")) for i, name in enumerate(names)])

    ends = with_global(stacked, **measures).withColumns({"_top": own("top"), "_bottom": own("bottom")})
    scaled = _to_bound(x, F.col("_top"), F.col("_bottom"), bound)
    return ends.withColumn(column, scaled).drop("_g", "_top", "_bottom")


def shrink(
    means: DataFrame,
    prior_weight: float = fv.PRIOR_WEIGHT,
    raw: str = "raw_score",
    weight: str = "weight_sum",
    out: str = "trend_score",
) -> DataFrame:
    """Pull each mean towards the mean of all means, the more so the less weight it has."""
    g = global_stats(means, mean=F.avg(raw))
    pulled = (F.col(raw) * F.col(weight) + g["mean"] * prior_weight) / (F.col(weight) + prior_weight)
    return means.withColumn(out, pulled)


def mean_of_means(means: DataFrame, raw: str = "raw_score") -> DataFrame:
    """Unweighted mean over localities."""
    return means.agg(F.avg(raw).alias("global_mean"), F.count(KEY).alias("n_localities"))
