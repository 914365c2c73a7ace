"""Putting score tables together, and joins by key list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrend.functions.numeric import finite
from placetrend.operators.clean import rank_by_score
from placetrend.operators.panel import KEY, YEAR


def _apart(key: str, tag: str = "") -> Column:
    """NULL for a row with a key; for one without, a mark of its own, so that it matches nothing and
    rows without a key spread over all partitions."""
    return F.when(F.col(key).isNull(), F.concat(F.lit(tag), F.monotonically_increasing_id().cast("string")))


def full_outer_chain(scores: Mapping[str, DataFrame], key: str = KEY, score: str = "trend_score") -> DataFrame:
    """Score tables joined one after the other on a shared key column.

    Rows without a key match nothing and each stays a row of its own. Every table is read once.
    """
    names = list(scores)
    tables = [
        df.select(key, F.col(score).alias(n)).withColumn("_apart", _apart(key, f"{n}:")) for n, df in scores.items()
    ]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({key: "_key", "_apart": "_mark"})
        both = a.join(b, F.col(key).eqNullSafe(F.col("_key")) & F.col("_apart").eqNullSafe(F.col("_mark")), "full")
        return both.withColumns({key: F.coalesce(key, "_key"), "_apart": F.coalesce("_apart", "_mark")}).drop("_key", "_mark")

    return reduce(joined, tables).select(key, *names)


def stack_scores(scores: Mapping[str, DataFrame], key: str = KEY, score: str = "trend_score") -> DataFrame:
    """Score tables -> (indicator, locality, trend_score), one below the other; a score that is no
    finite number is missing."""
    if not scores:
        raise ValueError("there is no score table")
    return reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(name).alias("indicator"), key, finite(F.col(score).cast("double")).alias(score))
            for name, df in scores.items()
        ],
    )


def fuse_stacked(
    stacked: DataFrame, names: Sequence[str], key: str = KEY, score: str = "trend_score"
) -> DataFrame:
    """One column per indicator by a partial aggregate; keys must be unique within an indicator.

    A repeated key raises, as no single row could hold its scores (the join chain can). Rows
    without a key match nothing and each stays a row of its own.
    """
    tag, value = F.col("indicator"), F.col(score)

    def only(name: str) -> Column:
        repeated = F.raise_error(F.lit(f"a {key} has more than one {name}")).cast("double")
        return F.when(F.count_if(tag == name) > 1, repeated).otherwise(F.max(F.when(tag == name, value)))

    marked = stacked.withColumn("_apart", _apart(key))
    return marked.groupBy(key, "_apart").agg(*[only(n).alias(n) for n in names]).drop("_apart")


def fuse_scores(scores: Mapping[str, DataFrame], key: str = KEY, score: str = "trend_score") -> DataFrame:
    """Same result as the chain when keys are unique per table, with one shuffle instead of four."""
    return fuse_stacked(stack_scores(scores, key, score), list(scores), key, score)


def anti_join_keys(df: DataFrame, keys: DataFrame, key: str = KEY, keep_null: bool = False) -> DataFrame:
    """Rows whose key is not listed. Rows without a key are kept or dropped as told."""
    kept = df.where(F.col(key).isNotNull()).join(keys.select(key).distinct(), key, "left_anti")
    return kept.unionByName(df.where(F.col(key).isNull())) if keep_null else kept


def top_n_series(
    panel: DataFrame, scores: DataFrame, n: int, key: str = KEY, year: str = YEAR
) -> DataFrame:
    """Whole series of the n best localities; the planner sees the limit and picks the join."""
    best = rank_by_score(scores, key=key).limit(n).select(key)
    return panel.join(best, key, "left_semi").orderBy(key, year)
