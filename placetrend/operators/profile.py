"""Table profiles by aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that proposes a range of values, and values that one task sorts.
SKETCH = 10_000
AT_ONCE = 100_000


def null_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: its position, name and type, rows and missing cells, from one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{k}") for k, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(k).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("kind"),
            F.col("n_rows").alias("n_rows"), F.col(f"m{k}").alias("n_missing"),
        )
        for k, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def row_profile(df: DataFrame, *keys: str) -> DataFrame:
    """Row count and distinct values of each key."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(k).alias(f"n_{k}") for k in keys]
    )


def _narrowed(values: DataFrame, wanted: dict[float, int], n: int) -> dict[float, tuple[float, float, int, int]]:
    """For each share a range of values that holds its rank and the next, how many values lie below it and
    how many inside; of ``n`` values, in two passes that count only."""
    found: dict[float, tuple[float, float, int, int]] = {}
    slack = 2 / SKETCH
    while open_shares := [s for s in wanted if s not in found]:
        around = [max(0.0, min(1.0, wanted[s] / max(n - 1, 1) + d)) for s in open_shares for d in (-slack, slack)]
        ends = values.agg(F.percentile_approx("v", around, SKETCH).alias("e")).first()["e"]
        ranges = dict(zip(open_shares, zip(ends[::2], ends[1::2], strict=True), strict=True))
        counts = [c for low, high in ranges.values() for c in (F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high)))]
        got = values.agg(*[c.alias(f"c{k}") for k, c in enumerate(counts)]).first()
        for k, (share, (low, high)) in enumerate(ranges.items()):
            below, inside = got[2 * k], got[2 * k + 1]
            if below <= wanted[share] and min(wanted[share] + 1, n - 1) < below + inside:
                found[share] = (low, high, below, inside)
        slack *= 4
    return found


def _ranked(values: DataFrame, rank: int) -> tuple[float, float]:
    """The value of ``rank``, from zero, and the next; of values that one task may hold."""
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
    first = upto.agg(F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > rank + 1, F.col("v"))).alias("b")).first()
    return first.a, first.a if first.b is None else first.b


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], at_once: int = AT_ONCE) -> list[float | None]:
    """Exact quantiles between the two values around a share's place, as ``percentile`` gives them.

    That function keeps every distinct value in one buffer. Here a sketch proposes a narrow range around
    each place, a pass counts the values below and inside it, and only a range of ``at_once`` values or
    fewer is sorted, by one task; a larger one is narrowed again, unless it is a single value. The input is
    read three times or a few more; write it first if it is costly.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = {share: share * (n - 1) for share in shares}
    ranges = _narrowed(values, {share: int(place) for share, place in places.items()}, n)
    out: list[float | None] = []
    for share in shares:
        low, high, below, inside = ranges[share]
        rank, held = int(places[share]) - below, inside
        while held > at_once and low < high:
            within = values.where(F.col("v").between(low, high))
            before = (low, high)
            low, high, less, held = _narrowed(within, {share: rank}, held)[share]
            rank -= less
            if (low, high) == before:  # few values, each very often: counted by value they are few rows
                break
        a, b = (low, high) if low == high else _ranked(values.where(F.col("v").between(low, high)), rank)
        part = places[share] - int(places[share])
        out.append(a if part == 0 else (1 - part) * a + part * b)
    return out


def describe_score(df: DataFrame, score: str = "trend_score") -> DataFrame:
    """Count, missing, mean, sample std, extremes and exact quartiles, which lie between two scores."""
    s = F.col(score)
    quarts = exact_quantiles(df, score, (0.25, 0.5, 0.75))
    return df.agg(
        F.count(s).alias("n"),
        F.count_if(s.isNull()).alias("n_missing"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std"),
        F.min(s).alias("min"),
        *[F.lit(q).cast("double").alias(name) for q, name in zip(quarts, ("q25", "q50", "q75"), strict=True)],
        F.max(s).alias("max"),
    )
