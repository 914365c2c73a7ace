"""Arithmetic with the missing-value and zero-divisor rules used throughout.

ANSI mode raises on division by zero, so every divisor that can be zero goes through ``ratio``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as DOUBLE, NULL where bottom is zero."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def finite(value: Column) -> Column:
    """The number, or NULL for NaN and infinities, which would spoil every extreme and mean."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_number(text: Column) -> Column:
    """Lenient cast: bad text and NaN both become NULL; so does a number with a type letter,
    which the engine's own cast would let through."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & ~text.rlike(r"[0-9.][dDfF]\s*$"), value)


def strict(cell: Column, to: str) -> Column:
    """The cell as another type; one that does not fit raises, whether or not the session's casts do."""
    value = cell.try_cast(to)
    wrong = F.raise_error(F.concat(F.lit(f"[CAST_INVALID_INPUT] not a {to}: "), cell.cast("string"))).cast(to)
    return F.when(cell.isNotNull() & value.isNull(), wrong).otherwise(value)


def null_safe_sum(columns: Iterable[Column]) -> Column:
    """Row-wise sum that counts NULL as 0; an empty family sums to 0."""
    return reduce(add, [F.coalesce(c.cast("bigint"), F.lit(0)) for c in columns], F.lit(0).cast("bigint"))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Sum of weight * column."""
    return reduce(add, [F.col(name) * F.lit(float(w)) for name, w in weights.items()])


def plain_sum(columns: Iterable[str]) -> Column:
    return reduce(add, [F.col(c) for c in columns])


def share_pct(parts: Iterable[Column], total: Column) -> Column:
    """Sum of parts in percent of total."""
    return ratio(reduce(add, list(parts)), total) * 100


def smoothed_growth_pct(first: Column, last: Column) -> Column:
    """Growth in percent with one added to the base, so a zero base is allowed."""
    return ratio(last - first, first + 1) * 100


def growth_rate(value: Column, previous: Column) -> Column:
    return ratio(value - previous, previous)


def cagr_pct(first: Column, last: Column, years: Column) -> Column:
    """Compound growth per year in percent; NULL without elapsed time or with a zero base."""
    power = F.pow(ratio(last, first), ratio(F.lit(1.0), years))
    return F.when((years > 0) & (first > 0), (power - 1) * 100)


def decay_weight(year: Column, latest_year: Column, decay: float) -> Column:
    """exp(-decay * age in years)."""
    return F.exp(F.lit(-float(decay)) * (latest_year - year))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` written into the plan once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def horner(x: Column, coefficients: Iterable[float]) -> Column:
    """Polynomial value; coefficients from the highest power down."""
    return reduce(lambda acc, c: acc * x + F.lit(c), list(coefficients)[1:], F.lit(list(coefficients)[0]))


# Hart's rational approximation of the normal tail (published, double precision)
NORMAL_TAIL_TOP = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORMAL_TAIL_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
NORMAL_TAIL_SWITCH = 7.07106781186547
NORMAL_TAIL_FRACTION = (0.65, 4.0, 3.0, 2.0)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a z statistic, without an error function in the engine."""


    def tails(a: Column) -> Column:
        bell = F.exp(-a * a / 2)
        near = bell * horner(a, NORMAL_TAIL_TOP) / horner(a, NORMAL_TAIL_BOTTOM)
        start, *steps = NORMAL_TAIL_FRACTION
        fraction = a + start
        for step in steps:
            fraction = a + F.lit(step) / fraction
        far = bell / (a + F.lit(1.0) / fraction) / math.sqrt(2 * math.pi)
        return 2 * F.when(a < NORMAL_TAIL_SWITCH, near).otherwise(far)

    return let(F.abs(z), tails)
