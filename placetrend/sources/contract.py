"""Column contracts, checked on the schema before any work starts."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def lacking_columns(columns: Iterable[str], needed: Iterable[str]) -> list[str]:
    have = set(columns)
    return [c for c in needed if c not in have]


def missing_columns(df: DataFrame, needed: Iterable[str]) -> list[str]:
    return lacking_columns(df.columns, needed)


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """The table itself, or ValueError naming what it lacks."""
    lacking = missing_columns(df, needed)
    if lacking:
        raise ValueError(f"missing columns {lacking}; found {df.columns}")
    return df


def usable_tables(tables: Mapping[str, DataFrame], needed: Iterable[str]) -> dict[str, DataFrame]:
    """Tables that have the needed columns; the others are logged and left out."""
    needed = list(needed)
    kept = {}
    for name, df in tables.items():
        lacking = missing_columns(df, needed)
        if lacking:
            log.warning("%s lacks %s and is left out", name, lacking)
        else:
            kept[name] = df
    return kept
