"""Final ranking: five scores on one sign-preserving scale, fused, added up and sorted."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import to_number
from placetrend.operators.clean import rank_by_score, total_score
from placetrend.operators.fuse import fuse_stacked, stack_scores
from placetrend.operators.scale import sign_preserving_stacked
from placetrend.sources.contract import lacking_columns, usable_tables
from placetrend.sources.delimited import read_with_header
from placetrend.sources.scores import SCORE_COLUMNS, ScoreTables
from placetrend.storage import settled


def read_scores(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Score name -> CSV path. Files without the two score columns are logged and left out."""
    tables = {name: read_with_header(spark, path) for name, path in paths.items()}
    return {
        name: df.select("locality", to_number(F.col("trend_score")).alias("trend_score"))
        for name, df in usable_tables(tables, SCORE_COLUMNS).items()
    }


def normalised_scores(scores: Mapping[str, DataFrame], write_first: bool = True) -> DataFrame:
    """(indicator, locality, trend_score) with every score on [-10, 10] by its own extremes.

    The scores are read twice, for the extremes and for the result. Tables that are still to be
    computed are therefore written first, stacked, in one go; give ``write_first=False`` for
    tables that are files already.
    """
    stacked = settled(stack_scores(scores), "scores", write_first)
    return sign_preserving_stacked(stacked, list(scores))


def composite_score(scores: Mapping[str, DataFrame], write_first: bool = True) -> DataFrame:
    """Five score tables -> commune, the five scaled scores and their total, best first.

    A locality that an indicator does not know counts as neutral (0) there. Each table must have
    one row per locality, which every score job guarantees.
    """
    names = _all_five(scores)
    return _ranked(normalised_scores({name: scores[name] for name in names}, write_first))


def normalised_tables(scores: ScoreTables) -> DataFrame:
    """``normalised_scores`` of score tables that were read together."""
    return sign_preserving_stacked(scores.stacked, scores.names)


def composite_of_tables(scores: ScoreTables) -> DataFrame:
    """``composite_score`` of score tables that were read together; tables beside the five are not used."""
    names = _all_five(scores.names)
    five = scores.stacked.where(F.col("indicator").isin(*names))
    return _ranked(sign_preserving_stacked(five, names))


def _all_five(names: Iterable[str]) -> Sequence[str]:
    lacking = lacking_columns(names, fv.COMPOSITE_SCORES)
    if lacking:
        raise ValueError(f"missing score tables: {lacking}")
    return fv.COMPOSITE_SCORES


def _ranked(scaled: DataFrame) -> DataFrame:
    names = fv.COMPOSITE_SCORES
    total = total_score(fuse_stacked(scaled, names))
    ranked = rank_by_score(total, "total").withColumnRenamed("locality", "commune")
    return ranked.select("commune", *names, "total")
