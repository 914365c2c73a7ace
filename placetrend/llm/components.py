"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.storage import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` run from the larger node to the smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; the root is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs no
    earlier round. Only partial aggregates and joins are used: a node with very many links is
    combined before it is shuffled, and its join can be split. Links with a null end and links of a
    node to itself are left out; an empty table gives an empty result. Rounds grow as the square of
    the logarithm of the largest component at most; the table never grows.
    """
    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    table = materialise(ends.where("u > v").distinct(), label)
    state = None
    while True:
        now = tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        table = materialise(_small_star(_large_star(table)), label)
    roots = table.select("v").distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
