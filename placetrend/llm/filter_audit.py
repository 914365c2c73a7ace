"""Which of several filters removes what, under every order in which they can be applied.

A text is known by the set of filters that it fails, its mask. Under an order of the filters it goes
at the step of the first that it fails. The orders are ranked lexicographically, by their Lehmer
digits, so those that begin alike have neighbouring ranks: the orders under which a mask goes at one
step are a few intervals of ranks. The count of a mask is added where an interval starts and taken off
where it ends, and a running sum over the ranks gives what each order removes at that step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placetrend.llm.shared import as_bytes, pieces_of, small
from placetrend.llm.spans import text_key
from placetrend.storage import materialise

#: The filters, in the order of their bits; the last one looks at the whole table.
LETTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
#: Bytes that go on with a character in UTF-8.
_INNER = bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """The mask of the filters that look at one text: few words, few distinct ones, capitals, marks."""
    words, distinct, capitals, points, marked = 0, set(), 0, 0, False
    for part in pieces_of(text):
        found = part.split()
        words += len(found)
        distinct.update(found)
        capitals += len(part) - len(part.translate(None, CAPITALS))
        points += len(part.translate(None, _INNER))
        marked = marked or len(part.translate(None, MARKS)) < len(part)
    failed = (words < MIN_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, marked)
    return sum(1 << k for k, x in enumerate(failed) if x)


def failure_masks(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """``doc_id, part, mask, good, toxic`` for every row of ``docs``.

    A null text counts as empty, a null part as the empty string. Texts are equal if their 128-bit
    digests are. A row with a null id is identical to no smaller id's text, and has no label. Of
    several labels of an id one that says good, or toxic, is enough; null says neither. Rows of one
    id stay rows of their own, and are not copies of each other. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["doc_id", "part", "own", "t1", "t2"]

    def judge(batches):
        for batch in small(batches):
            texts = as_bytes(batch.column(2))
            key = text_key([], texts)
            own = pa.array([own_failures(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, pa.array(key[:, 0]), pa.array(key[:, 1])], names)

    part = F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part")
    texts = docs.select(F.col(id_column).alias("doc_id"), part, F.col(text_column).alias("text"))
    rows = materialise(texts.mapInArrow(judge, f"doc_id {kind}, part string, own int, t1 bigint, t2 bigint"), "audit-rows")
    first = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    first = materialise(first.select("t1", "t2", "least"), "audit-copied")
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality").eqNullSafe(F.lit(1))).alias("good"), F.max(F.col("toxic").eqNullSafe(F.lit(1))).alias("toxic")
    )
    said = materialise(said, "audit-labels")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    flag = {c: F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")}
    judged = rows.join(first, ["t1", "t2"], "left").join(said, "doc_id", "left")
    mask = (F.col("own") + copied * F.lit(1 << LETTERS.index("E"))).alias("mask")
    return judged.select("doc_id", "part", mask, flag["good"], flag["toxic"])


def prefix_ranks(n: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Every way to begin an order of ``n`` filters, with the first rank of its orders and one past the last."""
    for length in range(1, n + 1):
        for begin in permutations(range(n), length):
            rank = 0
            for k, x in enumerate(begin):
                rank += sum(y < x and y not in begin[:k] for y in range(n)) * factorial(n - 1 - k)
            yield begin, rank, rank + factorial(n - length)


def intervals(spark: SparkSession, n: int) -> DataFrame:
    """``mask, step, late, ends``: the orders under which a text of the mask meets, at that step,
    a filter that it fails: as the first (it goes there) or later (``late``: it went before).

    ``ends`` are ``(rank, sign)``, neighbouring intervals joined. There are at most ``n`` * ``2 ** (n + 1)``
    rows, whatever the data.
    """
    found: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}
    for begin, low, high in prefix_ranks(n):
        for mask in range(1, 1 << n):
            if mask >> begin[-1] & 1:
                late = any(mask >> x & 1 for x in begin[:-1])
                found.setdefault((mask, len(begin), late), []).append((low, high))
    rows = []
    for (mask, step, late), spans in found.items():
        ends: list[tuple[int, int]] = []
        for low, high in sorted(spans):
            if ends and ends[-1][0] == low:
                ends.pop()
            else:
                ends.append((low, 1))
            ends.append((high, -1))
        rows.append((mask, step, late, ends))
    return spark.createDataFrame(rows, "mask int, step int, late boolean, ends array<struct<rank: int, sign: int>>")


def filter_audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every order of the filters does at every step, in each part of ``masks(part, mask, good, toxic)``.

    Columns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``; one row per part, order and step, zeros included; an empty table gives no row. Bit ``k``
    of a mask is the filter ``letters[k]``. The rows are combined to one per part and mask before they
    are shuffled, so a part or mask of very many rows is no hot key.
    """
    n, spark = len(letters), masks.sparkSession
    total = factorial(n)
    counts = masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    counts = materialise(counts, "audit-counts")
    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(n)])
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"), alone.alias("alone"))

    met = counts.join(F.broadcast(intervals(spark, n)), "mask").select("*", F.explode("ends").alias("end"))

    def change(column: str, late: bool) -> Column:
        here = F.col("late") if late else ~F.col("late")
        return F.when(here, F.col(column) * F.col("end.sign")).otherwise(0).cast("bigint")

    names = ("removed", "redundant", "good_lost", "toxic_lost")
    changes = zip(names, (change("n", False), change("n", True), change("good", False), change("toxic", False)), strict=True)
    deltas = met.where(F.col("end.rank") < total).select("part", "step", F.col("end.rank").alias("rank"), *[c.alias(x) for x, c in changes])
    steps = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    grid = parts.select("part", steps).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("rank"))
    zeros = grid.select("*", *[F.lit(0).cast("bigint").alias(x) for x in names])
    array = deltas.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(x).alias(x) for x in names])
    so_far = Window.partitionBy("part", "step").orderBy("rank")
    sums = array.select("part", "step", "rank", *[F.sum(x).over(so_far).alias(x) for x in names])

    # by rank, the order itself and the place in ``letters`` of its filter at each step
    orders = list(permutations(range(n)))
    order = F.array(*[F.lit("".join(letters[k] for k in o)) for o in orders])
    of_order = F.substring("filter_order", F.col("step"), F.lit(1))
    steps_before = Window.partitionBy("part", "rank").orderBy("step")
    return (
        sums.join(parts, "part")
        .withColumn("filter_order", F.element_at(order, F.col("rank") + 1))
        .withColumn("filter", of_order)
        .withColumn("kept", F.col("all") - F.sum("removed").over(steps_before))
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
        .withColumn("unique_fails", F.element_at("alone", F.instr(F.lit(letters), F.col("filter"))))
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


#: The same from counts by mask, order by order, for DuckDB.
AUDIT_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
said AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
         FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN words.doc_id > least THEN 'E' ELSE '' END AS failed
  FROM words LEFT JOIN said ON said.doc_id = words.doc_id),
counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS earlier
          FROM orders, range(1, 6) AS s(step)),
effects AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed,
         contains(failed, f) AS fails, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND failed <> '' AS gone
  FROM counts, steps),
sums AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM effects GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """The audit of the five filters over all of ``docs``; see ``failure_masks`` and ``filter_audit``."""
    return filter_audit(failure_masks(docs, labels, id_column, text_column, part_column))
