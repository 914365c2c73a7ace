"""Mixing sources to target weights by a splitting tree over blocks of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetrend.llm.shared import WORD
from placetrend.storage import materialise

WEIGHTS = (1, 2, 3)
CAP = 3
#: Words that an output shard aims at, and most shards.
SHARD_WORDS = 1 << 23
MOST_SHARDS = 1 << 14
SEED = 17
#: Words that a block aims at, most blocks of a source, documents that a cell aims at, most cells.
BLOCK_WORDS = 50_000
MOST_BLOCKS = 4096
CELL_ROWS = 64
MOST_CELLS = 4096


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, rank, n_rows, source_size, target`` from rows ``source, size``.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; none gets more
    than ``cap`` times its size. The excess goes to the others by weight until none is above, which
    is one common level per unit of weight: sources are filled in the order in which a rising level
    meets their caps. The windows run over one row per source.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy("meets", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(w) for w in weights])
    share = (
        by_source.withColumn("rank", F.row_number().over(named))
        .withColumn("weight", F.element_at(turn, (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", cap * F.col("source_size"))
        .withColumn("meets", F.col("cap") / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
    )
    reached = F.when(F.col("level") <= F.col("meets"), F.struct("meets", "rank", "level"))
    level = F.min(reached).over(every)["level"]
    return share.select("source", "rank", "n_rows", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _hypergeometric(items: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """How many of ``drawn`` of ``items`` are among the ``marked``, by inversion of a uniform ``chance``.

    Probabilities follow from each other by their ratio, from 10 deviations below the mode to 10
    above; what lies beyond weighs less than a double can tell.
    """
    low, high = F.greatest(F.lit(0), drawn + marked - items), F.least(marked, drawn)
    part = marked / F.greatest(items, F.lit(1))
    spread = F.ceil(10 * F.sqrt(F.greatest(drawn * part * (1 - part), F.lit(0.0)))) + 10
    mode = F.floor((drawn + 1) * (marked + 1) / (items + 2))
    first, last = F.greatest(low, mode - spread), F.least(high, mode + spread)

    def ratio(k: Column) -> Column:
        return (marked - k) * (drawn - k) / ((k + 1) * (items - marked - drawn + k + 1)).cast("double")

    def pick(bounds: Column) -> Column:
        a, b = bounds["a"], bounds["b"]
        steps = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        one = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"))
        total = F.aggregate(steps, one, lambda t, k: _let(t["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (t["s"] + w).alias("s"))))["s"]

        def find(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), a.alias("k"))

            def step(t: Column, k: Column) -> Column:
                def moved(w: Column) -> Column:
                    return F.struct(w.alias("w"), (t["s"] + w).alias("s"), F.when(t["s"] < goal, k + 1).otherwise(t["k"]).alias("k"))

                return _let(t["w"] * ratio(k), moved)

            return F.aggregate(steps, start, step)["k"]

        return _let(total * chance, find)

    return _let(F.struct(first.cast("bigint").alias("a"), F.greatest(first, last).cast("bigint").alias("b")), pick)


def _halved(quotas: Column, node: Column, seed: int) -> Column:
    """The part of each quota that goes to the left child: multivariate hypergeometric, so each
    half of the node's blocks is as likely as any other, and quotas stay exact."""
    items = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda t, q: t + q)
    empty = F.array().cast("array<bigint>")
    start = F.struct(empty.alias("left"), F.floor(items / 2).alias("need"), items.alias("rest"))

    def step(t: Column, q: Column) -> Column:
        uniform = F.pmod(F.xxhash64(F.lit(seed), node, F.size(t["left"])), F.lit(1 << 52)) / F.lit(float(1 << 52))
        taken = _hypergeometric(t["rest"], q, t["need"], uniform)
        return _let(
            taken,
            lambda x: F.struct(F.concat(t["left"], F.array(x)).alias("left"), (t["need"] - x).alias("need"), (t["rest"] - q).alias("rest")),
        )

    return F.aggregate(quotas, start, step)["left"]


def shard_count(sized: DataFrame) -> int:
    """A power of two that grows with the words, so that a shard stays one task's work."""
    words = sized.agg(F.sum("size")).first()[0] or 0
    return min(1 << max(words // SHARD_WORDS, 1).bit_length(), MOST_SHARDS)


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``rank, ends``: for each source of ``quotas(rank, quota)``, the number of its blocks that go to
    the first 1, 2, ... ``shards`` output shards, a power of two. One row holds a node of the tree,
    with one number per source."""
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("the tree halves: the number of shards must be a power of two")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"])
    nodes = quotas.agg(ordered.alias("quotas")).select(F.lit(1).cast("bigint").alias("node"), "quotas")
    for _ in range(depth):
        left = nodes.withColumn("left", _halved(F.col("quotas"), F.col("node"), seed))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        children = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("node") + 1).alias("node"), right.alias("quotas")),
        )
        nodes = left.select(F.inline(children))
    each = nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("quotas").alias("at", "quota"))
    upto = F.sum("quota").over(Window.partitionBy("at").orderBy("shard"))
    return (
        each.select((F.col("at") + 1).alias("rank"), "shard", upto.alias("upto"))
        .groupBy("rank")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("ends"))
    )


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan, their block and their cell. The plan has a row per source; the
    planner sees the size of its file and broadcasts it if it is small."""
    named = plan.withColumnRenamed("source", "plan_source")
    return (
        rows.join(named, F.col("source").eqNullSafe(F.col("plan_source")))
        .drop("plan_source")
        .withColumn("block", F.pmod("lot", "blocks"))
        .withColumn("cell", F.pmod(F.xxhash64("lot"), "cells"))
    )


def _passed(rows: DataFrame, by: str, room: str) -> DataFrame:
    """``rank, <by>, left``: for each source, the first value of ``by`` whose words don't fit in what
    is left of ``room``, and the words left there; the values before it fit."""
    totals = rows.groupBy("rank", by).agg(F.sum("size").alias("words"), F.first(room).alias("room"))
    upto = F.sum("words").over(Window.partitionBy("rank").orderBy(by))
    over = totals.withColumn("upto", upto).where("upto > room")
    first = F.min(F.struct(by, (F.col("room") - F.col("upto") + F.col("words")).alias("left")))
    return over.groupBy("rank").agg(first.alias("first")).select("rank", F.col(f"first.{by}").alias(f"cut_{by}"), "first.left")


def _chosen(lots: Column, room: Column) -> Column:
    """Which of the last cell's ``lots(lot, size)`` are taken, in their order: each that fits, and the
    smallest of the others if that comes nearer."""
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), room.alias("left"), F.lit(None).cast("struct<size:bigint,lot:bigint>").alias("spare"))

    def step(t: Column, x: Column) -> Column:
        fits = x["size"] <= t["left"]
        spare = F.struct(x["size"].alias("size"), x["lot"].alias("lot"))
        return F.struct(
            F.when(fits, F.concat(t["taken"], F.array(x["lot"]))).otherwise(t["taken"]).alias("taken"),
            F.when(fits, t["left"] - x["size"]).otherwise(t["left"]).alias("left"),
            F.when(fits, t["spare"]).when(t["spare"].isNull(), spare).otherwise(F.least(t["spare"], spare)).alias("spare"),
        )

    def finish(t: Column) -> Column:
        nearer = F.coalesce(t["spare"]["size"] < 2 * t["left"], F.lit(False))
        return F.when(nearer, F.concat(t["taken"], F.array(t["spare"]["lot"]))).otherwise(t["taken"])

    return F.aggregate(lots, start, step, finish)


def sized_rows(docs: DataFrame, id_column: str, source_column: str, text_column: str, seed: int) -> DataFrame:
    """``doc_id, source, size, lot``: the lot is the row's place in a seeded permutation of ids and texts."""
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
        lot(id_column, text_column, seed),
    )


def lot(id_column: str, text_column: str, seed: int) -> Column:
    """Rows of one id, or without one, part by their texts, so that they are not drawn all or none."""
    return F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")).alias("lot")


def mixing_plan(sized: DataFrame, shards: int, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per source: its target, how often all of it is taken, which blocks, cells and lots are
    taken once more, and how its blocks are dealt to the output shards.

    A source's rows fall into permuted blocks by their lots. It is taken whole as often as its target
    allows; then blocks follow in order while they fit, in the first that doesn't the cells that fit,
    and in the first cell that doesn't the lots that fit. Sums over blocks and cells are partial
    aggregates, so a source of any size gathers nowhere; a cell has some ``CELL_ROWS`` rows, or the
    source's part in ``MOST_BLOCKS * MOST_CELLS`` if that is more.
    """
    targets = source_targets(sized, weights, cap)
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    blocks = F.least(F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)), F.lit(MOST_BLOCKS))
    cells = F.least(F.greatest(F.ceil(F.col("n_rows") / (F.col("blocks") * CELL_ROWS)), F.lit(1)), F.lit(MOST_CELLS))
    base = materialise(
        targets.withColumn("epochs", epochs.cast("bigint"))
        .withColumn("room", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
        .withColumn("blocks", blocks.cast("bigint"))
        .withColumn("cells", cells.cast("bigint")),
        "mix-base",
    )
    rows = _placed(sized, base)
    by_block = materialise(base.join(_passed(rows, "block", "room").withColumnRenamed("left", "block_room"), "rank", "left"), "mix-blocks")
    inside = _placed(sized, by_block).where("block = cut_block")
    by_cell = materialise(by_block.join(_passed(inside, "cell", "block_room").withColumnRenamed("left", "cell_room"), "rank", "left"), "mix-cells")
    last = (
        _placed(sized, by_cell)
        .where("block = cut_block and cell = cut_cell")
        .groupBy("rank", "cell_room", "lot")
        .agg(F.sum("size").alias("size"))
        .groupBy("rank", "cell_room")
        .agg(_chosen(F.array_sort(F.collect_list(F.struct("lot", "size"))), F.col("cell_room")).alias("lots"))
        .select("rank", "lots")
    )
    whole = F.col("epochs") * F.col("blocks") + F.when(F.col("room") > 0, F.coalesce(F.col("cut_block") + 1, F.col("blocks"))).otherwise(0)
    quotas = by_cell.select("rank", whole.alias("quota"))
    return materialise(by_cell.join(last, "rank", "left").join(shard_quotas(quotas, shards, seed), "rank"), "mix-plan")


def with_draws(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows``, which have ``source``, ``size`` and ``lot``, with ``source_size``, ``target`` and
    ``draws``: for each time that the mix takes the row, its ``copy``, output ``shard`` and the
    ``place`` by which a shard is shuffled."""
    block, cell = F.col("block"), F.col("cell")
    fits_cell = (block == F.col("cut_block")) & (F.col("cut_cell").isNull() | (cell < F.col("cut_cell")))
    fits_lot = (block == F.col("cut_block")) & (cell == F.col("cut_cell")) & F.array_contains("lots", F.col("lot"))
    again = (F.col("room") > 0) & (F.col("cut_block").isNull() | (block < F.col("cut_block")) | fits_cell | F.coalesce(fits_lot, F.lit(False)))
    copies = F.col("epochs") + F.when(F.coalesce(again, F.lit(False)), 1).otherwise(0)
    numbers = F.when(copies > 0, F.sequence(F.lit(0).cast("bigint"), copies - 1)).otherwise(F.array().cast("array<bigint>"))

    def draw(copy: Column) -> Column:
        number = copy * F.col("blocks") + block
        shard = F.size(F.filter("ends", lambda e: e <= number))
        return F.struct(copy.alias("copy"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("lot"), copy).alias("place"))

    placed = _placed(rows, plan).withColumn("draws", F.transform(numbers, draw))
    return placed.select(*rows.columns, "source_size", "target", "draws")


def mix_draws(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, lot, source_size, target, draws``.

    A text's size is its words; a null text has none. A null source is a source of its own. Rows of one
    id and text are drawn together, others apart, also those without an id. Sources without words have
    the target 0 and are not drawn; a table without rows gives none. The draws depend on ids, texts and
    ``seed`` alone, so reruns agree. No row is drawn more than ``CAP`` times. Other columns are not read, and no
    document is shuffled.
    """
    sized = materialise(sized_rows(docs, id_column, source_column, text_column, seed), "mix-sizes")
    return with_draws(sized, mixing_plan(sized, shard_count(sized), seed=seed), seed)


def mixture(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = SEED
) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are drawn, dealt to output shards and
    shuffled in each by place. A shard is one task's output, of about equal numbers of blocks."""
    sized = materialise(sized_rows(docs, id_column, source_column, text_column, seed), "mix-sizes")
    shards = shard_count(sized)
    plan = mixing_plan(sized, shards, seed=seed)
    own = {c: f"own{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(
        *(F.col(f"`{c}`").alias(own[c]) for c in docs.columns),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        lot(id_column, text_column, seed),
    )
    drawn = with_draws(rows, plan, seed).select(*own.values(), F.inline("draws"))
    dealt = drawn.repartitionById(shards, "shard").sortWithinPartitions("place")
    return dealt.select(*(F.col(own[c]).alias(c) for c in docs.columns))
