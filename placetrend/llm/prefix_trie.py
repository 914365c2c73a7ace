"""The trie of conversation prefixes, with a sketch that keeps single prefixes out of the shuffles.

A prefix is named by 128 bits made of running sums: every turn is hashed together with its place, so
the sum of a prefix's hashes tells the sequence, and sums of blocks of a long conversation add up.
A count-min sketch over the names of all prefixes, of two rows of counters that stop at two, then
judges each prefix where it lies: an estimate of one proves that a single conversation has it, and its
node is written at once. Only prefixes that may be shared are grouped by name.

Totals over subtrees need no walk. The smallest member of a node owns it, and what a conversation owns
is the end of its path. A node of ``n`` members saves ``n - 1`` times its words, that is its words for
every member that does not own it; so a subtree's sum is, over its members, the words between its top
and the place from which the member owns its path. A subtree's leaves are the members that own one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetrend.llm.shared import WORD, gather_bits, in_bitmap
from placetrend.storage import materialise

#: Turns of one conversation that a task sums up together.
BLOCK_TURNS = 4096
#: Counters of a row of the sketch: 2 ** bits, at most. A full sketch proves less and loses nothing.
LEAST_BITS, MOST_BITS = 16, 27
#: Ids that are joined into one string before the strings of a node meet.
CHUNK_IDS = 8192
_HALF = (1 << 32) - 1


def _lanes(*columns: Column) -> tuple[Column, Column]:
    """128 bits of the columns, as two longs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def ordered_turns(conversations: DataFrame, words: str = WORD) -> DataFrame:
    """``conv_id, i, t1, t2, words``: the turns of each conversation numbered from one.

    They are ordered by turn, null first, then role, then text; null roles and texts are empty, equal
    rows are turns of their own, rows without ``conv_id`` are left out. The rows are sorted in ranges
    of all columns, so that a very long conversation is spread over tasks; what its tasks hold of
    earlier turns is one count each. ``t1, t2`` are the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    nth = F.monotonically_increasing_id().alias("nth")  # between equal rows, so that many of them can part
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    dealt = rows.select("*", nth).repartitionByRange(*order).sortWithinPartitions(*order)
    t1, t2 = _lanes(F.col("role"), F.col("text"))
    # the ids follow the order of the rows: the partition's number, then the place in it
    place = F.monotonically_increasing_id().alias("place")
    turns = dealt.select("conv_id", place, t1.alias("t1"), t2.alias("t2"), F.regexp_count("text", F.lit(words)).cast("bigint").alias("words"))
    turns = materialise(turns, "trie-turns").withColumn("task", F.shiftrightunsigned("place", 33))
    runs = turns.groupBy("conv_id", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task")) - F.col("n")
    runs = materialise(runs.select("conv_id", "task", (before - F.col("first") + 1).alias("shift")), "trie-runs")
    return turns.join(runs, ["conv_id", "task"]).select("conv_id", (F.col("place") + F.col("shift")).alias("i"), "t1", "t2", "words")


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, pos, t1, t2, words``, and a row of position zero for every conversation of ``turns``.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % group``, fewer if it has fewer,
    none if it is absent; its own turns after its first ``h`` follow. ``h`` is the unsigned CRC-32 of
    ``c`` in decimals, modulo ``most``. ``c % group`` has the sign of ``c``, as in SQL.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.groupBy("conv_id").agg(F.count_if(F.col("i") < most).alias("early"), F.count("*").alias("n"))
    convs = materialise(convs.select("*", heads.alias("h"), base.alias("base")), "trie-conversations")
    begins = turns.where(F.col("i") < most).select(F.col("conv_id").alias("base"), "i", "t1", "t2", "words")
    # a base has fewer than ``most`` such turns, and fewer than ``group`` conversations on each side
    borrowed = convs.join(begins, "base").where("i <= h").select("conv_id", F.col("i").alias("pos"), "t1", "t2", "words")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("early").alias("base_early"))
    shift = convs.join(bases, "base", "left").select(
        "conv_id", "h", (F.least("h", F.coalesce("base_early", F.lit(0).cast("bigint"))) - F.col("h")).alias("shift")
    )
    shift = materialise(shift, "trie-shifts")
    own = turns.join(shift, "conv_id").where("i > h").select("conv_id", (F.col("i") + F.col("shift")).alias("pos"), "t1", "t2", "words")
    none = F.lit(0).cast("bigint")
    tops = convs.select("conv_id", none.alias("pos"), none.alias("t1"), none.alias("t2"), none.alias("words"))
    return borrowed.unionByName(own).unionByName(tops)


def prefixes(rows: DataFrame) -> DataFrame:
    """Every prefix of every sequence of ``rows(conv_id, pos, t1, t2, words)``, positions from zero.

    ``conv_id, depth, p1, p2`` name it, ``q1, q2`` name the prefix one shorter; ``words`` are those of
    its last turn, ``through`` those of all its turns; ``last`` tells the whole sequence.
    """
    x1, x2 = _lanes(F.col("pos"), F.col("t1"), F.col("t2"))
    parts = [f(x) for x in (x1, x2) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(_HALF)))]
    names = [f"s{k}" for k in range(len(parts))]
    sums = [*names, "words"]
    zero = F.col("pos") == 0
    cells = rows.select(
        "conv_id", "pos", F.floor(F.col("pos") / BLOCK_TURNS).alias("block"), "words",
        *[F.when(zero, 0).otherwise(p).cast("bigint").alias(n) for p, n in zip(parts, names, strict=True)],
    )
    cells = materialise(cells, "trie-cells")
    blocks = cells.groupBy("conv_id", "block").agg(F.max("pos").alias("end"), *[F.sum(s).alias(f"b_{s}") for s in sums])
    by_block = Window.partitionBy("conv_id").orderBy("block")
    carried = blocks.select(
        "conv_id", "block", F.max("end").over(Window.partitionBy("conv_id")).alias("end"),
        *[(F.sum(f"b_{s}").over(by_block) - F.col(f"b_{s}")).alias(f"b_{s}") for s in sums],
    )
    within = Window.partitionBy("conv_id", "block").orderBy("pos")
    running = cells.select("*", *[F.sum(s).over(within).alias(f"r_{s}") for s in sums])
    met = running.join(materialise(carried, "trie-blocks"), ["conv_id", "block"])
    now = [F.col(f"r_{s}") + F.col(f"b_{s}") for s in names]
    earlier = [x - F.col(s) for x, s in zip(now, names, strict=True)]
    (p1, p2), (q1, q2) = _lanes(F.col("pos"), *now), _lanes(F.col("pos") - 1, *earlier)
    return met.select(
        "conv_id", F.col("pos").alias("depth"), p1.alias("p1"), p2.alias("p2"), q1.alias("q1"), q2.alias("q2"),
        "words", (F.col("r_words") + F.col("b_words")).alias("through"), (F.col("pos") == F.col("end")).alias("last"),
    )


def count_min(table: DataFrame, columns: tuple[str, ...], log2_counters: int) -> list[np.ndarray]:
    """A row of counters for each of the columns, which hold hashes: bitmaps of those that count two or more.

    The estimate of a row of ``table`` is one if any of its bits is unset, and then it is exact.
    """
    slots = [F.struct(F.lit(k).alias("row"), F.pmod(c, F.lit(1 << log2_counters)).alias("slot")) for k, c in enumerate(columns)]
    counted = table.select(F.explode(F.array(*slots)).alias("at")).groupBy("at.row", "at.slot").agg(F.count("*").alias("n"))
    twice = materialise(counted.where("n > 1").select("row", "slot"), "trie-counters")
    return [gather_bits(twice.where(F.col("row") == k), "slot", log2_counters) for k in range(len(columns))]


def screened(table: DataFrame) -> DataFrame:
    """``table`` of prefixes with ``single`` and ``parent_single``: the sketch proves one member only."""
    n = table.count()
    bits = min(max((4 * n).bit_length(), LEAST_BITS), MOST_BITS)
    sketch = count_min(table, ("p1", "p2"), bits)
    at = [table.columns.index(c) for c in ("p1", "p2", "q1", "q2")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields) + ", single boolean, parent_single boolean"

    def judge(batches):
        for batch in batches:
            a, b, c, d = (batch.column(k).to_numpy() for k in at)
            single = ~(in_bitmap(sketch[0], a) & in_bitmap(sketch[1], b))
            parent = ~(in_bitmap(sketch[0], c) & in_bitmap(sketch[1], d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(parent)], [*batch.schema.names, "single", "parent_single"])

    return table.mapInArrow(judge, schema)


def list_digests(ends: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256`` of ``ends(p1, p2, conv_id)``: the ids ascending, joined by commas.

    A SHA-256 must read its text in order. The ids are sorted in ranges over all tasks and joined
    there into strings of up to ``CHUNK_IDS`` ids, so that for a list of any length the task that hashes it
    reads few rows, one after another.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_IDS):
                part = batch.slice(start, CHUNK_IDS)
                p1, p2, ids = (part.column(k).to_numpy() for k in range(3))
                cut = np.flatnonzero(np.concatenate(([True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))))
                texts = [",".join(map(str, x.tolist())) for x in np.split(ids, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(p1[cut]), pa.array(p2[cut]), pa.array(ids[cut]), pa.array(texts, pa.string())], ["p1", "p2", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hasher = None, None
        for batch in batches:
            done = []
            p1, p2, texts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for a, b, text in zip(p1, p2, texts, strict=True):
                if key == (a, b):
                    hasher.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((*key, hasher.hexdigest()))
                key, hasher = (a, b), hashlib.sha256(text.encode())
            yield result(done)
        if key is not None:
            yield result([(*key, hasher.hexdigest())])

    def result(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["p1", "p2", "ends_sha256"])

    order = ["p1", "p2", "conv_id"]
    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = sorted_ends.mapInArrow(join, "p1 bigint, p2 bigint, least bigint, ids string")
    return chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "least").mapInArrow(digest, "p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences ``rows(conv_id, pos, t1, t2, words)`` of ``prefixes``.

    ``conv_id`` is the smallest member, ``depth`` the turns, ``parent_conv_id`` the parent's ``conv_id``
    (root: null), ``n_convs`` the members, ``n_children`` the children, ``n_leaves`` the childless nodes
    of its subtree, its top included, ``saved_tokens`` the sum over the subtree of the words of a node's
    last turn, once for each member but one, ``ends_sha256`` the digest of the ids of the sequences that
    end there, ascending and joined by commas. An empty table gives no row.
    """
    table = materialise(screened(materialise(prefixes(rows), "trie-prefixes")), "trie-screened")
    single, shared = table.where("single"), table.where("NOT single")
    key = ["p1", "p2"]
    groups = shared.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.count_if(~F.col("last")).alias("n_on"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max(F.col("through") - F.col("words")).alias("before"),
    )
    groups = materialise(groups, "trie-groups")
    # from where on a conversation owns its path, the words before that, and whether it owns a leaf
    owned = groups.select("conv_id", "depth", "before", (F.col("n_on") == 0).alias("leaf"))
    owned = owned.unionByName(single.select("conv_id", "depth", (F.col("through") - F.col("words")).alias("before"), F.col("last").alias("leaf")))
    owners = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("from"), F.max("leaf").alias("leaf"))
    owners = materialise(owners.select("conv_id", F.col("from.depth").alias("from"), F.col("from.before").alias("borrowed"), "leaf"), "trie-owners")
    # one that owns nothing has borrowed its whole path
    whole = table.where("last").select("conv_id", F.col("through").alias("whole"))
    owners = materialise(whole.join(owners, "conv_id", "left"), "trie-members")
    members = shared.select(*key, "conv_id", "depth", "words", "through").join(owners, "conv_id")
    ahead = F.coalesce("borrowed", "whole") - F.col("through") + F.col("words")
    sums = members.groupBy(*key).agg(
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("from") <= F.col("depth"), 0).otherwise(ahead)).alias("saved_tokens"),
    )
    links = groups.where("depth > 0").select("q1", "q2").unionAll(single.where("depth > 0 AND NOT parent_single").select("q1", "q2"))
    children = links.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    digests = list_digests(shared.where("last"))
    parents = groups.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))

    def parent(df: DataFrame) -> DataFrame:
        """A parent that is not grouped is single, and of the same conversation."""
        found = df.join(parents, ["q1", "q2"], "left")
        return found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")))

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    none = F.lit(0).cast("bigint")
    together = groups.join(sums, key).join(children, key, "left").join(digests, key, "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    grouped = (
        parent(together)
        .withColumn("n_children", F.coalesce("n_children", none))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
        .select(*columns)
    )
    alone = {
        "n_convs": F.lit(1).cast("bigint"), "n_children": F.when(F.col("last"), 0).otherwise(1).cast("bigint"),
        "n_leaves": F.lit(1).cast("bigint"), "saved_tokens": none,
        "ends_sha256": F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing),
    }
    # tails are written where they lie; only their first nodes look a parent up
    tails = single.where("parent_single OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    firsts = parent(single.where("NOT parent_single AND depth > 0"))
    return grouped.unionByName(tails.withColumns(alone).select(*columns)).unionByName(firsts.withColumns(alone).select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of a group of twenty begin alike."""
    return prefix_trie(materialise(with_shared_heads(ordered_turns(conversations)), "trie-rebuilt"))


#: The same by lists of whole prefixes and a join of every node with all above it, for DuckDB.
TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM turns),
convs AS (
  SELECT conv_id, base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, byte:
           list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM ids),
rebuilt AS (
  SELECT convs.conv_id, 0 AS own, i, r, x FROM convs JOIN turns ON turns.conv_id = base AND i <= h
  UNION ALL SELECT convs.conv_id, 1, i, r, x FROM convs JOIN turns ON turns.conv_id = convs.conv_id AND i > h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, md5(length(r) || ':' || r || x) AS t,
                    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
paths AS (
  SELECT conv_id, depth, words, list(t) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT path, min(conv_id) AS conv_id, any_value(depth)::BIGINT AS depth, count(*) AS n_convs, any_value(words) AS words,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
          FROM ended GROUP BY path),
childless AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children FROM nodes n),
above AS (SELECT path[1:k] AS path, (n_convs - 1) * words AS saved, n_children = 0 AS leaf FROM childless, range(0, 1000000) AS r(k) WHERE k <= depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       (SELECT count(*) FILTER (leaf) FROM above a WHERE a.path = n.path) AS n_leaves,
       (SELECT sum(saved) FROM above a WHERE a.path = n.path)::BIGINT AS saved_tokens, n.ends_sha256
FROM childless n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
