"""Near-duplicate groups by a chosen-path join of shingle sets.

Every set has ``TOKENS`` minwise tokens: the least of its shingles' hashes under as many orders. A tree
deals the sets out by the tokens at a few places, chosen by the node's own path, and goes on with each
child in the same way, so sets that meet in a deep node agree in every token chosen on the way there.
Sets of a similarity at the threshold stay together in a child with that probability, and a node has
children enough for them to survive; several independent trees make it unlikely that a pair is lost.

* A node with few sets, or whose sets but a few are in one group already, is compared exhaustively:
  those few with all. A pair is dropped by its sizes, or if 128 bits, one of each of as many further
  minwise hashes, differ in more than ``APART`` places.
* Any other node links each of its sets that is similar to the set of its smallest id, and branches. So a large group
  of near copies is one group, but for a few, after the roots, and is never paired with itself.
* Every link is confirmed by the intersection of the full sets before it counts. For this the sets of the
  pairs found in a node meet in blocks of bounded size: first the last 16 bits of their hashes, which can only
  make an intersection larger, and then the full sets of the pairs that these leave.

Equal sets are one, and copies never meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrend.llm.components import components
from placetrend.llm.shared import as_bytes, gather_bits, in_bitmap, pieces_of, small
from placetrend.llm.spans import text_key
from placetrend.storage import materialise

SHINGLE_WORDS = 4
PERCENT = 80
#: Independent trees. A set is in two children of every node: of a root by one token each, of a deeper node by
#: ``STEP`` tokens each, which is as many depths at once. Two sets at a similarity of 0.8 meet in a tree's leaf
#: at depth 1, 2, 3, 4 with a probability of 0.96, 0.85, 0.75, 0.68, so in none of eight trees with 7e-12, 3e-7,
#: 1e-5, 1e-4.
TREES = 8
STEP = 3
#: Tokens: each tree's root has two of its own, a deeper node chooses among all others.
TOKENS = 96
#: Depths after which the links found there are confirmed and the groups made anew.
REFRESH = 8
#: Sets of a node, less its largest group, that are compared with all of it.
FEW = 32
#: Sets that meet in a block, some ``FEW`` beside them, to be compared in full.
BLOCK_SETS = 64
#: Bits of 128 that may differ. At a similarity of 0.8 one in ten does on average, and more than 36 do
#: for one pair in 10**9.
APART = 36
SKETCH_BITS = 128
SEED = 11
#: Shingles of a set up to which 16 bits of each tell sets apart well; those of larger ones are left whole.
SHORT = 1 << 13
#: Bits of a filter over digests of texts: between these, by their number. A full one loses nothing.
LEAST_BITS, MOST_BITS = 16, 27

_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (TOKENS + SKETCH_BITS, 2), np.uint64) | np.uint64(1)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
#: Hashes that are mixed at once.
_PART = 1 << 8


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; of the whole sequence if it is shorter."""
    found: set[int] = set()
    tail: list[bytes] = []
    digest = xxhash.xxh3_64_intdigest
    for part in pieces_of(text.lower()):
        words = tail + part.split()
        if len(words) >= width:
            found.update(digest(b" ".join(words[k : k + width])) for k in range(len(words) - width + 1))
            words = words[len(words) - width + 1 :]
        tail = words
    if not found and tail:
        found.add(digest(b" ".join(tail)))
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def minwise(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a set, and two longs of one bit of each further minwise hash."""
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PART):
        mixed = (hashes[at : at + _PART, None] ^ _MIX[:, 0]) * _MIX[:, 1]
        np.minimum(least, mixed.min(axis=0), out=least)
    # a least value has many leading zeros; mixed once more, all its bits count
    final = least * _TURN
    final ^= final >> np.uint64(29)
    bits = (final[TOKENS:] >> np.uint64(40) & np.uint64(1)).astype(np.uint8)
    return (final[:TOKENS] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.packbits(bits).view(np.int64)


def shingled(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """For every row: ``doc_id, n`` shingles, ``key`` of the set, ``t1`` of the text, its sketch
    ``s1, s2`` and ``tokens``. The key of an empty set is null, as are its sketch and tokens."""
    names = ["doc_id", "n", "key", "t1", "s1", "s2", "tokens"]
    known = {}  # a copy right after its like is not read again

    def describe(data: bytes, digest: bytes):
        if known.get("text") != digest:
            hashes = shingle_set(data, width)
            tokens, sketch = minwise(hashes) if len(hashes) else (None, (None, None))
            key = xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None
            known.update(text=digest, found=(len(hashes), key, *sketch, tokens))
        return known["found"]

    def run(batches):
        for batch in small(batches):
            texts = as_bytes(batch.column(1))
            lanes = text_key([], texts)
            found = [describe(t, lanes[k].tobytes()) for k, t in enumerate(texts)]
            n, key, s1, s2, tokens = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(lanes[:, 0]),
                    pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(tokens, pa.list_(pa.int32())),
                ], names,
            )

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n bigint, key binary, t1 bigint, s1 bigint, s2 bigint, tokens array<int>")


def _sets_of(docs: DataFrame, id_column: str, text_column: str, width: int, wanted: DataFrame, short: bool) -> DataFrame:
    """``key, shingles`` of the sets of ``wanted(key, mark)``, as bytes: whole, or ``short``; only their own rows are
    read for words, which a mark of id and text tells. A repeated row may give its set more than once, from
    different tasks."""
    n = wanted.count()
    bitmap = gather_bits(wanted, "mark", min(max((16 * n).bit_length(), LEAST_BITS), MOST_BITS))

    def run(batches):
        sent: set[bytes] = set()
        for batch in small(batches, 256):
            texts = as_bytes(batch.column(1))
            lanes = text_key([], texts)
            met = np.flatnonzero(in_bitmap(bitmap, batch.column(0).to_numpy() ^ lanes[:, 0]))
            keys, sets = [], []
            for k in met.tolist():
                digest = lanes[k].tobytes()
                if digest not in sent:
                    sent.add(digest)
                    hashes = shingle_set(texts[k], width)
                    keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sets.append((shortened(hashes) if short else hashes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    texts = docs.select(F.xxhash64(F.col(id_column)).alias("hash"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, "key binary, shingles binary")


def shortened(hashes: np.ndarray) -> np.ndarray:
    """The last 16 bits of each hash of a set, sorted; all of a large set's."""
    return np.sort(hashes.astype(np.uint16)) if len(hashes) <= SHORT else hashes


def most_in_common(a: np.ndarray, b: np.ndarray) -> int:
    """No fewer than two sets that were ``shortened`` have in common."""
    if a.dtype == b.dtype == np.uint64:
        return len(np.intersect1d(a, b, assume_unique=True))

    def met(x: np.ndarray, y: np.ndarray) -> int:
        there = np.zeros(1 << 16, bool)
        there[y] = True
        return np.count_nonzero(there[x])

    a, b = a.astype(np.uint16, copy=False), b.astype(np.uint16, copy=False)
    return min(met(a, b), met(b, a))


def _compatible(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches of two rows allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= APART)


#: What a node knows of a set: its key and smallest id, its size and sketch.
SET = ("least", "key", "n", "s1", "s2")


def _roots(sets: DataFrame) -> DataFrame:
    """Each set in the children of every tree's root: ``node, key, least, n, s1, s2``."""
    child = [F.xxhash64(F.lit(k // 2), F.lit(k), F.element_at("tokens", k + 1)) for k in range(2 * TREES)]
    return sets.select(F.explode(F.array(*child)).alias("node"), *SET)


def _met(tops: DataFrame, n: int) -> DataFrame:
    """The ``tops`` whose node another set may be in; the nodes of ``n`` sets are counted by their names alone."""
    again = tops.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    bitmap = gather_bits(again, "node", min(max((16 * n).bit_length(), LEAST_BITS), MOST_BITS))

    def run(batches):
        for batch in small(batches, 8192):
            yield batch.filter(pa.array(in_bitmap(bitmap, batch.column(0).to_numpy())))

    return materialise(tops.mapInArrow(run, tops.schema), "join-tops")


def _children(entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """``entries`` of nodes that branch, in their children: for each of two, the node's own hash chooses
    ``STEP`` places of ``tokens(key, root, tokens)``, and the tokens there name the child."""
    deeper = TOKENS - 2 * TREES

    def child(k: int) -> Column:
        places = [F.pmod(F.xxhash64("node", F.lit(STEP * k + j)), F.lit(deeper)) for j in range(STEP)]
        return F.xxhash64("node", F.lit(k), *[F.element_at("tokens", (p + (2 * TREES + 1)).cast("int")) for p in places])

    placed = entries.select("node", *SET).join(tokens, "key")
    return placed.select(F.explode(F.array(child(0), child(1))).alias("node"), *SET, "root")


def _top_nodes(tops: DataFrame) -> DataFrame:
    """The nodes of the first depth, where every set is a group of its own; as ``_nodes`` has them."""
    hub = F.min(F.struct(*SET, "root")).alias("hub")
    nodes = tops.groupBy("node").agg(F.count("*").alias("size"), F.max("key").alias("main"), hub).where("size > 1")
    return materialise(nodes.select("node", "size", "main", (F.col("size") - 1).alias("rest"), "hub"), "join-nodes")


def _nodes(entries: DataFrame) -> DataFrame:
    """``node, size, main, rest, hub``: sets, the largest group, sets beside it, and the set of the smallest id.
    A node of one set, or of sets of one group, ``root``, is left alone."""
    groups = entries.groupBy("node", "root").agg(F.count("*").alias("n"), F.min(F.struct(*SET, "root")).alias("hub"))
    nodes = groups.groupBy("node").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"), F.min("hub").alias("hub"))
    nodes = nodes.where("size > most.n")
    nodes = nodes.select("node", "size", F.col("most.root").alias("main"), (F.col("size") - F.col("most.n")).alias("rest"), "hub")
    return materialise(nodes, "join-nodes")


def _compared(entries: DataFrame, nodes: DataFrame, percent: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Pairs to confirm, and the entries of nodes that branch, of ``entries(node, root)`` and ``SET``, all at
    one depth of all trees."""
    near = entries.join(nodes.where(F.col("rest") <= few).select("node", "main", "size"), "node")
    # pairs within the rest come twice, so only one way is taken
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.key") < F.col("b.key"))
    apart = (F.col("a.node") == F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & once & _compatible("a", "b", percent)
    across = near.where("root <> main").alias("a").join(near.alias("b"), apart)
    across = across.select(F.col("a.key").alias("u"), F.col("b.key").alias("v"), _block("b").alias("block"))
    wide = materialise(entries.join(nodes.where(F.col("rest") > few).select("node", "hub", "size"), "node"), "join-branching")
    hubs = wide.alias("a").where((F.col("a.root") != F.col("hub.root")) & _compatible("a", "hub", percent))
    pairs = across.union(hubs.select(F.col("hub.key").alias("u"), F.col("a.key").alias("v"), _block("a").alias("block")))
    ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "block")
    return ordered, wide


def _block(side: str) -> Column:
    """Of a pair found in a node, one of as many blocks as keep the sets that meet there few."""
    blocks = F.ceil(F.col(f"{side}.size") / BLOCK_SETS)
    return F.xxhash64(F.col(f"{side}.node"), F.pmod(F.xxhash64(F.col(f"{side}.key")), blocks))


def _each_once(pairs: DataFrame) -> DataFrame:
    """Every pair in one of the blocks that have it."""
    return pairs.groupBy("u", "v").agg(F.min("block").alias("block"))


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(u, v, block)`` whose full sets are similar, ``u, v``.

    A set is sent once to each block that has a pair of it, however many pairs that are, and a block has
    bounded numbers of sets, so nothing gathers. Sets are sent by a join that can be split. Most pairs are not
    similar, and a quarter of the bytes tells that of nearly all of them.
    """
    for short in (True, False):
        pairs = _similar(pairs, sets, docs, id_column, text_column, width, percent, short)
        if short:
            pairs = materialise(pairs, "join-likely")
    return pairs.select("u", "v")


def _similar(
    pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_column: str, text_column: str, width: int, percent: int, short: bool
) -> DataFrame:
    """Those of ``pairs`` whose sets are similar, or by their ``short`` forms may be."""
    members = pairs.select("block", F.col("u").alias("key")).union(pairs.select("block", "v")).distinct()
    members = materialise(members, "join-members")
    keys = members.select("key").distinct()
    wanted = materialise(sets.join(keys, "key", "left_semi").select("key", F.col("t1").bitwiseXOR(F.col("hash")).alias("mark")), "join-wanted")
    found = materialise(_sets_of(docs, id_column, text_column, width, wanted, short), "join-sets")
    sent = members.join(found, "key")

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        whole = 8 * SHORT if short else 0  # more bytes than a short form has
        shingles = (np.frombuffer(x, np.uint64 if len(x) > whole else np.uint16) for x in held.column("shingles").to_pylist())
        shingles = dict(zip(held.column("key").to_pylist(), shingles, strict=True))
        similar = []
        for u, v in zip(asked.column("u").to_pylist(), asked.column("v").to_pylist(), strict=True):
            a, b = shingles.get(u), shingles.get(v)
            if a is None or b is None:
                similar.append(False)
            else:
                both = most_in_common(a, b) if short else len(np.intersect1d(a, b, assume_unique=True))
                similar.append(100 * both >= percent * (len(a) + len(b) - both))
        return asked.select(["u", "v", "block"]).filter(pa.array(similar, pa.bool_()))

    return pairs.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(compare, "u binary, v binary, block bigint")


def similar_links(
    sets: DataFrame, docs: DataFrame, id_column: str, text_column: str, width: int = SHINGLE_WORDS, percent: int = PERCENT, few: int = FEW
) -> DataFrame | None:
    """``node, root`` of the sets of ``sets(key, least, n, t1, hash, s1, s2, tokens)`` that are linked; None if
    none are. ``t1`` and ``hash`` tell a row of ``docs`` that has the set, by its text and id.

    The links of the roots' children make the groups that deeper nodes are judged by; those found deeper are
    confirmed together, every ``REFRESH`` depths and at the end. Every depth is written, so a lost executor
    costs no finished one.
    """
    tops = _met(_roots(sets), sets.count()).withColumn("root", F.col("key"))
    pairs, wide = _compared(tops, _top_nodes(tops), percent, few)
    pairs = materialise(_each_once(pairs), "join-pairs")
    asked = wide.select("key").distinct()
    how = (sets, docs, id_column, text_column, width, percent)
    links, roots = materialise(_confirmed(pairs, *how), "join-links"), None
    tokens = materialise(sets.select("key", "tokens").join(asked, "key", "left_semi"), "join-tokens")
    depth, found = 0, []
    while True:
        last = wide.isEmpty()
        if found and (last or depth % REFRESH == 0):
            new = materialise(_each_once(reduce(DataFrame.union, found)), "join-pairs")
            links, found = materialise(links.union(_confirmed(new, *how)), "join-links"), []
        if last or depth % REFRESH == 0:
            roots = None if links.isEmpty() else materialise(components(links, "join-stars"), "join-roots")
        if last:
            return roots
        if depth % REFRESH == 0:
            named = tokens if roots is None else tokens.join(roots.withColumnRenamed("node", "key"), "key", "left")
            root = F.col("key") if roots is None else F.coalesce("root", "key")
            rooted = materialise(named.select("key", root.alias("root"), "tokens"), "join-rooted")
        entries = materialise(_children(wide, rooted), "join-entries")
        pairs, wide = _compared(entries, _nodes(entries), percent, few)
        found.append(pairs)
        depth += 1


def minhash_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    few: int = FEW,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are maximal runs without white space, A-Z in lower case; a text's set are its distinct
    shingles of ``width`` words, or all its words as one if it has fewer. Texts are linked if their
    intersection is ``percent`` hundredths of their union or more; ``component_id`` is the smallest id
    that links reach, itself included, and ``kept`` tells that it is the row's own. A text without
    words, or null, has no shingle and is linked with nothing, not even its like. Rows with equal
    sets are linked. A row with a null id stays, lends its group no id, and has a null component where
    the group has no other; it is not kept. Rows of one id keep their own texts' groups, the
    smallest id being that of the row itself at most. Repeated rows give repeated rows. Other columns
    are not read. Shingles and sets are told apart by hashes of 64 and 128 bits.
    """
    rows = materialise(shingled(docs, id_column, text_column, width), "join-rows")
    sets = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min(F.struct("doc_id", "t1")).alias("row"),
        F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("tokens").alias("tokens"),
    )
    sets = sets.select("key", "least", "n", "row.t1", F.xxhash64("row.doc_id").alias("hash"), "s1", "s2", "tokens")
    sets = materialise(sets, "join-distinct")
    roots = similar_links(sets, docs, id_column, text_column, width, percent, few)
    named = sets.select("key", "least")
    if roots is not None:
        linked = named.join(roots, named["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
        groups = linked.groupBy("root").agg(F.min("least").alias("least"))
        named = linked.select("key", "root").join(groups, "root").select("key", "least")
    named = materialise(named.select("key", "least"), "join-named")
    found = rows.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.coalesce("least", "doc_id")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


#: Links by counting the shingles that two distinct sets share, and what they reach, for DuckDB.
JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
  FROM words),
kinds AS MATERIALIZED (SELECT row_number() OVER () AS k, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS MATERIALIZED (SELECT k, n, unnest(s) AS x FROM kinds),
links AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT k, k FROM kinds UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
groups AS (SELECT a AS k, min(least) AS component_id FROM reach JOIN kinds ON kinds.k = reach.b GROUP BY a)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN kinds ON kinds.s = sets.s LEFT JOIN groups ON groups.k = kinds.k
"""
