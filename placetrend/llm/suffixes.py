"""Removal of long byte strings that occur more than once, by refining buckets of suffixes.

The bucket of a suffix is named by 128 bits. Names start at single bytes, up to eight of them are
their own name; from there the bucket of a suffix at depth ``2 d`` is named from its own bucket at depth ``d`` and that of the suffix ``d`` bytes later,
with the names just made used again for the next depth. A name settles equality, which is all that
removal asks of the order, so no global sort is needed: a shuffle counts a bucket's suffixes.

Most suffixes are alone in their bucket at a small depth already. Shuffles therefore go from coarse
to fine, and what one of them proves single is not refined further:

1. every window of ``width`` bytes has an anchor, its ``Q``-gram of the least hash, so equal
   windows have equal anchors, ``width / 2`` bytes apart on average;
2. windows of a repeated anchor, ``NODE`` neighbours together by their distance from it, are named by
   the string that they share: a string that occurs once makes all of them single;
3. of those left, neighbours are named by the string they cover: if it occurs twice, so do they all;
4. the remaining windows are named one by one, by the shared string and the bytes beside it.

Every step counts over all texts, and the filters between them lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.llm.shared import as_bytes, gather_bits, in_bitmap, small
from placetrend.llm.spans import DIGEST, FILTER_BITS, cut_spans, digest_of, text_key
from placetrend.storage import materialise

WIDTH = 400
#: Bytes of an anchor, and neighbouring windows that are named together.
Q = 32
NODE = 16

_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE_BITS = np.uint64(22)
#: Bytes whose buckets are refined at once: a few arrays of eight bytes for each, which a core's cache holds.
PART = 1 << 16
#: The depth at which a bucket's name is its bytes themselves.
PLAIN = 8


def _join(a: np.ndarray, b: np.ndarray, lane: np.uint64) -> np.ndarray:
    """The name of a bucket from two names."""
    x = a * lane + (b ^ (b >> np.uint64(29))) * _TURN
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: from block-wise minima, forwards and backwards."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


class Suffixes:
    """Buckets of the positions of some bytes: at depth ``Q`` of all, of one lane, for the anchors; deeper and
    in the other lane only where a step asks for them."""

    def __init__(self, data: bytes, width: int):
        self.data, self.width = np.frombuffer(data, np.uint8), width
        self.plain, depth = self.data.astype(np.uint64), 1
        while depth < PLAIN:
            self.plain = self.plain[:-depth] | self.plain[depth:] << np.uint64(8 * depth)
            depth *= 2
        names = self.plain
        while depth < Q:
            names = _join(names[:-depth], names[depth:], _LANES[0])
            depth *= 2
        self.grams = names

    @staticmethod
    def _half(length: int) -> int:
        return 1 << (length.bit_length() - 1)

    def _deep(self, at: np.ndarray, depth: int, lanes: tuple[int, ...]) -> list[np.ndarray]:
        """The names in ``lanes`` at ``depth``, a power of two, of the buckets of some positions."""
        if not lanes or depth <= PLAIN:
            return [self.plain[at]] * len(lanes)
        if depth == Q and lanes[0] == 0:
            return [self.grams[at], *self._deep(at, depth, lanes[1:])]
        half = depth // 2
        wanted = np.zeros(len(self.data), bool)
        wanted[at] = True
        wanted[at + half] = True
        names = self._deep(np.flatnonzero(wanted), half, lanes)
        rank = np.cumsum(wanted, dtype=np.int32) - 1
        first, second = rank[at], rank[at + half]
        return [_join(x[first], x[second], _LANES[lane]) for x, lane in zip(names, lanes, strict=True)]

    def names(self, at: list[np.ndarray], lengths: list[int]) -> list[list[np.ndarray]]:
        """Both lanes of the names of the strings of ``lengths`` bytes, of one half, at the positions ``at``."""
        depth = self._half(lengths[0])
        found = self._deep(np.concatenate([y for x, n in zip(at, lengths, strict=True) for y in (x, x + n - depth)]), depth, (0, 1))
        cuts = np.cumsum([len(x) for x in at for _ in range(2)])[:-1]
        pieces = [np.split(x, cuts) for x in found]
        return [[_join(x[2 * k], x[2 * k + 1], lane) for x, lane in zip(pieces, _LANES, strict=True)] for k in range(len(at))]

    def anchors(self) -> np.ndarray:
        """For every window, the position of its anchor: the first ``Q``-gram of the least hash."""
        grams = self.grams
        place = np.arange(len(grams), dtype=np.uint64)
        return (_least((grams >> _PLACE_BITS << _PLACE_BITS) | place, self.width - Q + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def _parts(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """``(text, offset, bytes)`` groups of about a block; a long text comes in parts that overlap so
    that each of its windows is in one of them."""
    held, total = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - width + 1, 0), PART):
            part = text[at : at + PART + width - 1]
            if held and total + len(part) > PART:
                yield held
                held, total = [], 0
            held.append((k, at, part))
            total += len(part)
    if held:
        yield held


class Nodes:
    """The windows of a group of parts: runs with one anchor, cut into runs of one node."""

    def __init__(self, parts: list[tuple[int, int, bytes]], width: int, bitmap: np.ndarray | None = None):
        joined = b"".join(p[2] for p in parts)
        self.suffixes = s = Suffixes(joined, width)
        sizes = np.array([len(p[2]) for p in parts])
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owner = np.repeat(np.arange(len(parts)), sizes)
        n = len(joined) - width + 1
        anchor = s.anchors()[:n]
        whole = owner[:n] == owner[width - 1 :]
        node = np.where(whole, (anchor - np.arange(n)) // NODE, -1)
        self.runs = np.flatnonzero(whole & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~whole[:-1])))
        self.anchor_names = s.grams[anchor[self.runs]].view(np.int64)
        cut = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (node[1:] != node[:-1])))
        edges = np.append(np.flatnonzero(cut), n)
        start, last = edges[:-1], edges[1:] - 1
        use = whole[start]
        if bitmap is not None:
            use &= in_bitmap(bitmap, s.grams[anchor[start]].view(np.int64))
        self.start, self.last = start[use], last[use]
        self.owner, self.firsts = owner[self.start], firsts
        self.high, self.low = (anchor[self.start] - self.start) % NODE, (anchor[self.last] - self.last) % NODE
        self.shared = self.start + self.high  # where the string that all windows of the node share starts

    def shared_names(self) -> list[np.ndarray]:
        found = self.suffixes.names([self.shared], [self.suffixes.width - NODE + 1])
        return [x.view(np.int64) for x in found[0]]

    def all_names(self) -> list[np.ndarray]:
        """The names of the shared strings and of the covered ones."""
        s = self.suffixes
        shared, start, last = s.names([self.shared, self.start, self.last], [s.width - NODE + 1, s.width, s.width])
        extent = (self.high * NODE + self.low).astype(np.uint64)
        covered = [_join(_join(a, b, lane), extent, lane) for a, b, lane in zip(start, last, _LANES, strict=True)]
        return [x.view(np.int64) for x in (*shared, *covered)]


@dataclass
class Texts:
    """Each text of ``WIDTH`` bytes or more once: those of ``every`` whose key is not in the bitmap of
    texts that occur twice, and ``copies`` for the others."""

    every: DataFrame
    copies: DataFrame
    bitmap: np.ndarray

    def rows(self, schema: str, rows) -> DataFrame:
        """What ``rows(texts, parts)`` makes of each group of parts, as arrays of ``schema``."""
        names = [f.split()[0] for f in schema.split(", ")]

        def run(bitmap):
            def each(batches):
                for batch in small(batches):
                    found = [t for t in as_bytes(batch.column(0)) if len(t) >= WIDTH]
                    if bitmap is not None and found:
                        met = in_bitmap(bitmap, text_key([], found)[:, 0].copy())
                        found = [t for t, skip in zip(found, met, strict=True) if not skip]
                    for parts in _parts(found, WIDTH):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in rows(found, parts)], names)

            return each

        return self.every.mapInArrow(run(self.bitmap), schema).union(self.copies.mapInArrow(run(None), schema))


def _repeated(names: DataFrame, *columns: str) -> DataFrame:
    return names.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*columns)


def _keyed(texts: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """``raw, k1, k2, size`` of texts of ``WIDTH`` bytes or more whose key is in the bitmap; without
    a bitmap, keys and sizes of all."""

    def run(batches):
        for batch in small(batches):
            found = [t for t in as_bytes(batch.column(0)) if len(t) >= WIDTH]
            key = text_key([], found)
            if bitmap is not None:
                at = np.flatnonzero(in_bitmap(bitmap, key[:, 0].copy()))
                key, found = key[at], [found[k] for k in at]
            raw = pa.array(found, pa.binary()) if bitmap is not None else pa.nulls(len(found), pa.binary())
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([raw, pa.array(key[:, 0]), pa.array(key[:, 1]), sizes], ["raw", "k1", "k2", "size"])

    return texts.mapInArrow(run, "raw binary, k1 bigint, k2 bigint, size bigint")


def _within(bitmap: np.ndarray, column: str, table: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in the bitmap."""
    at = table.columns.index(column)

    def run(batches):
        for batch in small(batches):
            yield batch.filter(pa.array(in_bitmap(bitmap, batch.column(at).to_numpy())))

    return table.mapInArrow(run, table.schema)


def distinct_texts(texts: DataFrame) -> tuple[Texts, DataFrame]:
    """The texts once each, and ``(k1, k2, start, end)`` of those that occur twice, all of whose
    windows repeat. Only texts that occur twice are shuffled."""
    counted = _keyed(texts).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("size").alias("end"))
    copied = materialise(counted.where("n > 1").select("k1", "k2", F.lit(0).cast("bigint").alias("start"), "end"), "suffix-copied")
    bitmap = gather_bits(copied, "k1", FILTER_BITS)
    one = _keyed(texts, bitmap).groupBy("k1", "k2").agg(F.first("raw").alias("raw")).select("raw")
    return Texts(texts, materialise(one, "suffix-copies"), bitmap), copied


def repeated_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``(k1, k2, start, end)``: strings of ``WIDTH`` bytes or more, all of whose windows repeat.

    Counts are partial aggregates, and rows are joined on names, joins that can be split, so a string
    of very many texts gathers in no task. A lost executor costs no finished step: each is written.
    """
    reach = NODE - 1
    texts, copied = distinct_texts(docs.select(F.col(text_column).alias("text")))
    anchors = texts.rows("a bigint", lambda t, p: [Nodes(p, WIDTH).anchor_names])
    a_bits = gather_bits(_repeated(anchors, "a"), "a", FILTER_BITS)
    shared = texts.rows("w1 bigint, w2 bigint", lambda t, p: Nodes(p, WIDTH, a_bits).shared_names())
    w_bits = gather_bits(_repeated(shared, "w1", "w2"), "w1", FILTER_BITS)

    def describe(texts, parts):
        nodes = Nodes(parts, WIDTH, a_bits)
        w1, w2, v1, v2 = nodes.all_names()
        at = np.flatnonzero(in_bitmap(w_bits, w1))
        index = sorted({p[0] for p in parts})
        key = dict(zip(index, text_key([], [texts[k] for k in index]), strict=True))
        owner = [parts[k] for k in nodes.owner[at].tolist()]
        keys = np.array([key[p[0]] for p in owner], np.int64).reshape(-1, 2)
        inner = nodes.shared[at] - nodes.firsts[nodes.owner[at]]  # within the part
        end = WIDTH - reach
        left = [p[2][max(c - reach, 0) : c] for p, c in zip(owner, inner.tolist(), strict=True)]
        right = [p[2][c + end : c + WIDTH] for p, c in zip(owner, inner.tolist(), strict=True)]
        start = nodes.start[at] - nodes.firsts[nodes.owner[at]] + np.array([p[1] for p in owner], np.int64)
        return [w1[at], w2[at], v1[at], v2[at], nodes.low[at], nodes.high[at], pa.array(left, pa.binary()), pa.array(right, pa.binary()), keys[:, 0], keys[:, 1], start]

    schema = (
        "w1 bigint, w2 bigint, v1 bigint, v2 bigint, low bigint, high bigint, "
        "left binary, right binary, k1 bigint, k2 bigint, start bigint"
    )
    nodes = materialise(texts.rows(schema, describe), "suffix-nodes")
    kinds = materialise(nodes.groupBy("w1", "w2", "v1", "v2").agg(F.count("*").alias("n")), "suffix-kinds")
    certain = nodes.join(kinds.where("n > 1").select("v1", "v2"), ["v1", "v2"]).select(
        "k1", "k2", "start", (F.col("start") + F.col("high") - F.col("low") + WIDTH).alias("end")
    )
    # a node that is alone, beside others that share its string: compare window by window
    mixed = kinds.groupBy("w1", "w2").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    mixed = materialise(mixed.select("w1", "w2"), "suffix-mixed")
    fields = ("low", "high", "left", "right", "k1", "k2", "start")
    each = (
        _within(gather_bits(mixed, "w1", FILTER_BITS), "w1", nodes)
        # combined by all four names first: what very many texts have in common is one row when it is joined
        .groupBy("w1", "w2", "v1", "v2")
        .agg(F.count("*").alias("n"), *(F.first(f).alias(f) for f in fields))
        .join(mixed, ["w1", "w2"])
        .withColumn("i", F.explode(F.sequence("low", "high")))
        .withColumn("i", F.col("i").cast("int"))
        .select(
            "w1", "w2", "i", "n", "k1", "k2", (F.col("start") + F.col("high") - F.col("i")).alias("start"),
            F.expr(f"concat(substring(left, length(left) - i + 1, i), substring(right, 1, {reach} - i))").alias("beside"),
        )
    )
    each = materialise(each, "suffix-windows")
    same = ["w1", "w2", "i", "beside"]
    found = each.groupBy(*same).agg(F.sum("n").alias("total")).where("total > 1").select(*same)
    single = each.where("n = 1").join(found, same).select("k1", "k2", "start", (F.col("start") + WIDTH).alias("end"))
    return materialise(certain.union(single).union(copied), "suffix-spans")


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Removed is every byte that a string of ``WIDTH`` bytes covers which also starts anywhere else, in
    the same text or another; overlaps count, strings never cross texts, and all are judged on the
    input. ``n_spans`` counts maximal removed runs; the digest is of the bytes left. A null text counts
    as empty. Null ids stay; a repeated row is another text that has the same strings. Other columns
    are not read.
    """
    return cut_spans(docs, repeated_spans(docs, text_column), id_column, text_column, DIGEST, digest_of)
