"""Substring dedup by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrend.llm.shared import BLOCK, as_bytes, blocks, gather_bits, in_bitmap, merged, small, without
from placetrend.llm.spans import FILTER_BITS, cut_spans, longs, row_key
from placetrend.storage import materialise

#: Chunk sizes in bytes: the least, the greatest, and one cut in ``2 ** MEAN_BITS`` positions.
LEAST, GREATEST, MEAN_BITS = 16, 64, 4
#: Bytes that a run of repeated chunks must cover to be removed, with the bytes at its ends that are
#: repeated too if these are compared: a passage of over 50 words has that much, a turn of phrase has not.
MIN_RUN = 128
GEAR_WINDOW = 32
#: Bytes before and behind a run that are compared with the earlier place. Behind, a passage that went
#: on for a whole chunk would have that chunk too; before, the cuts must first fall into step.
BEFORE, BEHIND = 256, GREATEST

_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = (h << 1) + gear[byte]`` at every byte: as 32 bits, it forgets what lies
    ``GEAR_WINDOW`` bytes back, so doubling the window five times gives all positions at once."""
    rolled, step = _GEAR[data], 1
    while step < GEAR_WINDOW:
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = longer, 2 * step
    return rolled


def _candidates(texts: list[bytes]) -> list[np.ndarray]:
    """Positions of each text at which the hash asks for a cut; a text's own bytes alone decide."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    high = np.uint32(32 - MEAN_BITS)
    joined = b"".join(texts)
    found = []
    for at in range(0, len(joined), BLOCK):
        lead = min(at, GEAR_WINDOW)
        part = np.frombuffer(joined, np.uint8, min(BLOCK, len(joined) - at) + lead, at - lead)
        found.append(np.flatnonzero(gear_hashes(part)[lead:] >> high == 0) + at + 1)
    cuts = np.concatenate(found) if found else np.zeros(0, np.int64)
    after = np.frombuffer(joined + b" ", np.uint8)[cuts]
    cuts = cuts[(after & 0xC0) != 0x80]  # no character is cut
    inside = [cuts[a:b] for a, b in zip(np.searchsorted(cuts, starts[:-1], "right"), np.searchsorted(cuts, starts[1:], "left"), strict=True)]
    return [c - s for c, s in zip(inside, starts[:-1], strict=True)]


def _forced(text: bytes, at: int) -> int:
    """The end of a chunk of greatest size from ``at``, at the start of a character."""
    end = at + GREATEST
    while end > at + GREATEST - 4 and text[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text. Candidates below ``LEAST`` bytes are passed over, and no
    chunk exceeds ``GREATEST``. Candidates that depend on bytes before the text are dropped: the
    first ``GEAR_WINDOW`` bytes of a text have none."""
    out = []
    for text, cuts in zip(texts, _candidates(texts), strict=True):
        size, at, ends = len(text), 0, []
        for cut in cuts[cuts >= GEAR_WINDOW].tolist():
            while cut - at > GREATEST:
                at = _forced(text, at)
                ends.append(at)
            if cut - at >= LEAST:
                at = cut
                ends.append(at)
        while size - at > GREATEST:
            at = _forced(text, at)
            ends.append(at)
        if size > at:
            ends.append(size)
        out.append(ends)
    return out


def _digested(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every chunk: its text's number, start, end, digest, and whether the text has it further up."""
    digest, ends = xxhash.xxh3_128_digest, chunk_ends(texts)
    owner, starts, digests, again = [], [], [], []
    for k, (text, own) in enumerate(zip(texts, ends, strict=True)):
        seen: set[bytes] = set()
        begins = [0, *own[:-1]] if own else []
        for a, b in zip(begins, own, strict=True):
            found = digest(text[a:b])
            digests.append(found)
            again.append(found in seen)
            seen.add(found)
        owner += [k] * len(own)
        starts += begins
    flat = [b for own in ends for b in own]
    numbers = (np.array(x, np.int64) for x in (owner, starts, flat))
    return *numbers, longs(digests), np.array(again, bool)


def chunk_occurrences(docs: DataFrame, id_column: str, text_column: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """``(d1, d2, doc_id, again, k1, k2, start, end)`` for every chunk, or for those in the bitmap:
    digest, document, whether the text has the chunk further up, row key, and place."""
    def rows(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        owner, starts, flat, found, again = _digested(texts)
        key = row_key(ids.to_pylist(), texts)
        at = np.arange(len(flat)) if bitmap is None else np.flatnonzero(in_bitmap(bitmap, found[:, 0].copy()))
        who = owner[at]
        columns = [found[at, 0], found[at, 1], ids.take(pa.array(who)), again[at], key[who, 0], key[who, 1], starts[at], flat[at]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    def run(batches):
        for batch in small(batches):
            at = 0
            for texts in blocks(as_bytes(batch.column(1))):
                yield rows(batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    names = ["d1", "d2", "doc_id", "again", "k1", "k2", "start", "end"]
    kind = docs.schema[id_column].dataType.simpleString()
    kinds = ["bigint", "bigint", kind, "boolean", "bigint", "bigint", "bigint", "bigint"]
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(k1, k2, start, end, d1, d2, first)`` of every chunk that stands further up in its text or in
    a document of a smaller id, with its digest and the smallest id that has it.

    Digests are counted by partial aggregation, so a chunk of very many documents is combined before
    it is shuffled. Chunks are then cut anew and only those whose digest repeats are joined, a join
    that can be split; a filter of bounded size keeps the others out.
    """
    repeated = materialise(
        chunk_occurrences(docs, id_column, text_column)
        .groupBy("d1", "d2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        .where("n > 1")
        .select("d1", "d2", "first"),
        "repeated-chunks",
    )
    bitmap = gather_bits(repeated, "d1", FILTER_BITS)
    met = chunk_occurrences(docs, id_column, text_column, bitmap).join(repeated, ["d1", "d2"])
    kept = F.col("doc_id").eqNullSafe(F.col("first")) & ~F.col("again")
    return materialise(met.where(~kept).select("k1", "k2", "start", "end", "d1", "d2", "first"), "repeated-spans")


def run_ends(spans: DataFrame) -> DataFrame:
    """``(k1, k2, start, end, side, d1, d2, first)``: the two ends of each run of touching ``spans``,
    side 0 with the digest and first document of its first chunk, side 1 with those of its last.
    A window holds the repeated chunks of one text; equal rows of a document count once."""
    place = Window.partitionBy("k1", "k2").orderBy("start")
    upto = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.distinct().withColumn("opens", (F.col("start") > F.coalesce(upto, F.lit(-1))).cast("int"))
    chunk = F.struct("d1", "d2", "first")
    runs = (
        opens.withColumn("run", F.sum("opens").over(place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k1", "k2", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(chunk, "start").alias("head"), F.max_by(chunk, "start").alias("tail"))
    )
    sides = F.array(*[F.struct(F.lit(k).alias("side"), *(F.col(f"{c}.{n}").alias(n) for n in ("d1", "d2", "first"))) for k, c in enumerate(("head", "tail"))])
    return materialise(runs.select("k1", "k2", "start", "end", F.inline(sides)), "run-ends")


def surroundings(docs: DataFrame, ends: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(d1, d2, side, f1, f2, at, bytes)``: for each chunk at the ``ends`` of runs, the row key and place
    of its first occurrence, and the bytes before it (side 0) or behind it (side 1) there.

    The two filters hold halves of digests together with the first document, so a chunk of very many
    documents gives rows in that document only."""
    wanted = materialise(ends.select("d1", "d2", "side", "first").distinct(), "run-end-chunks")
    marks = [F.col(d).bitwiseXOR(F.xxhash64("first")) for d in ("d1", "d2")]
    sided = [F.when(F.col("side") == 0, m).otherwise(F.bitwise_not(m)).alias("mark") for m in marks]
    bitmaps = [gather_bits(wanted.select(m), "mark", FILTER_BITS) for m in sided]

    def rows(ids: pa.Array, hashes: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        owner, starts, flat, found, again = _digested(texts)
        key = row_key(ids.to_pylist(), texts)
        marks = [found[:, k] ^ hashes[owner] for k in (0, 1)]
        for side, place in ((0, starts), (1, flat)):
            met = [in_bitmap(b, ~m if side else m) for b, m in zip(bitmaps, marks, strict=True)]
            at = np.flatnonzero(met[0] & met[1] & ~again)
            who = owner[at]
            pairs = zip(who.tolist(), place[at].tolist(), strict=True)
            around = [texts[k][p : p + BEHIND] if side else texts[k][max(p - BEFORE, 0) : p] for k, p in pairs]
            columns = [found[at, 0], found[at, 1], np.full(len(at), side, np.int32), ids.take(pa.array(who)), key[who, 0], key[who, 1], place[at]]
            columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(around, pa.binary())], names)

    def run(batches):
        for batch in small(batches):
            at, hashes = 0, batch.column(1).to_numpy()
            for texts in blocks(as_bytes(batch.column(2))):
                yield from rows(batch.column(0).slice(at, len(texts)), hashes[at : at + len(texts)], texts)
                at += len(texts)

    names = ["d1", "d2", "side", "doc_id", "f1", "f2", "at", "bytes"]
    kinds = ["bigint", "bigint", "int", docs.schema[id_column].dataType.simpleString(), "bigint", "bigint", "bigint", "binary"]
    texts = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column).alias("hash"), F.col(text_column).alias("text"))
    met = texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    own = met.join(wanted, ["d1", "d2", "side"]).where(F.col("doc_id").eqNullSafe(F.col("first")))
    one = own.groupBy("d1", "d2", "side").agg(F.min(F.struct("f1", "f2", "at", "bytes")).alias("one"))
    # written, so that the join with all ends, of which a very common passage has many, can be split
    return materialise(one.select("d1", "d2", "side", "one.*"), "run-end-places")


def _alike(left: bytes, right: bytes) -> int:
    """How many bytes both begin with."""
    n = min(len(left), len(right))
    return next((k for k in range(n) if left[k] != right[k]), n)


def stretched(text: bytes, ends: list[dict], least: int) -> list[tuple[int, int]]:
    """Merged spans of the runs of ``ends``, each taken on as far as the earlier place goes on alike, as
    far as they then have ``least`` bytes. An earlier place in the same text is not cut into, and no
    character is cut."""
    runs: dict[tuple[int, int], dict[int, dict]] = {}
    for end in ends:
        runs.setdefault((end["start"], end["end"]), {})[end["side"]] = end
    found = []
    for (start, end), sides in runs.items():
        a, b = start, end
        if before := sides[0]["bytes"]:
            more = _alike(text[max(start - len(before), 0) : start][::-1], before[::-1])
            a -= more if sides[0]["at"] is None else max(min(more, 2 * start - end - sides[0]["at"]), 0)
        if behind := sides[1]["bytes"]:
            more = _alike(text[end : end + len(behind)], behind)
            b += more if sides[1]["at"] is None else max(min(more, start - sides[1]["at"]), 0)
        while a < start and text[a] & 0xC0 == 0x80:
            a += 1
        while end < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b - a >= least:
            found.append((a, b))
    return merged(found)


def chunk_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_run: int = MIN_RUN, carry: tuple[str, ...] = (),
    to_ends: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``text``.

    ``text`` lacks each run of ``min_run`` or more bytes of chunks that occur before: further up in
    the text, or in the document of the smallest id that has them, which keeps them. Chunk ends
    depend on the bytes around them alone, so they fall alike in all copies of a passage, wherever it
    stands. Whole texts are read. A null text counts as empty; null ids come after all others, and
    rows of one id count as one document. Of other columns, only those of ``carry`` are read.

    With ``to_ends``, each run is first taken on byte by byte to where it ceases to equal the first
    place of its outermost chunks, by ``BEFORE`` and ``BEHIND`` bytes at most, and ``min_run`` holds
    for what comes out; else a repeated passage leaves its ends, which fill no whole chunk.
    """
    spans = repeated_spans(docs, id_column, text_column)

    def describe(texts, found):
        left = [without(t, s).decode("utf-8", "replace") for t, s in zip(texts, found, strict=True)]
        return [[len(t) for t in texts], [sum(b - a for a, b in s) for s in found], [len(s) for s in found], left]

    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, text string"
    if not to_ends:
        return cut_spans(docs, spans.select("k1", "k2", "start", "end"), id_column, text_column, schema, describe, row_key, min_run, carry)
    ends = run_ends(spans)
    met = ends.drop("first").join(surroundings(docs, ends, id_column, text_column), ["d1", "d2", "side"], "left")
    own = (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2"))
    met = materialise(met.select("k1", "k2", "start", "end", "side", F.when(own, F.col("at")).alias("at"), "bytes"), "run-surroundings")
    return cut_spans(docs, met, id_column, text_column, schema, describe, row_key, min_run, carry, stretched)
