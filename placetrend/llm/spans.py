"""Removing spans of bytes from texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.llm.shared import as_bytes, gather_bits, in_bitmap, merged, small, without

#: Bits of the filters that keep rows without a match out of a shuffle. A filter only saves work: it
#: loses no row, and where the data outgrow it more rows are shuffled.
FILTER_BITS = 24

Spans = list[tuple[int, int]]
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def longs(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as pairs of signed longs."""
    return np.frombuffer(b"".join(digests), np.dtype("<i8")).reshape(-1, 2)


def text_key(ids: list, texts: list[bytes]) -> np.ndarray:
    """What stands for a row where only its text counts, so that copies share their spans."""
    return longs([xxhash.xxh3_128_digest(t) for t in texts])


def row_key(ids: list, texts: list[bytes]) -> np.ndarray:
    """What stands for a row where its id and its text count."""
    return longs([xxhash.xxh3_128_digest(f"{i!r}\n".encode() + t) for i, t in zip(ids, texts, strict=True)])


def cut_spans(
    docs: DataFrame,
    spans: DataFrame,
    id_column: str,
    text_column: str,
    schema: str,
    describe: Callable[[list[bytes], list[Spans]], list[list]],
    keys: Callable[[list, list[bytes]], np.ndarray] = text_key,
    least: int = 1,
    carry: tuple[str, ...] = (),
    settle: Callable[[bytes, list[dict], int], Spans] | None = None,
) -> DataFrame:
    """``doc_id`` and what ``describe`` says of every row's text and its merged spans.

    ``spans(k1, k2, start, end)`` may overlap and repeat; touching ones are merged, and merged spans
    below ``least`` bytes are left in. Rows without spans are described where they are; the others
    are shuffled by key, with all spans of their text, which has no more of them than bytes.
    ``describe`` returns one list per field of ``schema``. The columns of ``carry`` come along behind.
    With ``settle``, which is given a text, its rows of ``spans`` and ``least``, that says which merged
    spans go; ``spans`` then has no equal rows, and may have further columns.
    """
    bitmap = gather_bits(spans, "k1", FILTER_BITS)
    parts = [c for c in spans.columns if c not in ("k1", "k2")]
    by_text = (spans if settle else spans.distinct()).groupBy("k1", "k2").agg(F.collect_list(F.struct(*parts)).alias("spans"))
    kind = docs.schema[id_column].dataType.simpleString()
    fields = [f.split() for f in schema.split(",")]
    names, kinds = ["doc_id", *(f[0] for f in fields)], [_ARROW[f[1]] for f in fields]
    along = [f"along{k}" for k in range(len(carry))]
    carried = "".join(f", {a} {docs.schema[c].dataType.simpleString()}" for a, c in zip(along, carry, strict=True))

    def arrays(texts: list[bytes], found: list[Spans]) -> list[pa.Array]:
        return [pa.array(c, k) for c, k in zip(describe(texts, found), kinds, strict=True)]

    def split(batches):
        for batch in small(batches):
            texts = as_bytes(batch.column(1))
            key = keys(batch.column(0).to_pylist(), texts)
            met = in_bitmap(bitmap, key[:, 0].copy())
            for wanted in (False, True):
                at = np.flatnonzero(met == wanted)
                chosen, n = [texts[k] for k in at], len(at)
                own = [pa.array(key[at, 0]), pa.array(key[at, 1]), pa.array(chosen, pa.binary())]
                if wanted:
                    columns = [*(pa.nulls(n, k) for k in kinds), *own]
                else:
                    columns = [*arrays(chosen, [[]] * n), *(pa.nulls(n, c.type) for c in own)]
                kept = [batch.column(k).take(pa.array(at)) for k in (0, *range(2, 2 + len(along)))]
                yield pa.RecordBatch.from_arrays([kept[0], *columns, *kept[1:]], [*names, "k1", "k2", "raw", *along])

    def whole(text: bytes, rows: list[dict], least: int) -> Spans:
        return [s for s in merged([(x["start"], x["end"]) for x in rows]) if s[1] - s[0] >= least]

    def cut(batches):
        for batch in small(batches):
            texts = as_bytes(batch.column(1))
            found = [(settle or whole)(t, x or [], least) for t, x in zip(texts, batch.column(2).to_pylist(), strict=True)]
            kept = batch.columns[3:]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays(texts, found), *kept], [*names, *along])

    out = f"doc_id {kind}, {schema}"
    extra = [F.col(f"`{c}`").alias(a) for a, c in zip(along, carry, strict=True)]
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *extra)
    rows = texts.mapInArrow(split, f"{out}, k1 bigint, k2 bigint, raw binary{carried}")
    moved = rows.where("raw is not null").select("doc_id", "k1", "k2", "raw", *along).join(by_text, ["k1", "k2"], "left")
    cut_rows = moved.select("doc_id", "raw", "spans", *along).mapInArrow(cut, out + carried)
    found = rows.where("raw is null").select(*names, *along).union(cut_rows)
    return found.select(*names, *(F.col(a).alias(c) for a, c in zip(along, carry, strict=True)))


DIGEST = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def digest_of(texts: list[bytes], spans: list[Spans]) -> list[list]:
    return [
        [len(t) for t in texts],
        [sum(b - a for a, b in s) for s in spans],
        [len(s) for s in spans],
        [hashlib.sha256(without(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)],
    ]
