"""Small helpers that several operators of this package use."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that an array computation takes at once.
BLOCK = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds copies of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces_of(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` cut at white space into parts of about ``size`` bytes; no word is cut."""
    at = 0
    while len(data) - at > size:
        found = SPACE.search(data, at + size)
        if found is None:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def blocks(texts: Iterable[bytes], size: int = BLOCK) -> Iterator[list[bytes]]:
    """Consecutive texts together, up to ``size`` bytes unless one text alone is longer."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def gather_bits(hashes: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bitmap in which the bits that ``column``'s values point at are set.

    At most ``2 ** (log2_bits - 6)`` rows reach the driver, whatever the size of ``hashes``.
    """
    slot = F.pmod(F.col(column), F.lit(1 << log2_bits))
    found = (
        hashes.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (log2_bits - 6), np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the ``int64`` values may be among those the bitmap was made of."""
    slot = values.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-touching spans with the same bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` less its merged ``spans``."""
    at, kept = 0, []
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
