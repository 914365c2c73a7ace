"""SimHash near-duplicate groups, found by the one-bit neighbourhoods of whole fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetrend.llm.components import components
from placetrend.llm.shared import as_bytes, fresh, pieces_of, small
from placetrend.storage import materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 2
BITS = 64
SEED = 42


def _shingles(words: list[bytes], width: int) -> list[bytes]:
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.dtype("<u8"), len(shingles))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes.

    A text of fewer than ``width`` words has one shingle of all its words; without a word the
    fingerprint is zero. The text is read in parts, so a long one needs no large arrays.
    """
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for part in pieces_of(text.lower()):
        words = tail + part.split()
        if len(words) >= width:
            found = _shingles(words, width)
            counts += _bit_counts(found)
            total += len(found)
            words = words[len(words) - width + 1 :]
        tail = words
    if not total and tail:
        counts, total = _bit_counts([b" ".join(tail)]), 1
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""

    def run(batches):
        for batch in small(batches):
            prints = np.array([fingerprint(t, width) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text_column).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _balls(segments: int) -> list[list[int]]:
    """For each segment, the masks of its Hamming ball of radius one, without the centre."""
    size = BITS // segments
    masks = [np.array(1 << i, np.uint64).view(np.int64).item() for i in range(BITS)]
    return [masks[k * size : (k + 1) * size] for k in range(segments)]


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links ``(u, v)`` that connect every two fingerprints of ``prints(fp)`` at ``max_bits`` or fewer.

    In place of tables by segment, a fingerprint enters one table under itself and under each that
    differs from it in one bit. The key is the whole fingerprint, so ``segments`` only orders the
    masks and changes no result. Two fingerprints that differ in one or two bits share a key: one of
    them moves one differing bit, the other moves the other or none. A key has ``BITS + 1`` fingerprints
    at most, so there is no hot bucket, however dense a group of near copies is. Its entries are
    kept as the set of moved bits, in one long. Matches are fetched by key, each entry is linked to
    one of them, and every link's complete distance is verified.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("balls of radius one meet for a distance of 0, 1 or 2 bits")
    flips = [mask for ball in _balls(segments) for mask in ball]
    moved = F.explode(F.array(*[F.lit(m).cast("bigint") for m in [0, *flips]]))
    entries = prints.select("fp", moved.alias("mask")).select(F.expr("fp ^ mask").alias("key"), "mask")
    table = entries.groupBy("key").agg(F.bit_or("mask").alias("bits"), F.max(F.col("mask") == 0).alias("centre"))
    matches = table.where(F.bit_count("bits") + F.col("centre").cast("int") >= 2)
    every = F.array(*[F.lit(m).cast("bigint") for m in flips])
    members = F.transform(F.filter(every, lambda m: F.col("bits").bitwiseAND(m) != 0), lambda m: F.col("key").bitwiseXOR(m))
    hub = F.when(F.col("centre"), F.col("key")).otherwise(F.array_min("members"))
    return (
        matches.withColumn("members", members)
        .select(F.explode("members").alias("u"), hub.alias("v"))
        .where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
        .distinct()
    )


def _rooted(rows: DataFrame, max_bits: int) -> DataFrame:
    """``fp, least, root`` for every fingerprint of ``rows(doc_id, fp)``: its smallest id, its group."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("fp"), max_bits), "near-links")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return materialise(rooted, "near-roots")


def one_per_group(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group.

    The row of the smallest id stays, rows without an id coming last; of several such rows the one of
    the least fingerprint, then that whose text has the least hash.
    """
    id_name, print_name, special, nth = (fresh(docs, n) for n in ("stay", "stay_print", "special", "nth"))
    rows = materialise(fingerprints(docs, id_column, text_column, width), "fingerprints")
    rooted = _rooted(rows, max_bits)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp"))
    kept = rows.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(best.alias("best"))
    # an id that is missing or on several rows does not tell which row stays
    often = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("often"))
    often = materialise(often, "near-repeated-ids")
    stays = kept.select(F.col("best.doc_id").alias(id_name), F.col("best.fp").alias(print_name))
    stays = stays.join(often, F.col(id_name).eqNullSafe(F.col("often")), "left")
    stays = materialise(stays.select(id_name, print_name, (F.col(id_name).isNull() | F.col("often").isNotNull()).alias(special)), "near-kept")
    own = F.col(f"`{id_column}`")
    named = docs.join(stays.where(~F.col(special)), own == F.col(id_name))

    def add_print(batches):
        for batch in small(batches):
            prints = np.array([fingerprint(t, width) for t in as_bytes(batch.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names)

    names, at = [*docs.columns, print_name], docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(print_name, T.LongType())])
    unclear = docs.join(often, own.eqNullSafe(F.col("often")), "left_semi").mapInArrow(add_print, schema)
    wanted = stays.where(special).withColumnRenamed(print_name, nth)
    met = unclear.join(wanted, (F.col(print_name) == F.col(nth)) & own.eqNullSafe(F.col(id_name))).drop(nth)
    any_one = Window.partitionBy(id_name, print_name).orderBy(F.xxhash64(F.col(f"`{text_column}`")))
    one = met.withColumn(nth, F.row_number().over(any_one)).where(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.select(*columns).union(one.select(*columns))


def simhash_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    The component is the smallest id that chains of links of ``max_bits`` or fewer reach, itself
    included. Rows with equal fingerprints are one node of the graph, so copies are never paired.
    Null and empty texts have the fingerprint zero and link like any other. A row with a null id
    stays, and lends its group no id; a group of null ids alone has a null component. Repeated rows
    give repeated rows. Other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_column, text_column, width), "fingerprints")
    rooted = _rooted(rows, max_bits)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
