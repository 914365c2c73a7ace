"""Token counts of whole texts from piece counts of distinct pre-tokens."""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.llm.shared import blocks, small

#: Fixed value: the pattern by which byte-level BPE tokenizers of this kind cut pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text whose pre-tokens are counted together.
BLOCK_BYTES = 16 << 20
#: Characters of one text that are cut into pre-tokens at once.
PART_CHARS = 1 << 20
MAX_TOKENS = 512


class PieceCounter:
    """The pre-tokens of texts, and the number of pieces of each, as the tokenizer file says.

    Strings of added tokens inside a text are one piece each, which is the library's default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cut = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            raise ValueError("only plain byte-level tokenizers are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.seam = regex.compile(r"(?<=\S) (?=\S)")

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut where a pre-token starts in any case."""
        at = 0
        while len(text) - at > PART_CHARS and (found := self.seam.search(text, at + PART_CHARS)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def frequencies(self, text: str) -> Counter[str]:
        """How often each pre-token occurs in ``text``; an added token is a pre-token."""
        found: Counter[str] = Counter()
        for k, stretch in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                found[stretch] += 1
            else:
                for part in self._parts(stretch):
                    found.update(self.pattern.findall(part))
        return found

    def pieces(self, pre_tokens: list[str]) -> np.ndarray:
        sizes = np.empty(len(pre_tokens), np.int64)
        for at in range(0, len(pre_tokens), 10_000):
            encoded = self.tokenizer.encode_batch_fast(pre_tokens[at : at + 10_000], add_special_tokens=False)
            sizes[at : at + 10_000] = [len(e) for e in encoded]
        return sizes


@functools.cache
def counter_for(path: str) -> PieceCounter:
    return PieceCounter(path)


def block_counts(counter: PieceCounter, texts: list[str]) -> np.ndarray:
    """Tokens of each text: frequencies by text and pre-token, joined to the pieces of the block's
    distinct pre-tokens, summed by text. Token ids are never made."""
    index: dict[str, int] = {}
    keys, counts, rows = [], [], []
    for row, text in enumerate(texts):
        found = counter.frequencies(text)
        keys.append(np.fromiter((index.setdefault(k, len(index)) for k in found), np.int64, len(found)))
        counts.append(np.fromiter(found.values(), np.int64, len(found)))
        rows.append(np.full(len(found), row))
    pieces = counter.pieces(list(index))
    total = np.zeros(len(texts), np.int64)
    np.add.at(total, np.concatenate(rows), pieces[np.concatenate(keys)] * np.concatenate(counts))
    return total


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Counts equal the library's for the whole text, without begin or end tokens, truncation or
    padding. A null text counts as empty and has no token. Repeated rows give repeated rows; null ids
    stay. Other columns are not read. ``path`` must name the same file on every executor.

    Pieces are counted once per distinct pre-token of a block of ``BLOCK_BYTES`` of text, and the
    join to the frequencies stays inside the block: no shuffle, so no hot pre-token, and memory is
    bounded by the block or by one longer text.
    """

    def run(batches):
        counter = counter_for(path)
        for batch in small(batches, 4096):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            encoded = [t.encode() for t in texts]
            sizes = np.fromiter(map(len, encoded), np.int64, len(texts))
            found, at = [], 0
            for block in blocks(encoded, BLOCK_BYTES):
                found.append(block_counts(counter, texts[at : at + len(block)]))
                at += len(block)
            tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    counted = docs.select(F.col(id_column).alias("doc_id"), text_column).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
