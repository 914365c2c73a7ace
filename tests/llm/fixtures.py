"""Rows with every awkward case, and helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, source string, fp bigint, k1 string, size string, _stay string, lot string, along0 string"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghéß") for _ in range(rng.randint(2, 8))) for _ in range(words))


def awkward(spark):
    """Null ids, texts and sources, empty and blank texts, ties, repeated rows, near and exact copies,
    a passage that many texts share, a very long text; clashing column names."""
    rng = random.Random(4)
    base, passage = sentence(rng, 200), sentence(rng, 120)
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", base, base, base.replace(" ", "  ", 1), base + " tail", "\x0b".join(["a b c"] * 30)]
    texts += [f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}" for _ in range(6)]
    texts += [sentence(rng, 300_000), "x" * 70_000, "▁ <|endoftext|> 漢字 🙂", "Licensed under the Apache License, Version 2.0.\n" + base]
    texts += ["ab " * 400, ("line one\n" * 4) + base]
    rows = [(k + 1, t, f"src{k % 3}" if k % 5 else None) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "src1"), (None, None, None), (7, "another text of the same id " + sentence(rng, 80), "src2")]
    return spark.createDataFrame([(*r, 1, "k", "s", "y", "l", "a") for r in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
