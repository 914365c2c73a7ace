"""Operators on texts against brute force, on awkward rows and on a test table."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placetrend.llm import chunks, licenses, mixing, pieces, quality, shared, simhash, suffixes, token_counts
from tests.llm.fixtures import awkward, empty, listed, sentence

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(shared.WORD)
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows(spark):
    return awkward(spark)


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source")
    return df, [tuple(r) for r in df.collect()]


@pytest.fixture(params=["rows", "documents"])
def case(request):
    return request.getfixturevalue(request.param)


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(shingles))


def plain_groups(prints, bits=2):
    known = sorted(set(prints))
    root = {p: p for p in known}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(p) for p in prints]


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash_groups(spark, case, bits):
    df, table = case
    prints = [plain_fingerprint(t) for _, t, _ in table]
    groups = plain_groups(prints, bits)
    least = defaultdict(list)
    for (i, _, _), g in zip(table, groups, strict=True):
        least[g] += [i] if i is not None else []
    expected = [(i, f"{p:016x}", min(least[g], default=None)) for (i, _, _), p, g in zip(table, prints, groups, strict=True)]
    found = simhash.simhash_groups(df, max_bits=bits)
    assert listed(found, "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


def test_simhash_links_dense_groups_without_pairs(spark):
    """Every fingerprint at up to three bits from a centre: one group, and links in proportion."""
    balls = {0} | {1 << a | 1 << b | 1 << c for a in range(64) for b in range(a, 64) for c in (0, 31, 32, 63)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in balls]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint"))
    assert links.count() < 70 * len(balls)
    from placetrend.llm.components import components

    found = components(links)
    assert found.count() == len(balls) and found.select("root").distinct().count() == 1


def test_one_per_group_keeps_whole_rows(spark, rows):
    df, table = rows
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    groups = plain_groups([plain_fingerprint(t) for _, t, _ in table])
    assert kept.count() == len(set(groups))
    ids = [(r.doc_id, plain_fingerprint(r.text)) for r in kept.collect()]
    assert len(ids) == len(set(ids)) and (7, plain_fingerprint(table[6][1])) in ids


def test_token_counts_equal_the_library(spark, case):
    df, table = case
    library = Tokenizer.from_file(BPE)
    expected = [
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in table
    ]
    assert listed(token_counts.token_counts(df, BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)


def test_long_texts_are_cut_where_a_pre_token_starts(monkeypatch):
    monkeypatch.setattr(token_counts, "PART_CHARS", 3)
    counter, library = token_counts.PieceCounter(BPE), Tokenizer.from_file(BPE)
    for text in ("a  b c\n d's it  ", "don't  stop\t now 12 34 !! <|endoftext|>x", " \n \n a"):
        assert token_counts.block_counts(counter, [text])[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_pieces_equal_the_library_and_round_trip(spark, case):
    df, table = case
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = pieces.encode_texts(df, PIECES)
    expected = sorted([(i, library.encode(t or ""), "▁" not in (t or "")) for i, t, _ in table], key=repr)
    assert sorted([(r.doc_id, r.ids, r.round_trip) for r in coded.collect()], key=repr) == expected
    back = pieces.decode_ids(coded.where("round_trip"), PIECES)
    assert listed(back, "doc_id", "text") == sorted([(i, t or "") for i, t, _ in table if "▁" not in (t or "")], key=repr)


def test_a_worker_keeps_few_stretches_of_many():
    model = pieces.PieceModel(PIECES)
    for start in range(0, 300_000, 1000):
        model.encode(" ".join(f"{k:x}" for k in range(start, start + 1000)))
    assert len(model.stretches) + len(model.older) <= 1 << 18


def test_a_stretch_is_searched_in_units_that_no_piece_reaches_over(monkeypatch):
    rng, model = random.Random(12), pieces.PieceModel(PIECES)
    words = [sentence(rng, 1) for _ in range(30)]
    text = " ".join(f"{a}\n{b}" for a in words for b in words)
    searched = []
    original = model._search
    monkeypatch.setattr(model, "_search", lambda s, out: searched.append(s) or original(s, out))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert model.encode(text).tolist() == library.encode(text)
    assert len(searched) < 200  # 900 stretches, one by one, before


def test_parts_of_a_text_give_the_same_pieces(monkeypatch):
    rng, library = random.Random(13), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [sentence(rng, 60), " " * 40 + "a  b   c" * 9, "x" * 90 + "  y" * 30 + " ", "▁▁a ▁ b▁c " * 9]
    monkeypatch.setattr(pieces, "PART_CHARS", 5)
    assert [pieces.PieceModel(PIECES).encode(t).tolist() for t in texts] == [library.encode(t) for t in texts]


def plain_base(text):
    words = WORDS.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_counts(spark, case):
    df, table = case
    found = quality.quality_rules(df, None)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    expected = [(i, *(b := plain_base(t)), not b[-1]) for i, t, _ in table]
    assert listed(found, *columns) == sorted(expected, key=repr)
    assert quality.keep_good(df, None).count() == sum(e[-1] for e in expected)


def test_quality_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    model = quality.train(docs, even)
    judged = quality.quality_rules(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right, total = judged.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right / total > 0.95
    assert quality.train(docs, labels.where("quality = 1")) is None
    first = labels.where("quality = 1").first().doc_id
    often = docs.where(F.col("doc_id") == first).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(400)))).withColumn("text", F.concat("text", F.lit(" "), "k")).drop("k")
    assert len(quality.labelled_sample(docs.union(often), labels, "doc_id", "text", "quality", 50)) == 50
    assert quality.train(docs, labels.limit(0)) is None


def plain_removed(texts, width):
    counts = Counter(t[p : p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if counts[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, case):
    df, table = case
    table = [(i, t if t is None or len(t) < 100_000 else t[:3000]) for i, t, _ in table]
    df = spark.createDataFrame(table, "doc_id bigint, text string").withColumn("k1", F.lit("clash"))
    expected = [(i, *e) for (i, _), e in zip(table, plain_removed([(t or "").encode() for _, t in table], 400), strict=True)]
    found = suffixes.suffix_dedup(df)
    assert listed(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_suffixes_name_only_what_a_step_asks_for(monkeypatch):
    rng, made, join = np.random.default_rng(3), [], suffixes._join
    data = rng.integers(97, 99, 1500, np.uint8).tobytes() * 2
    monkeypatch.setattr(suffixes, "_join", lambda a, b, lane: made.append(len(a)) or join(a, b, lane))
    nodes = suffixes.Nodes([(0, 0, data)], 400)
    assert sum(made) <= 3 * len(data)  # the anchors need one lane, at one depth
    at = np.arange(len(data) - 399)
    for length in (385, 400):
        names = {}
        for p, *name in zip(at.tolist(), *nodes.suffixes.names([at], [length])[0], strict=True):
            assert names.setdefault(data[p : p + length], name) == name
        assert len({tuple(x) for x in names.values()}) == len(names)
    assert all((a == b).all() for a, b in zip(nodes.all_names(), nodes.shared_names(), strict=False))


def test_suffix_parts_of_a_long_text_overlap(spark, monkeypatch, rows):
    monkeypatch.setattr(suffixes, "PART", 700)
    table = [(i, t[:5000] if t else t) for i, t, _ in rows[1]]
    expected = plain_removed([(t or "").encode() for _, t in table], 400)
    nodes = [n for t in table if t[1] for n in suffixes._parts([t[1].encode()], 400)]
    assert all(len(p[2]) <= 700 + 399 for g in nodes for p in g)
    covered = sum(max(len(t[1].encode()) - 399, 0) for t in table if t[1])
    windows = sum(int((n.last - n.start + 1).sum()) for n in (suffixes.Nodes(g, 400) for g in nodes))
    assert windows == covered and expected


def test_chunk_dedup(spark, rows):
    df, table = rows
    found = chunks.chunk_dedup(df, carry=("source",))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "text", "source"] and found.count() == len(table)
    seen: dict[bytes, int] = {}
    texts = {(i, t or "") for i, t, _ in table}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        data = t.encode()
        ends = chunks.chunk_ends([data])[0]
        own = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(own) == data and all(len(c) <= chunks.GREATEST for c in own)
        here: set[bytes] = set()
        flags = []
        for c in own:
            flags.append((c in seen and seen[c] != i) or c in here)
            here.add(c)
        for c in own:
            seen.setdefault(c, i)
        kept, k = [], 0
        while k < len(own):
            j = k
            while j < len(own) and flags[j]:
                j += 1
            if sum(map(len, own[k:j])) < chunks.MIN_RUN:
                kept += own[k:j]
            kept += own[j : j + 1]
            k = j + 1
        got = {r.text for r in found.where(F.col("doc_id").eqNullSafe(F.lit(i))).collect() if r.n_bytes == len(data)}
        assert b"".join(kept).decode() in got, i


def test_shared_passages_leave_all_texts_but_the_first(spark, rows):
    df, table = rows
    found = {r.doc_id: r.text for r in chunks.chunk_dedup(df.where("doc_id between 12 and 17")).collect()}
    whole = {i: t for i, t, _ in table if i in found}
    assert found[12] == whole[12]
    assert all(len(found[i]) < len(whole[i]) - 400 for i in range(13, 18))


def test_planted_passages_go_to_their_ends(spark):
    """Passages of 51 to 60 words between other words in two documents: all leave the second, whole."""
    rng = random.Random(11)
    passages = [sentence(rng, 51 + k % 10) for k in range(400)]
    table = [(k + 400 * j, f"{sentence(rng, rng.randint(3, 40))}. {p} | {sentence(rng, rng.randint(3, 40))}") for j in (0, 1) for k, p in enumerate(passages)]
    found = {r.doc_id: r for r in chunks.chunk_dedup(spark.createDataFrame(table, "doc_id int, text string"), to_ends=True).collect()}
    plain = {r.doc_id: r for r in chunks.chunk_dedup(spark.createDataFrame(table, "doc_id int, text string")).collect()}
    wanted = [(len(p.encode()), found[k + 400].n_removed, plain[k + 400].n_removed) for k, p in enumerate(passages)]
    assert all(found[k].text == t for k, t in table[:400])
    assert sum(n <= got <= n + 8 for n, got, _ in wanted) >= 0.98 * len(wanted) and all(got > 0.5 * n for n, got, _ in wanted)
    assert sum(got for _, got, _ in wanted) > 1.1 * sum(less for _, _, less in wanted)


def test_stretched_runs_spare_the_earlier_place_and_characters():
    rng = random.Random(12)
    head, passage = (sentence(rng, 30) + " é").encode(), (sentence(rng, 60) + " é").encode()
    text, size, at = head + passage + passage, len(passage), len(head)
    run = {"start": at + size + 40, "end": at + 2 * size}
    ends = [{**run, "side": 0, "at": at + 40, "bytes": text[: at + 40]}, {**run, "side": 1, "at": at + size, "bytes": text[at + size :][:64]}]
    assert chunks.stretched(text, ends, 128) == [(at + size, at + 2 * size)]  # not the " é" before, which is the first copy's own
    other = "x" * 40 + "ß" + "y" * 200 + "é" + "z" * 9
    data, run = other.encode(), {"start": 60, "end": 200, "at": None}
    cut = [{**run, "side": 0, "bytes": b"\x9f" + data[42:60]}, {**run, "side": 1, "bytes": data[200:242] + b"\xc3\xaa"}]
    assert chunks.stretched(data, cut, 128) == [(42, 242)] and chunks.stretched(data, cut, 201) == []


def test_mixing_targets_and_draws(spark, case):
    df, table = case
    sizes = [len(WORDS.findall(t or "")) for _, t, _ in table]
    by_source = defaultdict(int)
    for (_, _, s), n in zip(table, sizes, strict=True):
        by_source[s] += n
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * by_source[s] for s in capped)) / sum(weight[s] for s in free)
        if not (over := {s for s in free if level * weight[s] > 3 * by_source[s]}):
            break
        capped |= over
    target = {s: 3 * by_source[s] if s in capped else level * weight[s] for s in names}
    drawn = mixing.mix_draws(df).collect()
    assert sorted(r.size for r in drawn) == sorted(sizes)
    taken = defaultdict(int)
    for r in drawn:
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(target[r.source])
        assert [d["copy"] for d in r.draws] == list(range(len(r.draws))) and len(r.draws) <= 3
        taken[r.source] += r["size"] * len(r.draws)
    for s in names:  # whole texts only: half of the largest is the most that can be missing
        assert abs(taken[s] - target[s]) <= max(n for (_, _, x), n in zip(table, sizes, strict=True) if x == s) / 2 + 1
    again = mixing.mix_draws(df)
    assert listed(again, "doc_id", "size", "draws") == sorted([(r.doc_id, r["size"], r.draws) for r in drawn], key=repr)
    assert mixing.mixture(df).columns == df.columns
    assert mixing.mixture(df).count() == sum(len(r.draws) for r in drawn)


def test_rows_without_an_id_are_drawn_apart(spark):
    """A third of a source has no id, another third one id: its target is still met."""
    rng = random.Random(21)
    table = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, sentence(rng, rng.randint(1, 30)), "a" if k % 5 else "b") for k in range(3000)]
    drawn = mixing.mix_draws(spark.createDataFrame(table, "doc_id int, text string, source string")).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in drawn:
        taken[r.source] += r["size"] * len(r.draws)
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


def test_a_shard_is_one_task(spark):
    docs = spark.createDataFrame([(k, "word " * (1 + k % 50)) for k in range(2000)], "doc_id int, text string").withColumn("source", F.lit("s"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "SHARD_WORDS", 4000)
        patch.setattr(mixing, "BLOCK_WORDS", 100)
        sizes = mixing.mixture(docs).groupBy(F.spark_partition_id().alias("p")).agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert len(sizes) == 16 and max(r.n for r in sizes) < 1.5 * min(r.n for r in sizes)


def test_splitting_tree_keeps_quotas_and_halves_blocks(spark):
    quotas = [(1, 1000), (2, 0), (3, 37), (4, 1)]
    ends = {r["rank"]: r.ends for r in mixing.shard_quotas(spark.createDataFrame(quotas, "rank int, quota bigint"), 8).collect()}
    parts = {k: [b - a for a, b in zip([0, *e[:-1]], e, strict=True)] for k, e in ends.items()}
    assert all(sum(parts[k]) == q and min(parts[k]) >= 0 for k, q in quotas)
    totals = [sum(parts[k][s] for k, _ in quotas) for s in range(8)]
    assert max(totals) - min(totals) <= 1
    many = spark.range(400).select(F.lit(20).cast("bigint").alias("n"), F.lit(8).cast("bigint").alias("m"), F.lit(10).cast("bigint").alias("d"), ((F.col("id") + 0.5) / 400).alias("u"))
    draws = many.select(mixing._hypergeometric(F.col("n"), F.col("m"), F.col("d"), F.col("u")).alias("x")).agg(F.avg("x"), F.variance("x")).first()
    assert draws[0] == pytest.approx(4.0, abs=0.05) and draws[1] == pytest.approx(10 * 0.4 * 0.6 * 10 / 19, abs=0.1)


def test_licenses(spark):
    notice = "Released under the MIT License."
    table = [
        (1, "a/LICENSE", notice), (2, "a/x.py", "code"), (3, "a/b/y.py", "code"), (4, "a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."),
        (5, "a/b/c/z.py", "# Licensed under the Apache License,\n# Version 2.0.\ncode follows here and more"), (6, "c/z.py", "mit license words"),
        (7, None, None), (8, "a/b/c/w.py", ""), (8, "a/b/c/w.py", ""), (None, "c/q", "Mit der"), (9, "c/d.md", ("word " * 9000) + "\n" + notice),
    ]
    df = spark.createDataFrame(table, "doc_id int, path string, text string").withColumn("dir", F.lit("clash"))
    found = {(r.doc_id, r.path): (r.license, r.basis) for r in licenses.license_scan(df).collect()}
    assert licenses.license_scan(df).count() == len(table)
    assert found == {
        (1, "a/LICENSE"): ("MIT", "notice"), (2, "a/x.py"): ("MIT", "inherited"), (3, "a/b/y.py"): ("CC-BY-NC-4.0", "inherited"),
        (4, "a/b/LICENSE.txt"): ("CC-BY-NC-4.0", "notice"), (5, "a/b/c/z.py"): ("Apache-2.0", "notice"), (6, "c/z.py"): (None, None),
        (7, None): (None, None), (8, "a/b/c/w.py"): ("CC-BY-NC-4.0", "inherited"), (None, "c/q"): (None, None), (9, "c/d.md"): ("MIT", "notice"),
    }


STATEMENTS = [
    ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MIT", "Copyright (c) 2021 Acme Corp. Licensed under the MIT License."), ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("Apache-2.0", "Copyright 2019 Someone LLC. Licensed under the Apache License, Version 2.0."), ("MIT", "This file is licensed under the MIT License, see LICENSE for details."),
    ("GPL-3.0", "License: GPL-3.0"), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("Apache-2.0", "Apache License\n   Version 2.0, January 2004"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or later"),
    ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0, licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without permission."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0."), (None, "we had a license to print money"), (None, "mit der Version 2.0"), (None, "general public, version 3"), (None, "the MPL and the GPL"),
]


def prose(rng, n):
    return " ".join(rng.choice("of the and to under mit license version a public work is 2 4 general der work software terms copy use".split()) if rng.random() < 0.3 else sentence(rng, 1) for _ in range(n))


def plain_licenses(table, threshold=0.8):
    """Best template and cosine of each text, window by window."""
    texts = [licenses.terms_of(t or "") for _, _, t in table]
    df = Counter(t for x in texts for t in set(x))
    idf = {t: math.log((1 + len(table)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for terms in texts:
        best = (0.0, 0, None)
        for k, template in enumerate(licenses.TEMPLATES):
            own = licenses.terms_of(template.text)
            of = lambda t: idf.get(t, math.log(1 + len(table)) + 1)
            anchor = max(sorted(set(own)), key=of)
            vector = {t: own.count(t) * of(t) for t in own}
            for i, t in enumerate(terms):
                for place in (p for p, x in enumerate(own) if x == anchor and t == anchor):
                    a, b = max(i - place, 0), i - place + len(own)
                    window, near = terms[a:b], terms[max(i - place - licenses.AROUND, 0) : b + licenses.AROUND]
                    if len(window) >= licenses.COVERED * len(own) and set(template.needed) <= set(window) and not set(template.barred) & set(near):
                        w = {x: window.count(x) * idf[x] for x in window}
                        dot = sum(w[x] * vector.get(x, 0) for x in w)
                        cosine = round(dot / math.sqrt(sum(v * v for v in w.values())) / math.sqrt(sum(v * v for v in vector.values())), 9)
                        best = max(best, (cosine, -k, template.name))
        out.append((best[2], best[0]) if best[0] >= threshold else (None, None))
    return out


def test_each_license_and_its_variants_equal_plain_cosines(spark):
    rng = random.Random(31)
    texts = [t for _, t in STATEMENTS] + [f"{prose(rng, 60)} {t} {prose(rng, 60)}" for _, t in STATEMENTS if _] + [prose(rng, 200) for _ in range(40)]
    texts += ["", None, texts[0], "License: " + "MIT " * 3, "Licensed under the Apache", "Licensed under the strange and wonderful Apache License, Version 2.0"]
    table = [(k, f"d{k}/f.txt", t) for k, t in enumerate(texts)]
    found = {r.doc_id: (r.license, r.score) for r in licenses.license_scan(spark.createDataFrame(table, "doc_id int, path string, text string")).collect()}
    want = plain_licenses(table)
    assert [found[k][0] for k in range(len(STATEMENTS))] == [name for name, _ in STATEMENTS]
    for k, (name, score) in enumerate(want):
        assert found[k] == (name, None if score is None else pytest.approx(score, abs=1e-6)), texts[k]


def test_only_named_files_give_their_license_on(spark):
    mit, gpl = "Released under the MIT License.", "License: GPL-3.0"
    table = [
        (1, "p/a.py", mit), (2, "p/b.py", "code"), (3, "q/COPYING", gpl), (4, "q/r/s/x.c", "code"), (5, "q/LICENSE.md", "no licence at all"), (6, None, mit), (7, "top.txt", "code"),
        (8, "t/LICENSE", mit), (9, "t/licence-old", gpl), (10, "t/y", "code"), (11, "q/r/s/x.c", "code"), (12, "qq/z", "code"),
    ]
    found = {r.doc_id: (r.license, r.basis) for r in licenses.license_scan(spark.createDataFrame(table, "doc_id int, path string, text string")).collect()}
    assert found == {
        1: ("MIT", "notice"), 2: (None, None), 3: ("GPL-3.0", "notice"), 4: ("GPL-3.0", "inherited"), 5: ("GPL-3.0", "inherited"), 6: ("MIT", "notice"), 7: (None, None),
        8: ("MIT", "notice"), 9: ("GPL-3.0", "notice"), 10: ("GPL-3.0", "inherited"), 11: ("GPL-3.0", "inherited"), 12: (None, None),
    }


@pytest.mark.parametrize("name", ["simhash", "tokens", "pieces", "quality", "suffix", "chunk", "draws", "mixture", "one", "license"])
def test_empty_tables(spark, name):
    df = empty(spark)
    run = {
        "simhash": lambda: simhash.simhash_groups(df), "tokens": lambda: token_counts.token_counts(df, BPE), "pieces": lambda: pieces.encode_texts(df, PIECES),
        "quality": lambda: quality.quality_rules(df, None), "suffix": lambda: suffixes.suffix_dedup(df), "chunk": lambda: chunks.chunk_dedup(df),
        "draws": lambda: mixing.mix_draws(df), "mixture": lambda: mixing.mixture(df), "one": lambda: simhash.one_per_group(df),
        "license": lambda: licenses.license_scan(df, path_column="k1"),
    }
    assert run[name]().count() == 0
