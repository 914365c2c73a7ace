"""Licences of files: TF-IDF cosine to templates, and inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend.storage import materialise


@dataclass(frozen=True)
class Template:
    """A notice. Terms that tell it from a variant must be in the text, those of variants must not."""

    name: str
    text: str
    needed: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()


NC, SA, ND = ("nc", "noncommercial"), ("sa", "sharealike"), ("nd", "noderivatives", "noderivs")
NOT_PLAIN_GPL = ("lesser", "library", "affero")

#: Identifiers, for notices of the form "SPDX-License-Identifier: MIT" or "License: MIT".
IDENTIFIERS = (
    "Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "Unlicense",
)

#: Notices and titles by which widely used licences are named.
NOTICES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("2",)),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", ("2",)),
    Template("Apache-2.0", "Apache License 2.0", ("2",)),
    Template("MIT", "Released under the MIT License"),
    Template("MIT", "This project is licensed under the MIT License"),
    Template("MIT", "Licensed under the MIT License"),
    Template("MIT", "Distributed under the MIT License"),
    Template("MIT", "The MIT License (MIT)"),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("GPL-3.0", "licensed under the GNU General Public License, version 3", ("3",), NOT_PLAIN_GPL),
    Template("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", ("3",), NOT_PLAIN_GPL),
    Template("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("3",), NOT_PLAIN_GPL),
    Template("GPL-2.0", "licensed under the GNU General Public License, version 2", ("2",), NOT_PLAIN_GPL),
    Template("GPL-2.0", "GNU General Public License Version 2, June 1991", ("2",), NOT_PLAIN_GPL),
    Template("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", ("2",), NOT_PLAIN_GPL),
    Template("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ("lesser", "3")),
    Template("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", ("lesser", "3")),
    Template("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("lesser", "3")),
    Template("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1", ("lesser", "2", "1")),
    Template("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", ("lesser", "2", "1")),
    Template("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", ("lesser", "2", "1")),
    Template("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero", "3")),
    Template("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", ("affero", "3")),
    Template("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("affero", "3")),
    Template("BSD-3-Clause", "BSD 3-Clause License", ("3",)),
    Template("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    Template("BSD-2-Clause", "BSD 2-Clause License", ("2",)),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("2",)),
    Template("MPL-2.0", "Mozilla Public License Version 2.0", ("2",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0", ("4",), NC + SA + ND),
    Template("CC-BY-4.0", "Creative Commons Attribution 4.0 International", ("4",), NC + SA + ND),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("sa", "4"), NC + ND),
    Template("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", ("sharealike", "4"), NC + ND),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("nc", "4"), SA + ND),
    Template("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", ("noncommercial", "4"), SA + ND),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0", ("nd", "4"), NC + SA),
    Template("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", ("noderivatives", "4"), NC + SA),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0", ("nc", "sa", "4"), ND),
    Template("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", ("noncommercial", "sharealike", "4"), ND),
    Template("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0", ("nc", "nd", "4"), SA),
    Template("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", ("noncommercial", "noderivatives", "4"), SA),
    Template("CC0-1.0", "Released under CC0 1.0", ("cc0",)),
    Template("CC0-1.0", "CC0 1.0 Universal", ("cc0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Cosine from which some terms of a text count as a licence's notice.
THRESHOLD = 0.8
#: Share of a template's length that a stretch at an end of the text must have.
COVERED = 0.8
#: Terms on either side in which a variant's term bars a template.
AROUND = 2
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([._-].*)?$"
NOT_TERM = "[^a-z0-9]+"


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(NOT_TERM, text.lower()) if t]


def _identified(name: str) -> list[Template]:
    """Notices that give an identifier; all their terms must be there, and no variant's."""
    own = tuple(terms_of(name))
    barred = tuple(t for v in (NC, SA, ND) if not set(v) & set(own) for t in v) if "cc" in own else ()
    labels = ("SPDX-License-Identifier", "License")
    return [Template(name, f"{label}: {name}", tuple(dict.fromkeys((*terms_of(label), *own))), barred) for label in labels]


TEMPLATES = (*NOTICES, *(t for name in IDENTIFIERS for t in _identified(name)))


class Weighed:
    """The templates as sparse unit vectors under the document frequencies of a corpus."""

    def __init__(self, templates: Sequence[Template], frequency: dict[str, int], documents: int, threshold: float):
        self.templates, self.threshold = templates, threshold
        self.terms = [terms_of(t.text) for t in templates]
        self.weights: list[dict[str, float]] = []
        #: The rarest term of each template, by which a text's windows are laid, and its places there.
        self.anchors: list[tuple[str, list[int]]] = []
        for terms in self.terms:
            idf = {t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1 for t in terms}
            raw = {t: terms.count(t) * idf[t] for t in idf}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            self.weights.append({t: w / norm for t, w in raw.items()})
            rarest = max(sorted(idf), key=lambda t: idf[t])
            self.anchors.append((rarest, [k for k, t in enumerate(terms) if t == rarest]))

    def _literal(self, rows: list[tuple], names: tuple[str, ...]) -> Column:
        def value(x) -> Column:
            return F.array(*[F.lit(y) for y in x]) if isinstance(x, list) else F.lit(x)

        return F.array(*[F.struct(*[value(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows])

    def may_come_near(self, met: Column) -> Column:
        """False only for terms that no template comes near to: a cosine is at most the length of the part
        of the template that they have. ``met`` is the terms, of which those of templates are looked at."""
        known = F.array(*[F.lit(t) for t in sorted({t for w in self.weights for t in w})])
        tables = self._literal([(list(w), [x * x for x in w.values()]) for w in self.weights], ("terms", "squares"))
        least = self.threshold**2 * 0.999

        def near(found: Column) -> Column:
            def enough(table: Column) -> Column:
                parts = F.zip_with(table["terms"], table["squares"], lambda t, w: F.when(F.array_contains(found, t), w).otherwise(0.0))
                return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) >= least

            return F.exists(tables, enough)

        return F.transform(F.array(F.array_intersect(met, known)), near)[0]

    def windows(self, terms: Column) -> Column:
        """``(template, at, words)``: around every anchor in the terms, as many as the template has, where the
        needed terms are among them and no barred one is near."""
        some, none = F.lit("\0"), F.array().cast("array<string>")
        laid = [
            (k, anchor, place, len(own), list(t.needed) or ["\0"], list(t.barred) or ["\0"])
            for k, (t, own, (anchor, places)) in enumerate(zip(self.templates, self.terms, self.anchors, strict=True))
            for place in places
        ]
        table = self._literal(laid, ("template", "anchor", "place", "length", "needed", "barred"))
        numbered = F.zip_with(terms, F.sequence(F.lit(1), F.size(terms)), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        anchors = F.array(*[F.lit(a) for a in sorted({a for a, _ in self.anchors})])
        hits = F.filter(numbered, lambda x: F.array_contains(anchors, x["t"]))

        def around(x: Column) -> Column:
            def window(a: Column) -> Column:
                first = x["i"] - a["place"]
                begin = F.greatest(first, F.lit(1))
                wide = F.greatest(first - AROUND, F.lit(1))
                words = F.slice(terms, begin, first + a["length"] - begin)
                near = F.slice(terms, wide, first + a["length"] + AROUND - wide)
                ok = (F.size(words) >= COVERED * a["length"]) & (F.size(F.array_except(a["needed"], F.array_append(words, some))) == 0) & ~F.arrays_overlap(near, a["barred"])
                return F.struct(a["template"].alias("template"), first.alias("at"), F.when(ok, words).otherwise(none).alias("words"))

            return F.filter(F.transform(F.filter(table, lambda a: a["anchor"] == x["t"]), window), lambda w: F.size(w["words"]) > 0)

        return F.flatten(F.transform(hits, around))


def _split(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")


def _constant(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A table of constants, written into the plan."""
    structs = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def document_frequencies(files: DataFrame, text_column: str) -> DataFrame:
    """``term, n``: how many rows have each term. Every task adds up its own rows before the shuffle."""
    terms = F.explode(F.array_distinct(_split(F.col(text_column).cast("string")))).alias("term")
    return files.select(terms).groupBy("term").agg(F.count("*").alias("n"))


def _cosines(windows: DataFrame, known: Weighed, frequencies: DataFrame, documents: int) -> DataFrame:
    """``key, template, cosine`` of the windows ``(key, template, at, words)``."""
    spark = windows.sparkSession
    weights = _constant(spark, ("template", "term", "weight"), [(k, t, w) for k, own in enumerate(known.weights) for t, w in own.items()])
    each = windows.select("key", "template", "at", F.explode("words").alias("term")).groupBy("key", "template", "at", "term").agg(F.count("*").alias("tf"))
    idf = F.ln((1.0 + documents) / (1.0 + F.col("n"))) + 1.0
    weighed = each.join(frequencies, "term").select("key", "template", "at", "term", (F.col("tf") * idf).alias("w"))
    # the weights are constants of this module, under two thousand rows
    met = weighed.join(F.broadcast(weights), ["template", "term"], "left")
    sums = met.groupBy("key", "template", "at").agg(F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.select("key", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"))


def license_scan(
    files: DataFrame,
    id_column: str = "doc_id",
    path_column: str = "path",
    text_column: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``files``: ``doc_id``, ``path``, ``license``, ``basis``, ``score``.

    ``basis`` is ``notice`` if a stretch of the whole text, of as many terms as a template, comes near it,
    else ``inherited`` if a directory above the file has a licence file, the nearest such directory counting,
    else null. A licence file is one with a licence's file name and a notice. A notice may stand in a line
    with other words or be wrapped; it must have the terms that tell its licence from a variant. The nearest
    template wins; a tie goes to the earlier one, in a directory to the better score, then to the licence
    first in code-point order. An inherited licence has its file's score. Terms weigh by the share of all
    rows that have them.

    A null or empty text has no notice; a null path is a file of the root directory. Repeated rows
    give repeated rows, null ids stay, other columns are not read. Only built-in functions are used:
    whole texts are searched for the terms that a notice must have, and only around the rarest of these
    are stretches compared. Equal texts are compared once. Directories join by path, one row per directory.
    """
    spark = files.sparkSession
    frequencies = materialise(document_frequencies(files, text_column), "license-terms")
    documents = files.count()
    words = sorted({t for x in templates for t in terms_of(x.text)})
    found = frequencies.join(F.broadcast(_constant(spark, ("term",), [(w,) for w in words])), "term").collect()  # the templates' terms only
    known = Weighed(templates, {r.term: r.n for r in found}, documents, threshold)

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_column).cast("string"), F.lit(""))
    anchors = F.array(*[F.lit(a) for a in sorted({a for a, _ in known.anchors})])
    terms = _split(text)
    rows = files.select(
        F.col(id_column).alias("doc_id"),
        F.col(path_column).alias("path"),
        F.regexp_replace(path, "/?[^/]*$", "").alias("dir"),
        F.regexp_extract(path, "([^/]*)$", 1).rlike(LICENSE_FILE).alias("named"),
        F.concat_ws("-", F.xxhash64(text), F.hash(text)).alias("key"),
        F.transform(F.array(terms), lambda t: F.when(F.arrays_overlap(t, anchors), F.when(known.may_come_near(t), t)))[0].alias("terms"),
    )
    rows = materialise(rows, "license-rows")
    texts = rows.where("terms IS NOT NULL").groupBy("key").agg(F.first("terms").alias("terms"))
    windows = texts.select("key", F.inline(known.windows(F.col("terms"))))
    windows = materialise(windows.where(known.may_come_near(F.col("words"))), "license-windows")
    near = _cosines(windows, known, frequencies, documents).where(F.col("cosine") >= threshold)
    best = F.max(F.struct("cosine", (-F.col("template")).alias("least"))).alias("best")
    names = F.array(*[F.lit(t.name) for t in templates])
    own = near.groupBy("key").agg(best).select("key", F.element_at(names, 1 - F.col("best.least")).alias("own"), F.col("best.cosine").alias("own_score"))
    held = materialise(rows.drop("terms").join(materialise(own, "license-notices"), "key", "left"), "license-own")

    better = F.min(F.struct((-F.col("own_score")).alias("worse"), F.col("own"))).alias("best")
    dirs = held.where("own IS NOT NULL AND named").groupBy("dir").agg(better)
    dirs = dirs.select(F.col("dir").alias("above"), F.col("best.own").alias("license"), (-F.col("best.worse")).alias("score"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = held.where("own IS NULL").select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = asked.join(dirs, "above").groupBy("dir").agg(F.max(F.struct("depth", "license", "score")).alias("near"))
    given = nearest.select("dir", F.col("near.license").alias("given"), F.col("near.score").alias("given_score"))
    # written, so that the join can split a directory of very many files
    given = materialise(given, "license-directories")
    basis = F.when(F.col("own").isNotNull(), "notice").when(F.col("given").isNotNull(), "inherited")
    return held.join(given, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("own", "given").alias("license"),
        basis.alias("basis"),
        F.when(F.col("own").isNotNull(), F.col("own_score")).otherwise(F.col("given_score")).alias("score"),
    )
