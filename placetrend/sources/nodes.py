"""Snapshots of tagged map nodes.

Landed parquet tables are the main input. XML extracts are cut at every tag by the text reader's record
delimiter, so that one large extract is read by many tasks, and are landed as parquet in that one pass;
a node that lies across two splits is put together from what their tasks have seen of it.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from xml.sax.saxutils import unescape

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from placetrend.functions.geo import valid_location
from placetrend.functions.text import year_from_name
from placetrend.sources.contract import require_columns
from placetrend.storage import file_system, materialise

log = logging.getLogger(__name__)

NODE_COLUMNS = ("id", "lat", "lon", "tags")
XML_NAMES = (".osm", ".xml")

#: What a tag may begin with, after its ``<``, to matter: nodes, their tags, what else holds tags, comments.
_STARTS = r"^(/?(node|way|relation)|tag)[\s/>]|^!--|-->"
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_NUMBERED = re.compile(r"&#(x[0-9a-fA-F]+|[0-9]+);")
_QUOTES = {"&quot;": '"', "&apos;": "'"}
_CUT_SCHEMA = (
    "id BIGINT, lat DOUBLE, lon DOUBLE, keys ARRAY<STRING>, texts ARRAY<STRING>, "
    "snapshot STRING, file STRING, start BIGINT, part STRING"
)
_STRINGS = pa.list_(pa.string())
_CUT_FIELDS = pa.schema(
    [("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("keys", _STRINGS), ("texts", _STRINGS),
     ("snapshot", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("part", pa.string())]
)


def _attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag, with character references decoded; white space in them is a space."""
    found = {}
    for name, double, single in _ATTRIBUTE.findall(tag):
        plain = (double or single).replace("\t", " ").replace("\n", " ").replace("\r", " ")
        if "&" in plain:
            plain = _NUMBERED.sub(lambda m: chr(int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])), plain)
            plain = unescape(plain, _QUOTES)
        found[name] = plain
    return found


def _number(text: str | None, kind: type):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


class _Split:
    """The nodes of one split of an extract, from its tags in their order."""

    def __init__(self, snapshot: str, file: str, start: int):
        self.place = (snapshot, file, start)
        self.node: tuple | None = None  # the open node: id, lat, lon
        self.pairs: list[tuple[str | None, str | None]] = []
        self.commented = False
        # until the first element begins, tags may be those of a node of an earlier split
        self.behind = start > 0
        self.rows: list[tuple] = []

    def _put(self, part: str, node: tuple = (None, None, None)) -> None:
        keys, texts = ([p[k] for p in self.pairs] or None for k in (0, 1))
        self.rows.append((*node, keys, texts, *self.place, part))
        self.node, self.pairs, self.behind = None, [], False

    def tag(self, tag: str) -> None:
        if self.commented or tag.startswith("!--"):
            self.commented = "-->" not in tag
            return
        name = re.match(r"/?\w+", tag)
        name = name[0] if name else ""
        if name == "tag" and (self.node or self.behind):
            found = _attributes(tag)
            self.pairs.append((found.get("k"), found.get("v")))
        elif name == "/node":
            if self.behind:
                self._put("close")
            elif self.node:
                self._put("whole", self.node)
        elif name in ("node", "way", "relation", "/way", "/relation"):
            self.node, self.pairs, self.behind = None, [], False
            if name == "node":
                found = _attributes(tag)
                self.node = (_number(found.get("id"), int), _number(found.get("lat"), float), _number(found.get("lon"), float))
                if tag.rstrip()[: tag.rstrip().rfind(">")].endswith("/"):
                    self._put("whole", self.node)

    def end(self) -> None:
        if self.node:
            self._put("open", self.node)
        elif self.behind and self.pairs:
            self._put("between")


def _cut_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split: _Split | None = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_CUT_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT_FIELDS, strict=True)], schema=_CUT_FIELDS)

    for tags in batches:
        rows: list[tuple] = []
        for value, *place in zip(*(tags.column(k).to_pylist() for k in range(4)), strict=True):
            if split is None or split.place != tuple(place):
                if split is not None:
                    split.end()
                    rows += split.rows
                split = _Split(*place)
            split.tag(value)
        rows += split.rows if split else []
        if split:
            split.rows = []
        yield batch(rows)
    if split:
        split.end()
        yield batch(split.rows)


def _stitched(parts: pd.DataFrame) -> pd.DataFrame:
    """Nodes that lie across splits of one file, from their parts in the file's order."""
    done, held = [], None
    for row in parts.sort_values("start", kind="stable").to_dict("records"):
        tags = {c: [] if row[c] is None else list(row[c]) for c in ("keys", "texts")}
        if row["part"] == "open":
            held = {**row, **tags}
        elif held is not None:
            held = {**held, **{c: held[c] + tags[c] for c in tags}}
            if row["part"] == "close":
                done.append({**held, **{c: held[c] or None for c in tags}})
                held = None
    return pd.DataFrame(done, columns=parts.columns)


def read_node_xml(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """XML extracts -> (id, lat, lon, tags, snapshot), landed as parquet by one distributed pass.

    ``snapshot`` names a partition column that holds the extract's name; without it the file name
    is used. All extracts are one scan, and one that is not compressed is split as any text file. A node may span lines, have children or none, and lie across splits; a
    comment may hold tags unless it lies across splits. Extracts are UTF-8. A node without tags has no
    ``tags``; a number that is none is missing.
    """
    reader = spark.read.option("lineSep", "<")
    if snapshot:
        reader = reader.schema(f"value STRING, {snapshot} STRING")
    name = F.col(snapshot) if snapshot else F.col("_metadata.file_name")
    tags = reader.text(path).select(
        "value", name.alias("snapshot"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    cut = materialise(tags.where(F.col("value").rlike(_STARTS)).mapInArrow(_cut_nodes, _CUT_SCHEMA), "nodes-cut")
    # of every split at most one open end, one close and one in between
    parts = cut.where("part <> 'whole'")
    across = parts.groupBy("file").applyInPandas(_stitched, cut.schema)
    nodes = cut.where("part = 'whole'").unionByName(across)
    return nodes.select("id", "lat", "lon", F.map_from_arrays("keys", "texts").alias("tags"), "snapshot")


def node_format(spark: SparkSession, path: str) -> str:
    """``xml`` if the files of ``path``, or of folders in it, are so named; parquet, the main input, otherwise."""
    system, place = file_system(spark, path)
    files = system.listFiles(place, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return "xml" if re.search(rf"({'|'.join(map(re.escape, XML_NAMES))})(\.\w+)?$", name) else "parquet"
    return "parquet"


def read_node_table(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """Parquet nodes -> (id, lat, lon, tags, snapshot), ``tags`` a map.

    ``snapshot`` names the column that holds the extract's name; without it the file name is used.
    """
    table = require_columns(spark.read.parquet(path), [*NODE_COLUMNS, *([snapshot] if snapshot else [])])
    name = F.col(snapshot) if snapshot else F.col("_metadata.file_name")
    return table.select(*NODE_COLUMNS, name.alias("snapshot"))


def _has_year() -> Column:
    return year_from_name(F.col("snapshot")).isNotNull()


def _report(loaded: int | None, named: int | None) -> None:
    if not loaded:
        raise ValueError("no node was loaded")
    if loaded != (named or 0):
        log.warning("%d of %d nodes are in snapshots whose name has no year and are left out", loaded - (named or 0), loaded)


def watched_snapshots(nodes: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The nodes, which count themselves while a job reads them, and a check for when the job is done: no
    node at all raises, nodes without a year in the snapshot's name, which ``amenity_nodes`` leaves out, are
    logged. The input is not read a second time."""
    seen = Observation()
    watched = nodes.observe(seen, F.count(F.lit(1)).alias("loaded"), F.count_if(_has_year()).alias("named"))

    def check() -> None:
        try:
            counts = seen.get
        except Py4JJavaError:  # an empty input may be known for it before anything runs that could count
            counts = {}
        _report(counts.get("loaded"), counts.get("named"))

    return watched, check


def checked_snapshots(nodes: DataFrame) -> DataFrame:
    """The nodes, after the same check by a pass of its own, for a caller that wants to know beforehand."""
    names = nodes.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    _report(*names.agg(F.sum("n"), F.sum(F.when(_has_year(), F.col("n")))).first())
    return nodes


def amenity_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with an ``amenity`` tag, a valid place and a year in the snapshot name."""
    return nodes.select(
        "id",
        "lat",
        "lon",
        F.col("tags")["amenity"].alias("amenity"),
        F.col("tags")["name"].alias("name"),
        year_from_name(F.col("snapshot")).alias("year"),
    ).where(F.col("amenity").isNotNull() & F.col("year").isNotNull() & valid_location(F.col("lat"), F.col("lon")))
