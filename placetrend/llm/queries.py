"""The operators applied to the test tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrend.llm.chunks import chunk_dedup
from placetrend.llm.filter_audit import AUDIT_SQL, audit
from placetrend.llm.html_text import extract_text
from placetrend.llm.licenses import license_scan
from placetrend.llm.minhash_join import JOIN_SQL, minhash_groups
from placetrend.llm.mixing import mix_draws
from placetrend.llm.neighbours import nearest_neighbours
from placetrend.llm.pieces import encode_texts
from placetrend.llm.prefix_trie import TRIE_SQL, conversation_trie
from placetrend.llm.quality import quality_rules, train
from placetrend.llm.shared import read
from placetrend.llm.simhash import simhash_groups
from placetrend.llm.suffixes import suffix_dedup
from placetrend.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, read(spark, sf_dir, "labels")))


@query("op10_chunk_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(read(spark, sf_dir, "documents"), to_ends=True)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix_draws(read(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.size("draws")).alias("taken")
    places = (F.col(f"draws.{x}").alias(f"{x}s") for x in ("shard", "place"))
    return drawn.select("doc_id", "size", "source_size", "target", taken, *places)


@query("op5_licenses")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.col("doc_id").cast("string"))
    return license_scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", (F.col("doc_id") % 7).cast("string"), name)))


@query("op9_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


@query("op11_minhash_join", JOIN_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(read(spark, sf_dir, "documents"))


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))
