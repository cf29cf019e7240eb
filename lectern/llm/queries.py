"""The queries of this package and their SQL, for the repository's entry module."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bpe, dialogues, licenses, mixing, negatives, prefix_join, quality, shards, simhash, toxicity, unigram, urls
from lectern.session import prepare, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_blocks", F.array_join("licenses", " ").alias("licenses"), F.size("findings").cast("long").alias("n_findings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map is kept in the shared folder, one store a table: the next run on that table loads and edits it."""
    store = f"{shared_dir(spark)}/slot-maps/{zlib.crc32(sf_dir.encode()):08x}"
    return shards.shard_rows(table(spark, sf_dir, "documents"), store=store)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.components_of(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.prefix_tree(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    made = (op1_quality_rules, op2_nearest_neighbours, op3_license_scan, op4_url_filter, op5_simhash, op6_token_counts, op7_toxicity, op8_byte_bpe, op9_sharding, op10_mixing, op11_ngram_jaccard, op12_conversation_trie, op13_hard_negatives)
    return {f.__name__: _prepared(f) for f in made}


def _prepared(query: Query) -> Query:
    return lambda spark, sf_dir: query(prepare(spark), sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest_neighbours": ann.SQL, "op4_url_filter": urls.SQL, "op10_mixing": mixing.SQL, "op12_conversation_trie": dialogues.SQL, "op13_hard_negatives": negatives.SQL}
