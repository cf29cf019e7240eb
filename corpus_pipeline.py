"""A training corpus from the table documents: toxic and bad documents go, near copies go, sources are mixed, texts become tokens.

Every stage takes whole texts of any length, rows that stand more than once as rows of their own (but for near copies, where
one stays), and columns of any name; an empty table stays empty. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, mixing, quality, similar, toxicity
from lectern.session import materialize, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts have no evidence and stay; without labels of both kinds the score is low and all stay, or high if all labels are 1."""
    return toxicity.clean_documents(docs, table(prepare(spark), sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the learnt quality rules. Null texts count as empty, which the base refuses; null labels are not learnt from."""
    return quality.good_documents(docs, table(prepare(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more. The smallest id stays, null ids last; texts without words are copies of each other."""
    prepare(spark)
    return similar.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own; texts without words weigh nothing and are drawn like others."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each document of the mix; a null text has no tokens."""
    prepare(spark)
    return bpe.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_bad), ("simhash_dedup", drop_copies), ("mixing", mix_sources), ("byte_bpe", encode)]
#: The learnt stages can't be put in SQL; tests compare run() with the stages' own decisions, and each stage's module with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written and read again before the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for no, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if no < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
