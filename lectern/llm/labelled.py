"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fold that is never learnt from: crc32 of doc_id as text, modulo 3.
FOLDS, HELD_OUT = 3, 1


def held_out():
    """True for ids of the fold kept for evaluation; null ids are in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def sample_ids(labels: DataFrame, column: str, per_class: tuple[int, int]) -> dict[int, int]:
    """doc_id -> label of at most per_class[0] ids of label 0 and per_class[1] of label 1 outside the held-out fold, the first by hash.

    Ids with a null label or with both labels are left out.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo = hi")
    out: dict[int, int] = {}
    for value in (0, 1):
        for row in one.filter(F.col("lo") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[value]).collect():
            out[row["doc_id"]] = value
    return out


def sampled(docs: DataFrame, ids: dict[int, int]) -> DataFrame:
    """The rows of docs with these ids, and their label; ids is bounded by per_class, hence the broadcast."""
    spark = docs.sparkSession
    listed = spark.createDataFrame(sorted(ids.items()), "_id long, label int")
    return docs.join(F.broadcast(listed), F.col("doc_id") == F.col("_id")).drop("_id")
