"""Idempotent upserts as anti-joins: rows that are there stay, new ones are added, ids go on from the largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize


def one_document(rows: DataFrame) -> None:
    """Raises unless rows hold exactly one external_id."""
    if rows.select("external_id").distinct().limit(2).count() != 1:
        raise ValueError("expected one external_id")


def numbered_by(rows: DataFrame, column: str) -> DataFrame:
    """rows with n, from 1, in the order of a column without repeats: ranges are numbered side by side and put one after the other."""
    dealt = rows.repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "store-ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = counts.select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return dealt.join(F.broadcast(starts), "_range").withColumn("n", F.col("_before") + own).drop("_range", "_before")


def upsert_documents(stored: DataFrame, arriving: DataFrame, now: Column) -> DataFrame:
    """stored (document_id, external_id, title, source, updated_at) with arriving (external_id, title, source): known ids get updated_at, new ones get the next ids by external_id."""
    keys = arriving.dropDuplicates(["external_id"])
    touched = stored.join(keys.select("external_id", F.lit(True).alias("_seen")), "external_id", "left").withColumn("updated_at", F.when(F.col("_seen"), now).otherwise(F.col("updated_at"))).select(stored.columns)
    new = keys.join(stored, "external_id", "left_anti")
    last = stored.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("last"))
    numbered = numbered_by(new, "external_id").join(F.broadcast(last), how="cross")
    added = numbered.select((F.col("last") + F.col("n")).cast("long").alias("document_id"), "external_id", "title", "source", now.alias("updated_at"))
    return touched.unionByName(added)


def absent(stored: DataFrame, arriving: DataFrame, key: list[str], first: list[str]) -> DataFrame:
    """Those rows of arriving whose key stored lacks; of arriving rows with one key, the first in the order `first`. Null keys never conflict."""
    nulls = arriving.filter(" or ".join(f"{k} is null" for k in key))
    keyed = arriving.filter(" and ".join(f"{k} is not null" for k in key))
    one = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*first))).filter("_n = 1").drop("_n")
    return one.join(stored.select(*key), key, "left_anti").unionByName(nulls)


def insert_absent(stored: DataFrame, arriving: DataFrame, key: list[str], first: list[str]) -> DataFrame:
    """stored and the absent rows of arriving."""
    return stored.unionByName(absent(stored, arriving, key, first))


def link_parents(sections: DataFrame) -> DataFrame:
    """sections (section_id, document_id, path, parent_path, ...) with parent_id."""
    parents = sections.select(F.col("section_id").alias("parent_id"), "document_id", F.col("path").alias("parent_path"))
    return sections.join(parents, ["document_id", "parent_path"], "left")


def place_chunks(chunks: DataFrame, documents: DataFrame, sections: DataFrame, embedding_model: Column) -> DataFrame:
    """chunks with document_id, section_id (null for an unknown path), chunk_index (from 0, in the order of chapter, path, seq) and the model in their metadata."""
    known = chunks.join(documents.select("external_id", "document_id"), "external_id").join(sections.select("document_id", F.col("path").alias("section_path"), "section_id"), ["document_id", "section_path"], "left")
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("chapter", "section_path", "seq")) - 1
    extra = F.create_map(F.lit("embedding_model"), embedding_model)
    merged = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "embedding_model"), extra)
    return known.withColumn("chunk_index", index).withColumn("metadata", merged)


def receipt(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """external_id, sections, chunks: counts of what was given, not of what was new."""
    s = sections.groupBy("external_id").agg(F.count("*").alias("sections"))
    return s.join(chunks.groupBy("external_id").agg(F.count("*").alias("chunks")), "external_id", "full").na.fill(0, ["sections", "chunks"])
