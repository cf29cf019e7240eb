"""Sections to chunks: token windows or an injected chunker, identities, and batches packed for an embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, chapter_of, chunk_key, content_hash, count_words, strip
from lectern.operators.packing import runs

CHUNK_SIZE, OVERLAP = 800, 100
MAX_BATCH_TOKENS, MAX_BATCH_ITEMS = 100_000, 2048


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of size words in order, each led by the overlap last words of the one before; nothing for a blank text."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, F.greatest(s - overlap, F.lit(0)) + 1, F.least(s, F.lit(overlap)) + size), " "))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    pieces = F.transform(F.array(words), cut)[0]  # as the variable of a lambda the words are cut once, not once a window
    return F.filter(pieces, lambda p: p != "")


def chunk(sections: DataFrame, pieces: Callable[[Column], Column] | None = None, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of the leaf sections: external_id, section_path, chapter, heading, seq, text, token_count, page_range, metadata, id, content_hash.

    pieces: text -> array of pieces (default: windows of words); count: text -> tokens (default: words). Blank pieces go before seq is dealt.
    """
    cut = (pieces or windows)(F.col("text"))
    leaves = sections.filter("is_leaf").select("external_id", F.col("path").alias("section_path"), "heading", "page_range", "metadata", F.posexplode(F.filter(cut, lambda p: strip(p) != "")).alias("seq", "text"))
    key = chunk_key(F.col("external_id"), F.col("section_path"), F.col("seq"))
    return leaves.select(
        "external_id", "section_path", chapter_of(F.col("section_path")).alias("chapter"), "heading", "seq", "text", (count or count_words)(F.col("text")).alias("token_count"),
        "page_range", "metadata", key.alias("id"), content_hash(key, F.col("text")).alias("content_hash"),
    )


def batches(chunks: DataFrame, group: str, order: list[str], max_tokens: int = MAX_BATCH_TOKENS, max_items: int = MAX_BATCH_ITEMS) -> DataFrame:
    """group, the order columns, token_count and batch (from 0): filled in order, closed before a row would pass either limit; a row that is too large goes alone.

    Only these columns are moved, texts stay behind; a group of any size is spread over tasks.
    """
    slim = chunks.select(group, *order, "token_count")
    return runs(slim, group, order, F.col("token_count"), max_tokens, max_items).withColumn("run", F.col("run").cast("int")).withColumnRenamed("run", "batch")
