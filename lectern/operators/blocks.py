"""From chosen chunks to parent sections, evidence, citations and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import LABEL, document_label, source_label
from lectern.operators.packing import joined


def expand(selected: DataFrame, sections: DataFrame, titles: DataFrame) -> DataFrame:
    """qid, block_pos, section_id, document_id, full_text, source, from_chunks: the chapters that hold the selected chunks.

    selected (qid, pos, chunk_id, section_id), sections (section_id, document_id, path, depth, full_text), titles
    (document_id, title). A chapter's path is the first component of its sections' paths, so the ancestor join is an
    equi-join. Blocks stand in the order of their first chunk; chunks without section or chapter drop out.
    """
    own = sections.select("section_id", "document_id", F.substring_index("path", ".", 1).alias("chapter"))
    big = sections.filter("depth = 1").select(F.col("section_id").alias("block_id"), "document_id", F.col("path").alias("chapter"), F.coalesce("full_text", F.lit("")).alias("full_text"))
    met = selected.filter(F.col("section_id").isNotNull()).join(own, "section_id").join(big.drop("full_text"), ["document_id", "chapter"])
    grouped = met.groupBy("qid", "block_id", "document_id", "chapter").agg(F.min("pos").alias("first_pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("from_chunks"))
    placed = grouped.withColumn("block_pos", F.row_number().over(Window.partitionBy("qid").orderBy("first_pos")))
    full = placed.join(big.select("block_id", "full_text"), "block_id").join(titles, "document_id")
    return full.select("qid", "block_pos", F.col("block_id").alias("section_id"), "document_id", "full_text", source_label(F.col("title"), F.col("chapter")).alias("source"), "from_chunks")


def ancestors(sections: DataFrame) -> DataFrame:
    """section_id, ancestor_id of every ancestor-or-equal pair in a document: path prefixes by whole components, then an equi-join."""
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    below = sections.select("section_id", "document_id", F.explode(prefixes).alias("prefix"))
    return below.join(sections.select(F.col("section_id").alias("ancestor_id"), "document_id", F.col("path").alias("prefix")), ["document_id", "prefix"]).select("section_id", "ancestor_id")


def evidence_by_document(pooled: DataFrame) -> DataFrame:
    """qid, doc_pos, document, chunk_ids of (qid, pos, chunk_id, source): grouped by document, both in order of first appearance."""
    grouped = pooled.withColumn("document", document_label(F.col("source"))).groupBy("qid", "document").agg(F.min("pos").alias("first_pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return grouped.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("first_pos")).alias("doc_pos"), "document", "chunk_ids")


def cited_sources(answers: DataFrame) -> DataFrame:
    """answers (qid, answer, sources) with cited: those of sources whose title and chapter stand together in one bracket of the answer."""
    brackets = F.transform(F.regexp_extract_all("answer", F.lit(r"\[([^\[\]]+)\]"), 1), F.lower)

    def named(source):
        title = F.trim(F.lower(F.substring_index(source, LABEL, 1)))
        path = F.when(F.contains(source, F.lit(LABEL)), F.substring(source, F.locate(LABEL, source) + len(LABEL), F.length(source))).otherwise("")
        chapter = F.lower(F.substring_index(F.trim(path), ".", 1))

        def holds(bracket):
            numbers = F.transform(F.regexp_extract_all(bracket, F.lit(r"(\d+(?:\.\d+)*)"), 1), lambda n: F.substring_index(n, ".", 1))
            return F.contains(bracket, title) & F.when(chapter.rlike(r"^\d+$"), F.array_contains(numbers, chapter)).otherwise((chapter != "") & F.contains(bracket, chapter))

        return (title != "") & F.exists("brackets", holds)

    marked = answers.withColumn("sources", F.array_distinct("sources")).withColumn("brackets", brackets)
    return marked.withColumn("cited", F.filter("sources", named)).drop("brackets")


def delta_frames(deltas: DataFrame, limit: int = 200) -> DataFrame:
    """qid, frame_no, frame of (qid, seq, text): text is held back until there are limit characters, then sent; the rest comes last.

    A delta without text changes nothing. A question of very many deltas is spread over tasks; a frame, of limit deltas at most, is in one row.
    """
    framed = joined(deltas.select("qid", "seq", "text"), "qid", ["seq"], limit)
    return framed.select("qid", (F.col("run") + 1).cast("int").alias("frame_no"), F.col("text").alias("frame"))
