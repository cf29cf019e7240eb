"""Stored documents, sections and chunks: bucketed tables that only grow, so that a run that is tried again adds nothing twice.

Each table lies in a folder as Parquet, dealt into buckets by the keys that say whether a row is there already. An upsert
therefore shuffles what arrives and reads the stored side where it lies, whatever its size. Ids are hashes of stable keys
(external id; with path; chunk id), so no count or lock is needed to give them out; before anything is written, ids that
arrive are held against those that are stored, and one that another key has already is an error. One writer at a time:
plain folders don't keep two apart. A writer takes any number of documents. Indexes of vectors and of terms, once made,
are kept with the tables and take in what arrives.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.search import small
from lectern.operators.store import absent, place_chunks, receipt
from lectern.operators.text_index import TextIndex
from lectern.operators.vector_index import VectorIndex
from lectern.plans.contracts import CHUNKS_TABLE, DOCUMENTS_TABLE, SECTIONS_TABLE
from lectern.session import materialize

#: Columns, and the keys of a row, by which it is dealt.
TABLES = {"documents": (DOCUMENTS_TABLE, ["external_id"]), "sections": (SECTIONS_TABLE, ["document_id", "path"]), "chunks": (CHUNKS_TABLE, ["document_id", "content_hash"])}
BUCKETS = 64


class IdCollision(RuntimeError):
    """Two keys have one hash."""


def hashed(*keys: str) -> Column:
    return F.xxhash64(*keys)


class Library:
    """The library in a folder. buckets: of each table, when it is made; a folder keeps the number it was made with only if it is named the same again."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS) -> None:
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets
        self.name = f"library_{hashlib.sha256(self.base.encode()).hexdigest()[:24]}"
        for name, (columns, keys) in TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{self.base}/{name}'")
            spark.catalog.refreshTable(f"{self.name}_{name}")  # another session may have written

    def _stored(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = self._stored(name).schema
        whole = rows.select(*[(F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in columns])
        whole.repartition(self.buckets, *TABLES[name][1]).write.insertInto(f"{self.name}_{name}")

    def _checked(self, name: str, id_column: str, rows: DataFrame) -> DataFrame:
        """rows, if none of their ids belongs to another key, here or in the table. Of the stored side only ids and keys are read."""
        keys = TABLES[name][1]
        theirs = rows.select(id_column, F.struct(*keys).alias("key"))
        twice = theirs.groupBy(id_column).agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("not (a <=> b)")
        stored = self._stored(name).select(id_column, F.struct(*keys).alias("other"))
        met = stored.join(small(theirs.distinct()), id_column).filter("not (key <=> other)")
        found = [*twice.limit(1).collect(), *met.limit(1).collect()]
        if found:
            raise IdCollision(f"{name}: two keys have the id {found[0][0]}")
        return rows

    def documents(self) -> DataFrame:
        """One row a document: what was first said of it, and when it last arrived. Each arrival is a row in the table."""
        log = self._stored("documents")
        kept = [c for c in log.columns if c not in ("external_id", "updated_at")]
        first = log.groupBy("external_id").agg(F.min_by(F.struct(*kept), "updated_at").alias("first"), F.max("updated_at").alias("updated_at"))
        return first.select("external_id", "first.*", "updated_at").select(log.columns)

    def sections(self) -> DataFrame:
        return self._stored("sections")

    def chunks(self) -> DataFrame:
        return self._stored("chunks")

    def persist(self, documents: DataFrame, sections: DataFrame, chunks: DataFrame, now: Column | None = None) -> DataFrame:
        """Upsert documents (external_id, source, and title, uri, mime_type, metadata where known), their sections and embedded chunks.

        Known documents get a new updated_at, known sections (by path) and chunks (by content hash) stay as they are. A chunk of an
        unknown section has no section_id. Returns the receipt: counts of what was given, whatever was new.
        """
        stamp = F.current_timestamp() if now is None else now
        arriving = documents.dropDuplicates(["external_id"]).withColumns({"document_id": hashed("external_id"), "created_at": stamp, "updated_at": stamp})
        arriving = materialize(arriving, "library-documents")
        self._append("documents", self._checked("documents", "document_id", arriving))
        ids = arriving.select("external_id", "document_id")

        given = sections.join(ids, "external_id").withColumns({"section_id": hashed("external_id", "path"), "full_text": F.col("text")})
        new = materialize(absent(self._stored("sections"), given, ["document_id", "path"], ["ordinal", "text"]), "library-sections")
        self._append("sections", self._with_parents(self._checked("sections", "section_id", new)))

        placed = place_chunks(chunks, ids, self._stored("sections"), F.col("embedding_model"))
        placed = placed.withColumns({"chunk_id": hashed("id"), "content": F.col("text"), "embedding": F.col("vector"), "created_at": stamp})
        added = materialize(absent(self._stored("chunks"), placed, ["document_id", "content_hash"], ["chunk_index"]), "library-chunks")
        self._append("chunks", self._checked("chunks", "chunk_id", added))
        for index in self._indexes().values():
            index.add(_indexed(added))
        return receipt(sections, chunks)

    def _with_parents(self, new: DataFrame) -> DataFrame:
        """new with parent_id, among the stored sections or among themselves: two joins, so that the stored side stays in its buckets."""

        def above(rows: DataFrame, name: str) -> DataFrame:
            return rows.select("document_id", F.col("path"), F.col("section_id").alias(name))

        linked = new.withColumnRenamed("path", "_own").withColumnRenamed("parent_path", "path")
        linked = linked.join(above(self._stored("sections"), "_stored"), ["document_id", "path"], "left").join(above(new, "_new"), ["document_id", "path"], "left")
        return linked.withColumn("parent_id", F.coalesce("_stored", "_new")).drop("path", "_stored", "_new").withColumnRenamed("_own", "path")

    # Indexes

    def _made(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _indexes(self) -> dict[str, VectorIndex | TextIndex]:
        made = {"vector-index": VectorIndex, "text-index": TextIndex}
        return {name: make(self.spark, f"{self.base}/{name}") for name, make in made.items() if self._made(f"{name}/complete")}

    def make_indexes(self, cells: int | None = None) -> None:
        """Index all stored chunks; from now on what arrives is taken in. Indexes that are there stay."""
        rows, there = _indexed(self.chunks()), self._indexes()
        if "vector-index" not in there:
            VectorIndex.create(rows, f"{self.base}/vector-index", cells)
            self._complete("vector-index")
        if "text-index" not in there:
            TextIndex(self.spark, f"{self.base}/text-index").add(rows)
            self._complete("text-index")

    def _complete(self, name: str) -> None:
        self.spark.createDataFrame([(name,)], "index string").coalesce(1).write.text(f"{self.base}/{name}/complete")

    def vector_index(self) -> VectorIndex | None:
        return self._indexes().get("vector-index")

    def text_index(self) -> TextIndex | None:
        return self._indexes().get("text-index")

    def search_tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """chunks, sections and titles as DeepSearch takes them."""
        titles = self.documents().select("document_id", "title")
        return search_rows(self.chunks(), titles, self.sections()), self.sections().select("section_id", "document_id", "path", "depth", "full_text"), titles


def _indexed(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", "content", F.col("embedding").alias("vector"))


def search_rows(chunks: DataFrame, titles: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the title of their document and the path and heading of their section, which may be unknown; chunks of no document drop out."""
    where = sections.select("section_id", "path", F.col("heading").alias("_heading"))
    found = chunks.drop("heading").join(titles.select("document_id", "title"), "document_id").join(where, "section_id", "left")
    return found.select("chunk_id", "content", "document_id", "section_id", "title", "path", F.col("_heading").alias("heading"), F.col("embedding").alias("vector"))
