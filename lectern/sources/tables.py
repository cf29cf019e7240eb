"""Where stored documents, sections and chunks are read from: a provider gives each table by its name, from a folder of
Parquet, a database of the session's catalog, or a server that Spark reads over JDBC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.contracts import CHUNKS_TABLE, DOCUMENTS_TABLE, SECTIONS_TABLE
from lectern.plans.library import search_rows

Provider = Callable[[str], DataFrame]

#: The columns that every provider gives, whatever else its tables hold.
COLUMNS = {"documents": DOCUMENTS_TABLE, "sections": SECTIONS_TABLE, "chunks": CHUNKS_TABLE}
CATALOG, JDBC = "catalog:", "jdbc:"


class NoTable(LookupError):
    """A provider hasn't got a table, or a column that is asked of it."""


def connect(spark: SparkSession, at: str, **options: str) -> Callable[[], Provider]:
    """A factory of providers for a place: catalog:database, a jdbc: address (options as Spark's reader takes them), or a folder. Nothing is read before a table is asked for."""

    def read(name: str) -> DataFrame:
        if at.startswith(CATALOG):
            return spark.table(f"{at[len(CATALOG) :]}.{name}")
        if at.startswith(JDBC):
            return spark.read.format("jdbc").options(url=at, dbtable=name, **options).load()
        return spark.read.parquet(f"{at.rstrip('/')}/{name}")

    def provider(name: str) -> DataFrame:
        if name not in COLUMNS:
            raise NoTable(f"no table {name!r}; there are {', '.join(COLUMNS)}")
        wanted = spark.createDataFrame([], COLUMNS[name]).schema
        rows = read(name)
        if lacking := [c.name for c in wanted if c.name not in rows.columns and c.name in _NEEDED[name]]:
            raise NoTable(f"{name} at {at} has no column {', '.join(lacking)}")
        return rows.select(*[(F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in wanted])

    return lambda: provider


#: Without these a question can't be answered; other columns may be missing and are null then.
_NEEDED = {"documents": ("document_id", "title"), "sections": ("section_id", "document_id", "path", "depth", "full_text"), "chunks": ("chunk_id", "document_id", "section_id", "content", "embedding")}


def search_tables(provider: Provider) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, sections and titles as a question takes them."""
    titles, sections = provider("documents").select("document_id", "title"), provider("sections")
    return search_rows(provider("chunks"), titles, sections), sections.select("section_id", "document_id", "path", "depth", "full_text"), titles
