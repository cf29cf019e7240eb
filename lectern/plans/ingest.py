"""Books to stored documents, sections and embedded chunks, stage by stage, each stage a Parquet table in the run's folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, recursive, structure
from lectern.operators.store import one_document, receipt
from lectern.plans.contracts import DIMENSION
from lectern.plans.answers import AnswerStore
from lectern.plans.gateway import embed_chunks
from lectern.plans.library import Library
from lectern.plans.runner import Ledger, Place, Stage, run_in_order
from lectern.sources import files


@dataclass(frozen=True)
class IngestSettings:
    profile: str = "ddia"
    method: str = "pdfminer"
    clean: str | None = None
    chunk_size: int = 800
    overlap: int = 100
    embedding_model: str = "embed"
    dimension: int = DIMENSION
    max_batch_tokens: int = 100_000
    max_batch_items: int = 2048
    chunking: str = "recursive"
    vocabulary: str | None = None
    pattern: str | None = None
    retries: int = 2

    def checked(self, dimension: int = DIMENSION) -> IngestSettings:
        """These settings, or an error where their vectors would not fit the tables."""
        if self.dimension != dimension:
            raise ValueError(f"vectors of {self.dimension} components do not fit tables of {dimension}")
        return self


def clean_sections(sections: DataFrame, method: str = "normalize", fn: Callable[[Column], Column] | None = None, count: Callable[[Column], Column] = X.count_words) -> DataFrame:
    """Every section's text cleaned and counted again; llm needs a function."""
    if method not in ("normalize", "llm"):
        raise ValueError(f"unknown clean method {method!r}")
    if method == "llm" and fn is None:
        raise ValueError("the clean method llm needs a function")
    done = sections.withColumn("text", (X.clean if method == "normalize" else fn)(F.col("text")))
    return done.withColumn("token_count", count(F.col("text")))


def chunker(s: IngestSettings) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """What cuts texts into pieces and what counts their tokens: byte pairs where a vocabulary is named, else words."""
    if s.chunking not in ("recursive", "windows"):
        raise ValueError(f"unknown chunking {s.chunking!r}")
    count = recursive.BpeCounter(s.vocabulary, s.pattern) if s.vocabulary and s.pattern else recursive.words
    if s.chunking == "windows":
        return (lambda t: chunking.windows(t, s.chunk_size, s.overlap)), X.count_words
    return recursive.recursive(s.chunk_size, s.overlap, count), recursive.counted(count)


def stages(spark: SparkSession, source: str, external_id: str, embed, settings: IngestSettings | None = None, content_key: str = "", library: str | None = None, title: str | None = None, answers: str | None = None) -> list[Stage]:
    """Extract, structure, clean if asked, chunk, embed, persist; content_key: a hash of the source, so that changed files run again.

    The last stage upserts into the library at that folder, if one is named, and keeps a receipt of what was given. answers:
    a folder of paid vectors, so that a run that failed, or changed its chunks a little, pays only for texts that are new.
    """
    s = settings or IngestSettings()
    profile = structure.profile(s.profile)
    last = "03_clean" if s.clean else "02_structure"

    def stage(name: str, make: Callable[[Callable[[str], DataFrame]], DataFrame], depends: dict) -> Stage:
        def work(place: Place) -> str:
            make(lambda other: spark.read.parquet(place.path(other, "rows"))).write.mode("overwrite").parquet(f"{place.folder}/rows")
            return f"{place.folder}/rows"

        return Stage(name, work, depends, [f"{name}/rows/_SUCCESS"])

    def chunks(read) -> DataFrame:
        cut, count = chunker(s)
        return chunking.chunk(read(last), cut, count)

    def persist(read) -> DataFrame:
        sections, rows = read(last), read("04_embed")
        one_document(sections)
        if library:
            about = sections.select("external_id").distinct().select("external_id", F.lit(title).alias("title"), F.lit(source).alias("source"))
            Library(spark, library).persist(about, sections, rows)
        return receipt(sections, rows)

    def embedded(read) -> DataFrame:
        store = AnswerStore(spark, answers) if answers else None
        return embed_chunks(read("03_chunk"), embed, s.embedding_model, s.dimension, s.max_batch_tokens, s.max_batch_items, s.retries, store)

    cutting = {"size": s.chunk_size, "overlap": s.overlap, "by": s.chunking, "vocabulary": s.vocabulary, "pattern": s.pattern, "input": last}
    return [
        stage("01_extract", lambda read: files.extract(spark, source, s.method).withColumn("external_id", F.lit(external_id)), {"source": source, "method": s.method, "content": content_key}),
        stage("02_structure", lambda read: structure.parse_strict(read("01_extract").select("external_id", "text"), profile), {"external_id": external_id, "profile": vars(profile)}),
        *([stage("03_clean", lambda read: clean_sections(read("02_structure"), s.clean), {"method": s.clean})] if s.clean else []),
        stage("03_chunk", chunks, cutting),
        stage("04_embed", embedded, {"model": s.embedding_model, "tokens": s.max_batch_tokens, "items": s.max_batch_items}),
        stage("05_persist", persist, {"sections": last, "library": library}),
    ]


def ingest_book(spark: SparkSession, source: str, external_id: str, embed, runs: str, library: str, settings: IngestSettings | None = None, title: str | None = None, answers: str | None = None) -> dict:
    """A file into the library, from the first stage that isn't settled; the receipt. runs, answers: folders that the whole cluster reaches."""
    s = (settings or IngestSettings()).checked()
    key = files.content_key(spark, source)
    ledger = Ledger(spark, runs, external_id)
    run_in_order(stages(spark, source, external_id, embed, s, key, library, title, answers), ledger)
    return spark.read.parquet(ledger.path("05_persist", "rows")).first().asDict()
