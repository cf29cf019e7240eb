"""Records that cross stage borders, as Spark schemas and small dataclasses, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

DIMENSION = 1536


def _s(*fields: tuple[str, Any, bool]) -> StructType:
    return StructType([StructField(n, t, null) for n, t, null in fields])


_S, _I, _B = StringType(), IntegerType(), BooleanType()
PAGE_RANGE = _s(("lo", _I, True), ("hi", _I, True))
METADATA = MapType(_S, _S)
SECTION = _s(("external_id", _S, False), ("path", _S, False), ("depth", _I, False), ("parent_path", _S, True), ("ordinal", _I, False), ("heading", _S, False), ("is_leaf", _B, False), ("text", _S, False), ("token_count", _I, False), ("page_range", PAGE_RANGE, True), ("metadata", METADATA, True))
CHUNK = _s(("external_id", _S, False), ("section_path", _S, False), ("chapter", _I, True), ("heading", _S, False), ("seq", _I, False), ("text", _S, False), ("token_count", _I, False), ("page_range", PAGE_RANGE, True), ("metadata", METADATA, True), ("id", _S, False), ("content_hash", _S, False))
EMBEDDED_CHUNK = StructType([*CHUNK.fields, StructField("vector", ArrayType(FloatType()), False), StructField("embedding_model", _S, False)])
RETRIEVED_CHUNK = _s(("chunk_id", LongType(), False), ("content", _S, False), ("document_id", LongType(), False), ("section_id", LongType(), True), ("source", _S, False), ("score", DoubleType(), False), ("vector", ArrayType(FloatType()), True), ("is_references", _B, False), ("metadata", METADATA, True))
DOCUMENTS_TABLE = "document_id BIGINT, external_id STRING, title STRING, uri STRING, mime_type STRING, source STRING, metadata MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"
SECTIONS_TABLE = "section_id BIGINT, document_id BIGINT, parent_id BIGINT, path STRING, depth INT, ordinal INT, heading STRING, full_text STRING, token_count INT, metadata MAP<STRING,STRING>"
CHUNKS_TABLE = "chunk_id BIGINT, document_id BIGINT, section_id BIGINT, chunk_index INT, content STRING, embedding ARRAY<FLOAT>, token_count INT, content_hash STRING, chapter INT, heading STRING, page_range STRUCT<lo: INT, hi: INT>, metadata MAP<STRING,STRING>, created_at TIMESTAMP"


def create_tables(spark, database: str = "default") -> None:
    """The three tables at rest, if they aren't there."""
    for name, columns in (("documents", DOCUMENTS_TABLE), ("sections", SECTIONS_TABLE), ("chunks", CHUNKS_TABLE)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def _strings(x: Any, name: str) -> list[str]:
    if not isinstance(x, list) or not all(isinstance(s, str) for s in x):
        raise ValueError(f"{name} must be a list of strings")
    return [s.strip() for s in x if s.strip()]


@dataclass
class SearchPlan:
    """At least one sub-question and one query must be left once blanks are gone."""

    sub_questions: list[str]
    vector_queries: list[str] = field(default_factory=list)
    bm25_queries: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sub_questions, self.vector_queries, self.bm25_queries = (_strings(getattr(self, n), n) for n in ("sub_questions", "vector_queries", "bm25_queries"))
        if not self.sub_questions:
            raise ValueError("a plan needs a sub-question")
        if not (self.vector_queries or self.bm25_queries):
            raise ValueError("a plan needs a query")


@dataclass
class Reflection:
    is_sufficient: bool
    gaps: list[str] = field(default_factory=list)
    coverage: list[dict] = field(default_factory=list)
    new_vector_queries: list[str] = field(default_factory=list)
    new_bm25_queries: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not isinstance(self.is_sufficient, bool):
            raise ValueError("is_sufficient must be true or false")
        self.new_vector_queries, self.new_bm25_queries = _strings(self.new_vector_queries, "new_vector_queries"), _strings(self.new_bm25_queries, "new_bm25_queries")


def parse_json(kind: type, text: str):
    """A SearchPlan or Reflection from a model's JSON; anything malformed is an error."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("expected an object")
    try:
        return kind(**data)
    except TypeError as e:
        raise ValueError(str(e)) from None


@dataclass
class Event:
    """type: plan_ready, search_round, reflect_result, expand_ready, answer_delta or final; body: what it tells."""

    type: str
    body: dict

    def to_json(self) -> str:
        return json.dumps({"type": self.type, **self.body}, ensure_ascii=False, default=asdict)
