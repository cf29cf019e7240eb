"""New documents as a stream of files, each micro-batch an idempotent upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_stream(spark: SparkSession, path: str, schema: StructType | str, upsert: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files that arrive at path, batch by batch, to upsert(rows, batch id); a batch that is tried again must do no harm."""
    rows = spark.readStream.schema(schema).parquet(path)
    writer = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
