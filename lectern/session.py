"""Session helpers shared by every operator: the shared folder, worker import path, table reading."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Where tables go when the session names no spark.checkpoint.dir (single-machine tests only).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Most rows of an Arrow batch, so that batches of long texts stay small.
BATCH_ROWS = 1000
#: Most bytes of an Arrow batch, unless the session names another number: a batch of very long texts holds fewer rows.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches of texts small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
