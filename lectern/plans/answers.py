"""A store of paid answers: vectors by model and text, written where and when they are bought, so that no text is paid for twice.

An executor writes each request's vectors as a file before it asks for more. A task that is tried again first reads what its
run has written, and a later run joins the store before it asks at all. Each file also says what its request cost, so totals
hold whatever failed after the call. The folder is one that driver and executors share; files are moved to their names when
they are whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.session import prepare

Embed = Callable[[list[str]], list[tuple[int, list[float]]]]

#: What a request cost stands in its file's first row: calls made, those after an error, texts, tokens and money.
SUMS = ("calls", "retries", "texts", "tokens", "cost")
_FILE = "key string, vector array<float>, calls long, retries long, texts long, tokens long, cost double"


def answer_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


class AnswerStore:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = prepare(spark), base.rstrip("/")

    def folder(self, model: str) -> str:
        return f"{self.base}/{hashlib.sha256(model.encode()).hexdigest()[:32]}"

    def _files(self, model: str) -> DataFrame:
        self.spark.createDataFrame([], _FILE).write.mode("ignore").parquet(self.folder(model))
        return self.spark.read.schema(_FILE).parquet(self.folder(model))

    def known(self, model: str) -> DataFrame:
        """key, vector of every answer; where two tasks asked at the same time, one of them."""
        return self._files(model).groupBy("key").agg(F.first("vector").alias("vector"))

    def totals(self, model: str) -> dict[str, float]:
        """What all requests of this model have cost."""
        found = self._files(model).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)).first()
        return found.asDict()

    def pay(self, rows: DataFrame, embed: Embed, model: str, dimension: int, max_tokens: int, max_items: int, retries: int = 0, price: float = 0.0) -> dict[str, float]:
        """Ask for the vectors of rows (key, text, token_count) that are not stored, on the executors, and tell what that cost, summed there."""
        missing = rows.select("key", "text", "token_count").dropDuplicates(["key"]).join(self.known(model).select("key"), "key", "left_anti")
        run, folder = uuid.uuid4().hex, self.folder(model)

        def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task = TaskContext.get()
            yield from bought(batches, Purse(f"{folder}/run={run}", task.partitionId(), task.taskAttemptId()), embed, model, dimension, max_tokens, max_items, retries, price)

        told = Observation()
        paid = missing.mapInPandas(ask, "calls long, retries long, texts long, tokens long, cost double")
        paid.observe(told, *(F.sum(c).alias(c) for c in SUMS)).write.format("noop").mode("overwrite").save()
        return {c: told.get.get(c) or 0 for c in SUMS}


class Purse:
    """The files of one attempt at a partition of a run: what it writes, and what earlier attempts have written."""

    def __init__(self, folder: str, partition: int, attempt: int) -> None:
        self.partition, self.attempt, self.n = f"{partition:06d}", attempt, 0
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)

    def before(self) -> Iterator[pa.Table]:
        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name.startswith(f"{self.partition}-"):
                with self.files.open_input_file(info.path) as f:
                    yield pq.read_table(f)

    def put(self, table: pa.Table) -> None:
        name = f"{self.partition}-{self.attempt}-{self.n:06d}.parquet"
        path, hidden = f"{self.folder}/{name}", f"{self.folder}/.{name}"  # Spark reads no names that start with a point
        pq.write_table(table, hidden, filesystem=self.files)
        self.files.move(hidden, path)
        self.n += 1


def bought(batches: Iterable[pd.DataFrame], purse: Purse, embed: Embed, model: str, dimension: int, max_tokens: int, max_items: int, retries: int, price: float) -> Iterator[pd.DataFrame]:
    """What each request cost; its vectors are in the purse by then. Requests are packed by both limits, over batches."""
    from lectern.plans.gateway import ordered_vectors, request_ends

    have: set[str] = set()
    for table in purse.before():
        have.update(table.column("key").to_pylist())
        yield pd.DataFrame({c: [sum(table.column(c).to_pylist())] for c in SUMS})

    def request(part: pd.DataFrame) -> pd.DataFrame:
        calls = 0
        while True:
            calls += 1
            try:
                vectors = ordered_vectors(embed([t or "" for t in part["text"]]), len(part), dimension)
                break
            except Exception:
                if calls > retries:
                    raise
        tokens = int(part["token_count"].sum())
        cost = pd.DataFrame({"calls": [calls], "retries": [calls - 1], "texts": [len(part)], "tokens": [tokens], "cost": [tokens * price]})
        rest = pd.concat([cost, pd.DataFrame(0, index=range(len(part) - 1), columns=cost.columns)], ignore_index=True)
        columns = {"key": pa.array(part["key"], pa.string()), "vector": pa.array([np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32()))}
        purse.put(pa.table(columns | {c: pa.array(rest[c], pa.float64() if c == "cost" else pa.int64()) for c in SUMS}))
        return cost

    held = None
    for pdf in batches:
        pdf = pdf[~pdf["key"].isin(have)]
        held = pdf.reset_index(drop=True) if held is None else pd.concat([held, pdf], ignore_index=True)
        at = 0
        for end in request_ends(held["token_count"].fillna(0).tolist(), max_tokens, max_items):
            yield request(held.iloc[at:end])
            at = end
        held = held.iloc[at:].reset_index(drop=True)
    if held is not None and len(held):
        yield request(held)
