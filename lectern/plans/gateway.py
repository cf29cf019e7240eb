"""Calls to language models and embedders: injected functions behind task names, retries, checks and a cost hook."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import AsyncIterator, Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from lectern.plans.answers import AnswerStore, answer_key


def tried(call: Callable, retries: int):
    """call(), again after an error, so many times at most; no waiting in between."""
    for left in range(retries, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise


class Gateway:
    """complete(model, messages) -> (text, cost), stream(model, messages) -> texts, embed(model, texts) -> [(index, vector)]; each is optional."""

    def __init__(self, models: dict[str, str], *, complete=None, stream=None, embed=None, retries: int = 2, dimension: int | None = None, on_cost: Callable[[str, float], None] | None = None) -> None:
        self.models, self._complete, self._stream, self._embed = models, complete, stream, embed
        self.retries, self.dimension, self.on_cost, self.cost = retries, dimension, on_cost, 0.0

    def model(self, task: str) -> str:
        return self.models[task]  # an unknown task is the caller's error, not retried

    def _tried(self, call: Callable):
        return tried(call, self.retries)

    def _paid(self, task: str, cost: float | None) -> None:
        self.cost += cost or 0.0
        if self.on_cost:
            self.on_cost(task, cost or 0.0)

    async def _awaited(self, call: Callable):
        """call(), which gives an awaitable or an answer, tried as often as other calls; answers are made beside the event loop."""
        for left in range(self.retries, -1, -1):
            try:
                found = await asyncio.to_thread(call)
                return await found if inspect.isawaitable(found) else found
            except Exception:
                if not left:
                    raise

    async def acompletion(self, task: str, messages: list[dict]) -> str:
        model = self.model(task)
        text, cost = await self._awaited(lambda: self._complete(model, messages))
        self._paid(task, cost)
        return text

    async def aembedding(self, task: str, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        model = self.model(task)
        return ordered_vectors(await self._awaited(lambda: self._embed(model, texts)), len(texts), self.dimension)

    async def astreaming(self, task: str, messages: list[dict]) -> AsyncIterator[str]:
        """Texts as they come, from an asynchronous stream or a plain one; empty ones are skipped."""
        model = self.model(task)
        found = await self._awaited(lambda: self._stream(model, messages))
        if hasattr(found, "__aiter__"):
            async for text in found:
                if text:
                    yield text
            return
        rest, end = iter(found), object()
        while (text := await asyncio.to_thread(next, rest, end)) is not end:
            if text:
                yield text

    def completion(self, task: str, messages: list[dict]) -> str:
        model = self.model(task)
        text, cost = self._tried(lambda: self._complete(model, messages))
        self._paid(task, cost)
        return text

    def streaming(self, task: str, messages: list[dict]) -> Iterator[str]:
        """Texts as they come, empty ones skipped; only the start of a stream is retried."""
        model = self.model(task)
        yield from (t for t in self._tried(lambda: self._stream(model, messages)) if t)

    def embedding(self, task: str, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of texts, whatever order the provider answers in."""
        if not texts:
            return []
        model = self.model(task)
        return ordered_vectors(self._tried(lambda: self._embed(model, texts)), len(texts), self.dimension)


def ordered_vectors(found: list[tuple[int, list[float]]], n: int, dimension: int | None) -> list[list[float]]:
    if sorted(i for i, _ in found) != list(range(n)):
        raise ValueError(f"expected {n} vectors, got the indexes of {len(found)}")
    vectors = [v for _, v in sorted(found, key=lambda x: x[0])]
    if dimension is not None and any(len(v) != dimension for v in vectors):
        raise ValueError(f"a vector must have {dimension} components")
    return vectors


def request_ends(counts: list[int], max_tokens: int, max_items: int) -> list[int]:
    """Where requests end in rows of these token counts, but for the last, which more rows may join."""
    ends, at, tokens = [], 0, 0
    for i, n in enumerate(counts):
        if i > at and (tokens + n > max_tokens or i - at >= max_items):
            ends.append(i)
            at, tokens = i, 0
        tokens += n
    return ends


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[tuple[int, list[float]]]], model: str, dimension: int, max_tokens: int = 100_000, max_items: int = 2048, retries: int = 0, store: AnswerStore | None = None, price: float = 0.0, on_paid: Callable[[dict], None] | None = None) -> DataFrame:
    """chunks (text, token_count, ...) with vector and embedding_model; requests are packed within each task by the two limits, over Arrow batches.

    embed runs on executors and is tried retries times again. Without a store a task that is tried again asks again. With
    one each text is asked for once, ever: its missing texts are paid for at once, on_paid is told what that cost (price a
    token), and the vectors are joined from the store.
    """
    if store is not None:
        keyed = chunks.withColumn("_answer", answer_key(model, F.col("text")))
        spent = store.pay(keyed.select(F.col("_answer").alias("key"), "text", "token_count"), embed, model, dimension, max_tokens, max_items, retries, price)
        if on_paid:
            on_paid(spent)
        return keyed.join(store.known(model).withColumnRenamed("key", "_answer"), "_answer").select(*chunks.columns, "vector", F.lit(model).alias("embedding_model"))
    schema = StructType([*chunks.schema.fields, StructField("vector", ArrayType(FloatType())), StructField("embedding_model", StringType())])

    def answered(part: pd.DataFrame) -> pd.DataFrame:
        found = tried(lambda: ordered_vectors(embed(list(part["text"])), len(part), dimension), retries)
        return part.assign(vector=[np.asarray(v, dtype=np.float32) for v in found], embedding_model=model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            at = 0
            for end in request_ends(held["token_count"].tolist(), max_tokens, max_items):
                yield answered(held.iloc[at:end])
                at = end
            held = held.iloc[at:].reset_index(drop=True)
        if held is not None and len(held):
            yield answered(held)

    return chunks.mapInPandas(run, schema)
