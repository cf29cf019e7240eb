"""Spark jobs of one question under one tag, so that they can be told apart from others' and ended together.

Ending the jobs that run isn't enough: a thread may be between two jobs. So a tag that is cancelled is remembered, and while
any call under it goes on, its jobs are ended again and again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two looks, and tags that are remembered.
LOOK, REMEMBERED = 0.2, 10_000
_CANCELLED: dict[str, None] = {}


class Cancelled(RuntimeError):
    """The question was cancelled, or its reader left."""


def new_tag() -> str:
    return f"question-{uuid.uuid4().hex}"


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts meanwhile carry the tag."""
    context = spark.sparkContext
    had = tag in context.getJobTags()
    context.addJobTag(tag)
    try:
        yield
    finally:
        if not had:
            context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End all jobs of the tag, those that run and those that would follow; who waits for them gets Cancelled."""
    _CANCELLED[tag] = None
    while len(_CANCELLED) > REMEMBERED:
        _CANCELLED.pop(next(iter(_CANCELLED)))
    spark.sparkContext.cancelJobsWithTag(tag)


def at_once(spark: SparkSession, tag: str, calls: list[Callable]) -> list:
    """What the calls give, each in a thread of its own under the tag. If one fails, or the tag is cancelled, the jobs of all end."""

    def run(call: Callable):
        with tagged(spark, tag):
            return call()

    if not calls:
        return []
    with ThreadPoolExecutor(len(calls)) as pool:
        futures = [pool.submit(run, c) for c in calls]
        while True:
            done, going = wait(futures, LOOK, FIRST_EXCEPTION)
            if not going:
                break
            if tag in _CANCELLED or any(f.exception() for f in done):
                spark.sparkContext.cancelJobsWithTag(tag)
                wait(going, LOOK)
    errors = [e for f in futures if (e := f.exception())]
    if tag in _CANCELLED:
        raise Cancelled(tag) from (errors[0] if errors else None)
    if errors:
        raise min(errors, key=lambda e: "cancelled" in str(e))  # not that of a call that was ended for another's
    return [f.result() for f in futures]
