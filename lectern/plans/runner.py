"""Stages of a run, kept track of in a ledger: a folder of small records on any file system that Spark reaches.

A record is a file of its own, made once and never changed, so nothing has to be replaced as a whole. What is known of a
stage is the fold of its records: a success clears an error, a failure keeps what the last success left.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import SparkSession

RECORDS = "_ledger"


def _flat(value: Any, at: str = "") -> Iterator[str]:
    """One line for each leaf of nested settings, in an order that doesn't depend on that of keys."""
    if isinstance(value, dict):
        yield f"{at}:{len(value)}"
        for k in sorted(value, key=str):
            yield from _flat(value[k], f"{at}/{k}")
    elif isinstance(value, (list, tuple)):
        yield f"{at}#{len(value)}"
        for i, x in enumerate(value):
            yield from _flat(x, f"{at}/{i}")
    else:
        yield f"{at}={value!r}"


def settings_key(settings: dict, after: str = "") -> str:
    """A key of settings and of the key they build on: equal for equal settings, whatever their order."""
    digest = hashlib.sha256(after.encode())
    for line in _flat(settings):
        digest.update(f"{line}\n".encode())
    return digest.hexdigest()


class Files:
    """The few calls that a ledger needs of Hadoop's file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file under another name first, so that a reader never sees half of it."""
        fs, at = self._at(path)
        half = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(half, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(half, at):
            raise OSError(f"{path} could not be made")


@dataclass(frozen=True)
class Known:
    """What the ledger knows of a stage."""

    status: str = "new"
    key: str = ""
    outputs: tuple[str, ...] = ()
    error: str | None = None

    def then(self, record: dict) -> Known:
        if record["status"] == "failed":
            return replace(self, status="failed", error=record["error"])
        return Known(record["status"], record["key"], tuple(record["outputs"]))


class Ledger:
    """A run's folder base/run and its records. One writer at a time."""

    def __init__(self, spark: SparkSession, base: str, run: str) -> None:
        self.spark, self.files, self.run = spark, Files(spark), run
        self.root = f"{str(base).rstrip('/')}/{run}"

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def records(self) -> list[dict]:
        folder = self.path(RECORDS)
        return [json.loads(self.files.read(f"{folder}/{n}")) for n in self.files.names(folder) if n.endswith(".json")]

    def known(self) -> dict[str, Known]:
        found: dict[str, Known] = {}
        for r in self.records():
            found[r["stage"]] = found.get(r["stage"], Known()).then(r)
        return found

    def add(self, stage: str, status: str, **more: Any) -> None:
        no = 1 + sum(n.endswith(".json") for n in self.files.names(self.path(RECORDS)))
        self.files.create(self.path(RECORDS, f"{no:08d}.json"), json.dumps({"stage": stage, "status": status, "at": time.time(), **more}))

    def settled(self, stage: Stage, key: str) -> bool:
        """Done with this key, and all that it left is still there."""
        now = self.known().get(stage.name, Known())
        return now.status == "done" and now.key == key and all(self.files.exists(self.path(p)) for p in now.outputs)


@dataclass(frozen=True)
class Place:
    """Where a stage works: folder is its own; path() leads to anything in the run's folder."""

    ledger: Ledger
    folder: str

    def path(self, *parts: str) -> str:
        return self.ledger.path(*parts)


@dataclass
class Stage:
    """work(place) -> what to tell of the result; settings: all that it depends on; outputs: paths in the run's folder that it leaves."""

    name: str
    work: Callable[[Place], Any]
    settings: dict = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)

    def perform(self, ledger: Ledger, key: str) -> Any:
        try:
            told = self.work(Place(ledger, ledger.path(self.name)))
        except BaseException as e:
            ledger.add(self.name, "failed", error=f"{type(e).__name__}: {e}")
            raise
        ledger.add(self.name, "done", key=key, outputs=self.outputs)
        return told


def chained_keys(stages: list[Stage]) -> list[str]:
    """A stage's key covers all before it, so one that changes is noticed by every later one, even after a stop between two."""
    keys: list[str] = []
    for s in stages:
        keys.append(settings_key(s.settings, keys[-1] if keys else ""))
    return keys


def run_in_order(stages: list[Stage], ledger: Ledger) -> dict[str, Any]:
    """Perform the stages from the first that isn't settled to the last; what each told, by name."""
    keys = chained_keys(stages)
    begin = next((i for i, (s, k) in enumerate(zip(stages, keys, strict=True)) if not ledger.settled(s, k)), len(stages))
    return {s.name: s.perform(ledger, k) for s, k in zip(stages[begin:], keys[begin:], strict=True)}


def first_open(view: list[dict]) -> str | None:
    """The default policy: the first stage that isn't done."""
    return next((s["name"] for s in view if not s["done"]), None)


def run_by_policy(stages: list[Stage], ledger: Ledger, policy: Callable[[list[dict]], str | None] = first_open, most: int | None = None) -> dict[str, Any]:
    """Perform what the policy names, again and again, until it names nothing; no stage makes another run.

    It may name stages most times (default: four a stage and one more); beyond that there is a RuntimeError."""
    told, known = {}, {s.name: (s, settings_key(s.settings)) for s in stages}
    turns = 4 * len(stages) + 1 if most is None else most
    while (name := policy([{"name": n, "done": ledger.settled(s, k)} for n, (s, k) in known.items()])) is not None:
        if not turns:
            raise RuntimeError("the policy did not come to an end")
        turns -= 1
        stage, key = known[name]
        told[name] = stage.perform(ledger, key)
    return told
