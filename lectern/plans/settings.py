"""Settings from a TOML file and the environment, checked against the dataclass that holds them."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, TypeVar

from lectern.plans.contracts import DIMENSION
from lectern.plans.gateway import Gateway

T = TypeVar("T")
_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def _as(kind: Any, value: Any, name: str) -> Any:
    """value as the kind of the default that it replaces; None has no kind, so text stays text."""
    if kind is type(None) or not isinstance(value, str):
        fits = kind is type(None) or isinstance(value, kind) or (kind is float and type(value) is int)
        if not fits or (kind is int and isinstance(value, bool)):
            raise ValueError(f"{name} must be {kind.__name__}, not {value!r}")
        return float(value) if kind is float else value
    if kind is bool:
        if value.lower() not in _TRUE + _FALSE:
            raise ValueError(f"{name} must be true or false, not {value!r}")
        return value.lower() in _TRUE
    return kind(value)


def load(kind: type[T], path: str | None = None, prefix: str = "LECTERN", environ: Mapping[str, str] | None = None) -> T:
    """An instance of the dataclass kind: its defaults, then the file's top-level values, then the environment's PREFIX_NAME.

    A name in the file that kind lacks is an error; other tables of the file are others' settings. kind checks itself when it is made."""
    defaults = {f.name: f.default for f in fields(kind)}
    given = {k: v for k, v in (tomllib.loads(Path(path).read_text()) if path else {}).items() if not isinstance(v, dict)}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    env = os.environ if environ is None else environ
    given |= {n: env[key] for n in defaults if (key := f"{prefix}_{n.upper()}") in env}
    return kind(**{n: _as(type(defaults[n]), v, n) for n, v in given.items()})


@dataclass(frozen=True)
class ModelSettings:
    """Which model does which task, from the same files and environment as other settings. A blank task takes the default model."""

    default: str = "default"
    embed: str = "embed"
    plan: str = ""
    reflect: str = ""
    synth: str = ""
    retries: int = 2
    dimension: int = DIMENSION

    def __post_init__(self) -> None:
        if not self.default.strip() or not self.embed.strip():
            raise ValueError("default and embed must name models")
        if self.retries < 0 or self.dimension < 1:
            raise ValueError("retries must not be negative, and vectors have one component or more")


def ingest_models(s: ModelSettings) -> dict[str, str]:
    """Task to model of an ingest run."""
    return {"embed": s.embed, "default": s.default}


def query_models(s: ModelSettings) -> dict[str, str]:
    """Task to model of a question; its vectors come from the model that made the stored ones."""
    return {task: getattr(s, task) or s.default for task in ("plan", "reflect", "synth")} | {"embed": s.embed}


def gateway_of(s: ModelSettings, models: Mapping[str, str], **calls) -> Gateway:
    """A gateway to these models with the settings' retries and dimension; calls: complete, stream, embed, on_cost."""
    return Gateway(dict(models), retries=s.retries, dimension=s.dimension, **calls)
