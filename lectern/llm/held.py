"""What a Python worker keeps from task to task: one store at a time, and memory that goes back to the system.

Spark reuses its workers, so what one stage has left behind counts beside what the next one needs.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HELD: dict[Any, Any] = {}


def release() -> None:
    """Give back what is no longer used: cycles, Arrow's pool, and free pages of the C library, where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it only keeps the pages for later


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The store of that key, made once a worker; making one drops any other."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Drop what is held: the worker goes on to a stage that needs none of it."""
    _HELD.clear()
    release()
