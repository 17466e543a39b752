"""What Python workers keep between tasks. A worker serves many operators in turn, so it keeps one table at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """The table kept under ``key``, built if another one, or none, is kept."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # gives freed pages back to the system; glibc only
            libc.malloc_trim(0)
        _held[key] = build()
    return _held[key]
