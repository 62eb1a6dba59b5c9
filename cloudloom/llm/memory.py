"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand memory that a finished task no longer needs back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
