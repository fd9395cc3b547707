"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """``run``, after which the worker gives the memory it has freed back to the machine: Spark keeps it, idle, beside later stages."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
        if trim is not None:
            trim(0)
    return wrapped
