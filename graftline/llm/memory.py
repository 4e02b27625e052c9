"""Memory of Python workers, which live on between stages: what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's own function, where it has one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gives back what it freed whenever it has passed on a batch, and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            yield batch
            del batch
            give_back()
        give_back()

    return run
