"""What a task leaves in its Python worker, which goes on to serve other tasks and other operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool and, where the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, releasing memory when a task has ended."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
