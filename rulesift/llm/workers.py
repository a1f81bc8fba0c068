"""Helpers for code in Python workers: texts one at a time, memory given back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def values(column: pa.Array) -> Iterator[str | None]:
    """The values of a text column, one after another (not all as Python objects at once)."""
    for x in column:
        yield x.as_py()


def give_back() -> None:
    """Returns what this worker has freed to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; what it has freed goes back to the system when a task ends.
    Workers wait for the next task with all their memory otherwise."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
