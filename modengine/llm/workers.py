"""Memory of Python workers, which Spark keeps for the tasks of later operators.

What a task frees stays with the allocators of its worker, Arrow's and the C library's. A worker that waits would hold the
most that any task before needed, and an executor has that beside its heap once for each of its workers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: Bytes of a group from which its memory is given back at once; smaller ones leave little behind.
LARGE_GROUP = 1 << 20


def give_back() -> None:
    """Return freed memory to the system; without the C library's call for it, only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over the batches of a task, whose freed memory is given back at its end."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]):
    """``run`` over a group, whose freed memory is given back where the group is large."""

    @wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes >= LARGE_GROUP:
                give_back()

    return tidied
