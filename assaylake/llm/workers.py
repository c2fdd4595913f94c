"""Helpers of Python workers: batches of bounded bytes, and memory given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices whose texts (of that column) hold at most that many bytes, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = total = 0
        for i, size in enumerate(sizes):
            if total + size > most and i > at:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        if at < batch.num_rows:
            yield batch.slice(at)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on and runs tasks of later stages beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        return


def giving_back(run: Callable, *forget: Callable[[], object]) -> Callable:
    """run (of one argument, an iterator of results) that calls forget and gives memory back when a task is over."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return wrapped
