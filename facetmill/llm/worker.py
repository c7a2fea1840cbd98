"""Memory of Python workers, which outlive tasks: large blocks go back to the system when they are freed."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa

_MMAP_THRESHOLD = -3  # M_MMAP_THRESHOLD of mallopt


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None  # another C library: nothing to tune


@cache
def _tuned() -> None:
    libc = _libc()
    if libc is not None:
        libc.mallopt(_MMAP_THRESHOLD, 1 << 20)


def release() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tuned: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that returns its worker's memory when it ends.

    Tuned, it also returns large blocks meanwhile. That costs a page fault for each page of them, so
    a function that makes many large arrays is better off without.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tuned:
            _tuned()
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
