"""Python workers live on between tasks; what a task needed is given back at its end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, with its memory released when it ends."""

    @wraps(run)
    def call(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return call
