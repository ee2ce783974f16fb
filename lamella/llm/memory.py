"""Bounded memory in Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXTS_AT_ONCE = 1 << 20


def text_runs(column: pa.Array, most: int = TEXTS_AT_ONCE) -> Iterator[tuple[int, int, list]]:
    """Start, end and texts of runs of about `most` bytes; only one run is held as Python strings."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = min(len(column), int(np.searchsorted(ends, before + most, "right")) + 1)
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def give_back() -> None:
    """Returns freed memory to the system: idle workers stay alive, beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel
