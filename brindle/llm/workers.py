"""What the Python workers of executors share."""

from __future__ import annotations

import ctypes
import gc


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks and share an executor's limit."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep() -> None:
    """From now on freed arrays of up to 2 MB, 16 MB of them at most, stay with the worker: else each step of a loop faults their pages in again."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except AttributeError:  # another C library
        return
    mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
