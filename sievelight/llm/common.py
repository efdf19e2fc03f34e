"""Helpers the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from ..tables import drop_table, new_table, shared_dir, stored, table

__all__ = ["ASCII_SPACE", "drop_table", "new_table", "shared_dir", "stored", "table", "trim", "trimming"]

#: Fixed value: the ASCII white space of the word and line rules, inside a character class.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def trim() -> None:
    """Gives the memory of arrays that are gone back to the system, where the C library can: an idle worker then holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimming(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow(), with trim() at its end: idle workers stay while later stages run."""

    def trimmed(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return trimmed
