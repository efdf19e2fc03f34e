"""Arrow batches in slices, so that what a worker makes of a batch stays bounded however many rows it has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of rows that a stage works on and gives out at once; what they are made into takes some times as much, whatever the batch.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes, or of one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)
