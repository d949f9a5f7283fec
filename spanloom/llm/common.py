"""What several operators share: bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``most_bytes`` of text (or one longer text)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
            yield b.slice(at, to - at)
            at = to
