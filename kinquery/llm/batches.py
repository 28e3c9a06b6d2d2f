"""Arrow batches cut by bytes, so that what a worker makes of a slice is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts or ids have about ``most`` bytes together, ``rows`` rows at most.

    A single larger text is a slice of its own.
    """
    values = batch.column(column)
    kind = values.type
    sizes = pc.binary_length(values) if pa.types.is_string(kind) or pa.types.is_binary(kind) else pc.multiply(pc.list_value_length(values), 4)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
        hi = min(hi, lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
