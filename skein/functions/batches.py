"""Arrow columns of texts in slices of bounded size, for functions that run in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skein.functions import text as T

#: Bytes and rows that Python handles at once, so that a worker's memory doesn't depend on the Arrow batch.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 12
TOKEN = re.compile(T.TOKEN)


def slices(text: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, list[str]]]:
    """The first row and the texts of slices of about limit bytes and rows rows at most; a longer text is a slice of its own, a null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))))
        yield lo, [x or "" for x in text.slice(lo, hi - lo).to_pylist()]
        lo = hi
