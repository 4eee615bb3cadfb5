"""Arrow columns of texts in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_BYTES = 1 << 24


def sized_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, values) of runs of about `size` bytes or characters; a larger value is alone."""
    first, part, n = 0, [], 0
    for i, x in enumerate(column):
        part.append(x.as_py())
        n += len(part[-1] or "")
        if n >= size:
            yield first, part
            first, part, n = i + 1, [], 0
    if part:
        yield first, part
