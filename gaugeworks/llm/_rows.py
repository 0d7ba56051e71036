"""Arrow batches cut to bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes that are turned into Python objects at once.
ROWS, BYTES = 512, 2_000_000


def batches_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``ROWS`` rows, fewer where rows are long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(ROWS, ROWS * BYTES // max(BYTES, batch.nbytes * ROWS // batch.num_rows)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def text_column(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one if a table has it already; case doesn't tell names apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
