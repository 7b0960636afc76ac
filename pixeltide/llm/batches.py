"""Arrow batches cut by size of text, so that memory stays bounded whatever the texts' lengths.

What arrives is bounded by the session's own limits on rows and bytes of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .exchange import release


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, one row at least.

    Rows keep their order, and none is cut: a text longer than ``most`` comes alone.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, column, sizes
        release()
