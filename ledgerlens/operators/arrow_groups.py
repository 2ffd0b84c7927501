"""Groups of rows inside a task, for functions that `mapInArrow` applies to sorted rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Sent to Python workers by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Each run of rows with equal whole-number keys as one batch; a run may go on over several batches."""
    held: list[pa.RecordBatch] = []
    current: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy() for key in keys]
        changes = np.zeros(batch.num_rows - 1, bool)
        for column in columns:
            changes |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(column[start] for column in columns)
            if held and key != current:
                yield _joined(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
