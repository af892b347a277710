"""Groups of rows from a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool = True
) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (integers without nulls) as one table. With `whole`
    a run that spans batches comes in one piece, otherwise a piece per batch."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(c[begin].item() for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            held_key = key
            if not whole:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted stream as tables that end where a run of equal keys (integers
    without nulls) ends; for runs that are small."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        new = np.zeros(len(rows) - 1, bool)
        for k in keys:
            c = rows.column(k).to_numpy()
            new |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        last = int(cuts[-1]) + 1 if len(cuts) else 0
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
    if held is not None:
        yield held
