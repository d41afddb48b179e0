"""Whole groups out of a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def numbered(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Numbers the groups of rows that stand together from 0; nulls are alike."""
    new = np.zeros(table.num_rows, bool)
    for c in by:
        code = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def whole(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the number of each row's group; rows of a group come one after another. Only a group that runs on is held over."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        tail = held[-1].slice(held[-1].num_rows - 1) if held else None
        group = numbered(table if tail is None else pa.concat_tables([tail, table]), by)
        goes_on = tail is not None and group[0] == group[1]
        group = group if tail is None else group[1:]
        last = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if last == 0 and goes_on:
            held.append(table)
            continue
        done = pa.concat_tables([*held, table.slice(0, last)])
        if done.num_rows:
            yield done, numbered(done, by)
        held = [table.slice(last)]
    if held:
        done = pa.concat_tables(held)
        yield done, numbered(done, by)
