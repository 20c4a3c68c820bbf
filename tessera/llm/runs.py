"""Work on many small groups at once: sorted partitions, handed on in chunks of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.memory import lean


def by_runs(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, chunk_rows: int = 50_000, chunk_bytes: int = 16_000_000, parts: int | None = None) -> DataFrame:
    """``work(table, group)`` on chunks of whole groups, equal ``keys`` next to each other and numbered by ``group``.

    Keys are integers. A chunk holds about ``chunk_rows`` rows or ``chunk_bytes``, or one group if that is larger, so
    groups must be bounded; callers deal long ones to tiles first. ``parts``: how many tasks, where bytes say little of work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0

        def groups(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                column = table[k].to_numpy()
                new[1:] |= column[1:] != column[:-1]
            return np.cumsum(new)

        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n < chunk_rows and size < chunk_bytes:
                continue
            table = pa.Table.from_batches(held)
            group = groups(table)
            end = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if end:
                yield from work(table.slice(0, end).combine_chunks(), group[:end]).to_batches()
            held = table.slice(end).to_batches()
            n, size = table.num_rows - end, sum(b.nbytes for b in held)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, groups(table)).to_batches()

    return (rows.repartition(parts, *keys) if parts else rows.repartition(*keys)).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


def pairs_of(group: np.ndarray, side: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group, in parts; rows with a side are paired with the other side only."""
    at = np.arange(len(group))
    step = 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        i = at[(side[at] < 0) | (side[at] != side[at + step])]
        for begin in range(0, len(i), most):
            part = i[begin : begin + most]
            yield part, part + step
        step += 1


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a combined table as one array."""
    c = table[name]
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def joined(values: pa.Array) -> np.ndarray:
    """Bytes of all strings of a binary array without nulls, one after another, as they lie in it."""
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
