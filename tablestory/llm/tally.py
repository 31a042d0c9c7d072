"""Sums of arrays of fixed size over all rows of a table, whatever the number of tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PART = 1 << 12


def summed(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int, dtype=np.int64) -> np.ndarray:
    """The sum of the flat arrays that ``each`` makes of the batches of ``df``.

    A task adds up its own; the tasks' arrays travel in parts, are added by other tasks as a stream,
    and only one array of ``size`` comes to the driver.
    """
    parts = -(-size // _PART)

    def packed(rows) -> pa.RecordBatch:
        kept = [(k, zlib.compress(row.tobytes(), 1)) for k, row in rows if row.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([v for _, v in kept], pa.binary())], ["part", "sums"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * _PART, dtype)
        for batch in batches:
            for found in each(batch):
                total[:size] += found
        yield packed(enumerate(total.reshape(parts, _PART)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(zlib.decompress(row), dtype)
                sums[part] = sums[part] + row if part in sums else row
        yield packed(sums.items())

    made = df.mapInArrow(own, "part int, sums binary").repartition(min(parts, 64), "part").mapInArrow(add, "part int, sums binary")
    whole = np.zeros((parts, _PART), dtype)
    for row in made.collect():  # of bounded size; one job, not one a partition
        whole[row.part] += np.frombuffer(zlib.decompress(row.sums), dtype)
    return whole.reshape(-1)[:size]
