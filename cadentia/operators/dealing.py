"""Dealing rows to tasks whose work is not told by their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

#: Rows that a call over many groups gets at once; a larger group comes whole.
ROWS = 200_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys into as many parts as spark.sql.shuffle.partitions says.

    Adaptive execution merges parts by their bytes, so small rows with much work each would all meet in one task; a
    stated number of parts stays.  A grouping by the same keys needs no further shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _begins(batch: pa.RecordBatch, before: pa.RecordBatch | None, keys: list[str]) -> np.ndarray:
    """Whether each row's keys differ from those of the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None
    for key in keys:
        column = batch.column(key)
        first = pa.concat_arrays([before.column(key).slice(before.num_rows - 1, 1) if before else column.slice(0, 1), column])
        a, b = first.slice(0, len(column)), column
        unlike = pc.fill_null(pc.not_equal(a, b), True)
        if pa.types.is_floating(column.type):
            unlike = pc.and_not(unlike, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new |= pc.and_not(unlike, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def in_groups(rows: DataFrame, keys: list[str], order: list[Column | str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str | StructType, most: int = ROWS) -> DataFrame:
    """What `run` makes of whole groups of equal keys: it gets a table of about `most` rows, in order of keys and `order`, and the row at
    which each group begins.

    A call for each group costs about a millisecond, which small groups never earn back.  Here a task streams its groups, ordered by
    Spark, through few calls; only a group that is larger is in memory whole."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        begins: list[np.ndarray] = []
        size = 0

        def call() -> Iterator[pa.RecordBatch]:
            yield from run(pa.Table.from_batches(held), np.concatenate(begins)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(_begins(batch, held[-1] if held else None, keys))
            if len(new) and size + new[-1] >= most and size + new[-1] > 0:
                # All groups but the one that the batch ends with are whole.
                cut = int(new[-1])
                held.append(batch.slice(0, cut))
                begins.append(new[:-1] + size)
                yield from call()
                held, begins, size, batch, new = [], [], 0, batch.slice(cut), np.zeros(1, np.int64)
            held.append(batch)
            begins.append(new + size)
            size += batch.num_rows
        if held:
            yield from call()

    return dealt(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(whole, schema)
