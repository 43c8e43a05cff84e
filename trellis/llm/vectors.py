"""Vectors as packed integers, in chunks that one task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def scaled(vector: str, factor: int, limit: int) -> Column:
    """Every component as the integer floor(factor * x); more than ``limit`` in size is an error."""

    def whole(x: Column) -> Column:
        value = F.floor(x.cast("double") * factor)
        return F.when(F.abs(x.cast("double") * factor) < limit, value).otherwise(
            F.raise_error(F.lit(f"a component times {factor} is not below {limit}")).cast("long")
        )

    return F.transform(vector, whole)


def matrix(lists: pa.Array, width: int, dtype=np.int64) -> np.ndarray:
    """Integer lists as rows; shorter ones are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    out = np.zeros((len(lists), width), dtype)
    out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches of a task as tables of ``size`` rows; the last may be smaller."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == size:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
