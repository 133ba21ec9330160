"""Embeddings as whole numbers, packed in chunks: what the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of one chunk. A chunk is what a task holds at a time.
CHUNK = 1024
#: Components beyond this count as this: squared distances of 64 components then fit in 64 bits.
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component of it is a finite number."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component as int64, within LIMIT."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def integer_matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """The whole numbers of a list column whose vectors have one length."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(flat, scale).reshape(len(lists), -1)


def chunks(batches, rows: int = CHUNK):
    """Arrow batches as tables of ``rows`` rows (the last may have fewer)."""
    held, size = [], 0
    for batch in batches:
        while size + batch.num_rows >= rows:
            take = rows - size
            yield pa.Table.from_batches([*held, batch.slice(0, take)])
            batch, held, size = batch.slice(take), [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def narrow(matrix: np.ndarray) -> bytes:
    """A matrix of whole numbers within LIMIT as bytes."""
    return np.ascontiguousarray(matrix, np.int32).tobytes()


def wide(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(rows, -1).astype(np.int64)


def exact(total: Column) -> Column:
    """A sum of long values that does not overflow on the way; null where the result itself does not fit."""
    return F.sum(total.cast("decimal(38,0)"))


def floors(totals: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds rows (entry, place, n, total) into ``sums`` (Python integers) and ``counts``."""
    for row in totals.collect():
        counts[row["entry"]] = row["n"]
        sums[row["entry"], row["place"]] = int(row["total"])
