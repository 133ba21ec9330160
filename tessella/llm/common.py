"""Helpers that the training-data operators share: scratch tables, column names, packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.scratch import release, scratch_dir, stored  # noqa: F401

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; bytes.split() splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, like bytes of all elements together, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T if len(values) else values.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted unsigned array as compressed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


#: Rows that a chunk, or a group of merged chunks, is dealt into at once.
FAN = 1024
PACKED = "kind string, key long, source long, data array<binary>"
PACKED_ARROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("source", pa.int64()), ("data", pa.list_(pa.binary()))])


class Packed:
    """Arrays of one length, the first a sorted 64-bit hash, in a row per bucket of that hash.

    ``kinds`` are the dtypes; those ending in ``d`` are stored as differences. Buckets are equal ranges
    of the hash. Chunks deal into at most FAN buckets at first; where there are more, the rows of FAN chunks
    are merged and dealt on, so rows grow with the data and not with its square.
    """

    def __init__(self, kind: str, *kinds: str):
        self.kind = kind
        self.kinds = [(k.rstrip("d"), k.endswith("d")) for k in kinds]

    def pack(self, arrays) -> list[bytes]:
        return [pack_sorted(np.ascontiguousarray(x, k)) if delta else pack(np.ascontiguousarray(x, k)) for x, (k, delta) in zip(arrays, self.kinds)]

    def unpack(self, data: list[bytes]) -> list[np.ndarray]:
        return [unpack_sorted(x, k) if delta else unpack(x, k) for x, (k, delta) in zip(data, self.kinds)]

    def gather(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        """The arrays of all rows together, made one by one, so that only one is held in parts."""
        one = lambda i, k, delta: [unpack_sorted(r[i], k) if delta else unpack(r[i], k) for r in rows]
        return [np.concatenate(one(i, k, delta)) if rows else np.zeros(0, k) for i, (k, delta) in enumerate(self.kinds)]

    def deal(self, arrays, buckets: int, source: int):
        """A row per bucket of arrays sorted by their first."""
        which = ((arrays[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        for i, j in zip(edges, edges[1:]):
            if i < j:
                yield {"kind": self.kind, "key": int(which[i]), "source": source, "data": self.pack([x[i:j] for x in arrays])}

    @staticmethod
    def counts(size: int, bucket_bytes: int) -> tuple[int, int]:
        """(buckets that chunks deal into, buckets in the end) for ``size`` bytes."""
        buckets = 1 + size // bucket_bytes
        first = min(buckets, FAN)
        return first, -(-buckets // first) * first

    def refined(self, rows: DataFrame, first: int, buckets: int, chunks: int) -> DataFrame:
        """Rows of ``first`` buckets dealt on into ``buckets``; rows with a key below 0 stay as they are."""
        while first < buckets:
            wider = min(first * FAN, buckets)
            wider -= wider % first
            rows = rows.withColumn("part", F.pmod("source", F.lit(1 + chunks // FAN))).groupBy("key", "part").applyInArrow(self._split(wider), PACKED)
            first = wider
        return rows

    def _split(self, buckets: int):
        def split(key, table):
            if key[0].as_py() < 0:
                return table.select(PACKED_ARROW.names)
            arrays = self.gather(table.column("data").to_pylist())
            order = np.argsort(arrays[0], kind="stable")
            rows = list(self.deal([x[order] for x in arrays], buckets, key[1].as_py()))
            return pa.Table.from_pylist(rows, PACKED_ARROW)

        return split
