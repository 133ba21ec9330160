"""Vector code compression: a codebook per part of a vector, nearest entries by screening.

Vectors become whole numbers once and are stored in chunks; a round passes the codebooks (parts x entries x width
numbers) to the tasks and brings back one partial sum per entry and component.

Screening. With x a part and c an entry, ``|c|^2 - 2 x.c`` orders the entries as the squared distance
does. It is computed as one float32 matrix product. Each value's rounding error is at most
``(width + 6) u (|c|^2 + 2 |x| |c|)`` with u = 2^-24: each factor is rounded once, a sum of ``width`` products, in any
order and with or without fused steps, errs by width u, and norm, difference and bound take the rest. The value
plus and minus that bound is an interval that holds the true one. An entry whose interval begins
above the smallest upper end cannot be nearest; where more than one is left, all left are computed again
in int64, and ties go to the lower index.

Defined cases: vectors that are null or hold a null or non-finite component are left out, as are those
whose length is not the commonest one that the number of parts divides (of equally common ones the longer). Fewer
vectors than entries give fewer entries; none give no rows. Repeated rows count as often as they occur; a
null vec_id comes last in the order and is kept; equal ids are ordered by their vectors. Components
beyond ``vectors.LIMIT`` after scaling count as that limit. A label's sum that does not fit a long is
null. Null labels are one group. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import release, stored
from tessella.llm.vectors import chunks, exact, finite, floors, integer_matrix, narrow, whole_numbers, wide

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Label sums are broadcast below this many rows (about 20 bytes each) and joined by a shuffle above.
BROADCAST_ROWS = 50_000
UNIT = 2.0**-24


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` to each row of ``parts``, and the squared distance; both whole numbers in int64."""
    norms = (book * book).sum(1)
    lengths = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
    value = norms.astype(np.float32) - 2 * (parts.astype(np.float32) @ book.astype(np.float32).T)
    size = norms.astype(np.float64) + 2 * lengths[:, None] * np.sqrt(norms.astype(np.float64))
    bound = 1.001 * (parts.shape[1] + 6) * UNIT * size
    lower, upper = value.astype(np.float64) - bound, value.astype(np.float64) + bound
    left = lower <= upper.min(1)[:, None]
    code = left.argmax(1)
    row, entry = np.nonzero(left & (left.sum(1) > 1)[:, None])
    gap = parts[row] - book[entry]
    square = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((entry, square, row))
    won = order[np.diff(row[order], prepend=-1) != 0]
    code[row[won]] = entry[won]
    gap = parts - book[code]
    return code, np.einsum("ij,ij->i", gap, gap)


def _integers(scale: int, schema: pa.Schema):
    def make(batches):
        for table in chunks(batches):
            rest = [[x] for x in (table.column("vec_id").to_pylist(), table.column("label").to_pylist(), narrow(integer_matrix(table.column("embedding"), scale)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rest, schema.types)], schema=schema)

    return make


PARTIAL = "entry int, place int, n long, total long"


def _partial_sums(books: np.ndarray):
    """``books`` is (parts, entries, width). Entries are numbered through all parts."""
    parts, entries, width = books.shape

    def sums(batches):
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                points = wide(data, len(data) // (4 * parts * width))
                for p in range(parts):
                    own = points[:, p * width : (p + 1) * width]
                    code, _ = nearest(own, books[p])
                    order = np.argsort(code, kind="stable")
                    used, first, many = np.unique(code[order], return_index=True, return_counts=True)
                    n[p * entries + used] += many
                    total[p * entries + used] += np.add.reduceat(own[order], first, axis=0)
        entry, at = np.indices(total.shape)
        out = {"entry": entry.ravel().astype(np.int32), "place": at.ravel().astype(np.int32), "n": np.repeat(n, width), "total": total.ravel()}
        yield pa.RecordBatch.from_pydict(out)

    return sums


def _coded(books: np.ndarray, schema: pa.Schema):
    parts, _, width = books.shape

    def encode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                points = wide(data, len(data) // (4 * parts * width))
                found = [nearest(points[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
                codes = ["".join(f"{c:02x}" for c in row) for row in np.stack([c for c, _ in found], 1).tolist()]
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes, pa.string()), pa.array(error)], schema=schema)

    return encode


def trained(rows: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` rounds over the stored chunks ``rows``."""
    books = first
    parts, entries, width = books.shape
    for _ in range(rounds):
        partial = rows.select("data").mapInArrow(_partial_sums(books), PARTIAL)
        totals = partial.groupBy("entry", "place").agg(F.sum("n").alias("n"), exact(F.col("total")).alias("total"))
        sums, counts = np.zeros((parts * entries, width), object), np.zeros(parts * entries, object)
        floors(totals, sums, counts)
        used = counts > 0
        flat = books.reshape(parts * entries, width).copy()
        flat[used] = (sums[used] // counts[used, None]).astype(np.int64)
        books = flat.reshape(parts, entries, width)
    return books


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256, and its label.

    Codebooks start as the parts of the vectors with the ``entries`` smallest ids (at most 256, as a code has two digits a part).
    """
    spark = embeddings.sparkSession
    kept = embeddings.filter(finite(F.col("embedding"))).select("vec_id", "label", "embedding", F.size("embedding").alias("d"))
    lengths = kept.filter((F.col("d") > 0) & (F.col("d") % parts == 0)).groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    id_type, label_type = (kept.schema[c].dataType for c in ("vec_id", "label"))
    out = f"vec_id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error long"
    if not lengths:
        return spark.createDataFrame([], f"{out}, label_error long, codebooks_sha256 string").select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")
    kept = kept.filter(F.col("d") == lengths[0]["d"]).drop("d")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = whole_numbers(np.array([r["embedding"] for r in first]), scale).reshape(len(first), parts, -1).transpose(1, 0, 2)
    arrow = pa.schema([("ids", pa.list_(to_arrow_type(id_type))), ("labels", pa.list_(to_arrow_type(label_type))), ("data", pa.binary())])
    packed = f"ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>, data binary"
    rows = stored(kept.mapInArrow(_integers(scale, arrow), packed))
    books = trained(rows, start, rounds)
    arrow = pa.schema([("vec_id", to_arrow_type(id_type)), ("label", to_arrow_type(label_type)), ("code", pa.string()), ("error", pa.int64())])
    coded = stored(rows.mapInArrow(_coded(books, arrow), out))
    release(rows)
    sums = stored(coded.groupBy("label").agg(exact(F.col("error")).try_cast("long").alias("label_error")))
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.alias("c").join(sums.alias("s"), F.expr("c.label <=> s.label"), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "c.label")
