"""Best-fit packing of documents into training sequences, with large items matched first.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made from
the counts of pieces per length: a table of at most 2,048 rows whatever the corpus holds. It says how
many sequences there are of each pattern and which lengths lie where in them; each piece then takes
the slot of its rank among the pieces of its length. No row travels to the driver or to one task.

The plan. A piece of over a third of the capacity is large; two at most fit together. From the
longest down, each large piece is matched with the longest other large piece that fits beside it.
Then the smaller ones, longest first, each go where the smallest sufficient gap is left; where none
is, they open a sequence. Counts are handled a pattern at a time.

Ranks. Pieces are written once, with the number of their partition and of their place among the
partition's pieces of that length. Sums of the (partition, length) counts give each partition's first
rank, so a length that a third of all pieces share is never sorted or gathered.

Defined cases: a null or empty text is one piece of the closing id alone; a null doc_id stays null;
repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import stored
from tessella.llm.encoding import vocabulary, word_encoder

CAPACITY = 2048
END = (0).to_bytes(4, "little")
BROADCAST_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, carry_ids: bool = False) -> DataFrame:
    """The pieces of each document: at most ``capacity`` ids, cut only where a document is longer.

    ``part`` and ``nth`` number the pieces of one length; ``ids`` (with ``carry_ids``) are little-endian
    unsigned 32-bit ids.
    """
    path = tokenizer or vocabulary("word_bpe_49k.json")
    schema = PIECES + (", ids binary" if carry_ids else "")

    def cut(batches):
        encoder = word_encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(piece)
                    rows["start"].append(at // 4)
                    rows["length"].append(n)
                    rows["ids_crc32"].append(zlib.crc32(own))
                    rows["nth"].append(int(seen[n]))
                    rows["ids"].append(own if carry_ids else None)
                    seen[n] += 1
            n = len(rows["doc_id"])
            columns = [
                pa.array(rows["doc_id"], pa.int64()),
                pa.array(rows["piece"], pa.int32()),
                pa.array(rows["start"], pa.int64()),
                pa.array(rows["length"], pa.int64()),
                pa.array(rows["ids_crc32"], pa.int64()),
                pa.array([part] * n, pa.int32()),
                pa.array(rows["nth"], pa.int64()),
            ] + ([pa.array(rows["ids"], pa.binary())] if carry_ids else [])
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in each) for the large pieces: longest first, with the longest that fits beside it."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    made = []
    while order:
        n = order[-1]
        c = left[n]
        at = bisect_left(order, capacity - n + 1) - 1
        if at < 0:
            made.append((c, [n]))
            taken = c
        elif order[at] == n:  # fits beside its own kind
            taken = c - c % 2
            if taken:
                made.append((c // 2, [n, n]))
            else:
                at -= 1
                made.append((1, [n, order[at]] if at >= 0 else [n]))
                taken = 1
                if at >= 0:
                    _take(left, order, order[at], 1)
        else:
            taken = min(c, left[order[at]])
            made.append((taken, [n, order[at]]))
            _take(left, order, order[at], taken)
        _take(left, order, n, taken)
    return made


def _take(left: dict[int, int], order: list[int], n: int, c: int) -> None:
    left[n] -= c
    if not left[n]:
        order.pop(bisect_left(order, n))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(length, times), ...]) that hold exactly the counted pieces."""
    large = match_large({n: c for n, c in counts.items() if 3 * n > capacity}, capacity)
    groups: dict[int, list] = {}  # gap -> [sequences, runs] still open
    gaps: list[int] = []

    def put(gap: int, sequences: int, runs: list) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((sequences, runs))

    for sequences, lengths in large:
        put(capacity - sum(lengths), sequences, [(n, 1) for n in lengths])
    for n in sorted((n for n in counts if 3 * n <= capacity and counts[n] > 0), reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = min(capacity // n, c)
                full, rest = divmod(c, each)
                put(capacity - each * n, full, [(n, each)])
                if rest:
                    put(capacity - rest * n, 1, [(n, rest)])
                break
            gap = gaps[at]
            sequences, runs = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            # a sequence just filled has the smallest sufficient gap as long as another piece fits
            each = min(gap // n, c)
            used = min(sequences, c // each)
            put(gap - each * n, used, [*runs, (n, each)])
            if sequences > used:
                put(gap, sequences - used, runs)
            c -= used * each
    return [g for gap in gaps for g in groups[gap]]


def slots(patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, for ranks from 0: where each run of slots begins, its first sequence, slots a sequence, first offset."""
    first, found = 0, {}
    for sequences, runs in patterns:
        offset = 0
        for n, times in runs:
            at, rows = found.setdefault(n, (0, []))
            rows.append((at, first, times, offset))
            found[n] = (at + sequences * times, rows)
            offset += n * times
        first += sequences
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, (_, rows) in found.items()}


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, carry_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with their sequence_id and offset."""
    cut = stored(pieces(docs, capacity, tokenizer, carry_ids))
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n"))
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    small = firsts.count() <= BROADCAST_ROWS
    firsts = firsts.select("part", "length", "first")
    ranked = cut.join(F.broadcast(firsts) if small else firsts, ["part", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(lengths[order]))[0] + 1):
            if len(rows):
                n = int(lengths[rows[0]])
                begins, first, times, start = shared.value[n]
                run = np.searchsorted(begins, ranks[rows], side="right") - 1
                inside = ranks[rows] - begins[run]
                sequence[rows] = first[run] + inside // times[run]
                offset[rows] = start[run] + inside % times[run] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", F.col("first") + F.col("nth")))
    extra = ["ids"] if carry_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *extra)
