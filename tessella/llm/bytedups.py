"""Exact substring dedup: bytes covered by strings of ``width`` bytes that also start anywhere else.

Sharding. The anchor of a string of ``width`` bytes is the place in it where the hash of ``GRAM`` bytes is
smallest. Equal strings have equal anchors, so strings are dealt out by their anchor's hash and
duplicates always meet in one shard. Neighbouring strings mostly share an anchor: a fragment is a run of
them. Of two equal strings one side of the anchor is shared over ``SIDE`` grams at least, so first only
hashes of the anchor with either side are counted; a fragment whose two sides occur once cannot hold a
duplicate and stays behind.

Sorting. A shard's distinct fragments are sorted by external induced sorting (:mod:`suffixes`), which
also gives common prefixes. A string is a duplicate if its fragment occurs twice, or if a neighbour in the
order shares ``width`` bytes with it. Copies of a fragment meet once within each chunk of documents and
as one entry per chunk in the shard, so a passage in very many documents stays small.

Judged on the input: overlapping strings all count. Defined cases: a null or empty text has no bytes; a text shorter
than ``width`` loses none; rows equal in doc_id and text are copies of each other, as any equal texts are;
they are told by a hash of both; a very long text is dealt into strings like others and put together whole at the end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import pack, pack_sorted, stored, unpack, unpack_sorted
from tessella.llm.decontamination import merged
from tessella.llm.passages import ODD, document_key, mix
from tessella.llm.suffixes import suffix_order

WIDTH = 200
GRAM = 32
#: Grams counted on either side of an anchor: a window of 200 has 168 bytes beside its anchor, 84 or more of them on one side.
SIDE = 2
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
#: Bytes of corpus for each shard that is sorted.
SHARD_BYTES = 4 << 20
SORT_MEMORY = 64 << 20

ROWS = "kind string, key long, data array<binary>"
ARROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("data", pa.list_(pa.binary()))])


def _table(rows) -> pa.Table:
    return pa.Table.from_pylist([{"kind": k, "key": int(key), "data": data} for k, key, data in rows], ARROW)


def anchors(raw: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``width`` bytes: its anchor's place, and (per place) the hash of the bytes there."""
    h, n = raw.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15)
        while n < gram:  # gram is a power of two
            h = h[:-n] * power + h[n:]
            power = power * power
            n *= 2
        h = mix(h)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span, n = width - gram + 1, 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < span:
        least = np.minimum(least[: len(least) - (span - n)], least[span - n :])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), h


def fragments(raw: np.ndarray, width: int, gram: int):
    """(first string, strings, anchor, hash with the right side, hash with the left side) of each run of strings with one anchor.

    A side that the text cuts short has the hash 0. Least hashes crowd low values, so anchors are mixed again.
    """
    if len(raw) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    place, h = anchors(raw, width, gram)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    at = place[first]
    side = min(SIDE, (width - gram) // 2 // gram)
    sides = []
    with np.errstate(over="ignore"):
        for step in (gram, -gram):
            key, inside = h[at], np.ones(len(at), bool)
            for k in range(1, side + 1):
                to = at + k * step
                inside &= (to >= 0) & (to < len(h))
                key = key * ODD + h[np.clip(to, 0, len(h) - 1)]
            sides.append(np.where(inside, mix(key + np.uint64(abs(step) + (step < 0))) >> np.uint64(8) | np.uint64(1), np.uint64(0)))
        return first, np.diff(np.append(first, len(place))), mix(h[at] + ODD), *sides


def _in_chunks(limit: int, make):
    """Over batches of (row, text, ...): ``make(chunk number, rows)`` for every ``limit`` bytes of texts."""

    def scan(batches):
        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                raw = values[1].encode("utf-8", "surrogatepass")
                held.append((values[0], raw, *values[2:]))
                size += len(raw)
                if size >= limit:
                    for row in make(part << 24 | nth, held):
                        yield _table([row]).to_batches()[0]
                    held, size, nth = [], 0, nth + 1
        if held:
            for row in make(part << 24 | nth, held):
                yield _table([row]).to_batches()[0]

    return scan


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, first, end) of the runs of sorted hashes that fall into one bucket."""
    which = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
    return [(int(which[i]), i, j) for i, j in zip(edges, edges[1:]) if i < j]


def anchor_counts(buckets: int, width: int, gram: int):
    def make(chunk, held):
        rows, firsts, counts, rights, lefts = [], [], [], [], []
        for row, raw, *_ in held:
            first, count, _, right, left = fragments(np.frombuffer(raw, np.uint8), width, gram)
            rows.append(np.full(len(first), row))
            firsts.append(first)
            counts.append(count)
            rights.append(right)
            lefts.append(left)
        row, first, count, right, left = map(np.concatenate, (rows, firsts, counts, rights, lefts))
        yield "places", chunk, [pack(row), pack(first.astype(np.uint32)), pack(count.astype(np.uint32)), pack(right), pack(left)]
        both = np.concatenate((right, left))
        known, times = np.unique(both[both > 0], return_counts=True)
        for bucket, i, j in _by_bucket(known << np.uint64(8), buckets):
            yield "anchors", bucket, [np.int64(chunk).tobytes(), pack_sorted(known[i:j]), pack(times[i:j] > 1)]

    return make


def _repeated(key, table):
    """Over a bucket of anchors: to each chunk those of its anchors that occur twice or more anywhere."""
    parts = [(int(np.frombuffer(c, np.int64)[0]), unpack_sorted(k, np.uint64), unpack(m, bool)) for c, k, m in table.column("data").to_pylist()]
    known, at = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
    times = np.bincount(at, np.concatenate([m + 1 for _, _, m in parts]))
    out, start = [], 0
    for chunk, keys, _ in parts:
        again = times[at[start : start + len(keys)]] > 1
        start += len(keys)
        if again.any():
            out.append(("repeated", chunk, [pack_sorted(keys[again])]))
    return _table(out)


ASKED = pa.schema([("row", pa.int64()), ("wanted", pa.list_(pa.binary()))])


def _wanted(key, table):
    """A chunk's documents with their fragments whose anchors are repeated."""
    kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
    repeated = [unpack_sorted(d[0], np.uint64) for k, d in zip(kinds, data) if k == "repeated"]
    if not repeated:
        return pa.Table.from_pylist([], ASKED)
    repeated = np.sort(np.concatenate(repeated))
    row, first, count, *sides = next(d for k, d in zip(kinds, data) if k == "places")
    row, first, count = unpack(row, np.int64), unpack(first, np.uint32), unpack(count, np.uint32)
    again = np.zeros(len(row), bool)
    for side in sides:
        side = unpack(side, np.uint64)
        again |= repeated[np.minimum(np.searchsorted(repeated, side), len(repeated) - 1)] == side
    own = np.flatnonzero(again)
    own = own[np.lexsort((first[own], row[own]))]
    edges = [0, *(np.flatnonzero(np.diff(row[own])) + 1).tolist(), len(own)]
    out = []
    for i, j in zip(edges, edges[1:]):
        if i < j:
            mine = own[i:j]
            out.append({"row": int(row[mine[0]]), "wanted": [first[mine].tobytes(), count[mine].tobytes()]})
    return pa.Table.from_pylist(out, ASKED)


def cut_fragments(buckets: int, width: int, gram: int):
    """Of each chunk of documents: its distinct fragments to their buckets, and where they lie."""

    def make(chunk, held):
        known: dict[tuple, int] = {}
        rows, firsts, which, counts = [], [], [], []
        for row, raw, wanted in held:
            first, count = np.frombuffer(wanted[0], np.uint32).tolist(), np.frombuffer(wanted[1], np.uint32).tolist()
            begins, _, anchor, *_ = fragments(np.frombuffer(raw, np.uint8), width, gram)
            for a, n, k in zip(first, count, anchor[np.searchsorted(begins, first)].tolist()):
                at = known.setdefault((k, raw[a : a + n + width - 1]), len(known))
                if at == len(counts):
                    counts.append(0)
                counts[at] += 1
                rows.append(row)
                firsts.append(a)
                which.append(at)
        yield "places", chunk, [pack(np.array(rows, np.int64)), pack(np.array(firsts, np.uint32)), pack(np.array(which, np.uint32))]
        order = sorted(range(len(known)), key=(entries := list(known)).__getitem__)
        keys = np.array([entries[i][0] for i in order], np.uint64)
        for bucket, i, j in _by_bucket(keys, buckets):
            own = order[i:j]
            texts = [entries[x][1] for x in own]
            yield (
                "fragments",
                bucket,
                [
                    np.int64(chunk).tobytes(),
                    pack(np.array(own, np.uint32)),
                    pack(np.array([counts[x] for x in own], np.uint32)),
                    pack(np.array([len(t) for t in texts], np.uint32)),
                    pack_sorted(keys[i:j]),
                    zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
                ],
            )

    return make


def sort_shard(width: int, memory: int):
    """Over a bucket of fragments: the runs of duplicate strings of each, told to the chunks that have it."""

    def sort(key, table):
        known: dict[bytes, int] = {}
        times, users, of = [], [], []
        for chunk, own, counts, sizes, anchors, data in table.column("data").to_pylist():
            data = zstandard.ZstdDecompressor().decompress(data)
            ends = np.cumsum(unpack(sizes, np.uint32).astype(np.int64)).tolist()
            which = []
            for a, b, n, anchor in zip([0, *ends], ends, unpack(counts, np.uint32).tolist(), unpack_sorted(anchors, np.uint64).tolist()):
                at = known.setdefault(data[a:b], len(known))
                if at == len(times):
                    times.append(0)
                    of.append(anchor)
                times[at] += n
                which.append(at)
            users.append((int(np.frombuffer(chunk, np.int64)[0]), unpack(own, np.uint32), np.array(which)))
        strings = list(known)
        sizes = np.array([len(x) for x in strings])
        starts = np.cumsum(sizes + 1) - sizes - 1
        # 0 closes a string; a byte 0 inside one becomes 255, which UTF-8 never holds
        # an anchor whose fragments all occur twice has only duplicates: there is nothing to find by sorting
        open_ = {a for a, n in zip(of, times) if n == 1}
        sorted_ = np.array([a in open_ for a in of], bool)
        text = np.frombuffer(b"".join(x.replace(b"\0", b"\xff") + b"\0" for x, s in zip(strings, sorted_) if s), np.uint8)
        places, common = suffix_order(text, width, memory)
        near = np.flatnonzero(common >= width)
        found = np.zeros(len(text), bool)
        found[places[near]] = True
        found[places[near - 1]] = True
        twice = np.zeros(int((sizes + 1).sum()), bool)
        twice[np.repeat(sorted_, sizes + 1)] = found
        for x in np.flatnonzero(np.array(times) > 1).tolist():
            twice[starts[x] : starts[x] + sizes[x] - width + 1] = True
        steps = np.diff(np.concatenate(([False], twice, [False])).astype(np.int8))
        begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        lo, hi = np.searchsorted(begins, starts), np.searchsorted(begins, starts + sizes)
        out = []
        for chunk, own, which in users:
            runs = hi[which] - lo[which]
            at = np.repeat(lo[which], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            base = np.repeat(starts[which], runs)
            out.append(("runs", chunk, [pack(np.repeat(own, runs)), pack((begins[at] - base).astype(np.uint32)), pack((ends[at] - base).astype(np.uint32))]))
        return _table(out)

    return sort


SPANS = pa.schema([("row", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def place_runs(width: int):
    """A chunk's documents with the merged byte spans that go."""

    def place(key, table):
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        runs = [[unpack(x, np.uint32).astype(np.int64) for x in d] for k, d in zip(kinds, data) if k == "runs"]
        spot = [d for k, d in zip(kinds, data) if k == "places"]
        if not runs or not spot:
            return pa.Table.from_pylist([], SPANS)
        of, begin, end = map(np.concatenate, zip(*runs))
        order = np.argsort(of, kind="stable")
        of, begin, end = of[order], begin[order], end[order]
        row, first, which = unpack(spot[0][0], np.int64), unpack(spot[0][1], np.uint32).astype(np.int64), unpack(spot[0][2], np.uint32)
        lo, hi = np.searchsorted(of, which), np.searchsorted(of, which, side="right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, a, b = np.repeat(row, n), np.repeat(first, n) + begin[at], np.repeat(first, n) + end[at] + width - 1
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        out = []
        edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        for i, j in zip(edges, edges[1:]):
            if i < j:
                upto = np.maximum.accumulate(b[i:j])
                new = np.concatenate(([True], a[i + 1 : j] > upto[:-1]))
                heads = np.flatnonzero(new)
                out.append({"row": int(row[i]), "begins": a[i:j][heads].tolist(), "ends": np.append(upto[heads[1:] - 1], upto[-1]).tolist()})
        return pa.Table.from_pylist(out, SPANS)

    return place


def spans(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, memory: int = SORT_MEMORY) -> DataFrame:
    """row, spans (lists of begins and ends) of the bytes that go, of every document (by its key) that loses any."""
    rows = docs.select(document_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    gram = min(GRAM, 1 << (width.bit_length() - 2))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counting = _in_chunks(chunk_bytes, anchor_counts(1 + size // bucket_bytes, width, gram))
    counted = stored(rows.select("row", "text").mapInArrow(counting, ROWS), "kind").select("kind", "key", "data")
    repeated = counted.filter("kind = 'anchors'").groupBy("key").applyInArrow(_repeated, ROWS)
    asked = counted.filter("kind = 'places'").union(repeated).groupBy("key").applyInArrow(_wanted, "row long, wanted array<binary>")
    having = rows.join(stored(asked), "row").select("row", "text", "wanted")
    cutting = _in_chunks(chunk_bytes, cut_fragments(1 + size // shard_bytes, width, gram))
    cut = stored(having.mapInArrow(cutting, ROWS), "kind").select("kind", "key", "data")
    runs = cut.filter("kind = 'fragments'").groupBy("key").applyInArrow(sort_shard(width, memory), ROWS)
    placed = cut.filter("kind = 'places'").union(runs).groupBy("key").applyInArrow(place_runs(width), "row long, begins array<long>, ends array<long>")
    return stored(placed.groupBy("row").agg(F.collect_list(F.struct("begins", "ends")).alias("spans")))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def deduplicated(docs: DataFrame, width: int = WIDTH, keep_bytes: bool = True, **options) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, the remaining bytes as ``kept``."""
    rows = docs.select("doc_id", document_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(spans(docs, width, **options), "row", "left").select(F.col("doc_id").cast("long"), "text", "spans")
    fields = [f for f in KEPT if keep_bytes or f.name != "kept"]

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                gone = merged([x for part in found or [] for x in zip(part["begins"], part["ends"])])
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)]))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * len(KEPT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KEPT) if f in fields], schema=pa.schema(fields))

    kinds = {"doc_id": "long", "kept_sha256": "string", "kept": "binary"}
    return joined.mapInArrow(cut, ", ".join(f"{f.name} {kinds.get(f.name, 'long')}" for f in fields))


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, keep_bytes=False)
