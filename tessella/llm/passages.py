"""Near-duplicate passages by compact windows.

A passage is a run of at least ``width`` words; two are near-duplicates when their sets of five-word
shingles have a Jaccard similarity of 0.8 or more. For each of ``functions`` hash functions the
Cartesian tree over a text's shingle hashes has a node for every place p and the widest interval in which p
is the smallest: all passages inside that interval and over p share the min-hash. Only intervals that can hold
a passage are kept, about 2 n / width of them: the compact windows.

Windows meet under their function, the shingle at p and the shingles to its right, and again with those
to its left (``context`` of them); a shared passage leaves one of the two sides whole. Under a key, windows that are
equal for ``REACH`` shingles around p are one: the others link to the first, within a chunk of documents and
then among chunks. Different ones are all paired. Where more than ``crowd`` differ, their shingles are
fetched: what most of them hold is told apart from what few hold, windows that hold the same of the
former are one again, and those that share any of the latter are paired, or parted again (:func:`_crowd`).

Links lead to passages in two ways. (1) Passages equal word for word: around every linked window each run of ``width``
words is filed by its own hash, so documents that share it meet. Where the smallest shingle recurs in a run, its last place
is filed too (:func:`tied_windows`): of every run of a passage's width both copies file the same place. (2)
Near-duplicates: where the aligned windows of at least ``enough`` functions of a linked pair intersect over the width
of a passage, less what an insertion shifts, both sides' shingle hashes are cut out and compared exactly.

A document is a (doc_id, text): rows equal in both are one document. Documents are ordered by a hash of
both; of a linked pair the one that comes later holds the repeat.

Defined cases: a null or empty text has no passages; a null doc_id is a document of its text; a text of
one repeated word has one window per function; an empty table gives no rows; other columns are
ignored by :func:`report` and carried by :func:`cleaned`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import PACKED, PACKED_ARROW, Packed, free_name, release, stored
from tessella.llm.components import components
from tessella.llm.decontamination import merged, without, words_of

SHINGLE = 5
WIDTH = 50
SIMILARITY = 0.8
FUNCTIONS = 6
ENOUGH = 1
CONTEXT = 12
CHUNK_WORDS = 600_000
BUCKET_BYTES = 16 << 20
#: Different windows under one key that are paired without a look at their shingles.
CROWD = 128
#: Pairs of windows that are written at once.
BLOCK = 1 << 19
#: Words between the places where runs that are fetched for comparison begin and end.
GRID = 32
#: Pairs that are compared in one cell, each of two runs of RUN_BYTES; longer runs count as more.
PART_PAIRS = 1 << 12
RUN_BYTES = 1 << 9
#: Shingles that one changed word can leave unmatched, twice: a wider gap ends a passage.
GAP = 2 * SHINGLE
#: Shingles on either side of a window's smallest one that tell windows under a key apart.
REACH = WIDTH - SHINGLE + 1 + GAP
#: Matches that are aligned at once, and the passages by which slices overlap where there are more.
PAIRS = 1 << 16
SLICE = 4
#: Shingles between the places where runs of a repetitive alignment are compared as sets.
STRIDE = 4


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbours."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(x) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * ODD + x[i : len(x) - n + 1 + i]
        return mix(out)


def shingles(words: list[bytes]) -> np.ndarray:
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return run_hashes(ids, SHINGLE)


def compact_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
    """(first, place, end) of the Cartesian tree nodes whose interval has ``least`` values or more, for each given range.

    All ranges split together, a level at a time. Values are compared by their leading bits; of equal
    ones, places in a fixed shuffled order from the range's start decide, so that long runs of one
    value split evenly and copies split alike.
    """
    bits = max(1, int(len(values)).bit_length())
    low = np.uint64((1 << bits) - 1)
    tagged = np.full(len(values) + 1, ~np.uint64(0))
    at = np.arange(len(values), dtype=np.uint64)
    inside = at - np.repeat(starts, ends - starts).astype(np.uint64) if len(values) else at
    with np.errstate(over="ignore"):
        turn = mix(inside + np.uint64(1)) >> np.uint64(64 - ORDER_BITS)
    keep = np.uint64(64 - bits - ORDER_BITS)
    tagged[:-1] = (values >> (np.uint64(64) - keep)) << (np.uint64(64) - keep) | turn << np.uint64(bits) | at
    found = []
    wide = ends - starts >= least
    starts, ends = starts[wide], ends[wide]
    while len(starts):
        edges = np.empty(2 * len(starts), np.int64)
        edges[::2], edges[1::2] = starts, ends
        place = (np.minimum.reduceat(tagged, edges)[::2] & low).astype(np.int64)
        found.append((starts, place, ends))
        starts, ends = np.concatenate((starts, place + 1)), np.concatenate((place, ends))
        wide = ends - starts >= least
        starts, ends = starts[wide], ends[wide]
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def tied_windows(values: np.ndarray, ends: np.ndarray, least: int):
    """(first, place, end) for all runs of ``least`` values in one range whose smallest, by its leading bits, stands there more than once:
    the last place of the smallest, with the union of the runs it is that of.

    Which of equal values :func:`compact_windows` takes depends on the range; this place depends on the run alone, so equal runs have the same.
    """
    none = (np.zeros(0, np.int64),) * 3
    lead = values >> np.uint64(max(1, int(len(values)).bit_length()) + ORDER_BITS)
    order = np.argsort(lead, kind="stable")
    again = np.flatnonzero(lead[order][1:] == lead[order][:-1])
    one, two = order[again], order[again + 1]
    close = two - one < least
    one, two, n = one[close], two[close], len(values)
    change = np.bincount(np.maximum(two - least + 1, 0), minlength=n + 1) - np.bincount(np.minimum(one + least, n), minlength=n + 1)
    at = np.flatnonzero(np.cumsum(change)[:n] > 0)
    if len(at) < least:
        return none

    def smallest(x: np.ndarray, last: bool) -> np.ndarray:
        place, size = np.arange(len(x)), 1
        while size < least:
            step = min(size, least - size)
            left, right = place[:-step], place[step:]
            place = np.where(x[right] <= x[left] if last else x[right] < x[left], right, left)
            size += step
        return place

    first, final = at[: len(at) - least + 1], at[least - 1 :]
    whole = (final - first == least - 1) & (np.searchsorted(ends, first, side="right") == np.searchsorted(ends, final, side="right"))
    tied = np.flatnonzero(whole & (smallest(lead[at], True) != smallest(lead[at], False)))
    if not len(tied):
        return none
    first, place = first[tied], at[smallest(values[at], True)[tied]]
    heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return first[heads], place[heads], first[np.append(heads[1:], len(place)) - 1] + least


#: Bits that order equal values.
ORDER_BITS = 12
#: The function of windows from :func:`tied_windows`, which give spots and no links, and what tells their contents from others.
TIED = 127
TIED_CONTENT = 0x5BD1E995
#: A window: its key, document, function and side, place, first and end (in shingles of the document), hash of the shingles in reach.
CENTRES = Packed("centres", "u8d", "i8", "u1", "u4", "u4", "u4", "u4")
#: Windows under keys of many different ones.
CROWDS = Packed("crowds", "u8d", "i8", "u1", "u4", "u4", "u4")
CROWD_ROWS = "key long, doc long, f long, p long, a long, b long, near binary"
CROWD_ARROW = pa.schema([*((n, pa.int64()) for n in ("key", "doc", "f", "p", "a", "b")), ("near", pa.binary())])
#: A linked window of a document that all runs around are filed for: document, first, end in shingles.
SPOTS = Packed("spots", "u8d", "u4", "u4")
#: A document and its number of words.
SIZES = Packed("sizes", "u8d", "u4")
#: Aligned windows of a linked pair: hash of the pair, later document, earlier one, function, shift, first and end in the later one.
LINKS = Packed("links", "u8d", "i8", "i8", "u1", "i4", "i4", "i4")
#: Runs of the width of a passage: hash of their smallest shingle, document, place, hash.
RUNS = Packed("runs", "u8d", "i8", "u4d", "u8")
REGIONS = pa.schema([(n, pa.int64()) for n in ("d", "c", "a", "b", "ca", "cb")])
REGION_ROWS = ", ".join(f"{n} long" for n in REGIONS.names)


def document_key() -> Column:
    return F.xxhash64(F.lit("document"), F.col("doc_id"), F.col("text"))


def _source(nth: int) -> int:
    return TaskContext.get().partitionId() << 24 | nth


def _rows(rows):
    return pa.Table.from_pylist(list(rows), PACKED_ARROW)


def windows(docs: DataFrame, buckets: int, width: int, functions: int, context: int, chunk_words: int) -> DataFrame:
    """Rows of the different windows under each key, and, with keys below 0, a chunk's own links and spots, and all documents' numbers of words."""
    least = width - SHINGLE + 1
    context = min(context, (least + 1) // 2)

    def scan(batches):
        keys, arrays, n, nth = [], [], 0, 0
        for batch in batches:
            docs, sizes = batch.column(0).to_numpy(), []
            for key, text in zip(docs.tolist(), batch.column(1).to_pylist()):
                words = words_of(text)
                sizes.append(len(words))
                if len(words) >= width:
                    keys.append(key)
                    arrays.append(shingles(words))
                    n += len(arrays[-1])
                if n >= chunk_words:
                    yield from _rows(_chunk(np.array(keys, np.int64), arrays, buckets, least, functions, context, _source(nth))).to_batches()
                    keys, arrays, n, nth = [], [], 0, nth + 1
            yield from _rows([{"kind": "sizes", "key": -1 - _source(nth), "source": _source(nth), "data": SIZES.pack((docs.view(np.uint64), np.array(sizes, np.uint32)))}]).to_batches()
        if keys:
            yield from _rows(_chunk(np.array(keys, np.int64), arrays, buckets, least, functions, context, _source(nth))).to_batches()

    return docs.select(document_key().alias("d"), "text").mapInArrow(scan, PACKED)


def _chunk(keys, arrays, buckets, least, functions, context, source):
    keys, first = np.unique(keys, return_index=True)
    arrays = [arrays[i] for i in first]
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    s = np.concatenate(arrays)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    around = run_hashes(s, context)
    within = _interval_hashes(s)
    rows = []
    for f in range(functions):
        with np.errstate(over="ignore"):
            seed = mix(np.array([f + 1], np.uint64) * ODD)
            values = mix(s ^ seed)
        a, p, b = compact_windows(values, starts, ends, least)
        n = len(p)
        if f == 0:
            a, p, b = (np.concatenate(x) for x in zip((a, p, b), tied_windows(values, ends, least)))
        tied = np.arange(len(p)) >= n
        doc = np.searchsorted(ends, p, side="right")
        low, high = np.maximum(a, p - REACH), np.minimum(b, p + REACH)
        with np.errstate(over="ignore"):
            content = mix(within(low, high) ^ mix((p - low).astype(np.uint64) * ODD + (high - p).astype(np.uint64))) >> np.uint64(32)
            content ^= np.where(tied, np.uint64(TIED_CONTENT), np.uint64(0))
            where = np.where(tied, 2 * TIED, 2 * f)
            for side, at, whole in ((0, p, p + context <= ends[doc]), (1, p - context + 1, p - context + 1 >= starts[doc])):
                key = mix(around[at[whole]] ^ mix(seed + np.uint64(side + 1)))
                base = starts[doc[whole]]
                rows.append((key, keys[doc[whole]], where[whole] + side, p[whole] - base, a[whole] - base, b[whole] - base, content[whole]))
    entries = [np.concatenate(x) for x in zip(*rows)]
    # keys keep their bucket's bits and 40 more: as many false meetings at every size, and verification tells them
    spare = np.uint64(max(0, 24 - int(buckets).bit_length()))
    entries[0] = entries[0] >> spare << spare
    firsts = yield from _copies(entries, least, buckets, source)
    yield from CENTRES.deal([x[firsts] for x in entries], buckets, source)


def _interval_hashes(x: np.ndarray):
    """A function of arrays (first, end): the hash of each interval's values, wherever it stands."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(STEP, len(x)))))
    back = _powers(BACK, len(x) + 1)
    return lambda a, b: (upto[b] - upto[a]) * back[a]


def _copies(entries, least, buckets, source):
    """Sorts entries by key and content, yields rows of the links of equal ones to the first and of their spots, and returns where the firsts are: of
    each content all places in its first document."""
    key, docs, where, p, left, right, content = entries
    order = np.lexsort((p, docs, content, key))
    del key, docs, where, p, left, right, content
    _take(entries, order)
    key, docs, where, p, left, right, content = entries
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))[: len(key)]
    firsts = np.flatnonzero(new)
    of = firsts[np.cumsum(new) - 1]
    again = np.flatnonzero(~new)
    apart = again[(docs[again] != docs[of[again]]) & (where[again] < 2 * TIED)]
    if len(apart):
        yield {"kind": "links", "key": -1 - source, "source": source, "data": _links(entries, apart, of[apart])}
    if len(again):
        yield from _spots(entries, np.unique(np.concatenate((again, of[again]))), least, buckets, source)
    return np.flatnonzero(docs == docs[of])


def _take(arrays: list, at) -> None:
    """Keeps of each array what stands ``at``, one array after another, so that only one is held twice."""
    for i in range(len(arrays)):
        arrays[i] = arrays[i][at]


def _spots(entries, at, least, buckets, source):
    """Rows of the spots around the given entries, dealt by document; their bucket stands where other rows have their source."""
    _, docs, _, p, left, right, _ = entries
    p, left, right = (x[at].astype(np.int64) for x in (p, left, right))
    a, b = np.maximum(left, p - least + 1), np.minimum(right, p + least)
    for row in SPOTS.deal(_united(docs[at].view(np.uint64), a, b), buckets, source):
        yield row | {"key": -1 - source, "source": row["key"]}


def _paired(entries, least, buckets, source, crowd):
    """Over firsts sorted by key and content: links of all contents that share a key, and spots; those of more than ``crowd`` under a key as they are.

    Of two contents, every place of the later document links to the earlier one's first place, which is like its others.
    """
    key, docs, where, *_, content = entries
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))[: len(key)])
    places = np.diff(np.append(start, len(key)))
    heads, group, n, met = _met(key[start], docs[start])
    if not len(met):
        return
    yield from _spots(entries, start[met], least, buckets, source)
    linking = where[start] < 2 * TIED
    if not linking.all():
        start, places = start[linking], places[linking]
        heads, group, n, met = _met(key[start], docs[start])
    docs = docs[start]
    large = met[n[group[met]] > crowd]
    if len(large):
        all_places, _ = _expanded(start[large], places[large])
        yield {"kind": "crowds", "key": -1 - source, "source": source, "data": CROWDS.pack([x[all_places] for x in entries[:6]])}
    left_over = met[n[group[met]] <= crowd]
    last = (heads + n)[group[left_over]]
    step, held, count = 1, [], 0
    while len(left_over):
        fits = left_over + step < last
        left_over, last = left_over[fits], last[fits]
        own = left_over[docs[left_over] != docs[left_over + step]]
        later = np.where(docs[own] < docs[own + step], own + step, own)
        held.append((later, 2 * own + step - later))
        count += int(places[later].sum())
        step += 1
        if count and (count >= BLOCK or not len(left_over)):
            later, earlier = (np.concatenate(x) for x in zip(*held))
            apart, nth = _expanded(start[later], places[later])
            of = start[earlier][nth]
            for at in range(0, len(apart), BLOCK):
                yield {"kind": "links", "key": -1 - source, "source": source, "data": _links(entries, apart[at : at + BLOCK], of[at : at + BLOCK])}
            held, count = [], 0


def _expanded(first, n):
    """The numbers from ``first`` on, ``n`` of them, for each; and which one each is of."""
    nth = np.repeat(np.arange(len(n)), n)
    return first[nth] + np.arange(len(nth)) - np.repeat(np.cumsum(n) - n, n), nth


def _met(key, docs):
    """Of entries sorted by key: each key's first place, every entry's key by number, entries a key, and the places of those under keys of several documents."""
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads) if len(heads) else np.zeros(0, bool)
    return heads, group, np.diff(np.append(heads, len(key))), np.flatnonzero(several[group])


def _united(owner, a, b):
    """Touching intervals of one owner made one, sorted by owner and place."""
    order = np.lexsort((a, owner))
    owner, a, b = owner[order], a[order], b[order]
    seg = np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    wide = int(b.max()) + 1 if len(b) else 1
    upto = np.maximum.accumulate(b + seg * wide)
    new = np.concatenate(([True], (a + seg * wide)[1:] > upto[:-1]))[: len(a)]
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(a)]))[: len(heads)] - 1
    return owner[heads], a[heads], upto[tails] - seg[tails] * wide


def _links(entries, apart, of):
    """Pairs with the intersections of their aligned windows; of one pair, function and shift, touching ones are one."""
    _, docs, where, p, left, right, *_ = entries
    d, c = docs[apart], docs[of]
    p, left, right, cp, cl, cr = (x[i].astype(np.int64) for i in (apart, of) for x in (p, left, right))
    shift = p - cp
    a, b = np.maximum(left, cl + shift), np.minimum(right, cr + shift)
    turned = d < c
    a, b = np.where(turned, a - shift, a), np.where(turned, b - shift, b)
    shift = np.where(turned, -shift, shift)
    d, c = np.where(turned, c, d), np.where(turned, d, c)
    f = where[apart] >> 1
    with np.errstate(over="ignore"):
        pair = mix(d.view(np.uint64) * ODD ^ c.view(np.uint64))
    order = np.lexsort((a, shift, f, c, d, pair))
    pair, d, c, f, shift, a, b = (x[order] for x in (pair, d, c, f, shift, a, b))
    same = np.ones(len(d), bool)
    same[:1] = False
    for x in (d, c, f, shift):
        same[1:] &= x[1:] == x[:-1]
    owner, a, b = _united(np.cumsum(~same) - 1, a, b)
    first = np.flatnonzero(~same)[owner]
    return LINKS.pack((pair[first], d[first], c[first], f[first], shift[first], a, b))


def _meet(least: int, buckets: int, crowd: int):
    """Over a bucket of chunks' windows: links and spots under each key. Rows of the chunks' own pass through."""

    def meet(key, table):
        if key[0].as_py() < 0:
            return table.select(PACKED_ARROW.names)
        entries = CENTRES.gather(table.column("data").to_pylist())
        source = key[0].as_py()

        def rows():
            _take(entries, (yield from _copies(entries, least, buckets, source)))
            yield from _paired(entries, least, buckets, source, crowd)

        return _rows(rows())

    return meet


CROWDED = ["key", "doc", "f", "p", "a", "b"]


def crowd_links(docs: DataFrame, linked: DataFrame, crowd: int) -> DataFrame | None:
    """Rows of the links under keys of more than ``crowd`` different windows, whose shingles in reach are fetched from the texts."""
    crowds = linked.filter("kind = 'crowds'")
    if not crowds.limit(1).count():
        return None
    types = ["u8", *["i8"] * 5]
    flat = crowds.select("data").mapInArrow(_unpacked(CROWDS, CROWDED, types), ", ".join(f"{n} long" for n in CROWDED))
    asked = flat.groupBy(F.col("doc").alias("own")).agg(F.collect_list(F.struct("key", "f", "p", "a", "b")).alias("asked"))
    texts = docs.select(document_key().alias("own"), "text")

    def cut(batches):
        for batch in batches:
            for doc, text, some in zip(*(batch.column(k).to_pylist() for k in range(3))):
                s = (shingles(words_of(text)) >> np.uint64(32)).astype(np.uint32)
                rows = [x | {"doc": doc, "near": s[max(x["a"], x["p"] - REACH) : min(x["b"], x["p"] + REACH)].tobytes()} for x in some]
                yield from pa.Table.from_pylist(rows, CROWD_ARROW).to_batches()

    near = stored(texts.join(asked, "own").select("own", "text", "asked").mapInArrow(cut, CROWD_ROWS))
    met = stored(near.groupBy("key").applyInArrow(lambda key, table: _crowd(table, crowd), PACKED))
    release(near)
    return met


def _crowd(table, crowd: int):
    """Links under one key. They lose no two windows that are similar in reach: either both hold the same of what most hold, or one that holds all
    that they hold of it links to both, or they share a shingle that at most half hold, and meet in the smaller group of those that hold it.
    """
    columns = [table.column(n).to_numpy() for n in CROWDED]
    _, first = np.unique(np.stack((columns[1], columns[3])), axis=1, return_index=True)
    entries = [x[first] for x in columns]
    docs = entries[1]
    near = table.column("near").take(pa.array(first)).to_pylist()
    # equal windows of one document are one; its places follow each other in the order of documents and contents
    kinds_of: dict[tuple[int, bytes], int] = {}
    number = np.array([kinds_of.setdefault(x, len(kinds_of)) for x in zip(docs.tolist(), near)], np.int64)
    order = np.argsort(number, kind="stable")
    whole = [x[order] for x in entries]
    start = np.searchsorted(number[order], np.arange(len(kinds_of)))
    places = np.diff(np.append(start, len(order)))
    entries, near = [x[start] for x in whole], [x for _, x in kinds_of]
    docs = entries[1]
    owner = np.repeat(np.arange(len(near)), [len(x) // 4 for x in near])
    token = np.unique(np.frombuffer(b"".join(near), np.uint32).astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
    token, owner = token >> np.uint64(32), (token & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    known: set[bytes] = set()
    work = [(np.arange(len(docs)), token, owner)]
    while work:
        own, token, owner = work.pop()
        if len(own) <= crowd:
            i, j = np.triu_indices(len(own), 1)
            pairs.append((own[j], own[i]))
            continue
        runs = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        times = np.diff(np.append(runs, len(token)))
        most = np.flatnonzero(2 * times > len(own))
        holds = np.zeros((len(own), len(most)), bool)
        for column, k in enumerate(most.tolist()):
            holds[np.searchsorted(own, owner[runs[k] : runs[k] + times[k]]), column] = True
        kinds, head, kind = np.unique(np.packbits(holds, axis=1), axis=0, return_index=True, return_inverse=True)
        kind = kind.ravel()
        pairs.append((own, own[head[kind]]))
        if len(kinds) <= crowd:
            i, j = np.triu_indices(len(kinds), 1)
            pairs.append((own[head[j]], own[head[i]]))
        else:
            # every kind links to those that hold the most; of two similar ones both are similar to one that holds all that either does
            held = holds[head]
            open_ = np.argsort(-held.sum(axis=1), kind="stable")
            while len(open_):
                largest = open_[0]
                pairs.append((own[head], np.full(len(head), own[head[largest]])))
                open_ = open_[(held[open_] & ~held[largest]).any(axis=1)]
        for k in np.flatnonzero((times > 1) & (2 * times <= len(own))).tolist():
            some = owner[runs[k] : runs[k] + times[k]]
            if (name := some.tobytes()) not in known:
                known.add(name)
                if len(some) <= crowd:
                    work.append((some, token[:0], owner[:0]))
                else:
                    inside = np.isin(owner, some)
                    work.append((some, token[inside], owner[inside]))
    later, earlier = (np.concatenate(x) for x in zip(*pairs))
    turned = docs[later] < docs[earlier]
    both = np.unique(np.stack((np.where(turned, earlier, later), np.where(turned, later, earlier)))[:, docs[later] != docs[earlier]], axis=1)
    rows = []
    apart, nth = _expanded(start[both[0]], places[both[0]])
    of = start[both[1]][nth]
    for at in range(0, len(apart), BLOCK):
        rows.append({"kind": "links", "key": -1, "source": 0, "data": _links(whole, apart[at : at + BLOCK], of[at : at + BLOCK])})
    return _rows(rows)


def _unpacked(packed: Packed, names: list[str], types: list):
    """Rows of packed arrays as rows of numbers, without the hash in front where it has no name."""

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                arrays = packed.unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if t == "u8" else x.astype(t)) for x, t in zip(arrays[-len(names) :], types)], names=names)

    return unpack


def spots_of(linked: DataFrame, first: int, buckets: int, size: int, chunk_words: int) -> DataFrame:
    """doc, spots: the linked windows of each document that has any, touching ones made one."""
    dealt = linked.filter("kind = 'spots'").select("kind", F.col("source").alias("key"), "source", "data")

    def gather(table):
        owner, a, b = SPOTS.gather(table.column("data").to_pylist())
        owner, a, b = _united(owner, a.astype(np.int64), b.astype(np.int64))
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        spans = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)), pa.int32()), spans)
        return pa.table([pa.array(owner[heads].view(np.int64)), lists], names=["doc", "spots"])

    refined = SPOTS.refined(dealt, first, buckets, size // chunk_words)
    return refined.groupBy("key").applyInArrow(gather, "doc long, spots array<struct<a:long,b:long>>")


def regions(pairs: DataFrame, buckets: int, least: int, enough: int) -> DataFrame:
    """Where windows of ``enough`` functions of a pair intersect: (first, end) in one document and in the other, in shingles.

    Windows are compared where they agree on the shift between the documents, give or take a gap.
    """
    names = ["d", "c", "f", "shift", "a", "b"]
    flat = pairs.select("data").mapInArrow(_unpacked(LINKS, names, ["i8"] * 6), ", ".join(f"{n} long" for n in names))
    dealt = flat.withColumn("bucket", F.pmod(F.xxhash64("d", "c"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(lambda table: _intersect(table, least, enough), REGION_ROWS)


def _intersect(table, least, enough):
    d, c, f, shift, a, b = (table.column(n).to_numpy() for n in ("d", "c", "f", "shift", "a", "b"))
    order = np.lexsort((shift, c, d))
    d, c, f, shift, a, b = (x[order] for x in (d, c, f, shift, a, b))
    new = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(c) != 0) | (np.diff(shift) > GAP)))
    heads = np.flatnonzero(new)
    low, high = np.minimum.reduceat(shift, heads), np.maximum.reduceat(shift, heads)
    group = np.cumsum(new) - 1
    own, a, b = _united(group * 256 + f, a, b)
    # a sweep over the ends of each function's intervals: +1 where one begins, -1 where it ends
    group = np.concatenate((own, own)) // 256
    at, turn = np.concatenate((a, b)), np.repeat([1, -1], len(a))
    order = np.lexsort((-turn, at, group))
    group, at, turn = group[order], at[order], turn[order]
    over = np.cumsum(turn)
    begin = np.flatnonzero((over >= enough) & (over - turn < enough))
    end = np.flatnonzero((over < enough) & (over - turn >= enough))
    a, b, group = at[begin], at[end], group[begin]
    wide = b - a >= least - least // 4  # words put in on one side shift the other end of a passage
    a, b, group = a[wide], b[wide], group[wide]
    more = np.maximum(GAP, (b - a) // 4)
    first, low, high = heads[group], low[group], high[group]
    columns = (d[first], c[first], np.maximum(0, a - more), b + more, np.maximum(0, a - high - more), np.maximum(0, b - low + more))
    return pa.table([pa.array(x, pa.int64()) for x in columns], schema=REGIONS)


ANSWER = "kind string, key long, source long, data array<binary>, doc long, first long, end long, hashes binary"
ANSWER_ARROW = pa.schema([*PACKED_ARROW, ("doc", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("hashes", pa.binary())])


def narrowed(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of each: enough to tell the shingles of two runs apart."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def widened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def answers(docs: DataFrame, asked: DataFrame, buckets: int, least: int, chunk_words: int) -> DataFrame:
    """Of documents that are asked for any: all runs of ``least`` shingles in their spots, by bucket, and the shingle hashes of their regions."""

    def cut(batches):
        held, n, nth = [], 0, 0
        for batch in batches:
            for doc, text, spots, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                s = shingles(words_of(text))
                for at in range(0, len(wanted or []), 100):
                    some = [(x["first"], min(x["end"] - SHINGLE + 1, len(s))) for x in wanted[at : at + 100]]
                    rows = [{"kind": "segments", "doc": doc, "first": x["first"], "end": x["end"], "hashes": narrowed(s[a:b])} for x, (a, b) in zip(wanted[at : at + 100], some)]
                    yield from pa.Table.from_pylist(rows, ANSWER_ARROW).to_batches()
                if spots:
                    a, b = np.array([(x["a"], x["b"]) for x in spots], np.int64).T
                    _, a, b = _united(np.zeros(len(a), np.int64), a, b)
                    held += [(doc, int(i), s[i:j]) for i, j in zip(a, b) if j - i >= least]
                    n += int((b - a).sum())
                if n >= chunk_words:
                    yield from pa.Table.from_pylist(list(_filed(held, buckets, least, _source(nth))), ANSWER_ARROW).to_batches()
                    held, n, nth = [], 0, nth + 1
        if held:
            yield from pa.Table.from_pylist(list(_filed(held, buckets, least, _source(nth))), ANSWER_ARROW).to_batches()

    return docs.select(document_key().alias("doc"), "text").join(asked, "doc").select("doc", "text", "spots", "wanted").mapInArrow(cut, ANSWER)


def _filed(held, buckets, least, source):
    smallest, docs, at, hashes = [], [], [], []
    for doc, first, s in held:
        runs = run_hashes(s, least)
        with np.errstate(over="ignore"):
            low = mix(s ^ ODD)
        n = 1
        while 2 * n <= least:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < least:
            low = np.minimum(low[: len(low) - (least - n)], low[least - n :])
        smallest.append(mix(low))  # least hashes crowd low values
        docs.append(np.full(len(runs), doc))
        at.append(np.arange(first, first + len(runs)))
        hashes.append(runs)
    if not smallest:
        return
    rows = [np.concatenate(x) for x in (smallest, docs, at, hashes)]
    rows[2] = rows[2].astype(np.uint32)
    firsts = yield from _equal(rows, source)
    yield from RUNS.deal([x[firsts] for x in rows], buckets, source)


#: Runs of a document, by their first words, that stand in an earlier one: document, earlier one, first, end.
STRETCHES = Packed("stretches", "u8d", "i8", "u4", "u4")


def _equal(rows, source):
    """Sorts runs, yields a row of the stretches that are equal to the first document with the same run, and returns all places of that document: it may be
    a later one elsewhere."""
    smallest, docs, at, hashes = rows
    order = np.lexsort((at, docs, hashes, smallest))
    rows[:] = [x[order] for x in rows]
    smallest, docs, at, hashes = rows
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (smallest[1:] != smallest[:-1])))[: len(hashes)]
    firsts = np.flatnonzero(new)
    of = firsts[np.cumsum(new) - 1]
    apart = np.flatnonzero(docs != docs[of])
    if len(apart):
        d, c, a = docs[apart], docs[of[apart]], at[apart].astype(np.int64)
        yield {"kind": "stretches", "key": -1 - source, "source": source, "data": STRETCHES.pack(_merged(d, c, a, a + 1))}
    own = np.flatnonzero(docs == docs[of])
    # by smallest shingle, then document and place, which compress
    return own[np.lexsort((at[own], docs[own], smallest[own]))]


def _merged(d, c, a, b):
    """Touching stretches of one pair made one: (later document, earlier one, first run, end of runs)."""
    order = np.lexsort((c, d))
    d, c, a, b = (x[order] for x in (d, c, a, b))
    new = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(c) != 0)))[: len(d)]
    heads = np.flatnonzero(new)
    owner, a, b = _united(np.cumsum(new) - 1, a, b)
    first = heads[owner]
    return d[first].view(np.uint64), c[first], a, b


def _meet_runs(key, table):
    """Over a bucket of runs: its stretches. Stretches of the chunks pass through."""
    if key[0].as_py() < 0:
        return table.select(PACKED_ARROW.names)
    return _rows(_equal(RUNS.gather(table.column("data").to_pylist()), key[0].as_py()))


def equal_passages(answered: DataFrame, first: int, buckets: int, size: int, width: int, chunk_words: int) -> DataFrame:
    """d, c, begin, end: the stretches of passages that are equal word for word, in words of d."""
    packed = answered.filter("kind != 'segments'").select("kind", "key", "source", "data")
    dealt = RUNS.refined(packed, first, buckets, size // chunk_words)
    met = dealt.groupBy("key").applyInArrow(_meet_runs, PACKED)
    names = ["d", "c", "a", "b"]
    flat = met.select("data").mapInArrow(_unpacked(STRETCHES, names, ["u8", *["i8"] * 3]), ", ".join(f"{n} long" for n in names))
    bucketed = flat.withColumn("bucket", F.pmod(F.xxhash64("d"), F.lit(buckets)))

    def join_up(table):
        d, c, a, b = _merged(*(table.column(n).to_numpy() for n in names))
        columns = (d.view(np.int64), c, a, b - 1 + width)
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["d", "c", "begin", "end"])

    return bucketed.groupBy("bucket").applyInArrow(join_up, "d long, c long, begin long, end long")


def chains(i: np.ndarray, j: np.ndarray, fewest: int):
    """Alignments that rise in both members: of each band of shifts, the largest first, then of all matches (i, j).

    Matches that an alignment of all leaves out are aligned again, until too few are left for a passage.
    """
    if (np.diff(i) > 0).all() and (np.diff(j) > 0).all():
        yield i, j  # every band is part of it
        return
    shift = i - j
    order = np.argsort(shift, kind="stable")
    bands = np.split(order, np.flatnonzero(np.diff(shift[order]) > GAP) + 1)
    for band in sorted(bands, key=len, reverse=True) if len(bands) > 1 else []:
        if len(band) < fewest:
            break
        yield rising(np.sort(band), i, j)
    left = np.arange(len(i))
    while len(left) >= fewest:
        a, b = rising(left, i, j)
        if len(a) < fewest:
            break
        yield a, b
        taken = np.isin(i[left] * (len(j) + j.max() + 1) + j[left], a * (len(j) + j.max() + 1) + b)
        left = left[~taken]


def rising(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A longest run of the given pairs that rises in both members. Pairs are in order of i and then j."""
    a, b = i[own], j[own]
    if (np.diff(a) > 0).all() and (np.diff(b) > 0).all():
        return a, b
    # a longest common subsequence by bit vectors, one for each first member; a zero marks where the length grows
    low = int(b.min())
    full = grown = (1 << int(b.max()) - low + 1) - 1
    heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    values, vectors = (b - low).tolist(), [full]
    for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(a)]):
        row = 0
        for v in values[x:y]:
            row |= 1 << v
        both = grown & row
        grown = ((grown + both) | (grown - both)) & full
        vectors.append(grown)
    firsts, seconds = [], []
    left, n = full, (full ^ grown).bit_count()
    for k in range(len(heads), 0, -1):
        # the last place, of those left, where the length grows
        zeros = ~vectors[k] & left
        if not zeros:
            break
        at = zeros.bit_length() - 1
        left = (2 << at) - 1
        if (~vectors[k - 1] & left).bit_count() < n:
            firsts.append(heads[k - 1])
            seconds.append(at + low)
            left, n = (1 << at) - 1, n - 1
    return a[np.array(firsts[::-1], np.int64)], np.array(seconds[::-1], np.int64)


def fitting(i: np.ndarray, j: np.ndarray, least: int, short: int, similarity: float, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of an alignment (i, j): runs x..y of it similar enough, the furthest y for each x, and those shorter than a passage outside of them (with ``every``, anywhere).

    n matches over l and m shingles are similar enough where (1 + s) n >= s (l + m), which is a difference of two
    sums over the alignment. Runs shorter than a passage count as filled up to one.
    """
    n = len(i)

    def good(x, y):
        sizes = np.maximum(least, i[y] - i[x] + 1) + np.maximum(least, j[y] - j[x] + 1)
        return (1 + similarity) * (y - x + 1) >= similarity * sizes - 1e-9

    k = np.arange(n)
    p = (1 + similarity) * k - similarity * (i + j)
    top = np.maximum.accumulate(p[::-1])
    far = n - 1 - np.searchsorted(top, p - 1 + similarity - 1e-9)
    x = k[good(k, far)]
    x, y = _ahead(x, far[x])
    open_ = np.ones(n, bool)
    for a, b in zip(x.tolist(), y.tolist()) if not every else []:
        open_[a : b + 1] = False
    xs, ys = [x], [y]
    if open_.any():
        # a short run adds something if its first, last or a middle match is open: it then begins near an open one
        near = np.flatnonzero(np.convolve(open_, np.ones(least, np.int64))[least - 1 :] > 0)
        for more in range(short - 1, least):
            x = near[near + more < n]
            x = x[good(x, x + more)]
            xs.append(x)
            ys.append(x + more)
    return _ahead(np.concatenate(xs), np.concatenate(ys))


def _ahead(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs x..y that no other one with an earlier x reaches past."""
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    kept = np.concatenate(([True], y[1:] > np.maximum.accumulate(y)[:-1]))[: len(y)]
    return x[kept], y[kept]


def matches(own: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of equal shingles (i, j), in order of i and then j."""
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    low, high = np.searchsorted(ranked, own), np.searchsorted(ranked, own, side="right")
    times = high - low
    i = np.repeat(np.arange(len(own)), times)
    return i, order[np.repeat(low, times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)]


def _distinct(values: np.ndarray, least: int):
    """A function of the shingles that count: how many distinct ones of those any ``least`` neighbouring ones hold."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    before = np.full(n, -1)
    again = np.flatnonzero(values[order][1:] == values[order][:-1])
    before[order[again + 1]] = order[again]
    # a shingle is new to the windows that begin after its last occurrence
    k = np.arange(n)
    first, last = np.maximum(np.maximum(before, k - least) + 1, 0), np.minimum(k, n - least)

    def distinct(own: np.ndarray) -> np.ndarray:
        own = own & (first <= last)
        return np.cumsum(np.bincount(first[own], minlength=n + 1) - np.bincount(last[own] + 1, minlength=n + 1))[: n - least + 1]

    return distinct


def _fewest(values: np.ndarray, least: int) -> int:
    """The fewest distinct shingles in ``least`` neighbouring ones: a passage has as many or more."""
    return int(_distinct(values, least)(np.ones(len(values), bool)).min())


def _crowded(values: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """The shared shingles that stand in some ``least`` neighbouring ones of whose distinct ones at least half are shared."""
    n, distinct = len(values), _distinct(values, least)
    at = np.flatnonzero(2 * distinct(shared) >= distinct(np.ones(n, bool)))
    inside = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + least, minlength=n + 1))[:n] > 0
    return shared & inside


def verified(own: np.ndarray, theirs: np.ndarray, width: int, similarity: float) -> list[tuple[int, int]]:
    """Runs of a text, in words, that are near-duplicates of a run of the other; both as hashes of their shingles.

    Of every match along an alignment, the furthest one that still fits with it is found by binary search. Where no
    shingle recurs that is exact; otherwise what is found is checked on the sets of shingles. Texts whose shingles recur
    so much that there are more than PAIRS matches are met slice by slice, each reaching SLICE passages
    over the next, so that memory stays in proportion to the texts and passages of that length are seen whole.
    """
    least = width - SHINGLE + 1
    if min(len(own), len(theirs)) < least:
        return []
    if len(own) == len(theirs) and (own == theirs).all():
        return [(0, len(own) + SHINGLE - 1)]
    found: list[tuple[int, int]] = []
    ranked = np.sort(own), np.sort(theirs)
    once = all(bool((x[1:] != x[:-1]).all()) for x in ranked)
    mine, yours = _among(own, ranked[1]), _among(theirs, ranked[0])
    if not once:
        # where shingles recur, passages that are equal word for word need no alignment, nor do scattered matches
        if len(np.unique(own[mine])) < similarity * max(_fewest(own, least), _fewest(theirs, least)) - 1e-9:
            return []
        mine, yours = _crowded(own, mine, least), _crowded(theirs, yours, least)
        found = _equal_windows(own, theirs, least)
        # stretches that repeat earlier ones of their own text word for word are judged once
        mine, yours = mine & _news(own, least), yours & _news(theirs, least)
    open_ = mine.copy()
    for a, b in found:
        open_[a:b] = False
    if not open_.any() or not yours.any():
        pass
    elif _times(own[mine], theirs[yours]) <= PAIRS:
        found += _aligned(own, theirs, mine, yours, open_, once, least, similarity)
    else:
        step = SLICE * least
        ends = [range(0, max(1, len(x) - step), step) for x in (own, theirs)]
        for a in ends[0]:
            part, given, left = (x[a : a + 2 * step] for x in (own, mine, open_))
            # the slices that share most come first; once every shared shingle is in a run, the rest cannot add any
            common = [int(np.isin(part[left], theirs[c : c + 2 * step][yours[c : c + 2 * step]]).sum()) for c in ends[1]]
            for k in np.argsort(np.negative(common), kind="stable").tolist():
                if not left.any() or not common[k]:
                    break
                other = slice(ends[1][k], ends[1][k] + 2 * step)
                for x, y in _aligned(part, theirs[other], given, yours[other], left, once, least, similarity):
                    found.append((a + x, a + y))
                    left[x:y] = False
    if not once:
        known = [_rolling(own[a:b], least) for a, b in found if b - a >= least]
        found += [(a, a + least) for a in np.flatnonzero(_among(_rolling(own, least), np.sort(np.concatenate(known)))).tolist()] if known else []
    return merged([(a, b + SHINGLE - 1) for a, b in found])


def _among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def _times(own: np.ndarray, theirs: np.ndarray) -> int:
    """Pairs of equal values."""
    (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (own, theirs))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int((n[i] * m[j]).sum())


#: An odd multiplier and its inverse in 64 bits.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def _powers(of: int, n: int) -> np.ndarray:
    factors = np.full(n, of, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def _rolling(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` values."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) * _powers(STEP, len(x)))))
    return (upto[size:] - upto[:-size]) * _powers(BACK, len(x) - size + 1)


def _equal_windows(own: np.ndarray, theirs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of ``own``, in shingles, all of whose windows of ``least`` shingles stand in ``theirs``. Windows are compared by rolling hashes."""
    at = np.flatnonzero(_among(_rolling(own, least), np.sort(_rolling(theirs, least))))
    return merged((a, a + least) for a in at.tolist())


def _news(x: np.ndarray, least: int) -> np.ndarray:
    """Which shingles are near the beginning of a window of two passages that did not occur before: in it, or a passage before it."""
    size = min(2 * least, len(x))
    hashes = _rolling(x, size)
    order = np.argsort(hashes, kind="stable")
    first = order[np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))]
    change = np.bincount(np.maximum(first - least, 0), minlength=len(x) + 1) - np.bincount(np.minimum(first + size, len(x)), minlength=len(x) + 1)
    return np.cumsum(change)[: len(x)] > 0


def _aligned(own, theirs, mine: np.ndarray, yours: np.ndarray, open_: np.ndarray, once: bool, least: int, similarity: float) -> list[tuple[int, int]]:
    """Runs of ``own``, in shingles. ``mine`` and ``yours`` say which shingles of either side are matched, ``open_`` which are in no run yet."""
    inside, outside = np.flatnonzero(mine), np.flatnonzero(yours)
    i, j = matches(own[inside], theirs[outside])
    short = int(np.ceil(2 * similarity * least / (1 + similarity) - 1e-9))
    if len(i) == 0 or once and len(i) < short:
        return []
    i, j = inside[i], outside[j]
    check = None if once else _Sets(own, theirs, least, similarity)
    hit = open_.copy()
    found: list[tuple[int, int]] = []
    for a, b in chains(i, j, short):
        for x, y in zip(*(v.tolist() for v in fitting(a, b, least, short, similarity, check is not None))):
            run = int(a[x]), int(a[y]) + 1, int(b[x]), int(b[y]) + 1
            if check is None or not check.recurs(*run) or check(*run):
                found.append(run[:2])
                hit[run[0] : run[1]] = False
        for run in _by_sets(a, b, hit, least, check) if check is not None and hit.any() else []:
            found.append(run[:2])
            hit[run[0] : run[1]] = False
        if not hit.any():
            break
    if not once:
        found += _collapsed(own, theirs, np.flatnonzero(_among(own, np.sort(theirs))).tolist(), found, least, similarity)
    return found


def _latest(x: np.ndarray) -> np.ndarray:
    """For every value the place of the latest occurrence before it of itself or of any value before it, -1 without one.

    Values of x[a:b] recur inside it where this is a or more at b - 1.
    """
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order][1:] == x[order][:-1])
    before = np.full(len(x), -1)
    before[order[again + 1]] = order[again]
    return np.maximum.accumulate(before)


class _Sets:
    """Checks of two runs on their sets of shingles; one shorter than a passage is lengthened to one, to the right or to the left."""

    def __init__(self, own: np.ndarray, theirs: np.ndarray, least: int, similarity: float):
        self.sides, self.least, self.similarity = (own, theirs), least, similarity
        self.latest = _latest(own), _latest(theirs)

    def recurs(self, a: int, b: int, ca: int, cb: int) -> bool:
        """Whether shingles recur in either run or in what lengthens it; without that, sets and alignments say the same."""
        for latest, x, y in zip(self.latest, (a, ca), (b, cb)):
            x, y = max(0, min(x, y - self.least)), min(len(latest), max(y, x + self.least))
            if latest[y - 1] >= x:
                return True
        return False

    def filled(self, a: int, b: int, n: int) -> list[tuple[int, int]]:
        if b - a >= self.least:
            return [(a, b)]
        return list({(x, x + self.least) for x in (max(0, min(a, n - self.least)), max(0, b - self.least))})

    def close(self, f: tuple[int, int], g: tuple[int, int]) -> bool:
        left, right = (set(x[a:b].tolist()) for x, (a, b) in zip(self.sides, (f, g)))
        both = len(left & right)
        return both >= self.similarity * (len(left) + len(right) - both)

    def __call__(self, a: int, b: int, ca: int, cb: int) -> bool:
        own, theirs = self.sides
        return any(self.close(f, g) for f in self.filled(a, b, len(own)) for g in self.filled(ca, cb, len(theirs)))


def _by_sets(i: np.ndarray, j: np.ndarray, hit: np.ndarray, least: int, check):
    """Runs of an alignment, begun at every STRIDE-th match that no run has yet, that are similar as sets only: repeats count once there.

    Lengths rise by halves from a passage to SLICE passages.
    """
    for x in range(0, len(i), STRIDE):
        if not hit[i[x]]:
            continue
        for length in range(2, 2 * SLICE + 1):
            y = int(np.searchsorted(i, i[x] + length * least // 2)) - 1
            if i[y] - i[x] + 1 < length * least // 2 - GAP or 2 * (y - x + 1) < length * least // 2:
                break
            run = int(i[x]), int(i[y]) + 1, int(j[x]), int(j[y]) + 1
            if check.recurs(*run) and check(*run):
                yield run
                break


def _collapsed(own, theirs, shared, found, least, similarity):
    """Runs as wide as their matches: repeats inside a passage collapse in its set."""
    check = _Sets(own, theirs, least, similarity)
    out = []
    for a, b in _joined(GAP, shared):
        if b - a >= least and not any(x <= a and b <= y for x, y in found):
            inside = np.flatnonzero(_among(theirs, np.sort(own[a:b])))
            if inside[-1] + 1 - inside[0] >= least and check(a, b, int(inside[0]), int(inside[-1]) + 1):
                out.append((a, b))
    return out


def verify(mine: list[str], theirs: list[str], width: int, similarity: float) -> list[tuple[int, int]]:
    """:func:`verified` of two lists of words."""
    return verified(*(shingles([w.encode() for w in x]) for x in (mine, theirs)), width, similarity)


def _joined(gap: int, inside: list[int]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for i in inside:
        if runs and i - runs[-1][1] <= gap:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return [(a, b) for a, b in runs]


def on_grid(found: DataFrame) -> DataFrame:
    """Regions in words, widened to multiples of GRID, so that the partners of one centre ask for the same few runs of it."""
    down, up = (lambda x: (F.col(x) - F.col(x) % GRID).alias(x)), (lambda x: (F.ceil((F.col(x) + SHINGLE - 1) / GRID) * GRID).alias(x))
    return found.select("d", "c", down("a"), up("b"), down("ca"), up("cb")).distinct()


def asked_runs(pairs: DataFrame) -> DataFrame:
    """A row per document: the distinct runs that pairs ask for, bounded by its own words and not by its partners."""
    asked = pairs.select(F.col("d").alias("doc"), F.col("a").alias("first"), F.col("b").alias("end"))
    asked = asked.union(pairs.select(F.col("c").alias("doc"), F.col("ca").alias("first"), F.col("cb").alias("end"))).distinct()
    return asked.groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("asked"))


def repeats(
    docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, functions: int = FUNCTIONS, enough: int = ENOUGH,
    context: int = CONTEXT, chunk_words: int = CHUNK_WORDS, bucket_bytes: int = BUCKET_BYTES, crowd: int = CROWD,
) -> tuple[DataFrame, DataFrame]:
    """Verified passages: documents d and c (keys), and word runs begin, end of d that repeat passages of c; and n_words of every document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    first, buckets = Packed.counts(size, bucket_bytes)
    least = width - SHINGLE + 1
    made = CENTRES.refined(windows(docs, first, width, functions, context, chunk_words), first, buckets, size // chunk_words)
    linked = stored(made.groupBy("key").applyInArrow(_meet(least, first, crowd), PACKED))
    met = linked.filter("kind = 'links'")
    crowds = crowd_links(docs, linked, crowd)
    pairs = stored(on_grid(regions(met if crowds is None else met.union(crowds), buckets, least, enough)))
    # both bounded by a document's own windows, however many partners it has
    spots = spots_of(linked, first, buckets, size, chunk_words)
    asked = spots.join(asked_runs(pairs).withColumnRenamed("asked", "wanted"), "doc", "full")
    answered = stored(answers(docs, asked, first, least, chunk_words), "kind")
    n_words = linked.filter("kind = 'sizes'").select("data").mapInArrow(_unpacked(SIZES, ["d", "n_words"], ["u8", "i8"]), "d long, n_words long")
    n_words = stored(n_words.distinct())
    release(linked, *([] if crowds is None else [crowds]))
    equal = stored(equal_passages(answered, first, buckets, size, width, chunk_words))
    segments = answered.filter("kind = 'segments'").select("doc", "first", "end", "hashes")
    if docs.count() > n_words.count():
        # rows that are one document give its runs once each: one of them stays
        segments = segments.groupBy("doc", "first", "end").agg(F.max("hashes").alias("hashes"))
    near = stored(compared(pairs, segments, width, similarity))
    release(answered, pairs)
    return equal.union(near).distinct(), n_words


def celled(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the cell that each is compared in, so that a run is moved once for a cell and not once for a pair.

    A pair's label is the least run (by hash) that is one of its two or linked to one of them; runs that are linked among themselves share it. Small
    labels are dealt into cells whole; larger ones are cut into a square of cells by either side's run.
    """
    named = pairs.withColumn("x", F.xxhash64("d", "a", "b")).withColumn("y", F.xxhash64("c", "ca", "cb"))
    both = named.select("x", "y").union(named.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("least"))
    side = lambda x: least.select(F.col("x").alias(x), F.col("least").alias(f"of_{x}"))
    size = 1 + F.floor(5 * (F.col("b") - F.col("a") + F.col("cb") - F.col("ca")) / (2 * RUN_BYTES))
    labelled = stored(named.join(side("x"), "x").join(side("y"), "y").withColumn("label", F.least("of_x", "of_y")).withColumn("size", size).drop("of_x", "of_y"))
    cells = 1 + (labelled.agg(F.sum("size")).first()[0] or 0) // PART_PAIRS
    sums = labelled.groupBy("label").agg(F.ceil(F.sqrt(F.sum("size") / PART_PAIRS)).alias("wide"))
    cut = F.xxhash64("label", F.pmod("x", "wide"), F.pmod("y", "wide"))
    cell = F.when(F.col("wide") > 1, cut).otherwise(F.pmod(F.xxhash64("label"), F.lit(cells)))
    out = stored(labelled.join(sums, "label").select(*pairs.columns, cell.alias("cell")))
    release(labelled)
    return out


def needed(celled_pairs: DataFrame) -> DataFrame:
    """cell, doc, first, end: the runs that each cell is sent."""
    mine = celled_pairs.select("cell", F.col("d").alias("doc"), F.col("a").alias("first"), F.col("b").alias("end"))
    return mine.union(celled_pairs.select("cell", F.col("c").alias("doc"), F.col("ca").alias("first"), F.col("cb").alias("end"))).distinct()


def compared(pairs: DataFrame, segments: DataFrame, width: int, similarity: float) -> DataFrame:
    """d, c, begin, end: the near-duplicates among the runs of ``pairs``, by their hashes in ``segments`` (doc, first, end, hashes)."""
    dealt = celled(pairs)
    runs = needed(dealt).join(segments, ["doc", "first", "end"]).select(F.col("cell").alias("at"), "doc", "first", "end", "hashes")

    def compare(table, held):
        names = list(zip(*(held.column(n).to_pylist() for n in ("doc", "first", "end"))))
        kinds: dict[bytes, int] = {}
        kind = {name: kinds.setdefault(x, len(kinds)) for name, x in zip(names, held.column("hashes").to_pylist())}
        runs = [widened(x) for x in kinds]
        known: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of equal runs, too, each pair is judged once
        out = []
        for d, a, b, c, ca, cb in zip(*(table.column(n).to_pylist() for n in ("d", "a", "b", "c", "ca", "cb"))):
            both = kind[d, a, b], kind[c, ca, cb]
            if both not in known:
                known[both] = verified(runs[both[0]], runs[both[1]], width, similarity)
            out += [(d, c, a + i, a + j) for i, j in known[both]]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=["d", "c", "begin", "end"])

    return dealt.groupBy("cell").cogroup(runs.groupBy("at")).applyInArrow(compare, "d long, c long, begin long, end long")


def per_document(found: DataFrame) -> DataFrame:
    """The merged spans of each later document of a pair."""

    @F.udf("array<struct<begin:long,end:long>>", useArrow=True)
    def join_up(spans):
        return [{"begin": a, "end": b} for a, b in merged((x["begin"], x["end"]) for x in spans)]

    return found.groupBy("d").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).select("d", join_up("spans").alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: class_id (smallest doc_id it reaches over shared passages), n_links (links in
    the forest of centres), the runs of words that repeat passages of documents before it, and those documents' ids in ``repeats_of``."""
    found, n_words = repeats(docs, **options)
    found = stored(found)
    links = stored(found.select("d", "c").distinct())
    roots = stored(components(links.select(F.col("d").alias("a"), F.col("c").alias("b"))))
    slim = stored(docs.select("doc_id", document_key().alias("d")).join(n_words, "d"))
    rooted = slim.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    ends = links.select(F.explode(F.array("d", "c")).alias("d")).groupBy("d").agg(F.count("*").alias("n_links"))
    names = slim.groupBy(F.col("d").alias("c")).agg(F.min("doc_id").alias("id"))
    of = links.join(names, "c").groupBy("d").agg(F.sort_array(F.collect_set("id")).alias("repeats_of"))
    spans = per_document(found)
    joined = rooted.join(classes, "root").join(ends, "d", "left").join(of, "d", "left").join(spans, "d", "left")
    empty = F.array().cast("array<bigint>")
    runs = F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    return joined.select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_words",
        F.aggregate(F.transform(runs, lambda x: x["end"] - x["begin"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeated_words"),
        F.transform(runs, lambda x: x["begin"]).alias("begins"), F.transform(runs, lambda x: x["end"]).alias("ends"),
        F.coalesce("repeats_of", empty).alias("repeats_of"),
    )


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the passages that repeat those of earlier documents. n_chars, where there is one, follows."""
    spans = per_document(stored(repeats(docs, **options)[0]))
    key, own = free_name(docs, "d"), free_name(docs, "spans")
    joined = docs.withColumn(key, document_key()).join(spans.select(F.col("d").alias(key), F.col("spans").alias(own)), key, "left")

    @F.udf("string", useArrow=True)
    def cut(text, runs):
        return text if runs is None else without(text, [(x["begin"], x["end"]) for x in runs])

    touched = F.col(own).isNotNull()
    out = joined.withColumn("text", F.when(touched, cut("text", own)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
