"""Suffix and common-prefix order of a text by external induced sorting.

The text is a sequence of strings, each closed by 0. Suffixes that begin at an S* place (smaller than
the next suffix, larger than the one before) are ordered first. From them the L suffixes are induced in
ascending order and from those the S suffixes in descending order: a suffix taken from the queue of its
first byte puts its predecessor into the queue of the predecessor's byte. As suffixes leave in order,
each queue fills in order; the queues of all bytes together are a monotone priority queue. A queue
keeps (place, common prefix with the entry before) and moves to disk beyond a memory budget. The common
prefix of two neighbours in a queue is one more than the least common prefix on the way between
the suffixes that put them there, so it needs no comparison of texts.

Everything of one queue is handled at once, with arrays. The S* suffixes are ordered by the names of
their S* substrings and then by doubling over names, not by inducing again: the names of the reduced
text are so many that queues of one name each would hold a handful of entries. Common prefixes count up to ``cap``.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP = 200


class DiskQueues:
    """A queue of (place, common prefix) for each byte; the queues share a memory budget beyond which all move to disk."""

    def __init__(self, budget: int):
        self.budget = budget
        self.held = 0
        self.memory: list[list] = [[] for _ in range(257)]
        self.files: dict[int, object] = {}

    def put(self, byte: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.memory[byte].append((places, prefixes))
        self.held += 5 * len(places)
        if self.held > self.budget:
            for b, parts in enumerate(self.memory):
                if parts:
                    file = self.files.setdefault(b, None) or tempfile.TemporaryFile()
                    self.files[b] = file
                    for p, c in parts:
                        np.array([len(p)], np.int64).tofile(file)
                        p.tofile(file)
                        c.tofile(file)
                    self.memory[b] = []
            self.held = 0

    def take(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a queue in the order they were put; the queue is then empty."""
        parts = []
        file = self.files.pop(byte, None)
        if file is not None:
            file.seek(0)
            while len(n := np.fromfile(file, np.int64, 1)):
                parts.append((np.fromfile(file, np.uint32, n[0]), np.fromfile(file, np.uint8, n[0])))
            file.close()
        parts += self.memory[byte]
        self.held -= sum(5 * len(p) for p, _ in self.memory[byte])
        self.memory[byte] = []
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def close(self) -> None:
        for file in self.files.values():
            file.close()


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), and at every closing 0."""
    n = len(text)
    differs = np.empty(n, bool)
    differs[:-1] = text[1:] != text[:-1]
    differs[-1] = True
    at = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    follow = np.minimum.accumulate(at[::-1])[::-1]  # last place of each run of one byte
    follow += 1
    after = np.append(text, np.uint8(0))[follow]
    return (text < after) | (text == 0)


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number, the first lowest; zeros beyond the end."""
    out = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for n in (1, 2, 4):
        out = out[:-n] | out[n:] << np.uint64(8 * n)
    return out


ONES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = CAP, by_eight: np.ndarray | None = None) -> np.ndarray:
    """Bytes that the suffixes at a and b share before either closes, up to ``cap``: eight at a time, then one."""
    depth = np.zeros(len(a), np.int64)
    if by_eight is not None:
        active = np.arange(len(a))
        with np.errstate(over="ignore"):
            while len(active):
                x = by_eight[a[active] + depth[active]]
                whole = ((x - ONES) & ~x & TOPS) == 0  # no byte is 0
                active = active[whole & (x == by_eight[b[active] + depth[active]])]
                depth[active] += 8
                active = active[depth[active] < cap]
    active = np.flatnonzero(depth < cap)
    while len(active):
        x = text[a[active] + depth[active]]
        same = (x == text[b[active] + depth[active]]) & (x != 0)
        active = active[same]
        depth[active] += 1
        active = active[depth[active] < cap]
    return np.minimum(depth, cap).astype(np.uint8)


class RangeMinimum:
    """Least value in (i, j] of an array, from tables of the least over powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def over(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.uint8)
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            table = self.tables[k]
            out[own] = np.minimum(table[i[own] + 1], table[j[own] - (1 << int(k)) + 1])
        return out


def star_order(text: np.ndarray, small: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The S* places in order of their suffixes. Closing zeros come first, in order of place."""
    m = len(stars)
    closing = text[stars] == 0
    nexts = np.append(stars[1:], stars[-1] if m else 0)
    nexts = np.where(closing, stars, nexts)
    # names: order of the substrings from each S* place to the next, refined a byte at a time
    name = np.searchsorted(np.sort(text[stars]), text[stars]).astype(np.int64)
    depth = 1
    active = np.flatnonzero(~closing)
    while len(active):
        more = stars[active] + depth <= nexts[active]
        at = np.minimum(stars[active] + depth, len(text) - 1)
        # of equal bytes, that of an L suffix is the smaller
        value = np.where(more, 2 * text[at].astype(np.int64) + small[at] + 1, 0)
        name = _refined(name, active, value)
        # a substring goes on while it has bytes left and shares its name
        count = np.bincount(name, minlength=m + 1)
        active = active[more & (count[name[active]] > 1)]
        depth += 1
    rank = name
    step = 1
    while True:
        count = np.bincount(rank, minlength=m + 1)
        active = np.flatnonzero(~closing & (count[rank] > 1))
        if not len(active):
            break
        # names of one string only: beyond its closing zero nothing is compared
        ahead = np.minimum(active + step, m - 1)
        string = np.cumsum(closing) - closing
        inside = (string[ahead] == string[active]) & (active + step < m)
        if not inside.any():
            break
        value = np.where(inside, rank[ahead] + 1, 0)
        rank = _refined(rank, active, value)
        step *= 2
    return stars[np.lexsort((np.arange(m), rank))]


def _refined(rank: np.ndarray, active: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Ranks in which ``active`` entries of one rank are told apart by ``value``. A rank is the number of entries before it."""
    own = rank[active]
    order = np.argsort(own.astype(np.int64) * (int(value.max()) + 1) + value)
    o, v = own[order], value[order]
    first_of_rank = np.concatenate(([True], o[1:] != o[:-1]))
    new = first_of_rank | np.concatenate(([True], v[1:] != v[:-1]))
    at = np.arange(len(order))
    base = np.maximum.accumulate(np.where(first_of_rank, at, 0))
    shift = np.maximum.accumulate(np.where(new, at, 0)) - base
    out = rank.copy()
    out[active[order]] = o + shift
    return out


def suffix_order(text: np.ndarray, cap: int = CAP, budget: int = 256 << 20):
    """Places in order of their suffixes, and each one's common prefix with the one before. ``text`` is uint8 with closing zeros."""
    if not len(text):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    small = types(text)
    stars = np.flatnonzero(small & np.concatenate(([False], ~small[:-1])) | (text == 0))
    ordered = star_order(text, small, stars).astype(np.uint32)
    star_prefix = np.zeros(len(ordered), np.uint8)
    star_prefix[1:] = common_prefix(text, ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64), cap=cap, by_eight=eights(text))
    edges = np.searchsorted(text[ordered], np.arange(257))
    large, rest = DiskQueues(budget), DiskQueues(budget)
    done: dict[int, tuple] = {}
    try:
        for byte in np.unique(text).tolist():  # ascending: L suffixes
            places, prefixes = _own_run(text, small, *large.take(byte), byte, False, cap)
            done[byte] = places, prefixes
            a, b = edges[byte], edges[byte + 1]
            _induce(text, small, (places, prefixes), (ordered[a:b], star_prefix[a:b]), byte, large, False, cap)
        for byte in sorted(done, reverse=True):  # descending: S suffixes
            if byte == 0:
                places, prefixes = ordered[edges[0] : edges[1]], np.zeros(edges[1] - edges[0], np.uint8)
                done[0] = done[0], (places, prefixes)
                continue
            places, prefixes = _own_run(text, small, *rest.take(byte), byte, True, cap)
            lower, lower_prefix = done[byte]
            _induce(text, small, (places, prefixes), (lower[::-1], np.roll(lower_prefix[::-1], 1)), byte, rest, True, cap)
            # ascending again: each entry's prefix is with the one before, which follows it in this queue
            done[byte] = (lower, lower_prefix), (places[::-1], np.roll(prefixes[::-1], 1) if len(prefixes) else prefixes)
    finally:
        large.close()
        rest.close()
    out, common = [], []
    for byte in sorted(done):
        (lp, lc), (sp, sc) = done[byte]
        sc = sc.copy()
        lc = lc.copy()
        if len(lc):
            lc[0] = 0
        if len(sc):
            sc[0] = common_prefix(text, lp[-1:].astype(np.int64), sp[:1].astype(np.int64), cap=cap)[0] if len(lp) else 0
        out += [lp, sp]
        common += [lc, sc]
    return np.concatenate(out), np.concatenate(common)


def _own_run(text, small, places, prefixes, byte, kind, cap):
    """A queue with what it puts into itself: predecessors with the same byte, round after round."""
    prefixes = prefixes.copy()
    if len(prefixes):
        prefixes[0] = 0
    parts = [(places, prefixes)]
    since, first = cap, True
    while len(places):
        before = places.astype(np.int64) - 1
        own = np.flatnonzero((before >= 0) & (text[before] == byte) & (small[before] == kind))
        if not len(own):
            break
        new = before[own].astype(np.uint32)
        least = RangeMinimum(prefixes)
        step = np.empty(len(own), np.int64)
        step[1:] = least.over(own[:-1], own[1:])
        step[0] = 0 if first else min(since, int(prefixes[: own[0] + 1].min()))
        since = int(prefixes[own[-1] + 1 :].min()) if own[-1] + 1 < len(prefixes) else cap
        first = False
        places, prefixes = new, np.minimum(step + 1, cap).astype(np.uint8)
        parts.append((places, prefixes))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _induce(text, small, one, two, byte, queues, kind, cap):
    """Puts the predecessors of a byte's suffixes, first ``one`` then ``two``, into the queues of other bytes."""
    places = np.concatenate((one[0], two[0])).astype(np.int64)
    prefixes = np.concatenate((one[1], two[1]))
    if not len(places):
        return
    prefixes[0] = 0
    if len(one[0]) and len(two[0]):
        at = len(one[0])
        prefixes[at] = common_prefix(text, places[at - 1 : at], places[at : at + 1], cap=cap)[0]
    before = places - 1
    target = text[before]
    own = np.flatnonzero((before >= 0) & (small[before] == kind) & (target != 0) & (target != byte))
    if not len(own):
        return
    target = target[own]
    order = np.argsort(target, kind="stable")
    own, target = own[order], target[order]
    least = RangeMinimum(prefixes)
    heads = np.concatenate(([True], target[1:] != target[:-1]))
    common = np.zeros(len(own), np.int64)
    later = np.flatnonzero(~heads)
    common[later] = least.over(own[later - 1], own[later])
    common = np.minimum(common + 1, cap).astype(np.uint8)
    firsts = [*np.flatnonzero(heads).tolist(), len(own)]
    for i, j in zip(firsts, firsts[1:]):
        queues.put(int(target[i]), before[own[i:j]].astype(np.uint32), common[i:j])
