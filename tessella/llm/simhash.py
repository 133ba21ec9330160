"""SimHash near-duplicate detection with pigeonhole blocks.

A text's fingerprint sums the bits of the XXH64 hashes of its word shingles. Two fingerprints that
differ in at most ``distance`` bits agree on at least ``blocks - distance`` of ``blocks`` blocks of
bits, so each fingerprint is filed under every choice of that many blocks, and only fingerprints filed
together are compared. Choices of three from six blocks make keys of about 32 bits, which stay
selective for billions of documents.

Equal fingerprints are one node, so copies never meet. Fingerprints filed together are compared
inside the task by XOR and bit counts, and only a spanning forest of the links leaves it, never all
pairs. Where more than ``group_limit`` share a key, the group is filed again under choices of the blocks of the
bits that the key leaves open; this is exact, and ends, because the open bits run out: a group
whose open bits admit at most ``group_limit`` values cannot be larger.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle of them all; repeated rows and equal texts share a component; rows with a
null doc_id get a fingerprint and the component of the smallest non-null id; a very long text is summed whole, in
stretches of 65,536 shingles; an empty table gives no rows; other columns are ignored by :func:`report` and carried by :func:`deduplicated`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import free_name, release, stored
from tessella.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
GROUP_LIMIT = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int("".join("1" if 2 * c > n else "0" for c in ones.tolist()), 2)


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """``docs`` with a last column of signed 64-bit fingerprints, named ``fp`` or the next free name."""
    name = free_name(docs, "fp")
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def scan(batches):
        for batch in batches:
            own = np.fromiter((fingerprint(t, shingle) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(own.view(np.int64))], names=[*(batch.schema.names[i] for i in kept), name]
            )

    return docs.mapInArrow(scan, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(name, T.LongType())]))


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Signed masks of every choice of ``agree`` of ``blocks`` blocks of the given bits."""
    parts = [sum(1 << b for b in p) for p in np.array_split(np.array(bits, dtype=object), blocks)]
    return [sum(choice) for choice in itertools.combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``fp``: a spanning forest of every group that shares a key."""
    masks = _masks(list(range(64)), blocks, blocks - distance)
    keys = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    filed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.mask", "k.key")
    edges = None
    while True:
        several = stored(filed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        work = filed.join(several.filter(F.col("n") <= group_limit), ["mask", "key"]).select("mask", "key", "fp")
        dealt = work.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = stored(dealt.mapInArrow(_forests(distance), "a long, b long").distinct())
        edges = found if edges is None else edges.union(found)
        large = several.filter(F.col("n") > group_limit).select("mask", "key")
        if not large.limit(1).count():
            return edges
        again = filed.join(large, ["mask", "key"]).select("mask", "key", "fp")
        filed = stored(again.mapInPandas(_refiled(blocks, distance), "fp long, mask long, key long").distinct())


def _forests(distance: int):
    """Over rows (mask, key, fp) sorted by all three: the forests of their groups. A group is whole in one partition."""

    def scan(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns)]
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            cut = int(new[-1]) if len(new) else 0
            yield from emit(rows[2], new[:-1] if len(new) else new, cut)
            rest = [r[cut:] for r in rows]
        yield from emit(rest[2], np.zeros(0, np.int64), len(rest[2]))

    def emit(fps, inner, end):
        edges = []
        for group in np.split(fps[:end], inner):
            edges += forest(group.tolist() if len(group) < 32 else group, distance)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    return scan


def forest(fps, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps`` (a short list, or an array), from each unseen one outward."""
    edges = []
    if isinstance(fps, list):
        unseen = fps
        while unseen:
            front, unseen = [unseen[0]], unseen[1:]
            while front and unseen:
                at = front.pop()
                near = [x for x in unseen if ((x ^ at) & (1 << 64) - 1).bit_count() <= distance]
                edges += [(at, x) for x in near]
                unseen = [x for x in unseen if x not in near]
                front += near
        return edges
    unseen = np.ones(len(fps), bool)
    for first in range(len(fps)):
        front = [first] if unseen[first] else []
        unseen[first] = False
        while front:
            at = front.pop()
            near = np.flatnonzero(unseen & (np.bitwise_count((fps ^ fps[at]).view(np.uint64)) <= distance))
            unseen[near] = False
            edges += [(int(fps[at]), int(x)) for x in fps[near]]
            front += near.tolist()
    return edges


def _refiled(blocks: int, distance: int, carried: tuple | list = ("fp",)):
    def refile(frames):
        for pdf in frames:
            out = []
            for mask, own in pdf.groupby("mask"):
                bits = [b for b in range(64) if not (int(mask) >> b) & 1]
                fps = own["fp"].to_numpy()
                for more in _masks(bits, blocks, blocks - distance):
                    m = _signed((int(mask) & (1 << 64) - 1) | more)
                    out.append(own[list(carried)].assign(mask=np.int64(m), key=fps & np.int64(m)))
            if out:
                yield pd.concat(out)

    return refile


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root fp) of every fingerprint that has a link and is not the root itself."""
    return components(links(prints.select("fp").distinct()))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links of fingerprints."""
    prints = stored(fingerprinted(docs.select("doc_id", "text"), keep_text=False))
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stored(classes(least))
    rooted = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(by_root, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the stage that keeps one text of each group: bits that candidates may differ in, blocks, words of a shingle, least similarity.
WIDE_DISTANCE, WIDE_BLOCKS = 3, 6
EXACT_SHINGLE, SIMILARITY = 5, 0.8
#: Keys that the pairs of one text are dealt over.
SALTS = 64


def shingle_set(text: str | None, shingle: int = EXACT_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of fewer words than a shingle, of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle])) for i in range(count)), np.uint64, count))


def shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, shingles) of the ``texts`` (fp, text) that ``nodes`` (fp) name, each cut and moved once."""

    def cut(batches):
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return stored(texts.join(nodes, "fp", "left_semi").select("fp", "text").mapInArrow(cut, "fp long, shingles binary"))


def judged(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) whose ``sets`` (fp, shingles) have a Jaccard similarity of ``similarity`` or more."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda e, c: sets.select(F.col("fp").alias(e), F.col("shingles").alias(c))
    # a text with very many links is dealt over SALTS keys, each with its own copy of it
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = side("a", "x").join(salted.select("a", "salt").distinct(), "a")
    salted = salted.withColumn("turn", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    others = side("b", "y").join(salted.select("b", "turn").distinct(), "b")
    both = salted.join(copies, ["a", "salt"]).join(others, ["b", "turn"]).select("a", "b", "x", "y")
    return stored(both.mapInArrow(compare, "a long, b long"))


def verified(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) whose texts (fp, text) have a Jaccard similarity of ``similarity`` or more on five-word shingles."""
    sets = shingle_sets(texts, edges.select(F.explode(F.array("a", "b")).alias("fp")))
    out = judged(edges, sets, similarity)
    release(sets)
    return out


def _few(filed: DataFrame, distance: int, blocks: int, group_limit: int) -> DataFrame:
    """Rows (mask, key, fp, node) of all groups of two or more; larger ones are filed again, unless the open bits admit no distance beyond the limit."""
    done = None
    while True:
        several = stored(filed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        small = (F.col("n") <= group_limit) | (F.bit_count("mask") >= 64 - distance)
        found = filed.join(several.filter(small), ["mask", "key"]).select("mask", "key", "fp", "node")
        done = found if done is None else done.union(found)
        large = several.filter(~small).select("mask", "key")
        if not large.limit(1).count():
            return done
        again = filed.join(large, ["mask", "key"]).select("mask", "fp", "node")
        schema = "mask long, key long, fp long, node long"
        filed = stored(again.mapInPandas(_refiled(blocks, distance, ["fp", "node"]), schema).distinct())


def _proposed(distance: int, low: int, high: int):
    """Over rows (mask, key, fp, node, root) sorted by all: of each node the close ones after it, counted from 1, above ``low`` up to ``high``, with another root.

    Returns pairs (a, b), and (mask, key) of groups where such a pair comes later in the count.
    """

    def scan(batches):
        rest = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            rows = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns)]
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            cut = int(new[-1]) if len(new) else 0
            yield from emit([r[:cut] for r in rows], new[:-1])
            rest = [r[cut:] for r in rows]
        yield from emit(rest, np.zeros(0, np.int64))

    def emit(rows, inner):
        out = []
        for mask, key, fp, node, root in zip(*(np.split(r, inner) for r in rows)):
            if len(fp) < 2 or (root == root[0]).all():
                continue
            later = False
            for at in range(len(fp) - 1):
                near = at + 1 + np.flatnonzero(np.bitwise_count((fp[at + 1 :] ^ fp[at]).view(np.uint64)) <= distance)
                other = root[near] != root[at]
                turn = np.arange(1, len(near) + 1)
                out += [(int(node[at]), int(x), None, None) for x in node[near[other & (turn > low) & (turn <= high)]]]
                later = later or bool((other & (turn > high)).any())
            if later:
                out.append((None, None, int(mask[0]), int(key[0])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b", "mask", "key"])

    return scan


def _close(distance: int):
    """Over rows (mask, key, fp, node) sorted by all: the nodes that are close to another one of their group."""

    def scan(batches):
        rest = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            rows = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns)]
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            cut = int(new[-1]) if len(new) else 0
            yield emit([r[:cut] for r in rows], new[:-1])
            rest = [r[cut:] for r in rows]
        yield emit(rest, np.zeros(0, np.int64))

    def emit(rows, inner):
        hit = np.zeros(len(rows[2]), bool)
        for at in np.split(np.arange(len(hit)), inner):
            fp = rows[2][at]
            for k in range(len(at) - 1):
                near = at[k + 1 :][np.bitwise_count((fp[k + 1 :] ^ fp[k]).view(np.uint64)) <= distance]
                if len(near):
                    hit[at[k]] = hit[near] = True
        return pa.RecordBatch.from_arrays([pa.array(np.unique(rows[3][hit]), pa.int64())], names=["fp"])

    return scan


def similar(nodes: DataFrame, texts: DataFrame, distance: int, blocks: int, similarity: float, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) between ``nodes`` (node, fp) whose fingerprints are within ``distance`` bits and whose ``texts`` (fp: the node, text) are similar.

    They connect what all such pairs connect. A pair is judged by its texts before it counts as a link: each node
    proposes the next three of its close ones, then the next twelve, 48 and so on, as long as any of them is not connected to it.
    """
    masks = _masks(list(range(64)), blocks, blocks - distance)
    keys = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    filed = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.key", "fp", "node")
    work = stored(_few(filed, distance, blocks, group_limit))
    whole = work.select("mask", "key", "fp", "node").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp", "node")
    sets = shingle_sets(texts, stored(whole.mapInArrow(_close(distance), "fp long").distinct()))
    edges, roots, low, high = None, None, 0, 3
    while True:
        rooted = work.withColumn("root", F.col("node")) if roots is None else work.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        dealt = rooted.select("mask", "key", "fp", "node", "root").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp", "node")
        found = stored(dealt.mapInArrow(_proposed(distance, low, high), "a long, b long, mask long, key long"))
        good = judged(found.filter("a is not null").select("a", "b").distinct(), sets, similarity)
        edges = good if edges is None else edges.union(good)
        later = found.filter("mask is not null").select("mask", "key")
        if not later.limit(1).count():
            release(found, work, sets)
            return edges
        roots = stored(components(edges))
        rest = stored(work.join(later, ["mask", "key"], "left_semi"))
        release(found, work)
        work = rest
        low, high = high, 4 * high + 3


def of_equal_prints(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) from the smallest node of each fingerprint to those similar to it; the others of that fingerprint go on among themselves."""
    several = nodes.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    left, edges = stored(nodes.select("fp", "node").join(several, "fp", "left_semi")), None
    sets = shingle_sets(texts, left.select(F.col("node").alias("fp")))
    while True:
        heads = left.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
        asked = stored(left.join(heads, "fp").filter("node > a").select("fp", "a", F.col("node").alias("b")))
        if edges is not None and not asked.limit(1).count():
            release(sets)
            return edges
        good = judged(asked.select("a", "b"), sets, similarity)
        edges = good if edges is None else edges.union(good)
        left = asked.join(good, ["a", "b"], "left_anti").select("fp", F.col("b").alias("node"))


def deduplicated(docs: DataFrame, distance: int = WIDE_DISTANCE, blocks: int = WIDE_BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (where that repeats, the longest text).

    Texts are linked where their fingerprints differ in at most ``distance`` bits and their five-word shingles are
    similar; equal fingerprints are judged like others. Of a fingerprint's texts those similar to the smallest (by hash) are one
    class, and the classes' smallest texts meet those of other fingerprints. Texts are named by their hash; rows
    are numbered as they are written, and the number stands for a row where ids repeat or are null.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    named = packed.withColumn("node", F.xxhash64("text"))
    prints = stored(fingerprinted(named, keep_text=False).withColumn("number", F.expr("uuid()")))
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), (-F.col("size")).alias("size"), "number")
    best = stored(prints.groupBy("fp", "node").agg(F.min(rank).alias("rank")))
    shown = prints.join(best.select(F.col("rank.number").alias("number")), "number", "left_semi")
    texts = shown.select(F.col("node").alias("fp"), F.col("row.text").alias("text"))
    equal = of_equal_prints(best, texts, similarity)
    heads = best.select("node", "fp").join(equal.select(F.col("b").alias("node")), "node", "left_anti")
    roots = components(equal.union(similar(stored(heads), texts, distance, blocks, similarity)))
    rooted = best.join(roots, "node", "left").select("rank", F.coalesce("root", "node").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.number").alias("number"))
    return prints.join(keep, "number", "left_semi").select("row.*")
