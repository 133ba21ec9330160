"""Centroid clustering by dual-tree Lloyd rounds.

Vectors are dealt into chunks once; each chunk becomes a cover tree that is stored with it. In a round
every task builds a second cover tree over the centroids (k x dimension numbers, which is all that a
round passes on) and walks both at once: a pair of nodes whose smallest possible distance is above the
largest possible distance of the vector node to some centroid is dropped with all that lies below it.
A vector node left with one centroid goes to it whole, by its prefix sums; where two leaves meet, every
vector is compared with the leaf's centroids in whole numbers, ties to the smaller centroid number.
Tasks return one partial sum per centroid and component; the driver holds only the k centroids.

The cover tree of a chunk. The root holds all vectors. A node's children have centres that are vectors
of the node, the first child has the node's own centre, every vector lies within the node's radius
over ``BASE`` of its child's centre, and no child's centre is that close to an earlier child's. A node of ``LEAF``
vectors or fewer, or of equal vectors only, is a leaf. Bounds are doubles of exact squared distances
with ``SLACK`` added, so rounding never drops a centroid that could win or tie.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are
left out; fewer vectors than centroids give fewer centroids; none give no rows. Repeated rows count as
often as they occur; a null vec_id comes last in every order and is kept; equal ids are ordered by their
vectors. Components beyond ``vectors.LIMIT`` after scaling count as that limit. A sum that does not
fit a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import pack, release, stored, unpack
from tessella.llm.vectors import chunks, exact, finite, floors, integer_matrix, narrow, whole_numbers, wide

BASE = 1.3
LEAF = 8
SLACK = 1e-9
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
DIMENSION = 64


class CoverTree:
    """Nodes in order of level, so that a node's children are neighbours; each covers a range of ``order``."""

    FIELDS = [("start", np.int32), ("end", np.int32), ("centre", np.int32), ("first", np.int32), ("many", np.int32), ("radius", np.float64)]

    def __init__(self, order: np.ndarray, **fields: np.ndarray):
        self.order = order
        for name, _ in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> CoverTree:
        apart = distances(points, points)
        order, rows, queue = np.empty(len(points), np.int64), [], [(np.arange(len(points)), 0)]
        for members, begin in queue:
            radius = float(np.sqrt(squared(points[members], points[members[:1]]).max()))
            parts = [] if len(members) <= leaf or radius == 0 else cls._split(apart, members, radius / BASE)
            if len(parts) < 2:
                parts, order[begin : begin + len(members)] = [], members
            rows.append((begin, begin + len(members), members[0], len(queue) if parts else len(rows), len(parts) or 1, radius))
            for part in parts:
                queue.append((part, begin))
                begin += len(part)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        fields = {name: np.array(x, kind) for (name, kind), x in zip(cls.FIELDS, zip(*rows))}
        fields["centre"] = place[fields["centre"]]
        return cls(order, **fields)

    @staticmethod
    def _split(apart: np.ndarray, members: np.ndarray, reach: float) -> list[np.ndarray]:
        parts = []
        while len(members):
            near = apart[members[0], members] <= reach
            near[0] = True
            parts.append(members[near])
            members = members[~near]
        return parts

    def packed(self) -> list[bytes]:
        return [pack(getattr(self, name).astype(kind)) for name, kind in self.FIELDS]

    @classmethod
    def unpacked(cls, data: list[bytes]) -> CoverTree:
        return cls(None, **{name: unpack(x, kind) for (name, kind), x in zip(cls.FIELDS, data)})

    def leaves(self, nodes: np.ndarray) -> np.ndarray:
        return self.first[nodes] == nodes


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of two whole-number arrays, exact in int64."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets, rounded: they only say how a tree is split."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The ranges first..first+many one after another."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(first, many)


def dual_walk(tree: CoverTree, points: np.ndarray, ctree: CoverTree, centroids: np.ndarray):
    """(nodes, centroid numbers) decided whole, and (places, centroid numbers, squared distances) of single vectors.

    ``points`` are in the tree's order; ``ctree.order`` names the centroids. Its leaves hold one centroid, or equal ones.
    """
    ranked = centroids[ctree.order]
    lowest = np.array([ctree.order[s:e].min() for s, e in zip(ctree.start, ctree.end)])
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, pairs = [], []
    while len(q):
        gap = np.sqrt(squared(points[tree.centre[q]], ranked[ctree.centre[r]]).astype(np.float64))
        slack = SLACK * (1 + gap + tree.radius[q])
        low = gap - tree.radius[q] - ctree.radius[r] - slack
        high = gap + tree.radius[q] + slack
        edges = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        many = np.diff(np.r_[edges, len(q)])
        keep = low <= np.repeat(np.minimum.reduceat(high, edges), many)
        q, r = q[keep], r[keep]
        edges = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        many = np.diff(np.r_[edges, len(q)])
        last = ctree.leaves(r)
        alone = np.repeat(many == 1, many) & last
        whole.append((q[alone], lowest[r[alone]]))
        ended = ~alone & tree.leaves(q) & np.repeat(np.logical_and.reduceat(last, edges), many)
        pairs.append((q[ended], lowest[r[ended]]))
        open_ = ~alone & ~ended
        q, r = q[open_], r[open_]
        # children of both sides, all pairs of them, ordered by the vector node
        children = tree.many[q].astype(np.int64) * ctree.many[r]
        own = np.repeat(np.arange(len(q)), children)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(children) - children, children)
        q, r = tree.first[q[own]] + nth // ctree.many[r[own]], ctree.first[r[own]] + nth % ctree.many[r[own]]
        order = np.argsort(q, kind="stable")
        q, r = q[order].astype(np.int64), r[order].astype(np.int64)
    nodes, number = (np.concatenate(x) for x in zip(*pairs))
    size = tree.end[nodes] - tree.start[nodes]
    place, number = spread(tree.start[nodes], size), np.repeat(number, size)
    square = squared(points[place], centroids[number])
    order = np.lexsort((number, square, place))
    first = order[np.r_[True, np.diff(place[order]) != 0]] if len(order) else order
    return tuple(np.concatenate(x) for x in zip(*whole)), (place[first], number[first], square[first])


def _built(scale: int, schema: pa.Schema):
    def build(batches):
        for table in chunks(batches):
            points = integer_matrix(table.column("embedding"), scale)
            tree = CoverTree.over(points, LEAF)
            ids = table.column("vec_id").combine_chunks().take(pa.array(tree.order))
            row = [pa.array([x], t) for x, t in zip((ids.to_pylist(), narrow(points[tree.order]), tree.packed()), schema.types)]
            yield pa.RecordBatch.from_arrays(row, schema=schema)

    return build


PARTIAL = "entry int, place int, n long, total long"


def _partial_sums(centroids: np.ndarray):
    def sums(batches):
        ctree = CoverTree.over(centroids, 1)
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                tree = CoverTree.unpacked(row["tree"])
                points = wide(row["data"], tree.end[0])
                (nodes, number), (place, own, _) = dual_walk(tree, points, ctree, centroids)
                upto = np.concatenate([np.zeros_like(points[:1]), np.cumsum(points, axis=0)])
                np.add.at(n, number, (tree.end - tree.start)[nodes])
                np.add.at(total, number, upto[tree.end[nodes]] - upto[tree.start[nodes]])
                np.add.at(n, own, 1)
                np.add.at(total, own, points[place])
        entry, at = np.indices(total.shape)
        out = {"entry": entry.ravel().astype(np.int32), "place": at.ravel().astype(np.int32), "n": np.repeat(n, total.shape[1]), "total": total.ravel()}
        yield pa.RecordBatch.from_pydict(out)

    return sums


def _assigned(centroids: np.ndarray, schema: pa.Schema):
    def assign(batches):
        ctree = CoverTree.over(centroids, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = CoverTree.unpacked(batch.column("tree")[i].as_py())
                points = wide(batch.column("data")[i].as_py(), tree.end[0])
                (nodes, number), (place, own, square) = dual_walk(tree, points, ctree, centroids)
                cluster, distance = np.empty(len(points), np.int32), np.empty(len(points), np.int64)
                size = tree.end[nodes] - tree.start[nodes]
                inside = spread(tree.start[nodes], size)
                cluster[inside] = np.repeat(number, size)
                distance[inside] = squared(points[inside], centroids[cluster[inside]])
                cluster[place], distance[place] = own, square
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster), pa.array(distance)], schema=schema)

    return assign


def clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest SHA-256 of ``1:<vec_id>``. ``k`` times ``dimension`` numbers pass
    through the driver in a round, whatever the number of vectors.
    """
    spark = embeddings.sparkSession
    kept = embeddings.filter(finite(F.col("embedding")) & (F.size("embedding") == dimension)).select("vec_id", "embedding")
    ranked = kept.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    first = ranked.orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).collect()
    id_type = kept.schema["vec_id"].dataType
    out = f"vec_id {id_type.simpleString()}, cluster int, distance long"
    if not first:
        blank = "cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"{out}, {blank}")
    centroids = whole_numbers(np.array([r["embedding"] for r in first]), scale)
    arrow = pa.schema([("ids", pa.list_(to_arrow_type(id_type))), ("data", pa.binary()), ("tree", pa.list_(pa.binary()))])
    trees = stored(kept.mapInArrow(_built(scale, arrow), f"ids array<{id_type.simpleString()}>, data binary, tree array<binary>"))
    for _ in range(rounds):
        parts = trees.select("data", "tree").mapInArrow(_partial_sums(centroids), PARTIAL)
        totals = parts.groupBy("entry", "place").agg(F.sum("n").alias("n"), exact(F.col("total")).alias("total"))
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
        floors(totals, sums, counts)
        used = counts > 0
        centroids = centroids.copy()
        centroids[used] = (sums[used] // counts[used, None]).astype(np.int64)
    arrow = pa.schema([("vec_id", to_arrow_type(id_type)), ("cluster", pa.int32()), ("distance", pa.int64())])
    found = stored(trees.mapInArrow(_assigned(centroids, arrow), out))
    release(trees)
    shares = {r["cluster"]: int(r["share"]) for r in found.groupBy("cluster").agg(exact(F.col("distance")).alias("share")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, _long(share), _long(sum(shares.values())), digests[c]) for c, share in shares.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None

