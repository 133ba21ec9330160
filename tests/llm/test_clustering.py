import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import clustering
from tessella.llm.clustering import CoverTree, dual_walk

SCHEMA = "vec_id long, embedding array<float>, cluster string, H string"


def kept(rows, d=64):
    return [(i, v) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def brute(rows, k=16, rounds=3):
    """Every vector against every centroid in Python integers."""
    vs = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in kept(rows)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z"
    centroids = [v for _, v in sorted(vs, key=lambda x: (digest(x[0]), x[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in vs]

    for _ in range(rounds):
        to = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(vs, to) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    to = assign()
    share = [sum(d for d, m in to if m == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, m, d, share[m], sum(share), sha[m]) for (i, _), (d, m) in zip(vs, to)), key=str)


def rows_(n, seed, spread=0.3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)], "c", "h") for i in range(n)]
    rows += [(n, None, None, None), (n + 1, [0.5] * 63, "c", "h"), (n + 2, [math.nan] + [0.0] * 63, "c", "h"), (n + 3, [math.inf] + [0.0] * 63, "c", "h")]
    rows += [(n + 4, [None] + [0.0] * 63, "c", "h"), (n + 5, [], "c", "h"), (None, [0.1] * 64, "c", "h"), rows[0], rows[0]]
    rows += [(n + 10 + i, [0.25] * 64, "c", "h") for i in range(100)]
    return rows


def found(spark, rows, parts=3):
    out = clustering.clusters(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("n, spread", [(400, 0.3), (60, 0.01), (3, 0.1), (700, 0.1), (500, 0.03)])
def test_against_brute_force(spark, n, spread):
    rows = rows_(n, n, spread)
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [(i % 2) / 4] * 64, "c", "h") for i in range(50)]
    assert found(spark, rows) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5] * 64, "c", "h"), (2, [-0.5] * 64, "c", "h"), (3, [3e38] * 64, "c", "h")]
    got = found(spark, rows)
    assert [r[:3] for r in got] == [(1, got[0][1], 0), (2, got[1][1], 0), (3, got[2][1], 0)]
    assert found(spark, [(1, None, None, None)], 1) == []
    assert clustering.clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cover_tree_holds_its_invariants():
    rnd = np.random.default_rng(3)
    points = np.concatenate([rnd.integers(-50, 50, (300, 6)), np.full((40, 6), 7)])
    tree = CoverTree.over(points, 4)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    own = points[tree.order]
    for i in range(len(tree.start)):
        span = own[tree.start[i] : tree.end[i]]
        centre = own[tree.centre[i]]
        assert np.sqrt(((span - centre) ** 2).sum(1).max()) <= tree.radius[i] + 1e-9
        kids = range(tree.first[i], tree.first[i] + tree.many[i]) if tree.first[i] != i else ()
        if kids:
            assert tree.start[kids[0]] == tree.start[i] and tree.end[kids[-1]] == tree.end[i] and tree.centre[kids[0]] == tree.centre[i]
            centres = own[tree.centre[list(kids)]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + 1e9 * np.eye(len(centres))
            assert apart.min() > tree.radius[i] / clustering.BASE - 1e-6 and all(tree.radius[k] <= tree.radius[i] / clustering.BASE + 1e-6 for k in kids)


def test_walk_prunes_and_gives_every_vector_one_centroid():
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-1000, 1000, (12, 8))
    points = centres[rnd.integers(0, 12, 900)] + rnd.integers(-20, 20, (900, 8))
    tree, ctree = CoverTree.unpacked(CoverTree.over(points, clustering.LEAF).packed()), CoverTree.over(centres, 1)
    tree.order = CoverTree.over(points, clustering.LEAF).order
    own = points[tree.order]
    (nodes, number), (place, single, square) = dual_walk(tree, own, ctree, centres)
    got = np.full(900, -1)
    for i, c in zip(nodes, number):
        assert (got[tree.start[i] : tree.end[i]] == -1).all()
        got[tree.start[i] : tree.end[i]] = c
    got[place] = single
    want = ((own[:, None] - centres[None]) ** 2).sum(2)
    assert (got == want.argmin(1)).all() and (square == want.min(1)[place]).all()
    assert len(nodes) < 100 and len(place) < 100


def test_long_vectors_and_other_dimensions(spark):
    frame = spark.createDataFrame([(i, [float(i % 7)] * 5000, "c", "h") for i in range(40)], SCHEMA)
    out = clustering.clusters(frame, k=7, dimension=5000).groupBy("distance").agg(F.count("*")).collect()
    assert sum(r[1] for r in out) == 40
