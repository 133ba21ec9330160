import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import vectorcodes
from tessella.llm.vectorcodes import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ERROR string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry in Python integers."""
    vs = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) == 64]
    w = 64 // parts
    first = sorted(vs, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    errors, codes, books = defaultdict(int), defaultdict(str), []
    for p in range(parts):
        own = [v[p * w : (p + 1) * w] for _, v, _ in vs]
        book = [v[p * w : (p + 1) * w] for _, v, _ in first]
        for turn in range(rounds + 1):
            to = [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(book)) for x in own]
            if turn < rounds:
                for n in range(len(book)):
                    mine = [x for x, (_, m) in zip(own, to) if m == n]
                    if mine:
                        book[n] = [sum(x) // len(mine) for x in zip(*mine)]
        books += [x for c in book for x in c]
        for j, (d, n) in enumerate(to):
            errors[j] += d
            codes[j] += f"{n:02x}"
    of = defaultdict(int)
    for j, (_, _, label) in enumerate(vs):
        of[label] += errors[j]
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, codes[j], errors[j], of[label], sha) for j, (i, _, label) in enumerate(vs)), key=str)


def rows_(n, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(64)], rnd.choice([1, 2, None]), "c", "e") for i in range(n)]
    rows += [(n, None, 1, None, None), (n + 1, [math.nan] + [0.0] * 63, 1, "c", "e"), (n + 2, [-math.inf] + [0.0] * 63, 1, "c", "e"), (n + 3, [None] * 64, 1, "c", "e")]
    rows += [(n + 4, [], 1, "c", "e"), (n + 5, [0.5] * 12, 1, "c", "e"), (None, [0.1] * 64, None, "c", "e"), rows[0], rows[0]]
    rows += [(n + 10 + i, [0.25] * 64, 7, "c", "e") for i in range(60)]
    return rows


def found(spark, rows, parts=3):
    out = vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("n", [300, 5])
def test_against_brute_force(spark, n):
    rows = rows_(n, n)
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert [r[1:4] for r in found(spark, [(1, [3e38] * 64, 1, "c", "e"), (2, [-3e38] * 64, None, "c", "e")])] == [("00" * 8, 0, 0), ("01" * 8, 0, 0)]
    assert found(spark, [(1, None, 1, None, None)], 1) == []
    assert vectorcodes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size, step", [(3, 1), (4000, 1), (1 << 27, 1), (1 << 27, 1 << 20), (1 << 24, 7)])
def test_screening_never_loses_the_nearest(size, step):
    """Entries a few units apart around large values: float32 alone cannot order them."""
    rnd = np.random.default_rng(size)
    base = rnd.integers(-size, size + 1, 8)
    book = np.clip(base + step * rnd.integers(-3, 4, (16, 8)), -(1 << 27), 1 << 27)
    parts = np.clip(base + step * rnd.integers(-4, 5, (500, 8)), -(1 << 27), 1 << 27)
    square = ((parts[:, None] - book[None]) ** 2).sum(2)
    code, error = nearest(parts, book)
    assert (code == square.argmin(1)).all() and (error == square.min(1)).all()


def test_equal_entries_go_to_the_lower_index():
    book = np.array([[5, 5], [1, 1], [5, 5], [1, 1]])
    assert nearest(np.array([[5, 5], [1, 1], [3, 3]]), book)[0].tolist() == [0, 1, 0]
