import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessella.llm import katz

SCHEMA = "doc_id long, text string, score string"


def tokens_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), "\n"]


class Brute:
    """The model as its formulas state it, over dictionaries."""

    def __init__(self, texts):
        self.c1, self.c2, self.ch = Counter(), Counter(), Counter()
        for t in texts:
            for h, w in zip(["\n\n", *t], t):
                self.c1[w] += 1
                self.c2[h, w] += 1
                self.ch[h] += 1
        self.n = sum(self.c1.values())
        of = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, 7)]
        self.e, self.d = katz.discounts(of(self.c1)), katz.discounts(of(self.c2))
        left = sum(c * (1 - self.e[c - 1]) for c in self.c1.values() if c <= 5)
        self.n1 = self.n if left > 0 else self.n + 1
        self.rest = (left if left > 0 else 1) / self.n1
        self.after = defaultdict(list)
        for (h, w), c in self.c2.items():
            self.after[h].append((w, c))

    def kept(self, c):
        return self.d[c - 1] * c if c <= 5 else c - katz.EPSILON

    def p1(self, w):
        c = self.c1[w]
        return (self.e[c - 1] * c if c <= 5 else c) / self.n1 if c else self.rest

    def p(self, w, h):
        if (h, w) in self.c2:
            return self.kept(self.c2[h, w]) / self.ch[h]
        if not self.ch[h]:
            return self.p1(w)
        left = 1 - sum(self.kept(c) for _, c in self.after[h]) / self.ch[h]
        return left * self.p1(w) / (1 - sum(self.p1(x) for x, _ in self.after[h]))


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["the"] * 40
    out = [(i, " ".join(rnd.choice(words) if rnd.random() < 0.95 else f"rare{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 40))), "x") for i in range(n)]
    return out + [(n, None, "x"), (None, "the w1", "x"), (3, out[3][1], "x"), (n + 1, "the " * 30_000, "x")]


@pytest.mark.parametrize("n", [4, 400])
def test_scores_match_the_formulas(spark, n):
    rows = texts(n, n)
    crc = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 7 == 2
    split = [(d, tokens_of(t), crc(d)) for d, t, _ in rows]
    model = Brute([t for _, t, held in split if not held])
    distinct = len(model.c1)
    want = []
    for d, t, held in split:
        score = sum(math.log10(model.p(w, h)) for h, w in zip(["\n\n", *t], t))
        base = sum(math.log10((model.c1[w] + 1) / (model.n + distinct + 1)) for w in t)
        want.append((d if d is not None else -1, held, len(t), sum(1 for w in t if model.c1[w]), model.n, base, score))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r[0] if r[0] is not None else -1, *r[1:]) for r in katz.scored(frame, chunk_tokens=500, bucket_bytes=2000).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-5)
    for h in [*list(model.ch)[:20], "never"]:
        vocabulary = list(model.c1)
        assert sum(model.p(w, h) for w in vocabulary) + model.p("<unseen>", h) == pytest.approx(1)


def test_empty_table_and_no_training_texts(spark):
    assert katz.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if katz.held_out(i))
    row = katz.scored(spark.createDataFrame([(held, "a b", "x")], SCHEMA)).first()
    assert row["held_out"] and row["n_tokens"] == 3 and row["train_tokens"] == 0 and row["n_known"] == 0
