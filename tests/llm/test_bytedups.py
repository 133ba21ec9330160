import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import bytedups
from tessella.llm.suffixes import suffix_order

SCHEMA = "doc_id long, text string, kept string"


def brute(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("budget", [30, 1 << 20])
def test_suffix_order_and_common_prefixes(budget):
    rnd = random.Random(budget)
    for t in range(150):
        strings = [bytes(rnd.choice(b"ab" if t % 2 else b"abcd") for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(1, 6))]
        strings += strings[: t % 3]
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        cap = rnd.choice([3, 200])
        places, common = suffix_order(text, cap, budget)
        assert sorted(places.tolist()) == list(range(len(text)))
        order = [bytes(text[i:]).split(b"\0")[0] for i in places.tolist()]
        assert order == sorted(order)
        for a, b, n in zip(order, order[1:], common[1:].tolist()):
            assert n == min(cap, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@pytest.mark.parametrize("width", [8, 200])
def test_bytes_match_brute_force(spark, width):
    rnd = random.Random(width)
    letters = "abé" if width == 8 else "abcdefgh é\n"
    own = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [own(rnd.randint(0, 40 if width == 8 else 900)) for _ in range(40)]
    passage = own(width + 60)
    for i in range(0, 40, 3):
        at = rnd.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + passage[: width + rnd.randint(-2, 60)] + texts[i][at:]
    texts += ["", None, texts[0], texts[0], "a" * 2000, "\0" * (width + 1), "x" * (width - 1)]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bytedups.deduplicated(frame, width, chunk_bytes=3000, bucket_bytes=4000, shard_bytes=1000, memory=1000).collect()
    want = sorted((-1 if d is None else d, *x) for (d, _, _), x in zip(rows, brute([t for _, t, _ in rows], width)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_empty_table(spark):
    assert bytedups.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    rnd = random.Random(41)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long, "x"), (2, "start " + long[150_000:150_400] + " end", "x"), (3, "z" * 300_000, "x")]
    got = {r["doc_id"]: r for r in bytedups.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["n_bytes"], got[1]["n_removed"], got[1]["n_spans"]) == (400_000, 400, 1)
    assert got[1]["kept_sha256"] == hashlib.sha256((long[:150_000] + long[150_400:]).encode()).hexdigest()
    assert (got[2]["n_removed"], got[2]["kept_sha256"]) == (400, hashlib.sha256(b"start  end").hexdigest())
    assert (got[3]["n_removed"], got[3]["n_spans"]) == (300_000, 1)
