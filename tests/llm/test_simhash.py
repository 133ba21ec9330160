import random
import re

import xxhash

from tessella.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    root = {x: x for x in set(prints)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_fingerprint_matches_definition():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abCé \n\x0b\x1c\x85 ") for _ in range(rnd.randint(0, 60)))
        assert simhash.fingerprint(text) == brute(text)
    assert simhash.fingerprint(None) == 0


def test_report_with_nulls_copies_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, t, "x") for i, t in enumerate([base, base, base + " end", "", None, " \n", "one", "one two", "ONE two", "long " * 50_000])]
    rows += [(3, "", "x"), (None, base, "x")]
    got = simhash.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    prints = {r["doc_id"]: brute(r["text"]) for r in spark.createDataFrame(rows, SCHEMA).collect()}
    roots = brute_components(list(prints.values()))
    least = {}
    for d, f in prints.items():
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == least[roots[prints[r["doc_id"]]]]


def test_links_lose_nothing_when_groups_are_filed_again(spark):
    rnd = random.Random(2)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    prints = set(seeds)
    for s in seeds[:3]:
        for _ in range(150):
            prints.add(s ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [simhash._signed(x) for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(frame, group_limit=8)
    from tessella.llm.components import components

    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components(signed)
    groups, expected = {}, {}
    for x in signed:
        groups.setdefault(got.get(x, x), set()).add(x)
        expected.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_forest_spans_like_brute_force():
    import numpy as np

    rnd = random.Random(3)
    fps = sorted({rnd.getrandbits(8) for _ in range(60)})
    for given in (fps, np.array(fps, np.int64)):
        edges = simhash.forest(given, 1)
        assert len(edges) == len(fps) - len({x for x in brute_components(fps, 1).values()})


def test_deduplicated_keeps_one_of_each_and_all_columns(spark):
    rows = [(5, "a b c d e", "p"), (2, "a b c d e", "q"), (2, "a b c d e", "q"), (9, "quite another text here now", "r"), (None, None, None)]
    out = simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["fp"]) for r in out if r["doc_id"]) == [(2, "q"), (9, "r")]
    assert len(out) == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.report(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


def test_the_stage_keeps_one_of_similar_texts_and_both_of_unlike_ones(spark):
    rnd = random.Random(31)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows, pairs = [], []
    for k in range(60):
        base = [word() for _ in range(400)]
        close = list(base)
        close[200] = "changed"
        far = base[:40] + [word() for _ in range(360)]
        rows += [(3 * k, " ".join(base), "x"), (3 * k + 1, " ".join(close), "x"), (3 * k + 2, " ".join(far), "x")]
        pairs.append((3 * k, 3 * k + 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    kept = {r["doc_id"] for r in simhash.deduplicated(frame, distance=5, blocks=9).collect()}
    assert all(a in kept for a, _ in pairs) and all(i in kept for i in range(2, 180, 3))
    assert sum(b in kept for _, b in pairs) <= 6  # one change in 400 words is within five bits nearly always
    # the same edges, judged on the shingles themselves
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    texts = spark.createDataFrame([(1, rows[0][1]), (2, rows[1][1]), (3, rows[2][1])], "fp long, text string")
    assert [tuple(r) for r in simhash.verified(edges, texts).collect()] == [(1, 2)]


def rejected_in_the_middle():
    """Fingerprints 0, 1, 2: the text of 0 is unlike those of 1 and 2, which are alike."""
    rnd = random.Random(32)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    close = [*base[:200], "changed", *base[201:]]
    other = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    return [(10, 0, " ".join(other)), (11, 1, " ".join(base)), (12, 2, " ".join(close))]


def pairs_alike(rows, distance, similarity):
    out = []
    for x in rows:
        for y in rows:
            if x[0] < y[0] and ((x[1] ^ y[1]) & (1 << 64) - 1).bit_count() <= distance:
                a, b = (set(simhash.shingle_set(t[2]).tolist()) for t in (x, y))
                if len(a & b) >= similarity * len(a | b):
                    out.append((x[0], y[0]))
    return out


def roots_of(nodes, pairs):
    at = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_links_are_judged_before_they_connect(spark):
    """Against all pairs, on groups of close fingerprints whose texts fall into unlike families."""
    rnd = random.Random(33)
    rows, number = [], 100
    for _ in range(12):
        seed = simhash._signed(rnd.getrandbits(64))
        families = [[f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(3, 14)):
            text = list(rnd.choice(families))
            text[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
            rows.append((number, simhash._signed((seed ^ (1 << rnd.randrange(3)) ^ (1 << rnd.randrange(8))) & (1 << 64) - 1), " ".join(text)))
            number += 1
    for given, limit in ((rejected_in_the_middle(), 1024), (rows, 1024), (rows, 4)):
        nodes = spark.createDataFrame([r[:2] for r in given], "node long, fp long")
        texts = spark.createDataFrame([(n, t) for n, _, t in given], "fp long, text string")
        edges = [tuple(r) for r in simhash.similar(nodes, texts, 3, 6, 0.8, limit).collect()]
        want = pairs_alike(given, 3, 0.8)
        assert {tuple(sorted(e)) for e in edges} <= set(want) and want
        ids = [r[0] for r in given]
        assert roots_of(ids, edges) == roots_of(ids, want)


def test_equal_prints_of_unlike_texts_are_kept_apart(spark):
    rnd = random.Random(34)
    make = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    a, b = make(), make()
    rows = [(i, 7, " ".join([*x, f"t{i}"])) for i, x in enumerate([a, b, a, b, make()])]
    nodes = spark.createDataFrame([r[:2] for r in rows], "node long, fp long")
    texts = spark.createDataFrame([(n, t) for n, _, t in rows], "fp long, text string")
    assert sorted(tuple(r) for r in simhash.of_equal_prints(nodes, texts, 0.8).collect()) == [(0, 2), (1, 3)]
