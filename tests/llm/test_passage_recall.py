import random

from tessella.llm import passages


def words(rnd, n, pool=100_000):
    return [f"w{rnd.randrange(pool)}" for _ in range(n)]


def grams(run):
    return {tuple(run[i : i + 5]) for i in range(len(run) - 4)}


def brute(mine, theirs, width, most):
    """Places of ``mine`` under the shared shingles of some passage of ``width`` to ``most`` words with a near-duplicate in ``theirs``."""
    hit, shared = set(), grams(theirs)
    right = [grams(theirs[c : c + m]) for m in range(width, min(most, len(theirs)) + 1) for c in range(len(theirs) - m + 1)]
    for n in range(width, min(most, len(mine)) + 1):
        for a in range(len(mine) - n + 1):
            left = grams(mine[a : a + n])
            if any(len(left & r) * 10 >= 8 * len(left | r) for r in right):
                hit |= {i + k for i in range(a, a + n - 4) if tuple(mine[i : i + 5]) in shared for k in range(5)}
    return hit


def covered(found):
    return {i for a, b in found for i in range(a, b)}


def change(text, every, start):
    return [f"x{i}" if i % every == start else w for i, w in enumerate(text)]


def test_verify_covers_what_brute_force_over_all_passage_pairs_finds():
    rnd = random.Random(11)
    for _ in range(40):
        base = words(rnd, rnd.randint(22, 34))
        other = list(base)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(other))
            kind = rnd.randrange(3)
            if kind == 0:
                other[at] = "changed"
            elif kind == 1:
                other[at:at] = words(rnd, rnd.randint(1, 3))
            else:
                other[at : at + 1] = []
        mine = words(rnd, rnd.randint(0, 8)) + base + words(rnd, rnd.randint(0, 8))
        theirs = words(rnd, rnd.randint(0, 8)) + other + words(rnd, rnd.randint(0, 8))
        want = brute(mine, theirs, 20, 44)
        assert want <= covered(passages.verify(mine, theirs, 20, 0.8))


def test_verify_finds_passages_in_edited_runs_over_insertions_and_with_recurring_phrases():
    rnd = random.Random(12)
    base = words(rnd, 120)
    edited = [*base[:30], "changed", *base[31:60], *change(base[60:], 8, 3)]
    assert set(range(60)) <= covered(passages.verify(edited, base, 50, 0.8))
    half = words(rnd, 80)
    assert covered(passages.verify([*half[:40], *words(rnd, 7), *half[40:]], half, 50, 0.8)) == set(range(87))
    one = [*half[:25], "changed", *half[26:60]]
    assert set(range(60)) <= covered(passages.verify(one, [*half[:60], *words(rnd, 200), *half[3:8]], 50, 0.8))
    assert passages.verify(words(rnd, 90), words(rnd, 90), 50, 0.8) == []


def test_equal_passages_meet_whichever_document_is_the_centre(spark):
    rnd = random.Random(13)
    rows, groups = [], []
    for g in range(25):
        passage = words(rnd, 50)
        texts = [words(rnd, 40) + passage[:44] + words(rnd, 40) for _ in range(3)] + [words(rnd, 60) + passage + words(rnd, 60) for _ in range(2)]
        groups.append([10 * g + 3, 10 * g + 4])
        rows += [(10 * g + i, " ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = {r["doc_id"]: r for r in passages.report(frame, chunk_words=3000, bucket_bytes=20_000).collect()}
    assert all(by[b]["class_id"] == a and by[a]["class_id"] == a for a, b in groups)
    assert all(sum(by[i]["n_repeated_words"] for i in group) >= 50 for group in groups)
    assert all(by[i]["n_links"] == 0 for i in by if i % 10 < 3)


def test_a_centre_is_asked_for_each_run_once(spark):
    rnd = random.Random(14)
    rows = [(d, 0, x := rnd.randint(0, 90), x + 60, y := rnd.randint(40, 60), y + rnd.randint(46, 70)) for d in range(1, 500)]
    pairs = passages.on_grid(spark.createDataFrame(rows, "d long, c long, a long, b long, ca long, cb long"))
    assert pairs.count() == len(rows)
    for r, (d, _, a, b, ca, cb) in zip(pairs.sort("d").collect(), rows):
        assert r["d"] == d and r["a"] <= a and r["b"] >= b + 4 and r["ca"] <= ca and r["cb"] >= cb + 4
    asked = {r["doc"]: r["asked"] for r in passages.asked_runs(pairs).collect()}
    assert len(asked) == 500 and len(asked[0]) <= 4


def near_pairs(count):
    """Rows 2k, 2k + 1: unrelated texts around a passage of 50 to 60 words and its copy with one word changed."""
    rnd = random.Random(15)
    rows, edges = [], []
    for k in range(count):
        a = words(rnd, rnd.randint(50, 60))
        b = list(a)
        b[rnd.randrange(5, len(a) - 5)] = "changed"
        left, right = grams(a), grams(b)
        assert 0.8 <= len(left & right) / len(left | right) < 0.95
        rows += [(2 * k, " ".join(words(rnd, 60) + a + words(rnd, 60))), (2 * k + 1, " ".join(words(rnd, 60) + b + words(rnd, 60)))]
        edges.append(2 * k)
    return rows, edges


def recall(spark, count, **options):
    rows, edges = near_pairs(count)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["class_id"] for r in passages.report(frame, **options).collect()}
    return sum(found[e + 1] == found[e] for e in edges) / len(edges)


def test_near_passages_are_recalled(spark):
    assert recall(spark, 1000) >= 0.998


def template(rnd, names, lines):
    return [w for _ in range(lines) for w in f"the price of v{rnd.randrange(names)} is v{rnd.randrange(names)} euros and rising".split()]


def templated_pairs(rnd, names, lines, count):
    """Passages of one repeated template, and copies with two changed words that are still 0.8 similar."""
    while count:
        one = template(rnd, names, lines)
        two = list(one)
        for _ in range(2):
            two[rnd.randrange(len(two))] = f"changed{rnd.randrange(9)}"
        left, right = grams(one), grams(two)
        if one != two and len(left & right) >= 0.8 * len(left | right):
            count -= 1
            yield one, two


def test_passages_of_repeated_lines_are_found_behind_more_such_lines(monkeypatch):
    """Every shingle recurs many times here; aligned whole and in slices."""
    rnd = random.Random(16)
    for limit in (passages.PAIRS, 4000):
        monkeypatch.setattr(passages, "PAIRS", limit)
        for lines in (9, 12):
            for one, two in templated_pairs(rnd, 8, lines, 12):
                before, other = template(rnd, 8, 40), template(rnd, 8, 15)
                hit = covered(passages.verify(before + one, other + two, 50, 0.8)) & set(range(len(before), len(before) + len(one)))
                assert len(hit) >= 50


def test_slices_find_what_the_whole_finds(monkeypatch):
    rnd = random.Random(17)
    base = words(rnd, 900, 300)
    mine, theirs = words(rnd, 200, 300) + base[100:260] + words(rnd, 300, 300) + base[500:570], [*words(rnd, 500, 300), *change(base, 40, 7)]
    whole = covered(passages.verify(mine, theirs, 50, 0.8))
    monkeypatch.setattr(passages, "PAIRS", 10)
    assert len(whole) > 150 and whole <= covered(passages.verify(mine, theirs, 50, 0.8))


def test_equal_windows_like_brute_force():
    import numpy as np

    rnd = random.Random(19)
    for _ in range(50):
        own, theirs = (np.array([rnd.randrange(2) for _ in range(rnd.randint(6, 40))], np.uint64) for _ in range(2))
        runs = {tuple(theirs[c : c + 6]) for c in range(len(theirs) - 5)}
        want = {i for a in range(len(own) - 5) if tuple(own[a : a + 6]) in runs for i in range(a, a + 6)}
        assert covered(passages._equal_windows(own, theirs, 6)) == want


def test_equal_passages_of_repeated_lines_with_quoting_documents(spark):
    """Templated documents: pairs share 60 lines' worth of one passage; other documents quote half of it."""
    rnd = random.Random(18)
    rows, pairs = [], []
    for g in range(8):
        passage = template(rnd, 300, 8)
        texts = [words(rnd, 50) + passage[:40] + words(rnd, 30) for _ in range(3)] + [template(rnd, 300, 6) + passage + words(rnd, 20) for _ in range(2)]
        pairs.append((10 * g + 3, 10 * g + 4))
        rows += [(10 * g + i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in passages.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(found[a]["class_id"] == found[b]["class_id"] for a, b in pairs)
    assert all(found[a]["n_repeated_words"] + found[b]["n_repeated_words"] >= 72 for a, b in pairs)


def test_crowded_like_brute_force():
    import numpy as np

    rnd = random.Random(20)
    for _ in range(60):
        n = rnd.randint(6, 40)
        values = np.array([rnd.randrange(8) for _ in range(n)], np.uint64)
        shared = np.isin(values, [0, 1, 2])
        want = np.zeros(n, bool)
        for x in range(n - 5):
            window = set(values[x : x + 6].tolist())
            if 2 * len(window & {0, 1, 2}) >= len(window):
                want[x : x + 6] = True
        assert (passages._crowded(values, shared, 6) == (want & shared)).all()
