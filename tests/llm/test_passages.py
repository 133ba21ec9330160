import random

import numpy as np

from tessella.llm import passages

SCHEMA = "doc_id long, text string, spans string"


def words(rnd, n, pool=5000):
    return [f"w{rnd.randrange(pool)}" for _ in range(n)]


def test_compact_windows_match_brute_force():
    rnd = random.Random(1)
    tied = passages.compact_windows(np.zeros(30_000, np.uint64), np.array([0]), np.array([30_000]), 46)
    assert len(tied[0]) < 3000
    for _ in range(60):
        values = np.array([rnd.randrange(1 << 40) << 24 for _ in range(rnd.randint(0, 60))], np.uint64)
        cut = rnd.randint(0, len(values))
        starts, ends = np.array([0, cut]), np.array([cut, len(values)])
        got = set(zip(*(x.tolist() for x in passages.compact_windows(values, starts, ends, 4))))
        want = set()
        for lo, hi in ((0, cut), (cut, len(values))):
            for p in range(lo, hi):
                a, b = p, p + 1
                while a > lo and values[a - 1] > values[p]:
                    a -= 1
                while b < hi and values[b] >= values[p]:
                    b += 1
                if b - a >= 4:
                    want.add((a, p, b))
        assert got == want


def test_planted_passages_are_found_whole_and_clean_texts_left(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    shared = [words(rnd, n) for n in (50, 60, 90, 120)]
    near = [*shared[3][:60], "changed", *shared[3][61:]]
    for i in range(60):
        own = words(rnd, rnd.randint(60, 200))
        passage = shared[i % 4] if i % 3 == 0 else near if i % 3 == 1 and i < 30 else None
        if passage:
            at = rnd.randint(0, len(own))
            own = own[:at] + passage + own[at:]
            want[i] = (at, at + len(passage), i % 4 if i % 3 == 0 else 3)
        rows.append((i, " ".join(own), "x"))
    rows += [(100, "", "x"), (101, None, "x"), (104, "two words", "x"), (None, " ".join(shared[0]), "x"), (102, "same " * 30_000, "x"), (5, rows[5][1], "x"), (103, rows[5][1], "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = passages.report(frame, chunk_words=2000, bucket_bytes=5000).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    firsts = {}
    for i, (a, b, k) in want.items():
        firsts.setdefault(k, set()).add(by[i]["class_id"])
        if by[i]["begins"]:
            assert min(by[i]["begins"]) <= a + 1 and max(by[i]["ends"]) >= b - 1
            assert by[i]["n_repeated_words"] <= b - a + 2
    assert all(len(x) == 1 for x in firsts.values())
    for k in range(4):
        own = [i for i, w in want.items() if w[2] == k]
        assert sum(1 for i in own if not by[i]["begins"]) <= 1
    assert by[103]["class_id"] == by[5]["class_id"] == 5
    for i in set(range(60)) - set(want) - {5}:
        assert by[i]["n_links"] == 0 and by[i]["class_id"] == i and not by[i]["begins"]
    out = passages.cleaned(frame, chunk_words=2000, bucket_bytes=5000)
    assert out.columns == frame.columns and out.count() == len(rows)
    kept = " ".join(r["text"] or "" for r in out.collect())
    assert kept.count(" ".join(shared[1])) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert passages.report(empty).count() == 0
    assert passages.cleaned(empty).count() == 0


def quoted(rnd, pairs, quotes):
    """Pairs of texts with one changed word in a passage of 60, each among documents that quote only the passage's first or last 29 words."""
    rows = []
    for k in range(pairs):
        base = words(rnd, 60, 1 << 40)
        other = [*base[:30], "changed", *base[31:]]
        for i, part in enumerate([base, other, *[base[:29], base[31:]] * quotes]):
            own = words(rnd, 80, 1 << 40)
            rows.append((100 * k + i, " ".join(own[:40] + part + own[40:]), "x"))
    return rows


def test_near_copies_meet_beside_many_documents_that_quote_a_part_of_them(spark):
    rows = quoted(random.Random(3), 8, 10)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for crowd in (passages.CROWD, 3):
        by = {r["doc_id"]: r for r in passages.report(frame, chunk_words=2000, bucket_bytes=5000, crowd=crowd).collect()}
        for k in range(8):
            assert by[100 * k + 1]["class_id"] == 100 * k and sorted(x for i in (0, 1) for x in by[100 * k + i]["repeats_of"]) in ([100 * k], [100 * k + 1])
            assert all(by[100 * k + i]["n_links"] == 0 for i in range(2, 22))


def test_a_second_place_of_a_shared_phrase_in_the_first_document_is_not_lost():
    def entries(*rows):
        return [np.array(x, k) for x, k in zip(zip(*rows), (np.uint64, np.int64, np.uint8, np.uint32, np.uint32, np.uint32, np.uint32))]

    # document 1 has the key twice; document 2 shares all around the second place
    made = list(passages._paired(entries((9, 1, 0, 50, 0, 100, 7), (9, 1, 0, 300, 200, 400, 8), (9, 2, 0, 60, 0, 120, 9)), 46, 1, 0, 128))
    _, d, c, _, shift, _, _ = passages.LINKS.gather([r["data"] for r in made if r["kind"] == "links"])
    assert set(zip(d.tolist(), c.tolist(), shift.tolist())) == {(2, 1, 10), (2, 1, -240)}
    owner, a, b = passages.SPOTS.gather([r["data"] for r in made if r["kind"] == "spots"])
    assert set(zip(owner.tolist(), a.tolist(), b.tolist())) == {(1, 5, 96), (1, 255, 346), (2, 15, 106)}


def test_a_crowd_pairs_all_that_are_similar_in_reach(spark):
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    common = rnd.integers(0, 1 << 32, 60, np.uint32)
    rows, want = [], set()
    for i in range(60):
        own = rnd.integers(0, 1 << 32, 112, np.uint32)
        own[30:60] = common[:30]
        if i % 10 == 1:
            own[60:90] = rows[-1]["near"][60:90]
            want.add((i, i - 1))
        rows.append({"key": 1, "doc": i, "f": 0, "p": 56, "a": 0, "b": 112, "near": own})
    table = pa.Table.from_pylist([r | {"near": r["near"].tobytes()} for r in rows])
    links = passages._crowd(table, 8).column("data").to_pylist()
    _, d, c, *_ = passages.LINKS.gather(links)
    got = set(zip(d.tolist(), c.tolist()))
    assert want <= got and len(got) < 60 + len(want)


def test_equal_passages_of_recurring_shingles_meet(spark):
    """Passages over two words: the smallest shingle recurs, in other contexts each time. One function must do."""
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        passage = [f"p{k}x{rnd.randrange(2)}" for _ in range(50)]
        rows += [(10 * k + i, " ".join(words(rnd, rnd.randint(20, 90), 1 << 40) + passage + words(rnd, 30, 1 << 40)), "x") for i in range(2)]
    got = passages.report(spark.createDataFrame(rows, SCHEMA).repartition(3), functions=1, chunk_words=2000, bucket_bytes=5000).collect()
    assert [r["doc_id"] for r in got if r["class_id"] % 10] == []
    assert sum(r["n_repeated_words"] >= 50 for r in got) == 60


def test_all_places_of_a_passage_in_a_later_document_repeat_an_earlier_one(spark):
    """The later document holds the passage twice in equal surroundings, in a chunk of its own."""
    rnd = random.Random(6)
    rows = []
    for k in range(12):
        passage = words(rnd, 60, 1 << 40)
        block = words(rnd, 80, 1 << 40) + passage + words(rnd, 80, 1 << 40)
        rows.append((10 * k, " ".join(words(rnd, 40, 1 << 40) + passage + words(rnd, 40, 1 << 40)), "x"))
        rows.append((10 * k + 1, " ".join(block + words(rnd, 70, 1 << 40) + block), "x"))
    got = {r["doc_id"]: r for r in passages.report(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_words=50).collect()}
    twice = [got[10 * k + 1] for k in range(12) if got[10 * k + 1]["repeats_of"] == [10 * k]]
    assert twice and all(r["n_repeated_words"] >= 120 for r in twice)


def test_all_places_of_a_near_copy_in_a_later_document_repeat_an_earlier_one(spark):
    """The later document alone holds the near-copy twice in equal surroundings; also where windows under a key are a crowd."""
    rnd = random.Random(16)
    rows = []
    for k in range(24):
        passage = words(rnd, 60, 1 << 40)
        block = words(rnd, 80, 1 << 40) + [*passage[:30], f"x{k}", *passage[31:]] + words(rnd, 80, 1 << 40)
        rows.append((10 * k, " ".join(words(rnd, 40, 1 << 40) + passage + words(rnd, 40, 1 << 40)), "x"))
        rows.append((10 * k + 1, " ".join(block + words(rnd, 70, 1 << 40) + block), "x"))
    for crowd in (passages.CROWD, 1):
        got = {r["doc_id"]: r for r in passages.report(spark.createDataFrame(rows, SCHEMA).repartition(3), crowd=crowd).collect()}
        later = [got[10 * k + 1] for k in range(24) if got[10 * k + 1]["repeats_of"] == [10 * k]]
        assert len(later) > 5 and all(r["n_repeated_words"] >= 100 and len(r["begins"]) == 2 for r in later)


def test_tied_windows_like_brute_force():
    rnd = random.Random(7)
    for _ in range(60):
        values = np.array([rnd.randrange(5) << 40 for _ in range(rnd.randint(0, 60))], np.uint64)
        cut = rnd.randint(0, len(values))
        want = {}
        for lo, hi in ((0, cut), (cut, len(values))):
            for i in range(lo, hi - 5):
                run = values[i : i + 6].tolist()
                if run.count(min(run)) > 1:
                    p = i + 5 - run[::-1].index(min(run))
                    a, b = want.get(p, (i, i))
                    want[p] = a, i + 6
        got = {p: (a, b) for a, p, b in zip(*(x.tolist() for x in passages.tied_windows(values, np.array([cut, len(values)]), 6)))}
        assert got == want


def test_parts_find_what_one_part_finds(spark, monkeypatch):
    rows = quoted(random.Random(8), 6, 3)
    rows += rows[:2]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = []
    for pairs in (passages.PART_PAIRS, 1):
        monkeypatch.setattr(passages, "PART_PAIRS", pairs)
        found.append({tuple(r) for r in passages.repeats(frame, chunk_words=2000, bucket_bytes=5000)[0].collect()})
    assert found[0] == found[1] and len({(d, c) for d, c, _, _ in found[0]}) == 6


def test_runs_are_moved_once_for_a_cell(spark, monkeypatch):
    rows = [(d, c, 0, 64, 0, 64) for d in range(60) for c in range(d)] + [(1000 + d, 2000 + d, 0, 64, 0, 64) for d in range(60)]
    pairs = spark.createDataFrame(rows, "d long, c long, a long, b long, ca long, cb long")
    for most, moved in ((1 << 12, 180), (1 << 8, 600)):
        monkeypatch.setattr(passages, "PART_PAIRS", most)
        dealt = passages.celled(pairs)
        assert sorted(map(tuple, dealt.drop("cell").collect())) == sorted(rows)
        assert passages.needed(dealt).count() <= moved


def test_runs_that_share_too_few_different_shingles_are_not_aligned(monkeypatch):
    def never(*_):
        raise AssertionError

    mine, theirs = ["a"] * 19 + ["c"] * 49 + ["d"] * 30, ["e"] * 27 + ["c"] * 49 + ["f"] * 30
    monkeypatch.setattr(passages, "_aligned", never)
    assert passages.verify(mine, theirs, 50, 0.8) == []
    monkeypatch.undo()
    assert passages.verify([*mine[:68], "c", *mine[68:]], [*theirs[:76], "c", *theirs[76:]], 50, 0.8) == [(19, 69)]
