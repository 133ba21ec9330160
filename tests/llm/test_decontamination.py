import hashlib
import random

import pytest

from tessella.llm import decontamination as dec

SCHEMA = "doc_id long, text string, n_chars long, hit string"


def brute(text, items, window):
    words = dec.words_of(text)
    hit, ids = set(), set()
    for item_id, t in items:
        own = dec.words_of(t)
        k = min(window, len(own))
        for i in range(len(own) - k + 1) if own else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[i : i + k]:
                    hit |= set(range(p, p + k))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), hit, ids


def test_automaton_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(800):
        window, letters = rnd.choice([3, 4]), "abcde"[: rnd.choice([2, 3, 5])]
        make = lambda n: " ".join(rnd.choice(letters) for _ in range(n))
        items = [(i, make(rnd.randint(0, 8))) for i in range(rnd.randint(0, 5))]
        text = make(rnd.randint(0, 25))
        automaton = dec.Automaton(items, window)
        spans, found = automaton.match(dec.words_of(text))
        n, hit, ids = brute(text, items, window)
        assert {x for a, b in spans for x in range(a, b)} == hit and {automaton.ids[i] for i in found} == ids
        assert spans == dec.merged(spans)


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_report_and_cleaning(spark, block_words):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(400)}é"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([25, 12, 10, 4, 0, 30])] + [(6, None), (7, "W1É, w2é"), (None, "unique phrase here")]
    docs = []
    for i in range(40):
        text = " ".join(word() for _ in range(60))
        if i % 3 == 0:
            text = f"{text}. {items[i % 6][1].title()}!\n{text}"
        docs.append((i, text, len(text), "x"))
    docs += [(100, items[0][1], 1, "x"), (101, "", 0, "x"), (102, None, None, "x"), (None, "a UNIQUE phrase-here b c d e f g h", 1, "x"), docs[0]]
    frame = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dec.hits(frame, bench, block_words=block_words)
    name = found.columns[-1]
    got = {r["doc_id"]: r[name] for r in found.collect()}
    for d, t, *_ in docs:
        n, hit, ids = brute(t, items, 10)
        assert got[d]["n_words"] == n
        assert {x for a, b in zip(got[d]["begins"], got[d]["ends"]) for x in range(a, b)} == hit
        assert got[d]["items"] == sorted(ids)
    rows = {r["doc_id"]: r for r in dec.report(frame, bench).collect()}
    for d, t, *_ in docs:
        n, hit, ids = brute(t, items, 10)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (rows[d]["n_words"], rows[d]["n_hit"], rows[d]["n_items"], rows[d]["items_sha256"], rows[d]["contaminated"]) == (n, len(hit), len(ids), digest, bool(hit))
    out = dec.cleaned(frame, bench)
    assert out.columns == frame.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    assert 100 not in kept and {101, 102, None} <= set(kept)
    for d, t, *_ in docs:
        if d in kept and t:
            _, hit, _ = brute(t, items, 10)
            words = dec.words_of(t)
            assert dec.words_of(kept[d]["text"]) == [w for i, w in enumerate(words) if i not in hit]
            assert kept[d]["text"] == t if not hit else kept[d]["n_chars"] == len(kept[d]["text"])


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dec.report(spark.createDataFrame([], SCHEMA), bench).count() == 0
    row = dec.report(spark.createDataFrame([(1, "a b", 3, "x")], SCHEMA), bench).first()
    assert row["n_words"] == 2 and not row["contaminated"]
    assert dec.cleaned(spark.createDataFrame([(1, "a b", 3, "x")], SCHEMA), bench).count() == 1


def test_a_very_long_text_and_item(spark):
    rnd = random.Random(42)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(200_000)]
    item = " ".join(words[120_000:120_012])
    docs = spark.createDataFrame([(1, " ".join(words), 0, "x"), (2, "none of it", 0, "x")], SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, " ".join(words[:60_000])), (3, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in dec.report(docs, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (200_000, 60_012, 2)
    assert got[2]["n_hit"] == 0
