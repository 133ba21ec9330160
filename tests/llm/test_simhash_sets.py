import random

from tessella.llm import simhash


def test_texts_move_once_however_many_rounds_the_pairs_take(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(1 << 30)}" for _ in range(3000)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(40)]
    rows += [(100 + i, " ".join(f"w{rnd.randrange(1 << 30)}" for _ in range(80))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = []
    plain = simhash.shingle_sets

    def counted(texts, nodes):
        cut.append(plain(texts, nodes))
        return cut[-1]

    monkeypatch.setattr(simhash, "shingle_sets", counted)
    monkeypatch.setattr(simhash, "release", lambda *tables: None)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(frame).collect()) == [0, *range(100, 120)]
    # for equal fingerprints and for close ones; texts without a close one are not cut
    assert len(cut) == 2 and all(t.count() <= 40 for t in cut)
