import difflib
import random
import re

from pyspark.sql import functions as F

from tessella.operators import anchors, continuity


def places(text, piece):
    return [i for i in range(len(text) - len(piece) + 1) if piece and text.startswith(piece, i)][:200]


def by_hand(text, exact, prefix, suffix, hint):
    """The rules of the ladder on whole strings."""
    exact = " ".join((exact or "").split())
    if not exact or not text:
        return None
    at = places(text, exact)
    if at:
        def outward(p):
            left, right = text[:p], text[p + len(exact) :]
            n = max(k for k in range(33) if k <= min(len(left), len(prefix)) and left[len(left) - k :] == prefix[len(prefix) - k :])
            return n + max(k for k in range(33) if k <= min(len(right), len(suffix)) and right[:k] == suffix[:k])

        best = max(map(outward, at))
        tied = [p for p in at if outward(p) == best]
        p = tied[0] if hint is None else min(tied, key=lambda x: abs(x - hint))
        return (p, p + len(exact), "context" if best and len(at) > 1 else "exact", 1.0, len(tied) > 1)
    size = min(24, max(12, len(exact) // 3))
    last = max(0, len(exact) - size)
    found = {p + len(prefix[-32:]) for p in places(text, prefix[-32:])} | {max(0, p - len(exact)) for p in places(text, suffix[:32])}
    found |= {max(0, p - k) for k in range(0, last + 1, max(1, last // 5)) for p in places(text, exact[k : k + size])}
    found |= {hint} - {None}
    near = sorted((abs(p - (hint or 0)), p) for p in found if 0 <= p < len(text))[:200]
    slack, best = max(24, len(exact) // 4), None
    for p in sorted(p for _, p in near):
        low = max(0, p - slack)
        part = text[low : p + len(exact) + slack]
        held = [b for b in difflib.SequenceMatcher(None, part, exact).get_matching_blocks() if b.size]
        x, y = (held[0].a, held[-1].a + held[-1].size) if held else (0, len(part))
        ratio = difflib.SequenceMatcher(None, part[x:y], exact).ratio()
        if best is None or ratio > best[0]:
            best = (ratio, low + x, low + y)
    return None if best is None or best[0] < 0.8 else (best[1], best[2], "fuzzy", round(best[0], 4), False)


def test_anchors_like_the_rules_by_hand(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé.$(") for _ in range(rnd.randint(1, 6)))
    rows = []
    for k in range(250):
        words = [word() for _ in range(rnd.randint(5, 120))]
        text = " ".join(words)
        a = rnd.randrange(len(words))
        b = min(len(words), a + rnd.randint(1, 30))
        said = words[a:b]
        if k % 2:
            for _ in range(rnd.randint(1, 2)):
                said[rnd.randrange(len(said))] = word()
        prefix, suffix = " ".join(words[:a])[-40:] + " ", " " + " ".join(words[b:])[:40]
        given = rnd.random() < 0.5
        rows.append((text, rnd.choice([" ", "\n "]).join(said), prefix if given else "", suffix if given else "", rnd.choice([None, 0, 30, 10_000])))
    rows += [("aaaa aaa", "aa", "", "", None), ("aaaa aaa", "aa", "aa a", "", 9), ("", "x", "", "", None), ("x", "", "", "", None), ("a\U0001f600b a\U0001f600b", "\U0001f600b", "", "", 4)]
    frame = spark.createDataFrame(rows, "text string, exact string, prefix string, suffix string, hint int").withColumn("n", F.monotonically_increasing_id())
    got = anchors.reanchored(frame.coalesce(1)).sort("n").collect()
    kinds = set()
    for r in got:
        want = by_hand(r["text"], r["exact"], r["prefix"], r["suffix"], r["hint"])
        assert (None if r["anchor"] is None else tuple(r["anchor"])) == want, r
        kinds.add(want and want[2])
    assert kinds == {None, "exact", "context", "fuzzy"}
    none = spark.createDataFrame([(None, "x", None, None, None), ("x", None, None, None, None)], frame.drop("n").schema)
    assert [r["anchor"] for r in anchors.reanchored(none).collect()] == [None, None]


def test_names_like_a_boundary_pattern(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["ann", "Ann", "ANNA", "ann_", "é", "Éa", "St. John", "john", "st", "_", "x9", "Straße", "strasse", "İ", "ſt", "é"])
    texts = [("p%d" % (i % 7), rnd.choice([" ", ", ", ""]).join(word() for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, ("p1", None), (None, "ann")], "path string, content string").repartition(3)
    names = ["Ann", "anna", "st. john", "John", "é", "éa", "straße", "x9", "ann ann", "St", "john, john"]
    forms = spark.createDataFrame([(n,) for n in [*names, " ", "ann", "Ann"]], "form string")
    want = {}
    spots = set()
    for path, text in [*texts, (None, "ann")]:
        for n in {*names, "ann"}:
            for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.I):
                want[n, path] = want.get((n, path), 0) + 1
                spots.add((n, path, m.start(), text[max(0, m.start() - 40) : m.start()], m.group(), text[m.end() : m.end() + 40]))
    for limit in (continuity.BLOCK_CHARS, 8):
        monkeypatch.setattr(continuity, "BLOCK_CHARS", limit)
        assert {(r["form"], r["path"]): r["n"] for r in continuity.presence(forms, docs).collect()} == want
        assert {tuple(r) for r in continuity.form_places(forms, docs).collect()} == spots
    assert continuity.presence(forms.limit(0), docs).count() == 0 and continuity.presence(forms, docs.limit(0)).count() == 0


def test_evidence_list_counts_documents_per_snapshot(spark):
    chain = [("section", 2)]
    rows = [("a", "e", 1, "d1", chain), ("b", "e", 1, "d3", chain)]
    evidence = spark.createDataFrame(rows, "snapshot string, edge string, stored int, document string, chain array<struct<type:string,index:int>>")
    documents = spark.createDataFrame([("a", "d1", "One"), ("a", "d2", "Two"), ("b", "d3", "Three")], "snapshot string, document string, title string")
    assert sorted((r["snapshot"], r["locator"]) for r in anchors.evidence_list(evidence, documents).collect()) == [("a", "One, section 2"), ("b", "section 2")]


def test_revisions_like_all_pairs_with_fewer_compared(spark):
    rnd = random.Random(9)
    sentence = lambda k: " ".join("".join(rnd.choice("abcdefghijklmnop"[k : k + 6]) for _ in range(rnd.randint(1, 7))) for _ in range(25))
    rows = []
    for name in range(3):
        for version in range(9):
            base = sentence(3 * name) if version % 3 == 0 else rows[-1][2][: rnd.randint(60, 140)] + sentence(version % 4)
            rows.append((len(rows), f"{rnd.choice('xyz')}{version}/file{name}", base))
    rows += [(50, "a/empty", ""), (51, "b/empty", " "), (52, "c/empty", None), (53, "b/file0", rows[4][2]), (54, "alone", "x")]
    want = {}
    for i, path, text in rows:
        own = [(round(continuity.similarity(" ".join(text.split()), " ".join(t.split())), 4), p) for j, p, t in rows if text is not None and t is not None and j < i and p.rsplit("/")[-1] == path.rsplit("/")[-1]]
        if own:
            want[i] = max(own)[::-1]
    best, n = continuity.compared(spark.createDataFrame(rows, "ord long, path string, content string").repartition(3))
    assert {r["ord"]: (r["earlier"], r["similarity"]) for r in best.collect()} == want
    assert n < sum(8 - k for k in range(9)) * 3


def test_structure_maps_by_root(spark):
    from tessella.operators import lineage

    maps = spark.createDataFrame([("b", "x.md", '{"role": "narrative"}'), ("a", "z.md", '{"role":  "reference"}'), ("b", "a.md", "{}")], "root string, path string, plan string")
    assert [r["root"] for r in lineage.structure_roots(maps).collect()] == ["a", "b"]
    asked = spark.createDataFrame([("b",), ("none",)], "root string")
    assert {r["root"]: r["plans"] for r in lineage.structure_maps(maps, asked).collect()} == {"b": {"a.md": "{}", "x.md": '{"role":"narrative"}'}, "none": {}}


def test_one_fingerprint_for_every_record(spark):
    import hashlib

    from tessella.sources.files import request_fingerprint

    row = spark.range(1).select(request_fingerprint(text=F.lit("t"), prompt=F.lit("p"), none=F.lit(None).cast("string")).alias("f")).first()
    assert row["f"] == hashlib.sha256(b'{"prompt":"p","text":"t"}').hexdigest()
