import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import tokencounts


def brute(bounds, sections):
    counts = [0] * (len(sections) - 1)
    for a, b in zip(bounds, bounds[1:]):
        shares = [max(0, min(b, y) - max(a, x)) for x, y in zip(sections, sections[1:])]
        counts[shares.index(max(shares))] += 1
    return counts


def test_attribution_matches_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(1, 40)
        bounds = sorted({0, n, *(rnd.randint(0, n) for _ in range(rnd.randint(0, 12)))})
        sections = sorted([0, n, *(rnd.randint(0, n) for _ in range(rnd.randint(0, 6)))])
        assert tokencounts.attribute(np.array(bounds), np.array(sections)).tolist() == brute(bounds, sections)


def test_sections_add_up_to_the_whole_encoding(spark):
    texts = ["one line", "a\n\n\n b\n", "", None, "é\nß ü\n\n\n\nx", "word " * 60_000 + "\nend", "\n"]
    frame = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    rows = tokencounts.section_counts(frame).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == (i or None)), key=lambda r: r["section"])
        whole = tokenizer.encode(t or "", add_special_tokens=False)
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"] == len(whole.ids)
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in own) == (t or "")
        assert len(own) == max(1, len((t or "").splitlines(keepends=True)))


def test_fields_and_empty_table(spark):
    frame = spark.createDataFrame([("a title", None, "x"), ("", "", "y")], "title string, body string, n_tokens_ string")
    got = [r["n_tokens"] for r in tokencounts.field_counts(frame, ["title", "body"]).collect()]
    assert got[0][0] >= 2 and got[0][1] == 0 and sum(got[1]) == 1
    assert tokencounts.section_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
