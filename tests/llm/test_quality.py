import random
import re
from collections import Counter

from tessella.llm import quality
from tessella.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, m string, row string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def clean(rnd, n=120):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))


def rows_():
    rnd = random.Random(4)
    rows = [(i, clean(rnd), ["en", "fr"][i % 2], f"s{i % 3}", "x", "y") for i in range(200)]
    rows += [(200, "# $ % & < >| " * 60 + clean(rnd), "en", "s0", "x", "y"), (201, "a b c d\n" * 100, "en", "s0", "x", "y")]
    rows += [(202, "", "en", "s0", "x", "y"), (203, None, None, None, None, None), (204, "wörd é\x0b\x1c ñ \x85x\n\n" * 30, "xx", None, "x", "y")]
    rows += [(None, clean(rnd), "en", "s1", "x", "y"), rows[0], (205, "z" * 300_000, "en", "s0", "x", "y"), (206, clean(rnd, 40_000), "fr", "s1", "x", "y")]
    return rows


def test_counts_and_verdicts(spark):
    rows = rows_()
    got = quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute(r[1]) for r in rows}
    for r in got:
        n, chars, symbols, lines, repeats = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(200)) and kept[None] and kept[206]
    assert not any(kept[i] for i in (200, 201, 202, 203, 205))


def test_filtered_keeps_rows_whole(spark):
    rows = rows_()
    frame = spark.createDataFrame(rows, SCHEMA)
    out = quality.filtered(frame)
    assert out.columns == frame.columns
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())
    assert kept[:3] == [-1, 0, 0] and 200 not in kept


def test_sketches_merge_and_buckets_are_close(spark):
    from pyspark.sql import functions as F

    got = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] < r["b"] + max(1, r["b"] / 8) for r in got)
    measured = stored(quality.measure(spark.createDataFrame(rows_(), SCHEMA), "doc_id", "lang", "source"))
    whole = {tuple(r) for r in quality.quartiles(quality.sketches(measured), "lang").collect()}
    halves = quality.sketches(measured.filter("doc_id % 2 = 0")).union(quality.sketches(measured.filter("not coalesce(doc_id % 2 = 0, false)")))
    assert {tuple(r) for r in quality.quartiles(halves, "lang").collect()} == whole


def test_main_path_is_native(spark):
    plan = quality.measure(spark.createDataFrame(rows_(), SCHEMA), "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.quality(empty).count() == 0 and quality.filtered(empty).count() == 0
