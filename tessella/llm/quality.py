"""Quality rules with adaptive thresholds (DataFrame functions only).

Every text is measured once. The measures of each (language, source) go into mergeable quantile
sketches, and a text is rejected when a measure lies far outside what its own language and source
usually show. Fixed cut-offs remain only in the base rule.

The sketch. Measures are whole numbers (per-mille ratios, tenths of a character, words). A value
below 16 has a bucket of its own; a larger one keeps its four leading bits, so a bucket's lower
edge is within 1/16 of every value in it. A sketch is the bucket counts; two sketches merge by adding
counts, exactly and in any order, so the result does not depend on how Spark deals the rows out, and a
(language, source) has a bounded number of buckets however many rows it has. Sketches of sources with
fewer than ``min_rows`` texts are replaced by the merged sketch of their language, and that by the
sketch of everything.

The rule. With q1 and q3 the sketch's quartiles (bucket edges), a measure is too high above
``q3 + reach * max(q3 - q1, least)``, and (mean word length only) too low below
``q1 - reach * max(q3 - q1, least)``.

Defined cases: a null or empty text has no words and fails the base rule; a null language or source
forms a group of its own; a very long text is measured whole, as one array of words in the JVM; repeated rows count as often as they occur; an empty table gives no rows;
other columns are ignored by :func:`measure` unless carried, and carried through by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import stored

WORD = r"[^\x20\x09-\x0D]"
MIN_ROWS = 50
#: measure -> (reach above, reach below or None, least spread)
RULES = {
    "symbol_pm": (8, None, 8),
    "dup_line_pm": (8, None, 60),
    "repeat_pm": (8, None, 50),
    "word_length": (8, 8, 4),
}
#: Thresholds are broadcast below this many rows (about 100 bytes each) and joined by a shuffle above.
BROADCAST_ROWS = 50_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three words that occurs twice or more in the text.

    Windows are compared by 64-bit hashes of their three words. Sorting the hashes shows whether any
    repeats; only then are they sorted again with their places. A repeated window at place p covers
    p..p+2, so a sorted list of places covers min(3, gap to the next) words each.
    """
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def adjacent_equal(s: Column) -> Column:
        return F.size(F.array_distinct(s)) < F.size(s)

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        places = bind(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)),
                    ),
                    lambda x: x["p"],
                )
            ),
        )
        return bind(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
        )

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        bind(hashes(words), lambda h: F.when(adjacent_equal(h), covered(h)).otherwise(F.lit(0).cast("long")))
    )


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """The base counts of each text, as columns ``m.<name>`` of one struct ``m``, beside ``carry``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    words = F.filter(F.split(F.col("_t"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    kept = [F.col(c) for c in carry]
    return (
        docs.select(*kept, text.alias("_t"))
        .select(*kept, "_t", words.alias("_w"), lines.alias("_l"))
        .select(
            *kept,
            F.struct(
                F.size("_w").cast("long").alias("n_words"),
                F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                F.size("_l").cast("long").alias("n_lines"),
                _repeat_words(F.col("_w")).alias("n_repeat_words"),
            ).alias("m"),
        )
    )


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _derived(m: str = "m") -> dict[str, Column]:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.floor(a / b)).otherwise(F.lit(0)).cast("long")

    c = lambda name: F.col(f"{m}.{name}")
    return {
        "symbol_pm": ratio(1000 * c("n_symbols"), c("word_chars")),
        "dup_line_pm": ratio(1000 * c("n_dup_lines"), c("n_lines")),
        "repeat_pm": ratio(1000 * c("n_repeat_words"), c("n_words")),
        "word_length": ratio(10 * c("word_chars"), c("n_words")),
    }


def bucket(v: Column) -> Column:
    """Lower edge of a value's bucket: its four leading bits, the rest zero."""
    bits = F.greatest(F.length(F.bin(v)) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, bits), bits)


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts per language, source, measure: columns lang, source, measure, edge, n. ``measured`` should be a stored table: it is used several times."""
    long = measured.filter(~base_failed()).select(
        F.col("lang"), F.col("source"), F.explode(F.create_map(*[x for k, v in _derived().items() for x in (F.lit(k), bucket(v))])).alias("measure", "edge")
    )
    return long.groupBy("lang", "source", "measure", "edge").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """q1, q3 and rows of each merged sketch: the edges of the buckets that hold the quartile ranks."""
    merged = sketch.groupBy(*keys, "measure", "edge").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(whole.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(*keys, "measure", "edge", upto.alias("upto"), F.sum("n").over(whole).alias("rows"))
    return ranked.groupBy(*keys, "measure", "rows").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("edge"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("edge"))).alias("q3"),
    )


def thresholds(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): columns ``high_<measure>`` and ``low_<measure>``."""
    sketch = stored(sketches(measured))
    own = quartiles(sketch, "lang", "source").alias("o")
    by_lang = quartiles(sketch, "lang").alias("l")
    overall = quartiles(sketch).alias("a")
    joined = own.join(by_lang, F.expr("o.lang <=> l.lang and o.measure = l.measure"), "left").join(
        F.broadcast(overall), F.expr("o.measure = a.measure"), "left"
    )

    def pick(q: str) -> Column:
        return (
            F.when(F.col("o.rows") >= min_rows, F.col(f"o.{q}"))
            .when(F.col("l.rows") >= min_rows, F.col(f"l.{q}"))
            .otherwise(F.col(f"a.{q}"))
        )

    chosen = joined.select("o.lang", "o.source", "o.measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    bounds = []
    for name, (above, below, least) in RULES.items():
        of = F.col("measure") == name
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        bounds.append(F.max(F.when(of, F.col("q3") + above * spread)).alias(f"high_{name}"))
        if below:
            bounds.append(F.max(F.when(of, F.col("q1") - below * spread)).alias(f"low_{name}"))
    return chosen.groupBy("lang", "source").agg(*bounds)


def judge(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """``measured`` (lang, source, m and whatever it carries) with boolean base_failed and kept.

    The thresholds join on language and source. They are broadcast when counted to be few; beyond
    that the join shuffles and adaptive execution splits a hot source.
    """
    bounds = stored(thresholds(measured, min_rows))
    if bounds.count() <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    ok = F.lit(True)
    derived = _derived("d.m")
    for name, (_, below, _) in RULES.items():
        ok = ok & F.coalesce(derived[name] <= F.col(f"b.high_{name}"), F.lit(True))
        if below:
            ok = ok & F.coalesce(derived[name] >= F.col(f"b.low_{name}"), F.lit(True))
    joined = measured.alias("d").join(bounds.alias("b"), F.expr("d.lang <=> b.lang and d.source <=> b.source"), "left")
    failed = base_failed("d.m")
    return joined.select("d.*", failed.alias("base_failed"), (~failed & ok).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``docs``."""
    measured = stored(measure(docs, "doc_id", "lang", "source"))
    return judge(measured).select("doc_id", *[f"m.{c}" for c in BASE], "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. Every row is measured once and stored with its measures."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text", "lang", "source")
    return judge(stored(measure(rows, "row", "lang", "source"))).filter("kept").select("row.*")
