"""Quotations against the text they are said to come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import normalise_whitespace, quote_offset
from tessella.operators.segments import passage_at


#: A run of this many quotations or more is refused where more than this share is rejected (fixed values).
LEAST_CHECKED, MOST_REJECTED = 5, 0.25
#: Claims of one text are dealt over so many rows, each with its own copy of the text.
SLICES = 64


def _offsets(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, claim, offset) of each claim's needle in its text (doc_id, hay); null where it is not there.

    The claims of a text meet it a slice at a time, so the text is not repeated for each of them.
    """
    dealt = claims.groupBy("doc_id", F.pmod(F.xxhash64("claim"), F.lit(SLICES)).alias("slice")).agg(F.collect_list(F.struct("claim", "needle")).alias("c"))
    met = dealt.join(texts, "doc_id")
    found = F.transform("c", lambda x: F.struct(x["claim"].alias("claim"), quote_offset(F.col("hay"), x["needle"]).alias("offset")))
    return met.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.claim", "f.offset")


def verify(claims: DataFrame, passages: DataFrame, texts: DataFrame, most_rejected: float | None = MOST_REJECTED) -> DataFrame:
    """``claims`` (doc_id, claim, pos, quotation) with a verdict: kept, relocated (with the new pos) or why rejected.

    ``passages``: doc_id, pos, norm_start, norm_end, passage. ``texts``: doc_id, text. A run of five claims or
    more that rejects a larger share than ``most_rejected`` is refused as a whole; None refuses none.
    """
    needle = normalise_whitespace(F.coalesce("quotation", F.lit("")))
    rows = claims.withColumn("needle", needle).join(passages.select("doc_id", "pos", "passage"), ["doc_id", "pos"], "left")
    rows = rows.withColumn("named", F.coalesce(F.contains("passage", "needle"), F.lit(False))).drop("passage")
    open_ = rows.filter((F.col("needle") != "") & ~F.col("named")).select("doc_id", "claim", "needle")
    joined = passages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "passage"))), lambda x: x["passage"]), " ").alias("hay"))
    whole = texts.select("doc_id", normalise_whitespace(F.col("text")).alias("hay"))
    at, anywhere = _offsets(open_, joined), _offsets(open_, whole).select("doc_id", "claim", F.col("offset").alias("anywhere"))
    judged = rows.join(at, ["doc_id", "claim"], "left").join(anywhere, ["doc_id", "claim"], "left")
    verdict = (
        F.when(F.col("needle") == "", "empty")
        .when(F.col("named"), "kept")
        .when(F.col("offset").isNotNull(), "relocated")
        .when(F.col("anywhere").isNotNull(), "outside any passage")
        .otherwise("not in the source")
    )
    judged = judged.select("doc_id", "claim", "pos", "quotation", verdict.alias("verdict"), "offset")
    moved = passage_at(judged.filter("verdict = 'relocated'").select("doc_id", "offset").distinct(), passages).withColumnRenamed("pos", "new_pos")
    out = judged.join(moved, ["doc_id", "offset"], "left").select("doc_id", "claim", "quotation", "verdict", F.when(F.col("verdict") == "relocated", F.col("new_pos")).otherwise(F.col("pos")).alias("pos"))
    if most_rejected is not None:
        n, bad = out.agg(F.count("*"), F.count_if(~F.col("verdict").isin("kept", "relocated"))).first()
        if n >= LEAST_CHECKED and bad > most_rejected * n:
            raise ValueError(f"{bad} of {n} quotations are not in the text: the run is refused")
    return out


#: Characters that quotations without a whole inner word are met on.
GRAM = 4


def found_in(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, offset) for every quotation and text that holds it, both normalised.

    A text can only hold a quotation if it has all its parts: pairs of neighbouring inner words (the first and
    last word may be parts of words of the text), for three words the middle one, for fewer all runs of four
    characters. Texts give their distinct parts as hashes, without the text beside them; those with all parts
    of a quotation are then compared once. Null or empty quotations are nowhere.
    """
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    grams = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))
    hashed = lambda parts, kind: F.array_distinct(F.transform(parts, lambda x: F.xxhash64(F.lit(kind), x)))
    q = quotes.select("item_id", normalise_whitespace(F.col("text")).alias("q")).filter("q <> ''").withColumn("w", F.split("q", " ")).distinct()
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    kinds = {"pair": F.size("w") >= 4, "word": F.size("w") == 3, **{f"gram{n}": (F.size("w") <= 2) & (F.length("q") >= n if n == GRAM else F.length("q") == n) for n in range(1, GRAM + 1)}}
    parts = {"pair": pairs(inner), "word": inner, **{f"gram{n}": grams(F.col("q"), n) for n in range(1, GRAM + 1)}}
    some = [k for k, there in zip(kinds, q.agg(*[F.count_if(c) for c in kinds.values()]).first()) if there]
    if not some:
        return q.join(docs.select("doc_id"), F.lit(False)).select("item_id", "doc_id", F.lit(None).cast("long").alias("offset"))
    keyed = reduce(DataFrame.union, [q.filter(kinds[k]).select("item_id", "q", hashed(parts[k], k).alias("keys")) for k in some])
    d = docs.select("doc_id", normalise_whitespace(F.col("text")).alias("t")).filter("t <> ''").withColumn("w", F.split("t", " "))
    of_text = {
        "pair": F.when(F.size("w") >= 2, pairs(F.col("w"))), "word": F.col("w"),
        **{f"gram{n}": F.when(F.length("t") >= n, grams(F.col("t"), n)) for n in range(1, GRAM + 1)},
    }
    wanted = keyed.select("item_id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    held = d.select("doc_id", F.explode(F.concat(*[F.coalesce(hashed(of_text[k], k), F.array().cast("array<bigint>")) for k in some])).alias("key"))
    met = held.join(wanted, "key").groupBy("doc_id", "item_id").agg(F.count("*").alias("had"), F.min("n").alias("n")).filter("had >= n")
    asked = met.select("doc_id", "item_id").join(keyed.select("item_id", "q"), "item_id")
    return asked.join(d.select("doc_id", "t"), "doc_id").filter(F.contains("t", "q")).select("item_id", "doc_id", quote_offset(F.col("t"), F.col("q")).alias("offset"))
