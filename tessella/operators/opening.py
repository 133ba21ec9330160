"""Opening evidence: the passage that holds a quotation, where it was recorded or where it has moved to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import normalise_whitespace, split_at
from tessella.operators.anchors import reanchored
from tessella.operators.segments import addressable, leaves

#: The one type of segments whose rule its name gives (fixed value).
DEFAULT_TYPE = "section"
#: Evidence of one text is dealt over so many rows, each with its own copy of the text.
SLICES = 64


def require_reproducible(types: list[str] | None) -> None:
    """Only the default division can be made again from its name."""
    if types and list(types) != [DEFAULT_TYPE]:
        raise ValueError(f"the rules that found {', '.join(types)} are not stored, so their passages cannot be opened")


def indices(chain: Column) -> Column:
    """The ordinals of an address, whose labels do not count; null where a step has none."""
    found = F.transform(chain, lambda s: s["index"])
    return F.when((F.size(found) > 0) & ~F.exists(found, lambda i: i.isNull()), found)


def named_passages(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """``evidence`` (doc_id, item, path, exact) with pos, passage and segment end of the segment its path names; nulls where there is none."""
    found = segments.select("doc_id", "path", "pos", F.col("end").alias("closes"), normalise_whitespace(F.col("body")).alias("passage"))
    return evidence.join(found, ["doc_id", "path"], "left")


def find_passages(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Where each quotation is, from its named passage on: doc_id, item, found, passage, start, end, widened.

    A quotation that its passage does not hold begins there and goes on: the passage grows by the leaves that
    follow, until it holds the quotation or has grown by the quotation's length. ``found`` tells whether the address exists.
    """
    named = named_passages(evidence, segments).withColumn("needle", normalise_whitespace(F.coalesce("exact", F.lit(""))))
    at = F.when(F.col("needle") != "", F.nullif(F.instr("passage", F.col("needle")) - 1, F.lit(-1)))
    named = named.withColumn("at", at)
    inside = named.filter(F.col("at").isNotNull() | (F.col("needle") == "") | F.col("passage").isNull())
    done = inside.select("doc_id", "item", F.col("passage").isNotNull().alias("found"), "passage", F.col("at").alias("start"), (F.col("at") + F.length("needle")).alias("end"), F.lit(False).alias("widened"))
    open_ = named.filter(F.col("at").isNull() & (F.col("needle") != "") & F.col("passage").isNotNull())
    # leaves after the passage, as far as the quotation's length: of each leaf, the text before it that follows the passage
    inked = addressable(segments).select("doc_id", "pos", "norm_start", "norm_end", F.col("passage").alias("leaf"))
    starts = leaves(segments).select("doc_id", "pos", F.col("start").alias("opens"))
    inked = inked.join(starts, ["doc_id", "pos"])
    asked = open_.select("doc_id", "item", "closes", F.length("needle").alias("n")).join(inked.drop("pos"), "doc_id").filter("opens >= closes")
    first = asked.groupBy("doc_id", "item").agg(F.min("norm_start").alias("origin"))
    near = asked.join(first, ["doc_id", "item"]).filter(F.col("norm_start") - F.col("origin") < F.col("n"))
    follow = near.groupBy("doc_id", "item").agg(F.array_sort(F.collect_list(F.struct(F.col("norm_start").alias("s"), F.col("norm_end").alias("e"), F.col("leaf").alias("t")))).alias("f"), F.min("origin").alias("origin"))
    grown = open_.join(follow, ["doc_id", "item"], "left")
    wide = F.concat_ws(" ", F.array("passage"), F.transform("f", lambda x: x["t"]))
    grown = grown.withColumn("wide", F.coalesce(wide, "passage")).withColumn("at", F.nullif(F.instr("wide", F.col("needle")) - 1, F.lit(-1)))
    base = F.length("passage") + 1 - F.col("origin")
    ends = F.transform("f", lambda x: x["e"] + base)
    stop = F.array_min(F.filter(ends, lambda e: e >= F.col("at") + F.length("needle")))
    held = F.col("at").isNotNull()
    widened = grown.select(
        "doc_id", "item", F.lit(True).alias("found"), F.when(held, F.substr("wide", F.lit(1), stop)).otherwise(F.col("passage")).alias("passage"), F.col("at").alias("start"),
        (F.col("at") + F.length("needle")).alias("end"), held.alias("widened"),
    )
    return done.unionByName(widened)


def joined_texts(segments: DataFrame) -> DataFrame:
    """The addressable text of each document: its leaves with ink, joined by single spaces."""
    inked = addressable(segments)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "passage")))
    return inked.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["passage"]), " ").alias("text"))


def open_evidence(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Each piece of evidence (doc_id, item, path, exact, prefix, suffix, hint) opened in its text.

    Columns: doc_id, item, path (where it is now), passage, start, end, method, similarity, ambiguous, widened, moved. In its
    named passage where that holds it; else wherever the words are now, the passage going from
    the leaf where they begin to the end of the one where they end; else the named passage without a span; where
    that is gone too, nulls.
    """
    named = find_passages(evidence, segments)
    rows = evidence.join(named, ["doc_id", "item"])
    settled = F.col("found") & F.col("start").isNotNull() & ~F.col("widened")
    exact = rows.filter(settled).select(
        "doc_id", "item", "path", "passage", "start", "end", F.lit("exact").alias("method"), F.lit(1.0).alias("similarity"), F.lit(False).alias("ambiguous"), "widened", F.lit(False).alias("moved")
    )
    open_ = rows.filter(~settled)
    asked = open_.select("doc_id", "item", "path", "exact", "prefix", "suffix", "hint", F.col("found").alias("_found"), F.col("passage").alias("_passage"))
    met = reanchored(asked.join(joined_texts(segments), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit(""))))
    found = met.select("doc_id", "item", F.col("path").alias("stored"), "_found", "_passage", "anchor", F.when(F.col("anchor").isNotNull(), F.col("text")).alias("text"))
    spans = addressable(segments).join(segments.select("doc_id", "pos", F.col("path").alias("at_path")), ["doc_id", "pos"]).select("doc_id", "norm_start", "norm_end", "at_path")
    hit = found.filter("anchor is not null")
    over = hit.select("doc_id", "item", "anchor").join(spans, "doc_id").filter((F.col("norm_start") < F.col("anchor.end")) & (F.col("norm_end") > F.col("anchor.start")))
    place = over.groupBy("doc_id", "item").agg(F.min(F.struct("norm_start", "at_path", "norm_end")).alias("first"), F.max("norm_end").alias("closes"))
    opened = hit.join(place, ["doc_id", "item"]).select(
        "doc_id", "item", F.col("first.at_path").alias("path"),
        F.substr("text", F.col("first.norm_start").cast("int") + 1, (F.col("closes") - F.col("first.norm_start")).cast("int")).alias("passage"),
        (F.col("anchor.start") - F.col("first.norm_start")).cast("int").alias("start"), (F.col("anchor.end") - F.col("first.norm_start")).cast("int").alias("end"),
        "anchor.method", "anchor.similarity", "anchor.ambiguous", (F.col("anchor.end") > F.col("first.norm_end")).alias("widened"),
        (~F.col("first.at_path").eqNullSafe(F.col("stored"))).alias("moved"),
    )
    none = lambda t: F.lit(None).cast(t)
    lost = found.filter("anchor is null").select(
        "doc_id", "item", F.when(F.col("_found"), F.col("stored")).alias("path"), F.col("_passage").alias("passage"), none("int").alias("start"), none("int").alias("end"),
        F.when(F.col("_found"), "exact").alias("method"), F.when(F.col("_found"), F.lit(1.0)).alias("similarity"), F.when(F.col("_found"), F.lit(False)).alias("ambiguous"),
        F.lit(False).alias("widened"), F.lit(False).alias("moved"),
    )
    return exact.unionByName(opened).unionByName(lost)


def opened_by_index(evidence: DataFrame, segments: DataFrame, edge: str, stored: int) -> DataFrame:
    """One piece of evidence by its edge and its place in the stored list, opened and cut around its quotation."""
    one = evidence.filter((F.col("edge") == edge) & (F.col("stored") == stored)).withColumn("item", F.col("stored"))
    found = open_evidence(one.drop("edge", "stored"), segments)
    return found.withColumn("parts", split_at(F.col("passage"), F.col("start"), F.col("end"))).withColumn("note", anchor_sentence("method", "similarity", "ambiguous", "moved"))


def anchor_sentence(method: str, similarity: str, ambiguous: str, moved: str) -> Column:
    """What a reader should know about how a quotation was found; null where there is nothing to say."""
    percent = F.round(F.col(similarity) * 100).cast("int").cast("string")
    return (
        F.when(F.col(method) == "fuzzy", F.concat(F.lit("The text has been edited: the closest passage is shown, "), percent, F.lit("% alike.")))
        .when(F.col(ambiguous), "The quotation occurs in several places, one of which is shown.")
        .when(F.col(moved), "The passage has moved since it was recorded.")
    )


def following(segments: DataFrame) -> DataFrame:
    """Leaves numbered in order of their start, with the start of the next one."""
    w = Window.partitionBy("doc_id").orderBy("start", "pos")
    return leaves(segments).withColumn("next_start", F.lead("start").over(w))
