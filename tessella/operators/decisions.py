"""Recording what people decide about nodes and edges: checks of requests, rows for the logs, histories.

Requests come as tables and are judged by joins, so a batch of any size is recorded at once. Each
function returns the rows that go to a log and those that are refused, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vocabulary (fixed values).
STATUSES = ["proposed", "accepted", "corrected", "rejected"]
NODE, EDGE = "character", "relation"
KINDS = ["person", "collective", "entity", "unknown"]
CORRECTABLE = {NODE: ["name", "aliases", "kind", "notes"], EDGE: ["types", "valence", "directed", "notes"]}
#: Fields that follow from something else, and from what (fixed values).
REFUSED = {
    "id": "identity changes by merging and splitting", "source": "identity changes by merging and splitting", "target": "identity changes by merging and splitting",
    "weight": "a weight is a count", "weight_basis": "a basis says what was counted", "evidence": "evidence is checked against the text",
    "provenance": "provenance follows from correcting", "review_status": "a status is set by reviewing", "confidence": "a reading estimates itself",
    "salience": "salience is computed",
}


def clean_note(note: Column) -> Column:
    return F.nullif(F.trim(note), F.lit(""))


def subjects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All that can be reviewed, nodes then edges in document order: place, kind, id, declared, label.

    ``nodes``: ord, id, name, review_status. ``edges``: ord, id, source, target, review_status.
    """
    name = nodes.select(F.col("id").alias("_id"), "name")
    n = nodes.select(F.struct(F.lit(0).alias("k"), F.col("ord").cast("long").alias("o")).alias("place"), F.lit(NODE).alias("kind"), "id", F.col("review_status").alias("declared"), F.coalesce("name", "id").alias("label"))
    ends = edges.join(name.select(F.col("_id").alias("source"), F.col("name").alias("_a")), "source", "left").join(name.select(F.col("_id").alias("target"), F.col("name").alias("_b")), "target", "left")
    label = F.concat_ws(" and ", F.coalesce("_a", "source"), F.coalesce("_b", "target"))
    e = ends.select(F.struct(F.lit(1).alias("k"), F.col("ord").cast("long").alias("o")).alias("place"), F.lit(EDGE).alias("kind"), "id", F.col("review_status").alias("declared"), label.alias("label"))
    return n.unionByName(e)


def history(log: DataFrame, **of) -> DataFrame:
    """A log oldest first, of one subject, field or snapshot where asked."""
    for column, value in of.items():
        log = log.filter(F.col(column) == value)
    return log.orderBy("decided_at", "seq")


def record_reviews(requests: DataFrame, known: DataFrame, standing: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (kind, id, status, note, ...) as log rows, and the refused with ``reason``.

    ``known``: kind, id of the snapshot's subjects. ``standing``: kind, id, status, note now in force. A status outside the vocabulary,
    an unknown kind or subject, and ``corrected`` with neither a note nor a correction on record are
    refused. What stands already is not recorded again.
    """
    asked = requests.withColumn("note", clean_note(F.col("note")))
    joined = (
        asked.join(known.select("kind", "id", F.lit(True).alias("_known")).distinct(), ["kind", "id"], "left")
        .join(standing.select("kind", "id", F.col("status").alias("_status"), F.col("note").alias("_note"), F.lit(True).alias("_stands")), ["kind", "id"], "left")
        .join(corrections.select("kind", "id", F.lit(True).alias("_corrected")).distinct(), ["kind", "id"], "left")
    )
    reason = (
        F.when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "not a status")
        .when(~F.coalesce(F.col("kind").isin(NODE, EDGE), F.lit(False)), "not a kind of subject")
        .when(F.col("_known").isNull(), "not in the snapshot")
        .when((F.col("status") == "corrected") & F.col("note").isNull() & F.col("_corrected").isNull(), "says nothing about what is corrected")
    )
    judged = joined.withColumn("reason", reason)
    same = F.coalesce(F.col("_stands"), F.lit(False)) & (F.col("_status") == F.col("status")) & F.col("_note").eqNullSafe(F.col("note"))
    return judged.filter(F.col("reason").isNull() & ~same).select(*asked.columns), judged.filter("reason is not null").select(*asked.columns, "reason")


def field_reason(kind: Column, field: Column) -> Column:
    """Why a field may not be corrected; null where it may."""
    fits = (kind == NODE) & field.isin(CORRECTABLE[NODE]) | (kind == EDGE) & field.isin(CORRECTABLE[EDGE])
    told = F.coalesce(*[F.when(field == name, F.lit(why)) for name, why in REFUSED.items()])
    elsewhere = field.isin(CORRECTABLE[NODE] + CORRECTABLE[EDGE])
    return F.when(~F.coalesce(kind.isin(NODE, EDGE), F.lit(False)), "not a kind of subject").when(fits, F.lit(None).cast("string")).when(told.isNotNull(), told).when(elsewhere, "a field of the other kind").otherwise("no such field")


def normalised(field: Column, value: Column) -> tuple[Column, Column]:
    """A correction's JSON value in the field's own form (JSON again), and why it is refused (null where it is not)."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    text = F.trim(F.try_variant_get(v, "$", "string"))
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    number = F.try_variant_get(v, "$", "double")
    string, numeric = kind == "STRING", kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE)")
    quoted = lambda x: F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("v")))) - 6)
    why = (
        F.when(v.isNull(), "not a value")
        .when((field == "name") & (~string | (text == "")), "a name is text")
        .when((field == "kind") & ~F.coalesce(string & text.isin(KINDS), F.lit(False)), "not a kind")
        .when(field.isin("aliases", "types") & ~kind.startswith("ARRAY"), "a list is needed")
        .when((field == "valence") & ~numeric, "a number is needed")
        .when((field == "valence") & ~number.between(-1, 1), "outside -1 to 1")
        .when((field == "directed") & (kind != "BOOLEAN"), "true or false is needed")
        .when((field == "notes") & ~string, "text is needed")
    )
    made = (
        F.when(field.isin("name", "notes", "kind"), quoted(text))
        .when(field.isin("aliases", "types"), F.to_json(items))
        .when(field == "valence", number.cast("string"))
        .otherwise(F.trim(value))
    )
    return F.when(why.isNull(), made), why


def record_corrections(requests: DataFrame, held: DataFrame, standing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (kind, id, field, value as JSON, note) as rows of the correction log (with ``was``), as reviews, and the refused.

    ``held``: kind, id, field, value: what the snapshot says now (JSON; no row: the field is absent), with a row
    of a null field for each subject. ``standing``: kind, id, field, value, note in force; what stands already is not recorded again.
    """
    value, bad = normalised(F.col("field"), F.col("value"))
    asked = requests.withColumn("_bad", F.coalesce(field_reason(F.col("kind"), F.col("field")), bad)).withColumn("value", F.coalesce(value, "value")).withColumn("note", clean_note(F.col("note")))
    known = held.select("kind", "id", F.lit(True).alias("_known")).distinct()
    now = held.filter("field is not null").select("kind", "id", "field", F.col("value").alias("was"))
    old = standing.select("kind", "id", "field", F.col("value").alias("_value"), F.col("note").alias("_note"), F.lit(True).alias("_stands"))
    joined = asked.join(known, ["kind", "id"], "left").join(now, ["kind", "id", "field"], "left").join(old, ["kind", "id", "field"], "left")
    judged = joined.withColumn("reason", F.coalesce("_bad", F.when(F.col("_known").isNull(), "not in the snapshot")))
    same = F.coalesce(F.col("_stands"), F.lit(False)) & (F.col("_value") == F.col("value")) & F.col("_note").eqNullSafe(F.col("note"))
    good = judged.filter(F.col("reason").isNull() & ~same).select(*requests.columns, "was")
    reviews = good.select("kind", "id", F.lit("corrected").alias("status"), "note").distinct()
    return good, reviews, judged.filter("reason is not null").select(*requests.columns, "reason")


def review_overlay(known: DataFrame, standing: DataFrame) -> DataFrame:
    """Every subject in document order with the status in force: the standing decision, else what is declared, else ``proposed``."""
    s = standing.select("kind", "id", F.col("status").alias("_s"), "note")
    joined = known.join(s, ["kind", "id"], "left")
    return joined.select("place", "kind", "id", "label", F.coalesce("_s", F.when(F.col("declared").isin(STATUSES), F.col("declared")), F.lit("proposed")).alias("status"), "note", F.col("_s").isNotNull().alias("reviewed"))


def tally(rows: DataFrame) -> DataFrame:
    """Subjects per status, all statuses, zeros included."""
    vocabulary = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "rank int, status string")
    return vocabulary.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("rank", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def with_decision(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """An overlay with decisions just made (kind, id, status, note) folded in."""
    f = fresh.select("kind", "id", F.col("status").alias("_s"), F.col("note").alias("_n"))
    joined = rows.join(f, ["kind", "id"], "left")
    return joined.withColumns({"status": F.coalesce("_s", "status"), "note": F.when(F.col("_s").isNotNull(), F.col("_n")).otherwise(F.col("note")), "reviewed": F.col("reviewed") | F.col("_s").isNotNull()}).drop("_s", "_n")


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON values are the same to a reader: an absent one, an empty text and an empty list are."""
    bare = lambda c: F.when(~F.coalesce(F.trim(c), F.lit("")).isin("", '""', "[]", "null"), F.to_json(F.try_parse_json(c)))
    return bare(a).eqNullSafe(bare(b))


def pending(corrections: DataFrame, held: DataFrame) -> DataFrame:
    """Corrections (kind, id, field, value) with ``applied``: whether the snapshot says so already."""
    now = held.filter("field is not null").select("kind", "id", "field", F.col("value").alias("_now"))
    return corrections.join(now, ["kind", "id", "field"], "left").withColumn("applied", same_value(F.col("value"), F.col("_now"))).drop("_now")


def replaced(corrections: DataFrame, fresh: DataFrame) -> DataFrame:
    """Corrections with fresh ones in place of those of the same field."""
    return corrections.join(fresh.select("kind", "id", "field"), ["kind", "id", "field"], "left_anti").unionByName(fresh)


def conflict_rows(conflicts: DataFrame, work: str, snapshot: str, when: str) -> DataFrame:
    """Rows of the conflict log: what a new reading says where a correction was made against something else."""
    return conflicts.select(F.lit(work).alias("work"), F.lit(snapshot).alias("snapshot"), "kind", "id", "field", "was", "proposed", F.lit(when).alias("seen_at"))


def overlay_json(corrections: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per subject one JSON text of its corrections and conflicts."""
    item = F.struct("field", "value", "was")
    c = corrections.groupBy("kind", "id").agg(F.array_sort(F.collect_list(item)).alias("corrections"))
    k = conflicts.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("field", "was", "proposed"))).alias("conflicts"))
    joined = c.join(k, ["kind", "id"], "full")
    return joined.select("kind", "id", F.to_json(F.struct("corrections", "conflicts")).alias("json"))


def ordinals(log: DataFrame, *keys: str) -> DataFrame:
    """A log with ``nth``: the place of each row among those of its keys, from 1."""
    return log.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("decided_at", "seq")).cast("long"))
