"""Merging and splitting entities of a registry.

A registry is a row per entity (entity_id, collection_id, name, kind, notes, provenance, review_status, merged_into) and a
row per form (entity_id, collection_id, ord, form, form_key); an entity's first form is its name. Both are
rewritten as tables: rows of the entities concerned are replaced, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import entity_id, form_key, slugify

FORMS = ["entity_id", "collection_id", "ord", "form", "form_key"]


class IdentityError(ValueError):
    """A merge or split that makes no sense."""


@dataclass
class Rewrite:
    """The registry afterwards, the row for the log of decisions (action, source_id, target_id, forms, note), and warnings."""

    entities: DataFrame
    forms: DataFrame
    decision: DataFrame
    warnings: list[str] = field(default_factory=list)


def rewritten(entities: DataFrame, forms: DataFrame, new_entities: DataFrame, new_forms: DataFrame, retire: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch of entities in place of their old rows, with their forms; ``retire`` (entity_id, merged_into) keep a row and lose all forms.

    Only forms held by entities outside the batch conflict, so forms may change hands within it.
    """
    batch = new_entities.select("entity_id").union(retire.select("entity_id")).distinct() if retire is not None else new_entities.select("entity_id")
    others = forms.join(batch, "entity_id", "left_anti")
    taken = new_forms.join(others.select("collection_id", "form_key", F.col("entity_id").alias("holder")), ["collection_id", "form_key"]).limit(3).collect()
    if taken:
        raise IdentityError("; ".join(f"{r['form']} belongs to {r['holder']}" for r in taken))
    kept = entities.join(new_entities.select("entity_id"), "entity_id", "left_anti")
    if retire is not None:
        gone = retire.select("entity_id", F.col("merged_into").alias("_into"))
        kept = kept.join(gone, "entity_id", "left").withColumn("merged_into", F.coalesce("_into", "merged_into")).drop("_into")
    return kept.select(*entities.columns).unionByName(new_entities.select(*entities.columns)), others.select(*FORMS).unionByName(new_forms.select(*FORMS))


def _standing(entities: DataFrame, collection: str, ids: list[str]) -> dict[str, Row]:
    found = {r["entity_id"]: r for r in entities.filter(F.col("entity_id").isin(ids) & (F.col("collection_id") == collection)).collect()}
    for i in ids:
        if i not in found:
            raise IdentityError(f"{i} is no entity of this collection")
        if found[i]["merged_into"]:
            raise IdentityError(f"{i} was merged into {found[i]['merged_into']} already")
    return found


def _numbered(forms: DataFrame, *order) -> DataFrame:
    """Forms in order, each key once, numbered from 0 per entity."""
    once = forms.groupBy("entity_id", "collection_id", "form_key").agg(F.min_by(F.struct("form", *order), F.struct(*order)).alias("f"))
    w = Window.partitionBy("entity_id").orderBy(*[f"f.{c}" for c in order])
    return once.select("entity_id", "collection_id", (F.row_number().over(w) - 1).cast("int").alias("ord"), F.col("f.form").alias("form"), "form_key")


def alias_warnings(corrections: DataFrame | None, entity: str) -> list[str]:
    """Works where a correction in force governs the entity's aliases, and so hides forms that change hands."""
    if corrections is None:
        return []
    held = corrections.filter((F.col("kind") == "character") & (F.col("id") == entity) & (F.col("field") == "aliases"))
    return [f"a correction governs the aliases in {r['work']}" for r in held.select("work").distinct().orderBy("work").collect()]


def merge(entities: DataFrame, forms: DataFrame, collection: str, into: str, absorb: str, note: str | None = None, corrections: DataFrame | None = None) -> Rewrite:
    """Two entities are one: ``into`` takes the forms of ``absorb``, which is retired.

    The survivor keeps its name, its kind unless unknown, and its notes if it has any.
    """
    if into == absorb:
        raise IdentityError("an entity cannot be merged into itself")
    found = _standing(entities, collection, [into, absorb])
    keep, gone = found[into], found[absorb]
    survivor = entities.filter(F.col("entity_id") == into).withColumns(
        {
            "kind": F.when(F.coalesce("kind", F.lit("unknown")) == "unknown", F.lit(gone["kind"])).otherwise(F.col("kind")),
            "notes": F.coalesce(F.nullif("notes", F.lit("")), F.lit(gone["notes"])), "review_status": F.lit("corrected"),
        }
    )
    mine = forms.filter((F.col("collection_id") == collection) & F.col("entity_id").isin(into, absorb)).withColumn("from", (F.col("entity_id") == absorb).cast("int"))
    moved = [r["form"] for r in mine.filter("from = 1").orderBy("ord").collect()]
    joined = _numbered(mine.withColumn("entity_id", F.lit(keep["entity_id"])), "from", "ord")
    spark = entities.sparkSession
    retire = spark.createDataFrame([(absorb, into)], "entity_id string, merged_into string")
    new_entities, new_forms = rewritten(entities, forms, survivor, joined, retire)
    decision = _decision(spark, collection, "merge", absorb, into, moved, note)
    return Rewrite(new_entities, new_forms, decision, alias_warnings(corrections, into))


def split(
    entities: DataFrame, forms: DataFrame, collection: str, entity: str, moving: list[str], name: str | None = None, note: str | None = None, corrections: DataFrame | None = None
) -> Rewrite:
    """One entity is two: the forms ``moving`` go to a new one, called ``name`` or by the first of them.

    The forms must be the entity's, one must stay, and a name that is none of them must be free. The first form that
    stays becomes the old entity's name; the new entity is a person's own and has the old one's kind.
    """
    source = _standing(entities, collection, [entity])[entity]
    wanted = [m.strip() for m in moving if m.strip()]
    if not wanted:
        raise IdentityError("a split moves one form at least")
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "at int, form string").withColumn("form_key", form_key(F.col("form")))
    asked = asked.groupBy("form_key").agg(F.min("at").alias("at"))
    mine = forms.filter((F.col("collection_id") == collection) & (F.col("entity_id") == entity))
    held = mine.join(asked, "form_key", "left").orderBy("ord").collect()
    moved = sorted((r for r in held if r["at"] is not None), key=lambda r: r["at"])
    stays = [r for r in held if r["at"] is None]
    if len(moved) < asked.count():
        raise IdentityError(f"{entity} answers to {', '.join(r['form'] for r in held)} only")
    if not stays:
        raise IdentityError("a split leaves one form at least: moving all of them is a rename")
    chosen = (name or moved[0]["form"]).strip()
    key = spark.range(1).select(form_key(F.lit(chosen)).alias("k")).first()["k"]
    if key not in {r["form_key"] for r in moved} and forms.filter((F.col("collection_id") == collection) & (F.col("form_key") == key)).limit(1).count():
        raise IdentityError(f"{chosen} denotes another entity")
    made = "char:" + (slugify(chosen) or "unnamed")
    if made == entity or entities.filter(F.col("entity_id") == made).limit(1).count():
        made = spark.range(1).select(entity_id(F.lit(chosen), F.lit(moved[0]["form_key"][:8]))).first()[0]
    old = entities.filter(F.col("entity_id") == entity)
    changes = {"name": F.lit(stays[0]["form"]), "review_status": F.lit("corrected")}
    new = {"entity_id": F.lit(made), "name": F.lit(chosen), "notes": F.lit(None).cast("string"), "provenance": F.lit("human"), "review_status": F.lit("corrected")}
    both = old.withColumns(changes).unionByName(old.withColumns(new))
    rows = [(entity, collection, i, r["form"], r["form_key"]) for i, r in enumerate(stays)]
    own = [(chosen, key), *((r["form"], r["form_key"]) for r in moved if r["form_key"] != key)]
    rows += [(made, collection, i, f, k) for i, (f, k) in enumerate(own)]
    new_forms = spark.createDataFrame(rows, "entity_id string, collection_id string, ord int, form string, form_key string")
    new_entities, all_forms = rewritten(entities, forms, both, new_forms)
    decision = _decision(spark, collection, "split", source["entity_id"], made, [r["form"] for r in moved], note)
    return Rewrite(new_entities, all_forms, decision, alias_warnings(corrections, entity))


def _decision(spark, *values) -> DataFrame:
    return spark.createDataFrame([values], "collection_id string, action string, source_id string, target_id string, forms array<string>, note string")


def merged_registry(entities: DataFrame, forms: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many merges at once (from_id, to_id, closed over chains): the registry afterwards, by joins and one grouping of forms."""
    into = merges.select(F.col("from_id").alias("entity_id"), "to_id")
    pointed = entities.join(into, "entity_id", "left")
    gone = pointed.filter("to_id is not null").groupBy(F.col("to_id").alias("entity_id")).agg(
        F.min_by(F.nullif("kind", F.lit("unknown")), F.when(F.col("kind") != "unknown", F.col("entity_id"))).alias("_kind"), F.min_by("notes", F.when(F.col("notes").isNotNull(), F.col("entity_id"))).alias("_notes"),
        F.lit(True).alias("_took"),
    )
    kept = pointed.join(gone, "entity_id", "left").withColumns(
        {
            "merged_into": F.coalesce("to_id", "merged_into"),
            "kind": F.when((F.coalesce("kind", F.lit("unknown")) == "unknown") & F.col("_kind").isNotNull(), F.col("_kind")).otherwise(F.col("kind")),
            "notes": F.coalesce(F.nullif("notes", F.lit("")), "_notes"), "review_status": F.when(F.col("_took"), "corrected").otherwise(F.col("review_status")),
        }
    )
    moved = forms.join(into, "entity_id", "left").withColumn("from", F.when(F.col("to_id").isNull(), F.lit("")).otherwise(F.col("entity_id"))).withColumn("entity_id", F.coalesce("to_id", "entity_id"))
    return kept.select(*entities.columns), _numbered(moved, "from", "ord")


def retired(entities: DataFrame) -> DataFrame:
    return entities.filter("merged_into is not null").select("entity_id", "name", "merged_into")


def described(decisions: DataFrame) -> DataFrame:
    """A line for each decision, oldest first."""
    arrow = F.when(F.col("action") == "merge", "->").otherwise("=>")
    line: Column = F.format_string("%s  %-5s %s %s %s  (%s)", F.col("decided_at").cast("string"), "action", "source_id", arrow, "target_id", F.array_join("forms", ", "))
    return decisions.orderBy("decided_at", "seq").select(line.alias("line"))
