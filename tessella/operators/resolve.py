"""Surface names to stable entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import entity_id

#: Tokens allowed to a reply that groups names: a base, more for each name, at most (fixed values).
BASE_TOKENS, TOKENS_PER_FORM, MOST_TOKENS = 8192, 48, 32768
#: Context asked for: at least, at most, characters taken for a token, reserve (fixed values).
LEAST_CONTEXT, MOST_CONTEXT, CHARACTERS_PER_TOKEN, RESERVE = 8192, 32768, 3, 512


def token_budget(forms: Column) -> Column:
    """Tokens for a reply that names so many forms; null below none."""
    return F.when(forms >= 0, F.least(BASE_TOKENS + TOKENS_PER_FORM * forms, F.lit(MOST_TOKENS)))


def context_size(characters: Column, reply_tokens: Column) -> Column:
    """Tokens of context for a prompt of so many characters and its reply."""
    wanted = F.floor(characters / CHARACTERS_PER_TOKEN) + reply_tokens + RESERVE
    return F.greatest(F.lit(LEAST_CONTEXT), F.least(F.lit(MOST_CONTEXT), wanted))


def gather(mentions: DataFrame) -> DataFrame:
    """Mentions (ord, name, key, kind) by folded name: first spelling, mentions, first kind that is known."""
    known = F.col("kind") != "unknown"
    return mentions.groupBy("key").agg(
        F.min_by("name", "ord").alias("name"), F.count("*").alias("n"), F.min_by(F.when(known, F.col("kind")), F.when(known, F.col("ord"))).alias("kind")
    )


def look_up(forms: DataFrame, registry: DataFrame) -> DataFrame:
    """``forms`` with the entity that claims their key (null: none yet). A key has one claimant at most."""
    return forms.join(registry.select("key", "entity_id"), "key", "left")


def group_alone(unresolved: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Every name its own entity: the first of an id has it, others add the first eight characters of their key.

    With ``registry`` (entity_id) ids that are taken there count as had.
    """
    w = Window.partitionBy("_id").orderBy("ord")
    ids = unresolved.withColumn("_id", entity_id(F.col("name")))
    again = F.row_number().over(w) > 1
    if registry is not None:
        ids = ids.join(registry.select(F.col("entity_id").alias("_id"), F.lit(True).alias("_had")).distinct(), "_id", "left")
        again = again | F.coalesce("_had", F.lit(False))
    apart = entity_id(F.col("name"), F.substr(F.col("key"), F.lit(1), F.lit(8)))
    return ids.withColumn("entity_id", F.when(again, apart).otherwise(F.col("_id"))).drop("_id", "_had")


def alias_claims(mentions: DataFrame) -> DataFrame:
    """Which names claim which alias: alias_key, owner_key, first spelling. ``mentions``: ord, key, aliases (structs key, form). A name's own form is no alias."""
    each = mentions.select("ord", "key", F.posexplode("aliases").alias("at", "a")).filter(F.col("a.key") != F.col("key"))
    return each.groupBy(F.col("a.key").alias("alias_key"), F.col("key").alias("owner_key")).agg(F.min_by(F.col("a.form"), F.struct("ord", "at")).alias("form"))


def alias_owners(claims: DataFrame) -> DataFrame:
    """Claims of aliases (form, owner): how many owners each form has, and its owner where that is one."""
    return claims.groupBy("form").agg(F.count_distinct("owner").alias("n_owners"), F.min("owner").alias("_o")).select(
        "form", "n_owners", F.when(F.col("n_owners") == 1, F.col("_o")).alias("owner")
    )


def usable_aliases(claims: DataFrame, primaries: DataFrame) -> DataFrame:
    """Aliases with a single owner that are nobody's own name."""
    return alias_owners(claims).join(primaries.select("form"), "form", "left_anti").filter("n_owners = 1").select("form", "owner")


def apply_groups(unresolved: DataFrame, groups: DataFrame, registry: DataFrame) -> DataFrame:
    """Given groups (group, canonical, canonical_key, kind, forms (keys), same_as) of unresolved keys: key, entity_id, name, kind, registered, warning.

    Forms that are not unresolved do nothing; a group without any is dropped; ``same_as`` is the key of a form of the
    registry (key, entity_id, name, kind), and one that is unknown makes a new entity, with a warning. A
    registered entity keeps its name, and its kind unless unknown.
    """
    parts = groups.select("group", "canonical", "kind", "same_as", F.posexplode("forms").alias("at", "key")).join(unresolved.select("key"), "key", "left_semi")
    known = registry.select(F.col("key").alias("same_as"), F.col("entity_id").alias("_to"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    joined = parts.join(known, "same_as", "left")
    found = F.col("_to").isNotNull()
    # of several groups with one id the first has it
    fresh = joined.filter(~found).groupBy("group", "canonical").agg(F.min(F.struct("at", "key")).alias("f")).select("group", F.col("canonical").alias("name"), F.col("f.key").alias("key"), F.col("group").alias("ord"))
    made = group_alone(fresh, registry).select("group", F.col("entity_id").alias("_new"))
    both = joined.join(made, "group", "left")
    wished = F.coalesce("same_as", F.lit("")) != ""
    return both.select(
        "group", "key",
        F.coalesce("_to", "_new").alias("entity_id"), F.coalesce("_name", "canonical").alias("name"),
        F.when(found & (F.coalesce("_kind", F.lit("unknown")) != "unknown"), F.col("_kind")).otherwise(F.coalesce("kind", F.lit("unknown"))).alias("kind"),
        found.alias("registered"), F.when(wished & ~found, F.concat(F.lit("unknown registered name "), "same_as")).alias("warning"),
    )


def resolve(mentions: DataFrame, registry: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Names and aliases of all passes to entities: assignments (form_key, entity_id), entities (entity_id, name, kind, registered), dropped aliases, warnings (group, warning).

    ``mentions``: ord, name, key, kind, aliases (structs key, form). ``registry``: a row per form: key, entity_id, name,
    kind. What the registry knows is settled first; the rest by ``groups`` (names in none stay open), or each name alone. An alias is
    then judged on whether those who claim it became one entity.
    """
    names = gather(mentions)
    looked = look_up(names, registry)
    settled = looked.filter("entity_id is not null").select("key", "entity_id")
    first = mentions.groupBy("key").agg(F.min("ord").alias("ord"))
    unresolved = looked.filter("entity_id is null").drop("entity_id").join(first, "key")
    if groups is None:
        made = group_alone(unresolved, registry).select("key", "entity_id", "name", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.lit(False).alias("registered"))
        warnings = mentions.sparkSession.createDataFrame([], "group string, warning string")
    else:
        grouped = apply_groups(unresolved, groups, registry)
        made = grouped.select("key", "entity_id", "name", "kind", "registered")
        warnings = grouped.filter("warning is not null").select(F.col("group").cast("string").alias("group"), "warning").distinct()
    of_names = settled.union(made.select("key", "entity_id"))
    claims = alias_claims(mentions).join(of_names.select(F.col("key").alias("owner_key"), "entity_id"), "owner_key")
    claims = claims.join(registry.select(F.col("key").alias("alias_key")), "alias_key", "left_anti")
    owners = claims.join(names.select(F.col("key").alias("alias_key")), "alias_key", "left_anti").groupBy("alias_key").agg(
        F.count_distinct("entity_id").alias("n_owners"), F.min("entity_id").alias("entity_id"), F.min("form").alias("form")
    )
    usable = owners.filter("n_owners = 1").select(F.col("alias_key").alias("key"), "entity_id")
    assignments = of_names.union(usable).select(F.col("key").alias("form_key"), "entity_id")
    entities = made.groupBy("entity_id").agg(F.min("name").alias("name"), F.min("kind").alias("kind"), F.bool_or("registered").alias("registered"))
    return assignments, entities, owners.filter("n_owners > 1").select("alias_key", "form", "n_owners"), warnings
