"""Versions over two axes, and the registry of entities across works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def configuration_digest(runs: DataFrame, fields: list[str]) -> DataFrame:
    """``runs`` with ``configuration``: twelve hex digits of the fields that decide what an analysis does."""
    body = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]))
    return runs.withColumn("configuration", F.substr(F.sha2(body.cast("binary"), 256), F.lit(1), F.lit(12)))


def grid(rows: DataFrame, columns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every cell of revisions by configurations, empty ones included. Both axes are short lists by nature."""
    cells = rows.select("revision").distinct().crossJoin(columns.select("configuration").distinct())
    found = snapshots.groupBy("revision", "configuration").agg(F.count("*").alias("n"), F.max("snapshot").alias("newest"))
    return cells.join(found, ["revision", "configuration"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def newest(snapshots: DataFrame, *keys: str) -> DataFrame:
    """The newest snapshot per key, by time and then sequence number."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("seq"))
    return snapshots.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def appearances(entities: DataFrame, members: DataFrame) -> DataFrame:
    """For each entity the works whose newest snapshot has it, none included: id, n_works, total degree."""
    per = members.groupBy("id").agg(F.count_distinct("work").alias("n_works"), F.sum("degree").alias("degree"))
    return entities.select("id").join(per, "id", "left").select("id", F.coalesce("n_works", F.lit(0)).cast("long").alias("n_works"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def spanning(found: DataFrame) -> DataFrame:
    return found.filter("n_works > 1")


def unanalysed(works: DataFrame, snapshots: DataFrame) -> DataFrame:
    return works.join(snapshots.select("work"), "work", "left_anti")


def captions(readings: DataFrame, name: str, key: str) -> DataFrame:
    """``readings`` with a label: the name, and six digits of the key where the name repeats."""
    several = F.count("*").over(Window.partitionBy(name)) > 1
    return readings.withColumn("label", F.when(several, F.concat(F.col(name), F.lit(" "), F.substr(F.col(key), F.lit(1), F.lit(6)))).otherwise(F.col(name)))


def runs_of(work: str, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that made a snapshot of the work, each once, by their start and then their sequence number."""
    return runs.join(snapshots.filter(F.col("work") == work).select("run").distinct(), "run", "left_semi").orderBy("started_at", "seq")


def lineage_rows(work: str, revisions: DataFrame, members: DataFrame, snapshots: DataFrame, runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A work's two axes and what lies on them: revisions with their number of documents, runs, snapshots with their nodes and edges. Oldest first."""
    mine = revisions.filter(F.col("work") == work)
    counted = members.groupBy(F.col("version").alias("revision")).agg(F.count("*").alias("n_documents"))
    rows = mine.join(counted, "revision", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)).cast("long")).orderBy("created_at", "seq")
    sizes = lambda t, name: t.groupBy("snapshot").agg(F.count("*").alias(name))
    own = snapshots.filter(F.col("work") == work).join(sizes(nodes, "n_nodes"), "snapshot", "left").join(sizes(edges, "n_edges"), "snapshot", "left")
    filled = own.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_nodes", "n_edges")})
    return rows, runs_of(work, snapshots, runs), filled.orderBy("created_at", "seq")


def column_order(runs: DataFrame) -> DataFrame:
    """Configurations in the order of their first run: configuration, place from 0."""
    first = runs.groupBy("configuration").agg(F.min(F.struct("started_at", "seq")).alias("first"))
    return first.select("configuration", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("place"))


def orphans(rows: DataFrame, columns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots that lie on no cell of the grid, since their revision or configuration is not known."""
    on_row = snapshots.join(rows.select("revision").distinct(), "revision", "left_semi")
    on_grid = on_row.join(columns.select("configuration").distinct(), "configuration", "left_semi")
    return snapshots.join(on_grid.select("snapshot"), "snapshot", "left_anti")


def pair_difference(a_revision: Column, b_revision: Column, a_run: Column, b_run: Column) -> Column:
    """What sets two readings apart, as a sentence."""
    text, run = ~a_revision.eqNullSafe(b_revision), ~a_run.eqNullSafe(b_run)
    return (
        F.when(text & run, "different text, different analysis: neither can be credited")
        .when(text, "different text, same analysis")
        .when(run, "same text, different analysis")
        .otherwise("same text, same analysis")
    )


def has_history(snapshots: DataFrame) -> bool:
    """Whether there are two readings to compare."""
    return snapshots.limit(2).count() > 1


def registry(entities: DataFrame, works: DataFrame, snapshots: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name) across works, and the works that were never analysed.

    Of each work only the newest snapshot counts. Columns: id, name, n_works, degree, works (work and degree there), the most
    widespread first. An entity in no work is kept.
    """
    last = newest(snapshots, "work").select("work", "snapshot")
    inside = nodes.join(last, "snapshot").select("work", "snapshot", "id")
    ends = edges.join(last, "snapshot").select("work", F.explode(F.array("source", "target")).alias("id")).groupBy("work", "id").agg(F.count("*").alias("degree"))
    at = inside.join(ends, ["work", "id"], "left").select("id", "work", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    per = at.groupBy("id").agg(F.count("*").alias("n_works"), F.sum("degree").alias("degree"), F.array_sort(F.collect_list(F.struct("work", "degree"))).alias("works"))
    joined = entities.join(per, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_works", "degree")})
    return joined.orderBy(F.desc("n_works"), "name", "id"), unanalysed(works, snapshots)


def newest_of_project(snapshots: DataFrame) -> str | None:
    row = snapshots.orderBy(F.desc("created_at"), F.desc("snapshot")).limit(1).collect()
    return row[0]["snapshot"] if row else None


def status(works: DataFrame, revisions: DataFrame, snapshots: DataFrame, entities: DataFrame) -> DataFrame:
    """Per work: revisions, snapshots, newest snapshot, entities of its collection that stand."""
    n = lambda t, name: t.groupBy("work").agg(F.count("*").alias(name))
    last = snapshots.groupBy("work").agg(F.max_by("snapshot", F.struct("created_at", "snapshot")).alias("newest"))
    size = entities.filter("merged_into is null").groupBy("collection").agg(F.count("*").alias("n_entities"))
    joined = works.join(n(revisions, "n_revisions"), "work", "left").join(n(snapshots, "n_snapshots"), "work", "left").join(last, "work", "left").join(size, "collection", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_revisions", "n_snapshots", "n_entities")})


#: The order in which each table is listed (fixed values).
ORDERS = {
    "works": ["title", "work"], "collections": ["name", "collection"], "entities": ["name", "id"], "revisions": ["created_at", "seq"], "snapshots": ["created_at", "seq"],
}


def listed(table: str, rows: DataFrame, **of) -> DataFrame:
    """A table in its order, with rows of some values only where asked; retired entities are left out."""
    for column, value in of.items():
        rows = rows.filter(F.col(column) == value)
    if "merged_into" in rows.columns:
        rows = rows.filter("merged_into is null")
    return rows.orderBy(*ORDERS[table])


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("created_at"), "snapshot")


def entity_of_form(forms: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (collection, form_key) with the entity that has the form."""
    return asked.join(forms.select("collection", "form_key", "entity_id"), ["collection", "form_key"], "left")


def work_at(works: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` (root) with the work that was last read from there; of several the lowest id."""
    return roots.join(works.groupBy("root").agg(F.min("work").alias("work")), "root", "left")


def settings_under(settings: DataFrame, prefix: str) -> DataFrame:
    """Settings (name, value as JSON) whose names begin so, with their values as variants."""
    return settings.filter(F.col("name").startswith(prefix)).select("name", F.try_parse_json("value").alias("value"))


def settings_like(snapshots: DataFrame, runs: DataFrame, snapshot: str, override: dict | None = None) -> tuple[dict, list[str]]:
    """What the run of a snapshot was asked to do (effort, target_characters, max_rejection_rate), and what ``override`` puts in its place."""
    run = snapshots.filter(F.col("snapshot") == snapshot).join(runs.select("run", "parameters"), "run").limit(1)
    v = F.try_parse_json("parameters")
    kinds = {"effort": "string", "target_characters": "int", "max_rejection_rate": "double"}
    rows = run.select(*[F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in kinds.items()]).collect()
    if not rows:
        raise ValueError(f"there is no snapshot {snapshot} with a run")
    held = rows[0].asDict()
    told = [f"{k}: {override[k]} in place of {held[k]}" for k in kinds if override and k in override and override[k] != held[k]]
    return held | {k: v for k, v in (override or {}).items() if k in kinds}, told


def structure_roots(maps: DataFrame) -> DataFrame:
    """Every folder (root) with confirmed answers, in order; ``maps``: root, path, plan as JSON, confirmed_at."""
    return maps.select("root").distinct().orderBy("root")


def structure_maps(maps: DataFrame, roots: DataFrame) -> DataFrame:
    """Per asked folder (root) its confirmed answers as a map of path to plan; an empty map where nobody has been asked."""
    plans = maps.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.try_parse_json("plan").cast("string").alias("plan"))))).alias("plans"))
    return roots.join(plans, "root", "left").withColumn("plans", F.coalesce("plans", F.create_map().cast("map<string,string>")))
