"""Graph versions as documents: rendering, saving, reading back what a run was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import canonical_json, run_id, snapshot_id
from tessella.operators.validate import document_issues
from tessella.plans.store import Store

#: Version of the document's shape (fixed value).
DOCUMENT_VERSION = "1.0"


class SnapshotError(ValueError):
    """A document that is not sound, or names what is not there."""


def canonical_struct(value: Column) -> Column:
    """A struct as canonical JSON: without nulls, its keys in order."""
    return canonical_json(F.to_json(value))


def identified_run(run: DataFrame) -> DataFrame:
    """Runs (model, provider, prompt_version, prompt_sha256, pipeline_version, parameters as JSON, started_at) with their id, made of all of them."""
    fields = ["model", "provider", "prompt_version", "prompt_sha256", "pipeline_version", "parameters", "started_at"]
    return run.withColumn("run", run_id(canonical_struct(F.struct(*[F.col(f) for f in fields]))))


def with_snapshot_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("snapshot", snapshot_id(F.col("revision"), F.col("run")))


def rendered_evidence(evidence: DataFrame) -> DataFrame:
    """One array per edge (source, target): located pieces in order of passage, then the rest by quotation. ``evidence``: source, target, passage, document, chain, exact, prefix, suffix, note."""
    locator = F.struct(F.col("document").alias("document_id"), F.col("chain").alias("path"))
    selector = F.struct("exact", F.nullif("prefix", F.lit("")).alias("prefix"), F.nullif("suffix", F.lit("")).alias("suffix"))
    item = F.struct(F.col("passage").isNull().alias("loose"), "passage", "exact", F.struct(F.when(F.col("document").isNotNull() | F.col("chain").isNotNull(), locator).alias("locator"), selector.alias("selector"), "note").alias("piece"))
    grouped = evidence.groupBy("source", "target").agg(F.collect_list(item).alias("e"))
    ordered = F.array_sort("e", lambda x, y: F.when(_before(x, y), -1).when(_before(y, x), 1).otherwise(0))
    return grouped.select("source", "target", F.transform(ordered, lambda x: x["piece"]).alias("evidence"))


def _before(x: Column, y: Column) -> Column:
    place = lambda e: F.struct(e["loose"], F.coalesce(e["passage"], F.lit(0)), e["exact"])
    return place(x) < place(y)


def rendered_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges as the document shows them, heaviest first: snapshot, ord, relation."""
    joined = edges.join(rendered_evidence(evidence), ["source", "target"], "left")
    fields = [F.col(c) for c in ("id", "source", "target", "weight", "weight_basis", "types", "provenance")]
    return joined.select("id", "weight", F.struct(*fields, "evidence").alias("relation"))


def build_document(head: DataFrame, nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per snapshot: snapshot, document (JSON without nulls), sha256 of its canonical form.

    ``head``: snapshot, work, title, collection, collection_name, revision, revision_sha256, run, model, prompt_version, prompt_sha256,
    parameters, created_at. ``nodes``: snapshot, id, name, kind, provenance, review_status, aliases, notes. ``edges``: snapshot,
    relation (observed ones first: ord). ``documents``: revision, position, document, role, sha256, path. The document of a
    snapshot is one value, as the published form is.
    """
    node = F.struct("name", "id", F.struct("id", "name", "kind", "provenance", "review_status", F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases"), F.nullif("notes", F.lit("")).alias("notes")).alias("n"))
    n = nodes.groupBy("snapshot").agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"]).alias("characters"))
    e = edges.groupBy("snapshot").agg(F.array_agg(F.struct("ord", "relation")).alias("e"))
    e = e.select("snapshot", F.transform(F.array_sort("e", lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)), lambda x: x["relation"]).alias("relations"))
    d = documents.groupBy("revision").agg(F.array_sort(F.collect_list(F.struct("position", F.struct(F.col("document").alias("id"), "role", "sha256", "path").alias("d")))).alias("d"))
    d = d.select("revision", F.transform("d", lambda x: x["d"]).alias("documents"))
    joined = head.join(n, "snapshot", "left").join(e, "snapshot", "left").join(d, "revision", "left")
    empty = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    body = F.to_json(
        F.struct(
            F.lit(DOCUMENT_VERSION).alias("schema_version"), F.struct(F.col("collection").alias("id"), F.col("collection_name").alias("name")).alias("collection"),
            F.array(F.struct(F.col("work").alias("id"), "title")).alias("works"), "documents",
            F.array(F.struct(F.col("revision").alias("id"), F.col("work").alias("work_id"), F.col("revision_sha256").alias("sha256"))).alias("text_revisions"),
            F.array(F.struct(F.col("run").alias("id"), "model", "prompt_version", "prompt_sha256", "parameters")).alias("analysis_runs"),
            F.struct(F.col("snapshot").alias("id"), F.col("work").alias("work_id"), F.col("revision").alias("text_revision_id"), F.col("run").alias("analysis_run_id"), "created_at").alias("snapshot"),
        )
    )
    whole = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"characters":'), empty(F.col("characters")), F.lit(',"relations":'), empty(F.col("relations")), F.lit("}"))
    return joined.select("snapshot", "work", "revision", "run", "created_at", whole.alias("document")).withColumn("sha256", F.sha2(canonical_json(F.col("document")).cast("binary"), 256))


def save_snapshot(store: Store, built: DataFrame, runs: DataFrame, nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> None:
    """Stores documents that are sound; one issue anywhere and nothing is stored. ``nodes`` and ``edges`` are those the documents were built of."""
    found = document_issues(nodes, edges, documents).limit(5).collect()
    if found:
        raise SnapshotError("; ".join(f"{r['kind']} {r['path']}: {r['what']}" for r in found))
    store.upsert("runs", runs, ["run"])
    store.insert_snapshot(built.select(F.col("snapshot").alias("id"), "sha256", "work", "revision", "run", "created_at", "document"))
