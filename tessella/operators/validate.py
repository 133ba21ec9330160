"""Checks of graph versions: duplicates, references, self-relations, shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.scratch import stored


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference (not null) leads nowhere."""
    return rows.filter(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)), column, "left_anti")


def self_relations(edges: DataFrame) -> DataFrame:
    return edges.filter("source = target")


def shape_issues(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """One row per failed check: the keys and the check's name. Checks are conditions that hold for a sound row."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(*keys, F.explode(failed).alias("issue"))


def edge_checks() -> dict[str, Column]:
    """What the published document asks of an edge."""
    c = F.col
    return {
        "id": F.length(c("id")).between(1, 512),
        "weight": c("weight") >= 0,
        "basis": c("weight_basis").isNotNull(),
        "provenance": c("provenance").isin("observed", "asserted", "human"),
        "confidence": c("confidence").isNull() | c("confidence").between(0, 1),
    }


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All issues of one version's nodes and edges: kind, id. References are only judged where ids are sound."""
    twice = [duplicates(t, "id").select(F.lit("duplicate").alias("kind"), "id") for t in (nodes, edges)]
    ends = [dangling(edges, e, nodes, "id").select(F.lit("reference").alias("kind"), "id") for e in ("source", "target")] if "id" in edges.columns else []
    loops = self_relations(edges).select(F.lit("reference").alias("kind"), "id")
    return reduce(DataFrame.unionByName, [*twice, *ends, loops]).distinct()


def _nodes_shape() -> dict[str, Column]:
    c = F.col
    return {
        "id": c("id").rlike(r"^\S.*$"), "name": F.length(F.trim("name")) > 0, "kind": c("kind").isNull() | c("kind").isin("person", "collective", "entity", "unknown"),
        "provenance": c("provenance").isin("observed", "asserted", "human"), "review_status": c("review_status").isNull() | c("review_status").isin("proposed", "accepted", "corrected", "rejected"),
        "aliases": c("aliases").isNull() | ~F.exists("aliases", lambda x: x.isNull() | (F.trim(x) == "")),
    }


def _edges_shape() -> dict[str, Column]:
    c = F.col
    return edge_checks() | {
        "source": F.length("source") > 0, "target": F.length("target") > 0, "types": c("types").isNull() | ~F.exists("types", lambda x: x.isNull() | (x == "")),
        "evidence": c("evidence").isNull() | ~F.exists("evidence", lambda e: e["exact"].isNull() | (F.trim(e["exact"]) == "")),
    }


def document_issues(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """All issues of graph versions, by path: snapshot, kind (schema, duplicate, reference), path, what.

    ``nodes``: snapshot, ord, id, name, kind, provenance, review_status, aliases. ``edges``: snapshot, ord, id, source, target, weight,
    weight_basis, types, provenance, confidence, evidence (structs document, exact). ``documents``: snapshot, document. A version whose shape is not sound is
    judged on its shape only; evidence is held against documents only where the version names any.
    """
    at = lambda part, field: F.concat(F.lit(f"/{part}/"), F.col("ord").cast("string"), F.lit("/"), field)
    shape = [shape_issues(t, checks, "snapshot", "ord").select("snapshot", F.lit("schema").alias("kind"), at(part, F.col("issue")).alias("path"), F.lit("does not fit").alias("what"))
             for t, checks, part in ((nodes, _nodes_shape(), "characters"), (edges, _edges_shape(), "relations"))]
    shape = shape[0].unionByName(shape[1])
    sound = lambda t: t.join(shape.select("snapshot").distinct(), "snapshot", "left_anti")
    n, e = sound(nodes), sound(edges)
    twice = [
        t.groupBy("snapshot", "id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("ord")).alias("o")).filter("n > 1")
        .select("snapshot", F.lit("duplicate").alias("kind"), F.concat(F.lit(f"/{part}/"), F.element_at("o", 2).cast("string"), F.lit("/id")).alias("path"), F.col("id").alias("what"))
        for t, part in ((n, "characters"), (e, "relations"))
    ]
    ids = n.select("snapshot", F.col("id").alias("end")).distinct()
    ends = [
        e.withColumn("end", F.col(side)).join(ids, ["snapshot", "end"], "left_anti").select("snapshot", F.lit("reference").alias("kind"), at("relations", F.lit(side)).alias("path"), F.col("end").alias("what"))
        for side in ("source", "target")
    ]
    loops = e.filter("source = target").select("snapshot", F.lit("reference").alias("kind"), at("relations", F.lit("target")).alias("path"), F.lit("relates an entity to itself").alias("what"))
    pieces = e.select("snapshot", "ord", F.posexplode("evidence").alias("i", "piece")).select("snapshot", "ord", "i", F.col("piece.document").alias("document")).filter("document is not null")
    judged = pieces.join(documents.select("snapshot").distinct(), "snapshot", "left_semi").join(documents.select("snapshot", "document"), ["snapshot", "document"], "left_anti")
    lost = judged.select("snapshot", F.lit("reference").alias("kind"), at("relations", F.concat(F.lit("evidence/"), F.col("i").cast("string"))).alias("path"), F.col("document").alias("what"))
    return reduce(DataFrame.unionByName, [shape, *twice, *ends, loops, lost])


def issue_counts(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """:func:`document_issues` counted, for graphs with very many edges: snapshot, kind, what, n.

    Rows are counted where they are, and what is known of few (ends, documents, snapshots) is looked up afterwards. Of the edges only a hash of the
    id moves; ids are compared themselves where two hashes are equal.
    """
    parts = ((nodes, _nodes_shape()), (edges, _edges_shape()))
    failed = lambda checks: reduce(lambda a, b: a + b, [F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1) for ok in checks.values()])
    shape = [t.groupBy("snapshot").agg(F.sum(failed(checks).cast("long")).alias("n")) for t, checks in parts]
    shape = stored(shape[0].union(shape[1]).groupBy("snapshot").agg(F.sum("n").alias("n")).filter("n > 0"))
    sound = lambda t: t.join(shape.select("snapshot"), "snapshot", "left_anti")
    told = lambda t, kind, what: t.select("snapshot", F.lit(kind).alias("kind"), what.alias("what"), F.col("n").cast("long").alias("n"))
    twice = [sound(_repeated(t)) for t in (nodes, edges)]
    ids = nodes.select("snapshot", F.col("id").alias("end")).distinct()
    ends = [edges.groupBy("snapshot", F.col(side).alias("end")).agg(F.count("*").alias("n")) for side in ("source", "target")]
    lost_ends = sound(ends[0].union(ends[1]).join(ids, ["snapshot", "end"], "left_anti"))
    loops = sound(edges.filter("source = target").groupBy("snapshot").agg(F.count("*").alias("n")))
    pieces = edges.select("snapshot", F.explode("evidence").alias("piece")).select("snapshot", F.col("piece.document").alias("document")).filter("document is not null")
    counted = sound(pieces.groupBy("snapshot", "document").agg(F.count("*").alias("n")))
    lost = counted.join(documents.select("snapshot").distinct(), "snapshot", "left_semi").join(documents.select("snapshot", "document"), ["snapshot", "document"], "left_anti")
    found = [
        told(shape, "schema", F.lit("does not fit")), *[told(t.withColumn("n", F.lit(1)), "duplicate", F.col("id")) for t in twice],
        told(lost_ends, "reference", F.col("end")), told(loops, "reference", F.lit("relates an entity to itself")), told(lost, "reference", F.col("document")),
    ]
    return reduce(DataFrame.union, found).groupBy("snapshot", "kind", "what").agg(F.sum("n").alias("n"))


def _repeated(rows: DataFrame) -> DataFrame:
    """snapshot, id: the ids that a snapshot has more than once."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = rows.select("snapshot", "id", F.xxhash64("snapshot", "id").alias("h"))
    suspect = stored(hashed.select("h").repartition(partitions, "h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    return hashed.join(suspect, "h", "left_semi").groupBy("snapshot", "id").agg(F.count("*").alias("n")).filter("n > 1").select("snapshot", "id")


def axis_issues(snapshots: DataFrame, works: DataFrame, revisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshots (snapshot, work, revision, run) that name a work, revision or run that is not there: snapshot, axis, what."""
    tables = {"work": works, "revision": revisions, "run": runs}
    each = [dangling(snapshots, a, t, a).select("snapshot", F.lit(a).alias("axis"), F.col(a).alias("what")) for a, t in tables.items()]
    return reduce(DataFrame.unionByName, each)
