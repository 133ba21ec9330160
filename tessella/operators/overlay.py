"""Human decisions over graph versions: latest-wins logs, redirects through merges, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import edge_ends, edge_id
from tessella.plans.scratch import stored


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row under each key. ``order`` must be total (time, then sequence number)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def _followed(steps: DataFrame, longest: int) -> DataFrame:
    """``steps`` (from_id, to_id) followed for ``longest`` steps or to their ends, in rounds that double their length."""
    now, length = stored(steps), 1
    while length < longest:
        on = now.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_next"))
        new = stored(now.join(on, "to_id", "left").select("from_id", F.coalesce("_next", "to_id").alias("to_id")))
        open_ = new.join(steps.select(F.col("from_id").alias("to_id")), "to_id", "left_semi")
        now, length = new, 2 * length
        if not open_.limit(1).count():
            break
    return now


def merge_closure(merges: DataFrame) -> DataFrame:
    """Where each merged id (from_id, to_id; one row per from_id) ends up, over any chain.

    An id on a cycle ends at itself, and a chain that runs into a cycle at the id where it meets it.
    """
    steps = stored(merges.select("from_id", "to_id").filter("from_id <> to_id"))
    ends = _followed(steps, steps.count())
    # after as many steps as there are merges, who still has a step ahead stands on a cycle, and each id of it is stood on
    cycle = ends.join(steps.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("from_id")).distinct()
    if cycle.limit(1).count():
        cycle = stored(cycle)
        open_ = stored(steps.join(cycle, "from_id", "left_anti"))
        ends = _followed(open_, max(1, open_.count())).union(cycle.select("from_id", F.col("from_id").alias("to_id")))
    return ends.select("from_id", "to_id")


def redirected(log: DataFrame, closure: DataFrame, column: str) -> DataFrame:
    """``log`` with ids in ``column`` moved along ``closure``, before any folding."""
    c = closure.select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    return log.join(c, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(*log.columns)


def redirected_edge_ids(log: DataFrame, closure: DataFrame, column: str) -> DataFrame:
    """The same for ids of edges, through their ends. An edge whose ends become one keeps its id."""
    ends = edge_ends(F.col(column))
    parts = log.withColumn("_s", ends["source"]).withColumn("_t", ends["target"]).withColumn("_p", ends["provenance"])
    moved = redirected(redirected(parts, closure, "_s"), closure, "_t")
    built = edge_id(F.col("_s"), F.col("_t"), F.col("_p"))
    return moved.withColumn(column, F.when(F.col("_s").isNull() | (F.col("_s") == F.col("_t")), F.col(column)).otherwise(built)).select(*log.columns)


def with_status(subjects: DataFrame, standing: DataFrame) -> DataFrame:
    """Subjects (kind, id, declared) with the standing decision, else what they declare, else ``proposed``."""
    s = standing.select("kind", "id", F.col("status").alias("_s"))
    return subjects.join(s, ["kind", "id"], "left").withColumn("status", F.coalesce("_s", "declared", F.lit("proposed"))).drop("_s")


def status_counts(rows: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """Rows per key and status, zeros included. ``vocabulary`` is the small table of statuses."""
    counted = rows.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    axes = rows.select(*keys).distinct().crossJoin(vocabulary.select("status")) if keys else vocabulary.select("status")
    return axes.join(counted, [*keys, "status"], "left").select(*keys, "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def apply_corrections(subjects: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """Subjects with their latest corrections: an empty value takes the field away; provenance and status say so.

    ``corrections``: id, field, value, was (latest per id and field).
    """
    wide = corrections.groupBy("id").agg(
        *[F.max(F.when(F.col("field") == f, F.struct(F.nullif("value", F.lit("")).alias("value")))).alias(f"_{f}") for f in fields]
    )
    joined = subjects.join(wide, "id", "left")
    touched = F.lit(False)
    for f in fields:
        touched = touched | F.col(f"_{f}").isNotNull()
    values = [F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value").cast(subjects.schema[f].dataType)).otherwise(F.col(f)).alias(f) for f in fields]
    rest = [F.col(c) for c in subjects.columns if c not in fields and c != "provenance"]
    provenance = [F.when(touched, "human").otherwise(F.col("provenance")).alias("provenance")] if "provenance" in subjects.columns else []
    return joined.select(*rest, *values, *provenance, F.when(touched, "corrected").alias("review_status"))


def correction_conflicts(subjects: DataFrame, corrections: DataFrame, held: dict[str, Column]) -> DataFrame:
    """Corrections whose subject now says something else than when they were made."""
    now = F.coalesce(*[F.when(F.col("field") == f, c.cast("string")) for f, c in held.items()])
    return corrections.join(subjects, "id").select("id", "field", "was", now.alias("proposed")).filter("not (was <=> proposed)")


def missing_subjects(subjects: DataFrame, corrections: DataFrame) -> DataFrame:
    return corrections.join(subjects.select("id"), "id", "left_anti")
