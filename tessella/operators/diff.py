"""Comparison of two graph versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribution(text_changed: Column, analysis_changed: Column) -> Column:
    """What a difference can be due to."""
    return F.when(text_changed & analysis_changed, "both").when(text_changed, "text").when(analysis_changed, "analysis").otherwise("same")


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes (ord, id, key, forms) that came or went.

    A node that went is merged if its own folded name is a form of a later node, a node that came is split
    if its name is a form of an earlier node that is still there. Counterparts are in order.
    """
    forms = lambda nodes: nodes.select("ord", F.col("id").alias("other"), F.explode(F.array_distinct(F.concat(F.array("key"), "forms"))).alias("form"))

    def side(nodes: DataFrame, others: DataFrame, plain: str, found: str) -> DataFrame:
        met = nodes.join(forms(others).select("other", F.col("ord").alias("at"), "form"), F.col("key") == F.col("form"), "left")
        group = met.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("other").isNotNull(), F.struct("at", "other")))).alias("c"))
        return group.select("id", F.when(F.size("c") > 0, found).otherwise(plain).alias("change"), F.transform("c", lambda x: x["other"]).alias("counterparts"))

    gone = before.join(after.select("id"), "id", "left_anti")
    new = after.join(before.select("id"), "id", "left_anti")
    still = before.join(after.select("id"), "id", "left_semi")
    return side(gone, after, "removed", "merged").union(side(new, still, "added", "split"))


def redirect(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """``edges`` with ends moved along ``merges`` (from_id, to_id)."""
    a = merges.select(F.col("from_id").alias("source"), F.col("to_id").alias("_a"))
    b = merges.select(F.col("from_id").alias("target"), F.col("to_id").alias("_b"))
    moved = edges.join(a, "source", "left").join(b, "target", "left")
    return moved.withColumn("source", F.coalesce("_a", "source")).withColumn("target", F.coalesce("_b", "target")).drop("_a", "_b").select(*edges.columns)


def keyed(edges: DataFrame, *extra: str) -> DataFrame:
    """One edge per unordered pair: the last by ``ord``. With ``extra`` ("provenance") the key takes that in too."""
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), *extra]
    return edges.groupBy(*pair).agg(F.max_by(F.struct("weight", "types", "weight_basis"), "ord").alias("e"))


def edge_changes(before: DataFrame, after: DataFrame, merges: DataFrame | None = None, comparable: bool = True) -> DataFrame:
    """Pairs that came, went, changed weight (where bases are comparable) or types. One row may hold two kinds; others are left out."""
    if merges is not None:
        before = redirect(before, merges)
    x, y = keyed(before).withColumnRenamed("e", "x"), keyed(after).withColumnRenamed("e", "y")
    wx, wy = F.col("x.weight"), F.col("y.weight")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    types = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(f"{c}.types"), F.array().cast("array<string>"))))
    changes = F.array_compact(
        F.array(
            F.when(F.col("y").isNull(), "removed"), F.when(F.col("x").isNull(), "added"),
            F.when(both & F.lit(comparable) & (wy > wx), "strengthened"), F.when(both & F.lit(comparable) & (wy < wx), "weakened"),
            F.when(both & (types("x") != types("y")), "retyped"),
        )
    )
    joined = x.join(y, ["a", "b"], "full")
    return joined.select("a", "b", changes.alias("changes"), wx.alias("before_weight"), wy.alias("after_weight")).filter(F.size("changes") > 0)


def leading_change(changes: Column) -> Column:
    """The change that decides how an edge is drawn."""
    order = ["removed", "added", "weakened", "strengthened", "retyped"]
    return F.coalesce(*[F.when(F.array_contains(changes, c), c) for c in order], F.get(changes, F.lit(0)))


def overlay_union(before: DataFrame, after: DataFrame) -> DataFrame:
    """All of ``after``, and of ``before`` the pairs that are no more."""
    pair = lambda e: e.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    old = pair(before).join(pair(after).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")
    return after.withColumn("only_before", F.lit(False)).unionByName(old.withColumn("only_before", F.lit(True)))


def unchanged(edges: DataFrame, changes: DataFrame) -> DataFrame:
    keyed_edges = edges.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    return keyed_edges.join(changes.select("a", "b"), ["a", "b"], "left_anti")


def change_sentences(changes: DataFrame, names: DataFrame) -> DataFrame:
    """Changes with names, and weights with two decimals unless whole."""
    number = lambda w: F.when(w == F.floor(w), F.format_string("%d", w.cast("long"))).otherwise(F.format_string("%.2f", w.cast("double")))
    a, b = names.select(F.col("id").alias("a"), F.col("name").alias("a_name")), names.select(F.col("id").alias("b"), F.col("name").alias("b_name"))
    named = changes.join(a, "a", "left").join(b, "b", "left")
    return named.select(
        "a", "b",
        F.concat_ws(" ", F.coalesce("a_name", F.col("a").cast("string")), F.lit("and"), F.coalesce("b_name", F.col("b").cast("string")), F.concat(F.array_join("changes", ", "), F.lit(":")),
                    F.coalesce(number(F.col("before_weight")), F.lit("none")), F.lit("to"), F.coalesce(number(F.col("after_weight")), F.lit("none"))).alias("sentence"),
    )
