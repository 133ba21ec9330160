"""Aggregation of claims about pairs into weighted, evidenced edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import edge_id, normalise_whitespace
from tessella.operators import pairs
from tessella.plans.scratch import stored


def resolved(claims: DataFrame, assignments: DataFrame) -> DataFrame:
    """``claims`` with ``source`` and ``target`` ids of the folded names ``first_key`` and ``second_key`` (null: unknown).

    ``assignments`` has form_key and entity_id, one row per key.
    """
    a = assignments.select(F.col("form_key").alias("first_key"), F.col("entity_id").alias("source"))
    b = assignments.select(F.col("form_key").alias("second_key"), F.col("entity_id").alias("target"))
    return claims.join(a, "first_key", "left").join(b, "second_key", "left")


def refused(claims: DataFrame) -> DataFrame:
    """Resolved claims that make no edge, with the reason."""
    reason = F.when(F.col("source").isNull() | F.col("target").isNull(), "unresolved").when(F.col("source") == F.col("target"), "one entity")
    return claims.withColumn("reason", reason).filter("reason is not null")


def passage_key() -> Column:
    """The passage where it is known, else the quotation itself, so that no key is null."""
    return F.coalesce(F.concat(F.lit("p"), F.col("passage").cast("string")), F.concat(F.lit("q"), normalise_whitespace(F.col("quotation"))))


def evidence(claims: DataFrame) -> DataFrame:
    """One row per unordered pair and passage: the first claim there (by ``ord``), with all types claimed there.

    ``claims``: ord, source, target, passage, quotation, types. This, not a nested list, is the form that
    scales with a pair that half of all claims are about.
    """
    usable = claims.filter(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
    keyed = usable.select(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), passage_key().alias("passage_key"),
        "ord", "passage", "quotation", "types",
    )
    first = F.min(F.struct("ord", "passage", "quotation")).alias("first")
    return keyed.groupBy("source", "target", "passage_key").agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))


def aggregate_claims(claims: DataFrame, basis: str, provenance: str = "observed") -> DataFrame:
    """Edges: weight is the number of distinct passages; types are sorted."""
    found = evidence(claims)
    edges = found.groupBy("source", "target").agg(
        F.count("*").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types")
    )
    named = edge_id(F.col("source").cast("string"), F.col("target").cast("string"), F.lit(provenance))
    return edges.select(named.alias("id"), "source", "target", "weight", F.lit(basis).alias("weight_basis"), F.lit(provenance).alias("provenance"), "types")


def nested_evidence(found: DataFrame) -> DataFrame:
    """Each edge's evidence as one array: located passages in order, then the rest by quotation."""
    item = F.struct(F.col("first.passage").isNull().alias("loose"), F.col("first.passage").alias("passage"), F.col("first.quotation").alias("quotation"))
    return found.groupBy("source", "target").agg(F.sort_array(F.collect_list(item)).alias("evidence"))


def heaviest(edges: DataFrame, n: int = 1) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "id").limit(n)


def shared_basis(edges: DataFrame, *keys: str) -> DataFrame:
    """The one basis of each group's weights, null where there are several: only then may weights be compared."""
    return edges.groupBy(*keys).agg(F.when(F.count_distinct("weight_basis") == 1, F.max("weight_basis")).alias("basis"), F.count_distinct("weight_basis").alias("n_bases"))


def require_one_basis(edges: DataFrame) -> str | None:
    """The basis of all weights; an error where they are of several."""
    found = [r[0] for r in edges.select("weight_basis").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"weights of different bases cannot be compared: {', '.join(sorted(found))}")
    return found[0] if found else None


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at each node, none included."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def filtered(edges: DataFrame, least: float | None = None, types: list[str] = (), provenances: list[str] = ()) -> DataFrame:
    """Edges that pass; an empty list has no opinion. An edge without types fails any wish for types."""
    keep = F.lit(True)
    if least is not None:
        keep = keep & (F.col("weight") >= least)
    if types:
        keep = keep & F.arrays_overlap(F.coalesce("types", F.array().cast("array<string>")), F.array(*map(F.lit, types)))
    if provenances:
        keep = keep & F.col("provenance").isin(*provenances)
    return edges.filter(keep)


def drawable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def shown_nodes(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Nodes that stay in view: those with a kept edge, and those that had no edge to begin with."""
    had, have = degrees(nodes, edges).withColumnRenamed("degree", "had"), degrees(nodes, kept).withColumnRenamed("degree", "degree")
    return had.join(have, "id").filter("degree > 0 or had = 0").select("id", "degree")


def sqrt_scale(value: Column, most: Column, low: float, high: float) -> Column:
    return F.when((value <= 0) | (most <= 0) | value.isNull() | most.isNull(), F.lit(float(low))).otherwise(low + (high - low) * F.sqrt(F.least(value / most, F.lit(1.0))))


def widths(edges: DataFrame) -> DataFrame:
    """Line widths 1 to 14 by the square root of the weight's share of the largest of its basis."""
    most = F.max("weight").over(Window.partitionBy("weight_basis"))
    return edges.withColumn("width", sqrt_scale(F.col("weight"), most, 1, 14))


def declared_and_enacted(edges: DataFrame) -> DataFrame:
    """Pairs that reference text asserts, narrative shows, or both. ``edges`` have ord and provenance; the first of a side counts."""
    keyed = edges.filter(F.col("provenance").isin("asserted", "observed")).select(
        F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "provenance", "ord", "weight"
    )
    first = lambda p: F.min_by(F.when(F.col("provenance") == p, F.col("weight")), F.when(F.col("provenance") == p, F.col("ord")))
    both = keyed.groupBy("a", "b").agg(
        first("asserted").alias("declared"), first("observed").alias("enacted"),
        F.bool_or(F.col("provenance") == "asserted").alias("is_declared"), F.bool_or(F.col("provenance") == "observed").alias("is_enacted"),
    )
    finding = F.when(~F.col("is_enacted"), "declared_only").when(~F.col("is_declared"), "enacted_only").otherwise("agreed")
    return both.select("a", "b", finding.alias("finding"), "declared", "enacted")


def declared_within(members: DataFrame, enacted: DataFrame) -> DataFrame:
    """:func:`declared_and_enacted` where all pairs of members (id, home) that share a home are declared, with weight 1.

    ``enacted`` has source, target and weight, a row per pair. It goes to the cells of the declared pairs and what it has of them is left out
    there, so that no declared pair is shuffled.
    """
    blocks = pairs.blocked(members)
    where = lambda end: blocks.select(F.explode("ids").alias(end), F.col("name").alias(f"_{end}"))
    keyed = enacted.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight")
    shared = F.coalesce(F.arrays_overlap("_a.homes", "_b.homes") & (F.col("a") < F.col("b")), F.lit(False))
    seen = stored(keyed.join(where("a"), "a", "left").join(where("b"), "b", "left").withColumn("shared", shared))
    turned = F.col("_b") < F.col("_a")
    met = seen.filter("shared").select(
        F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("l"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("r")
    )
    held = met.groupBy("left", "right").agg(F.collect_list(F.struct("l", "r")).alias("met"))
    dealt = pairs.cells(blocks, held).withColumn("one", F.explode("lefts"))
    rest = F.when(F.col("met").isNull(), F.col("rights")).otherwise(F.array_except("rights", F.transform(F.filter("met", lambda m: m["l"] == F.col("one")), lambda m: m["r"])))
    only = pairs.ordered(dealt.select("left", "right", "one", F.explode(rest).alias("other")))
    no = F.lit(None).cast(keyed.schema["weight"].dataType)
    finding = F.when(F.col("shared"), "agreed").otherwise("enacted_only")
    told = seen.select("a", "b", finding.alias("finding"), F.when(F.col("shared"), F.lit(1)).cast("long").alias("declared"), F.col("weight").alias("enacted"))
    return told.union(only.select("x", "y", F.lit("declared_only"), F.lit(1).cast("long"), no))


def confidence(value: Column) -> Column:
    """A confidence that was said: a number from 0 to 1."""
    return F.when(value.isNotNull() & ~F.isnan(value) & value.between(0, 1), value)


def confidence_summary(edges: DataFrame, *keys: str, below: float = 0.5) -> DataFrame:
    said = confidence(F.col("confidence").cast("double"))
    return edges.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(said).alias("n_said"), F.count_if(said < below).alias("n_uncertain"), F.min(said).alias("least")
    )


def filter_options(edges: DataFrame) -> DataFrame:
    """Types by frequency, then name."""
    return edges.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


#: Provenances in the order in which they are offered (fixed values).
PROVENANCES = ["observed", "asserted", "human"]


def options(edges: DataFrame, *keys: str) -> DataFrame:
    """What each graph (of equal ``keys``) can be filtered by: types (most frequent first), provenances (where there are several), weights.

    Weights can be filtered by only where they are of one basis and differ.
    """
    types = edges.select(*keys, F.explode("types").alias("type")).groupBy(*keys, "type").agg(F.count("*").alias("n"))
    ranked = types.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))).alias("t")).select(*keys, F.transform("t", lambda x: x["type"]).alias("types"))
    rest = edges.groupBy(*keys).agg(
        F.collect_set("provenance").alias("p"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.count_distinct("weight_basis").alias("b"), F.max("weight_basis").alias("basis")
    )
    known = F.filter(F.array(*map(F.lit, PROVENANCES)), lambda x: F.array_contains("p", x))
    out = rest.join(ranked, list(keys), "left") if keys else rest.crossJoin(ranked)
    return out.select(
        *keys, F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.when(F.size("p") > 1, known).otherwise(F.array().cast("array<string>")).alias("provenances"),
        F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.lit(0)).alias("most"), ((F.col("b") == 1) & (F.col("most") > F.col("least"))).alias("weights_usable"),
        F.when(F.col("b") == 1, F.col("basis")).alias("basis"),
    )


def edge_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges of ``pairs`` (a, b), whichever way round."""
    keyed = edges.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    wanted = pairs.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return keyed.join(wanted, ["_a", "_b"], "left_semi").drop("_a", "_b")


def finding_marks(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges that assert or observe (id) with the finding (a, b, finding) about their pair."""
    keyed = edges.filter(F.col("provenance").isin("asserted", "observed")).select("id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return keyed.join(findings.select("a", "b", "finding"), ["a", "b"]).select("id", "finding")


def marks_of(findings: DataFrame, *ids: Column) -> DataFrame:
    """:func:`finding_marks` where a finding can name the edges about its pair itself: ``ids``, null where there is no such edge. Nothing is joined."""
    return findings.select(F.explode(F.array_compact(F.array(*ids))).alias("id"), "finding")


def finding_list(findings: DataFrame, names: DataFrame) -> DataFrame:
    """Findings with names (id, name): finding, subject; an id stands for a name that is missing."""
    n = lambda end: names.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
    joined = findings.join(n("a"), "a", "left").join(n("b"), "b", "left")
    return joined.select("finding", F.concat_ws(" and ", F.coalesce("_a", F.col("a").cast("string")), F.coalesce("_b", F.col("b").cast("string"))).alias("subject"))


def finding_sentence(findings: DataFrame) -> DataFrame:
    """One row, one sentence."""
    of = lambda f: F.count_if(F.col("finding") == f)
    n = findings.agg(of("declared_only").alias("d"), of("enacted_only").alias("e"), of("agreed").alias("g"))
    parts = F.array_compact(F.array(F.when(F.col("d") > 0, F.format_string("%d declared but never enacted", "d")), F.when(F.col("e") > 0, F.format_string("%d enacted but never declared", "e"))))
    return n.select(F.when(F.size(parts) == 0, F.format_string("Every relation is both declared and enacted (%d).", "g")).otherwise(F.concat(F.array_join(parts, ", "), F.format_string("; %d agreed.", "g"))).alias("sentence"))


def uncertain(rows: DataFrame, below: float = 0.5) -> DataFrame:
    """Nodes or edges that their reading was not sure of."""
    return rows.filter(confidence(F.col("confidence").cast("double")) < below)


def confidence_sentence(n: Column, n_said: Column, n_uncertain: Column, below: float = 0.5) -> Column:
    """What may be said of a reading's confidence."""
    scope = F.when(n_said == n, F.format_string("%d relation(s)", n_said)).otherwise(F.format_string("%d of %d relation(s)", n_said, n))
    told = F.when(n_uncertain == 0, F.lit(f"none below {below:.2f}")).otherwise(F.concat(n_uncertain.cast("string"), F.lit(f" below {below:.2f}")))
    return F.when(n_said == 0, "not recorded by this reading").otherwise(F.concat(scope, F.lit(", "), told))


def confidence_legend(n_said: Column, below: float = 0.5) -> Column:
    return F.when(n_said > 0, F.lit(f"Dotted edges are those this reading was less than {below:.2f} sure of; an edge without a confidence is solid."))


def decimal(value: Column) -> Column:
    """A count as it is, any other number with two decimals; a dash where it is no number."""
    sound = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return F.when(~sound, "\u2014").when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(F.format_string("%.2f", value.cast("double")))


def signed(value: Column) -> Column:
    """A tone with two decimals and its sign."""
    return F.when(value > 0, F.format_string("+%.2f", value.cast("double"))).otherwise(F.format_string("%.2f", value.cast("double")))


def _fields(**fields: Column) -> Column:
    return F.filter(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k.capitalize()).alias("label"), v.cast("string").alias("value"))) for k, v in fields.items()]), lambda x: x.isNotNull())


def described_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A panel per node: id, title, fields it carries. ``nodes``: id, name, kind, salience, confidence, provenance."""
    joined = nodes.join(degrees(nodes, drawable(nodes, edges)), "id")
    two = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double")))
    fields = _fields(kind=F.col("kind"), relations=F.col("degree"), salience=two("salience"), confidence=two("confidence"), provenance=F.col("provenance"), id=F.col("id"))
    return joined.select("id", F.col("name").alias("title"), fields.alias("fields"))


def described_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """A panel per edge: id, title, fields it carries. ``edges``: id, source, target, weight, weight_basis, valence, confidence, provenance, directed."""
    n = lambda end: names.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
    joined = edges.join(n("source"), "source", "left").join(n("target"), "target", "left")
    arrow = F.when(F.coalesce("directed", F.lit(False)), " \u2192 ").otherwise(" \u2014 ")
    two = F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", F.col("confidence").cast("double")))
    fields = _fields(weight=F.concat_ws(" ", decimal(F.col("weight")), "weight_basis"), valence=F.when(F.col("valence").isNotNull(), signed(F.col("valence"))), confidence=two, provenance=F.col("provenance"), id=F.col("id"))
    return joined.select("id", F.concat(F.coalesce("_source", "source"), arrow, F.coalesce("_target", "target")).alias("title"), fields.alias("fields"))
