"""Text into addressable segments, windows and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import normalise_whitespace

#: A block starts at the text's start or at the first ink after a blank line.
BLOCK = r"(?:\A|\n[ \t]*\n)[ \t]*(?=\S)"


def lines(docs: DataFrame) -> DataFrame:
    """Lines of each text (doc_id, text) with their place: pos from 1, start and end in code points, without line feeds."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("line") + 1).over(upto) - 1
    return parts.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), (end - F.length("line")).cast("long").alias("start"), end.cast("long").alias("end"), "line")


#: Characters that texts do not use (fixed values: permanent noncharacters and private planes); three that a text lacks mark its matches.
MARKS = [chr(c) for c in (*range(0xFDD0, 0xFDF0), *range(0x10FF00, 0x10FF20))]
#: Multiline, only line feeds end lines, classes as Unicode has them.
FLAGS = "(?mdU)"


def _marked(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """An array over all rules of structs depth, k, label, size, rest: the parts into which a rule's matches divide the text.

    Part k, from 1, begins at match k, which is ``size`` long; with what follows it, it is ``rest`` long. Part 0 is what stands before.
    """
    free = F.slice(F.filter(F.array(*map(F.lit, MARKS)), lambda m: ~F.contains(text, m)), 1, 3)
    # bound to a variable, so that the marks are chosen once a text
    return F.get(F.transform(F.array(free), lambda m: _divided(text, rules, *(F.get(m, F.lit(i)) for i in range(3)))), F.lit(0))


def _divided(text: Column, rules: list[tuple[str, str, str]], opens: Column, names: Column, closes: Column) -> Column:
    def measured(depth: int):
        return lambda x: F.struct(
            F.lit(depth).alias("depth"),
            x["k"].alias("k"),
            F.when(x["n"] > 1, F.substr(x["p"], F.lit(1), x["n"] - 1)).alias("label"),
            F.greatest(x["c"] - x["n"] - 1, F.lit(0)).alias("size"),
            (F.length(x["p"]) - F.when(x["k"] > 0, x["n"] + 1).otherwise(0)).alias("rest"),
            *([F.substr(x["p"], x["n"] + 1, x["c"] - x["n"] - 1).alias("match"), F.substr(x["p"], x["c"] + 1).alias("gap")] if len(rules) == 1 else []),
        )

    arrays = []
    for depth, (_, pattern, _) in enumerate(rules):
        pattern = pattern.replace("(?P<", "(?<")
        label = F.lit("${label}") if "(?<label>" in pattern else F.lit("")
        found = F.regexp_replace(text, F.lit(f"{FLAGS}(?:{pattern})"), F.concat(opens, label, names, F.lit("$0"), closes))
        parts = F.transform(F.split(found, opens), lambda p, k: F.struct(k.alias("k"), p.alias("p"), F.instr(p, names).alias("n"), F.instr(p, closes).alias("c")))
        arrays.append(F.transform(parts, measured(depth)))
    return F.concat(*arrays)


def segments(docs: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per nested segment of each text (doc_id, text); by default blocks between blank lines.

    ``rules``: (type, pattern, "start" or "end" of the match), outermost first, with a group ``label`` or without. A boundary
    closes all open segments of its own depth and deeper; ordinals restart under each parent; a text without any
    boundary is one segment. Boundaries are rows, and depth, end and parent come from windows over each text's
    rows; one shuffle brings them together with the text. A null text counts as empty; one that uses nearly all of MARKS is refused.
    """
    rules = rules or [("section", BLOCK, "end")]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if len(rules) == 1:
        return _flat(rows, rules[0])
    # the text goes with one part only, and not with every row that comes of it
    parts = F.transform(_marked(F.col("text"), rules), lambda m: m.withField("text", F.when((m["k"] == 0) & (m["depth"] == 0), F.col("text"))))
    each = rows.select("_row", "doc_id", F.explode(parts).alias("m")).select("_row", "doc_id", "m.*")
    own = Window.partitionBy("_row", "depth").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rest").over(own), F.lit(0)).cast("int")
    ends = [d for d, (_, _, side) in enumerate(rules) if side == "end"]
    at = before + F.when(F.col("depth").isin(ends), F.col("size")).otherwise(0)
    whole = Window.partitionBy("_row")
    placed = each.withColumn("at", at).withColumn("_marks", F.sum((F.col("k") > 0).cast("int")).over(whole))
    kept = placed.filter("k > 0 or text is not null")
    real = F.col("k") > 0
    order = Window.partitionBy("_row").orderBy(F.col("k") == 0, "at", "depth", "k")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    # what comes next is what came last in the opposite order, where Spark's frames grow row by row
    ahead = Window.partitionBy("_row").orderBy(F.desc(F.col("k") == 0), F.desc("at"), F.desc("depth"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in rules]), F.col("depth") + 1)
    found = kept.withColumns({"pos": F.row_number().over(order) - 1, "type": kind, "end": F.lit(None).cast("int"), "parent": F.lit(None).cast("int")})
    for d in range(len(rules)):
        here, real_at = F.col("depth") == d, lambda below, c: F.when(real & (F.col("depth") < below), F.col(c))
        found = found.withColumns({
            "end": F.when(here, F.last(real_at(d + 1, "at"), True).over(ahead)).otherwise(F.col("end")),
            "parent": F.when(here, F.last(real_at(d, "pos"), True).over(back)).otherwise(F.col("parent")),
        })
    found = found.withColumn("index", F.row_number().over(Window.partitionBy("_row", "parent", "type").orderBy(F.col("k") == 0, "pos"))).withColumn("path", F.array().cast("array<int>"))
    for d in range(len(rules)):
        above = F.last(F.when(real & (F.col("depth") < d), F.col("path")), True).over(back)
        path = F.concat(F.coalesce(above, F.array().cast("array<int>")), F.array("index"))
        found = found.withColumn("path", F.when(F.col("depth") == d, path).otherwise(F.col("path")))
    fields = ["pos", "type", "index", "depth", F.col("at").alias("start"), "end", "label", "parent", "path"]
    told = found.groupBy("_row", "doc_id").agg(F.max("text").alias("text"), F.first("_marks").alias("_marks"), F.collect_list(F.when(real, F.struct(*fields))).alias("s"))
    blank = {"pos": F.lit(0), "type": F.lit(rules[-1][0]), "index": F.lit(1), "depth": F.lit(0), "start": F.lit(0), "end": F.length("text"), "label": F.lit(None).cast("string"), "parent": F.lit(None).cast("int"), "path": F.array(F.lit(1))}
    one = F.array(F.struct(*[c.alias(n) for n, c in blank.items()]))
    text, end = F.col("text"), lambda x: F.coalesce(x["end"], F.length(F.col("text")))
    cut = F.transform(F.when(F.col("_marks") > 0, F.col("s")).otherwise(one), lambda x: x.withField("end", end(x)).withField("body", F.substr(text, x["start"] + 1, end(x) - x["start"])))
    return told.select("doc_id", F.explode(cut).alias("s")).select("doc_id", *[f"s.{n}" for n in (*blank, "body")])


def _flat(rows: DataFrame, rule: tuple[str, str, str]) -> DataFrame:
    """Segments of one rule: each body is put together from the parts beside its boundary, in time linear in the text."""
    kind, _, side = rule
    w = Window.partitionBy("_row").orderBy("k")
    each = rows.select("_row", "doc_id", F.explode(_marked(F.col("text"), [rule])).alias("m")).select("_row", "doc_id", "m.*")
    before = F.coalesce(F.sum("rest").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = each.select("doc_id", "k", "label", "match", "gap", "size", before.alias("before"), F.lead("k").over(w).alias("next"), F.lead("match").over(w).alias("ahead"))
    alone = F.col("k") == 0
    start = F.col("before") + (F.when(alone, 0).otherwise(F.col("size")) if side == "end" else F.lit(0))
    body = F.concat("gap", F.coalesce("ahead", F.lit(""))) if side == "end" else F.when(alone, F.col("gap")).otherwise(F.concat("match", "gap"))
    own = placed.filter("k > 0 or next is null").select("doc_id", F.greatest(F.col("k"), F.lit(1)).alias("index"), start.alias("start"), "label", body.alias("body"))
    return own.select(
        "doc_id", (F.col("index") - 1).alias("pos"), F.lit(kind).alias("type"), "index", F.lit(0).alias("depth"), "start", (F.col("start") + F.length("body")).alias("end"), "label",
        F.lit(None).cast("int").alias("parent"), F.array("index").alias("path"), "body",
    )


def leaves(found: DataFrame) -> DataFrame:
    """Segments that are nobody's parent."""
    return found.join(found.select("doc_id", F.col("parent").alias("pos")).filter("pos is not null").distinct(), ["doc_id", "pos"], "left_anti")


def addressable(found: DataFrame) -> DataFrame:
    """Leaves with ink, normalised, with their span in the text that joins them by single spaces."""
    inked = leaves(found).withColumn("passage", normalise_whitespace(F.col("body"))).filter("passage <> ''")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("passage") + 1).over(before), F.lit(0)).cast("long")
    return inked.select("doc_id", "pos", start.alias("norm_start"), (start + F.length("passage")).alias("norm_end"), "passage")


def passage_at(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """``offsets`` (doc_id, offset) with the pos of the half-open span that holds them; past the end, the last.

    Spans adjoin, so the holder is the last span that starts at or before the offset: one sort per text, no range join.
    """
    marks = spans.select("doc_id", F.col("norm_start").alias("at"), F.lit(0).alias("kind"), "pos", F.lit(None).cast("long").alias("row"))
    asked = offsets.withColumn("row", F.monotonically_increasing_id()).select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("pos"), "row")
    w = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.union(asked).withColumn("pos", F.last("pos", True).over(w)).filter("kind = 1").select("doc_id", F.col("at").alias("offset"), "pos")


def windows(pieces: DataFrame, target: int) -> DataFrame:
    """Greedy packing of consecutive pieces (doc_id, pos, start, end): a window closes before it would pass ``target`` characters; a piece is never cut."""
    items = F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    start = F.expr("named_struct('done', cast(array() as array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>), 'now', cast(null as struct<start:bigint,end:bigint,first:bigint,last:bigint>))")

    def step(state, x):
        now = state["now"]
        fresh = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pos"].alias("first"), x["pos"].alias("last"))
        wider = F.struct(now["start"].alias("start"), x["end"].alias("end"), now["first"].alias("first"), x["pos"].alias("last"))
        fits = now.isNotNull() & (x["end"] - now["start"] <= target)
        return F.struct(
            F.when(fits | now.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(now))).alias("done"), F.when(fits, wider).otherwise(fresh).alias("now")
        )

    folded = pieces.groupBy("doc_id").agg(items.alias("i")).select("doc_id", F.aggregate("i", start, step, lambda s: F.concat(s["done"], F.array(s["now"]))).alias("w"))
    return folded.select("doc_id", F.posexplode("w").alias("window_index", "w")).select("doc_id", F.col("window_index").cast("long").alias("window_index"), "w.*")


def document_spans(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Each document's span in its version's text: version, position, document, start, end (exclusive)."""
    joined = members.join(docs.select("document", "content"), "document")
    w = Window.partitionBy("version").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("content")).over(w)
    return joined.select("version", "position", "document", (end - F.length("content")).cast("long").alias("start"), end.cast("long").alias("end"))


def version_text(members: DataFrame, docs: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """The text of each version: its documents' contents in order of position, nothing between; of some roles only where given."""
    joined = members.join(docs.filter(F.col("role").isin(*roles)) if roles else docs, "document")
    ordered = F.array_sort(F.collect_list(F.struct("position", "content")))
    return joined.groupBy("version").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "").alias("text"))


def document_at(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """``offsets`` (version, offset) with the document whose half-open span holds them: none beyond the last, the first where the offset is null.

    Spans adjoin, so the holder is the last span that starts at or before the offset: one sort per version.
    """
    marks = spans.select("version", F.col("start").alias("at"), F.lit(0).alias("kind"), "document", "end", F.lit(None).cast("long").alias("offset"))
    asked = offsets.select(
        "version", F.coalesce("offset", F.lit(0)).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("document"),
        F.lit(None).cast("long").alias("end"), F.col("offset").cast("long").alias("offset"),
    )
    marks = marks.filter(F.col("at") < F.col("end"))  # an empty document holds no offset
    w = Window.partitionBy("version").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marks.unionByName(asked).withColumn("document", F.last("document", True).over(w)).withColumn("end", F.last("end", True).over(w))
    return held.filter("kind = 1").select("version", "offset", F.when(F.col("at") < F.col("end"), F.col("document")).alias("document"))


def span_of(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """The span in the joined text of each passage (doc_id, pos) that has one."""
    return positions.join(spans.select("doc_id", "pos", "norm_start", "norm_end"), ["doc_id", "pos"])


def locate_quotation(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims (doc_id, claim, first, last, quotation) with the first passage of their window, in order, that holds the quotation; null where none does."""
    needle = claims.withColumn("_needle", normalise_whitespace(F.coalesce("quotation", F.lit(""))))
    near = needle.join(passages.select("doc_id", F.col("pos").alias("_pos"), "passage"), "doc_id").filter(
        F.col("_pos").between(F.col("first"), F.col("last")) & (F.col("_needle") != "") & F.contains("passage", "_needle")
    )
    first = near.groupBy("doc_id", "claim").agg(F.min("_pos").alias("pos"))
    return claims.join(first, ["doc_id", "claim"], "left")


def locator_path(found: DataFrame) -> DataFrame:
    """Segments with ``chain``: the steps (type, index, label) from the outermost one to each.

    A segment's ordinals are in ``path``; each step's type and label are those of the ancestor with that part of the path.
    """
    steps = found.select("doc_id", "pos", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("depth", "part"))
    owner = found.select("doc_id", F.col("path").alias("part"), "type", "index", "label")
    chained = steps.join(owner, ["doc_id", "part"]).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("depth", "type", "index", "label"))).alias("c"))
    chain = F.transform("c", lambda s: F.struct(s["type"].alias("type"), s["index"].alias("index"), s["label"].alias("label")))
    return found.join(chained.select("doc_id", "pos", chain.alias("chain")), ["doc_id", "pos"])
