"""What each document of a corpus is: proposals, answers, confirmation, and regions within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import normalise_whitespace
from tessella.operators.anchors import reanchored
from tessella.operators.continuity import revision_proposals

#: Roles that may be confirmed, and what stands where there is none yet (fixed values).
ROLES, UNKNOWN = ["narrative", "reference", "excluded"], "unknown"
#: Below this share in common a revision is called a rewrite (fixed value).
REWRITE = 0.5

REGION = "struct<label:string,role:string,starts_at:int,ends_at:int,begins_with:string,ends_with:string>"
REGIONS = f"struct<regions:array<{REGION}>,note:string>"


class StructureError(ValueError):
    """Answers that cannot be confirmed."""


def divided(rows: DataFrame, text: str, begins: Column, ends: Column, role: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the regions of a text, normalised, at the quotations where its narrative begins and ends (struct regions, note).

    Undivided, with a note, where a quotation is not there or the narrative would end before it begins.
    """
    quotes = [F.coalesce(q, F.lit("")) for q in (begins, ends)]
    asked = rows.withColumn("_normal", normalise_whitespace(F.coalesce(F.col(text), F.lit(""))))
    asked = asked.withColumns({"_begin_quote": quotes[0], "_end_quote": quotes[1], "_region_role": role})
    for side in ("begin", "end"):
        asked = _anchored(asked, f"_{side}_quote", f"_{side}")
    return asked.withColumn(out, _regions(F.col("_normal"), [F.col("_begin_quote"), F.col("_end_quote")], [F.col("_begin"), F.col("_end")], F.col("_region_role"))).drop(
        "_normal", "_begin_quote", "_end_quote", "_region_role", "_begin", "_end"
    )


def _anchored(rows: DataFrame, quote: str, out: str) -> DataFrame:
    """``rows`` with ``out``: where the quotation is in ``_normal``."""
    asked = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("kept"), F.col("_normal").alias("text"), F.col(quote).alias("exact"))
    none = {"prefix": F.lit(""), "suffix": F.lit(""), "hint": F.lit(None).cast("int")}
    return reanchored(asked.withColumns(none)).select("kept.*", F.col("anchor").alias(out))


def _region(label: str, role: Column, start: Column, end: Column, *quotes: Column) -> Column:
    names = ("label", "role", "starts_at", "ends_at", "begins_with", "ends_with")
    values = (F.lit(label), role, start, end, *(quotes or (F.lit(""), F.lit(""))))
    return F.struct(*[c.alias(n) for n, c in zip(names, values)])


def _whole(normal: Column, role: Column) -> Column:
    return F.array(_region("whole document", role, F.lit(0), F.length(normal)))


def _regions(normal: Column, quotes: list[Column], places: list[Column], role: Column) -> Column:
    given = [F.trim(q) != "" for q in quotes]
    lacking = [g & p.isNull() for g, p in zip(given, places)]
    a = F.coalesce(places[0]["start"], F.lit(0))
    b = F.coalesce(places[1]["end"], F.length(normal))

    whole = _whole(normal, role)
    around = [_region("before the narrative", F.lit("reference"), F.lit(0), a), _region("narrative", role, a, b, *quotes), _region("after the narrative", F.lit("reference"), b, F.length(normal))]
    parts = F.filter(F.array(*around), lambda r: (r["starts_at"] < r["ends_at"]) | (r["label"] == "narrative"))
    missing = F.when(lacking[0], quotes[0]).when(lacking[1], quotes[1])
    note = F.when(missing.isNotNull(), F.concat(F.lit("a boundary is not in the document: '"), F.left(missing, F.lit(60)), F.lit("'"))).when(
        b <= a, "the narrative would end before it begins: nothing was divided"
    )
    split = given[0] | given[1]
    return F.struct(F.when(split & note.isNull(), parts).otherwise(whole).alias("regions"), F.when(split, note).alias("note")).cast(REGIONS)


def proposed(docs: DataFrame) -> DataFrame:
    """Per document (ord, path, content): characters, role, addressing, revision_of, each with its basis, and its one region.

    Roles need the text read and are left open; only blank-line sections can be made again, so addressing is settled.
    """
    earlier = revision_proposals(docs).select("path", F.col("earlier").alias("revision_of"), "similarity")
    joined = docs.join(earlier, "path", "left")
    percent = F.concat(F.round(F.col("similarity") * 100).cast("int").cast("string"), F.lit("%"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    basis = (
        F.when(F.col("revision_of").isNull(), F.concat(F.lit("no earlier document is named "), name))
        .when(F.col("similarity") >= REWRITE, F.concat(F.lit("same filename as "), "revision_of", F.lit(", "), percent, F.lit(" of the text in common")))
        .otherwise(F.concat(F.lit("same filename as "), "revision_of", F.lit(", only "), percent, F.lit(" of the text in common: a rewrite, or a coincidence of names")))
    )
    size = F.length(normalise_whitespace(F.coalesce("content", F.lit(""))))
    return joined.select(
        "ord", "path", size.cast("long").alias("characters"), F.lit(UNKNOWN).alias("role"), F.lit("needs the text read").alias("role_basis"), F.lit(False).alias("role_settled"),
        F.lit("section").alias("addressing"), F.lit(True).alias("addressing_settled"), "revision_of", basis.alias("revision_basis"),
        _whole(normalise_whitespace(F.coalesce("content", F.lit(""))), F.lit(UNKNOWN)).alias("regions"), F.lit(None).cast("string").alias("note"),
    )


def answered(plans: DataFrame, docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Plans with a reader's answers (path, role, reason, begins, ends); ``unsure`` leaves a role open, and a document without an answer keeps its plan, with a note."""
    a = answers.select("path", F.col("role").alias("_role"), F.col("reason").alias("_why"), "begins", "ends", F.lit(True).alias("_said"))
    joined = plans.join(a, "path", "left").join(docs.select("path", "content"), "path", "left")
    said = F.coalesce(F.col("_said"), F.lit(False))
    role = F.when(F.coalesce("_role", F.lit("unsure")) == "unsure", UNKNOWN).otherwise(F.col("_role"))
    cut = divided(joined, "content", F.col("begins"), F.col("ends"), role, "_cut")
    new = {
        "role": F.when(said, role).otherwise(F.col("role")),
        "role_basis": F.when(said, F.concat(F.lit("read: "), F.coalesce(F.nullif("_why", F.lit("")), F.lit("no reason given")))).otherwise(F.col("role_basis")),
        "regions": F.when(said, F.col("_cut.regions")).otherwise(F.col("regions")),
        "note": F.when(said, F.col("_cut.note")).otherwise(F.lit("no answer: still unclassified")),
    }
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in plans.columns])


def confirmed(plans: DataFrame, corrections: DataFrame) -> DataFrame:
    """Settled plans: corrections (path, role) first, the proposed role else. Absent paths, unknown roles, and documents still without a role are refused."""
    absent = corrections.join(plans.select("path"), "path", "left_anti").orderBy("path").first()
    if absent:
        raise StructureError(f"there is no document at {absent['path']}")
    wrong = corrections.filter(~F.coalesce(F.col("role").isin(ROLES), F.lit(False))).orderBy("path").first()
    if wrong:
        raise StructureError(f"{wrong['path']}: {wrong['role']} is not a role")
    joined = plans.join(corrections.select("path", F.col("role").alias("_role")), "path", "left")
    open_ = joined.filter(F.coalesce("_role", "role", F.lit(UNKNOWN)) == UNKNOWN).orderBy("ord").first()
    if open_:
        raise StructureError(f"{open_['path']} has no role yet")
    basis = (
        F.when(F.col("_role").isNull(), F.concat(F.lit("confirmed: "), "role_basis")).when(F.col("role") == UNKNOWN, "corrected").otherwise(F.concat(F.lit("corrected, over "), "role_basis"))
    )
    final = F.coalesce("_role", "role")
    moved = F.transform("regions", lambda r: r.withField("role", F.when(r["role"] == F.col("role"), final).otherwise(r["role"])))
    new = {"role": final, "role_basis": basis, "role_settled": F.lit(True), "regions": moved}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in plans.columns])


def require_settled(plans: DataFrame) -> DataFrame:
    """Plans that may be saved; one that is not confirmed is refused."""
    unsettled = plans.filter("not role_settled").orderBy("ord").first()
    if unsettled:
        raise StructureError(f"{unsettled['path']} is not confirmed")
    return plans


def restored(plans: DataFrame, docs: DataFrame, saved: DataFrame) -> DataFrame:
    """Fresh plans with the answers saved earlier (path, role, role_basis, regions). Boundaries are found anew in the text as it is."""
    s = saved.select("path", F.col("role").alias("_role"), F.col("role_basis").alias("_basis"), F.col("regions").alias("_regions"))
    joined = plans.join(s, "path", "left").join(docs.select("path", "content"), "path", "left")
    had = F.col("_role").isNotNull()
    mark = F.get(F.filter("_regions", lambda r: (r["begins_with"] != "") | (r["ends_with"] != "")), F.lit(0))
    cut = divided(joined.withColumn("_mark", mark), "content", F.col("_mark.begins_with"), F.col("_mark.ends_with"), F.col("_mark.role"), "_cut")
    cut = cut.withColumn("_cut", F.when(had & F.col("_mark").isNotNull(), F.col("_cut")))
    new = {
        "role": F.coalesce("_role", "role"), "role_basis": F.coalesce("_basis", "role_basis"), "role_settled": F.col("role_settled") | had,
        "regions": F.coalesce("_cut.regions", F.when(had & (F.size("_regions") > 0), F.col("_regions")), "regions"),
        "note": F.coalesce("_cut.note", "note"),
    }
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in plans.columns])


def plan_summary(plans: DataFrame) -> DataFrame:
    """One row: documents, those undecided, excluded, ready, and a sentence."""
    counted = plans.agg(F.count("*").alias("n"), F.count_if(F.col("role") == UNKNOWN).alias("n_undecided"), F.count_if(F.col("role") == "excluded").alias("n_excluded"))
    read = F.col("n") - F.col("n_excluded")
    sentence = F.when(F.col("n_undecided") > 0, F.format_string("%d of %d documents have no role yet", "n_undecided", "n")).otherwise(
        F.concat(F.format_string("%d documents will be read", read), F.when(F.col("n_excluded") > 0, F.format_string(", %d left out", "n_excluded")).otherwise(""))
    )
    return counted.withColumn("ready", (F.col("n_undecided") == 0) & (read > 0)).withColumn("sentence", sentence)


def kept_text(text: str, plan: list[dict]) -> tuple[str, str | None]:
    """A text without its excluded regions, and why nothing was cut where that failed.

    The region with boundary quotations stays; what is before it goes where a region before it is excluded, and what is after it
    likewise. Quotations are found whatever white space is between their words.
    """
    out = [i for i, r in enumerate(plan) if r["role"] == "excluded"]
    if not out:
        return text, None
    at = next((i for i, r in enumerate(plan) if r["begins_with"] or r["ends_with"]), None)
    if at is None:
        return text, "no region has a boundary to cut at: kept whole"
    first, last = 0, len(text)
    for quote, there, edge in ((plan[at]["begins_with"], any(i < at for i in out), 0), (plan[at]["ends_with"], any(i > at for i in out), 1)):
        if quote and there:
            found = _in_raw(text, quote)
            if found is None:
                return text, f"a boundary is not in the document: kept whole: {quote[:40]!r}"
            first, last = (found[0], last) if edge == 0 else (first, found[1])
    kept = text[first:last]
    return (kept, None) if kept.strip() else (text, "nothing would be left: kept whole")


def _in_raw(text: str, quote: str) -> tuple[int, int] | None:
    import re

    words = quote.split()
    found = re.search(r"\s+".join(map(re.escape, words)), text) if words else None
    return found.span() if found else None


def kept(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """Documents (path, content) with excluded regions cut: content, note, cut. Only those with such a region leave the JVM."""

    @F.udf("struct<content:string,note:string>", useArrow=True)
    def cut(content, own):
        kept_part, note = kept_text(content or "", own or [])
        return {"content": kept_part, "note": note}

    joined = docs.join(plans.select("path", "regions"), "path", "left")
    some = F.coalesce(F.exists("regions", lambda r: r["role"] == "excluded"), F.lit(False))
    # Spark runs the function for all rows, so that the others' texts are kept from it
    done = joined.withColumn("_k", F.when(some, cut(F.when(some, F.col("content")), F.when(some, F.col("regions")))))
    content = F.coalesce("_k.content", "content")
    return done.select(*[c for c in docs.columns if c != "content"], content.alias("content"), F.col("_k.note").alias("note"), (~content.eqNullSafe(F.col("content"))).alias("cut"))
