"""From a text version and what was said about its windows to a graph version.

The order of the steps is the order of the survey: segment, read, verify, resolve (all that was mentioned, verified or not), aggregate (what was
verified), build, correct, save. Each step is a DataFrame; only the share of rejected quotations is looked at on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import context, form_key, normalise_whitespace
from tessella.operators import edges as E
from tessella.operators import resolve as R
from tessella.operators import segments as S
from tessella.operators.verify import MOST_REJECTED, verify
from tessella.plans.scratch import stored
from tessella.sources.files import Extraction, extract, request_fingerprint

#: Bases of weights of the two passes, and the characters of a window (fixed values).
OBSERVED_BASIS, ASSERTED_BASIS, WINDOW = "interaction_passages", "asserted_statements", 12_000


def fingerprint(text: Column, prompt_sha256: str) -> Column:
    """What a window's reply is recorded under: the window and the prompt it was sent with."""
    return request_fingerprint(prompt_sha256=F.lit(prompt_sha256), text=text)


def windows_of(text: DataFrame, found: DataFrame, prompt_sha256: str, target: int = WINDOW) -> DataFrame:
    """Windows of whole leaves: doc_id, window, first, last, text, fingerprint."""
    packed = S.windows(S.leaves(found).select("doc_id", "pos", "start", "end"), target)
    cut = packed.join(text, "doc_id").withColumn("text", F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return cut.select("doc_id", F.col("window_index").alias("window"), "first", "last", "text", fingerprint(F.col("text"), prompt_sha256).alias("fingerprint"))


@dataclass
class Pass:
    """One reading of one kind of text: its segments, what was said, and the verdicts on quotations (claim, verdict, pos)."""

    segments: DataFrame
    passages: DataFrame
    extraction: Extraction
    verdicts: DataFrame


def read_pass(text: DataFrame, replies: DataFrame, prompt_sha256: str, asserted: bool = False, target: int = WINDOW, most_rejected: float | None = MOST_REJECTED) -> Pass:
    """Segments, windows, claims and verdicts of texts (doc_id, text) of one version."""
    # each step is written once: later ones read it several times
    found = stored(S.segments(text))
    passages = stored(S.addressable(found))
    wins = stored(windows_of(text, found, prompt_sha256, target))
    said = extract(wins, replies, asserted)
    said = Extraction(stored(said.claims), stored(said.mentions), said.usage)
    claim = F.concat_ws(":", F.col("window").cast("string"), F.col("at").cast("string"))
    claims = said.claims.filter("verdict = 'ok'").drop("verdict").withColumn("claim", claim).join(wins.select("doc_id", "window", F.col("first").alias("_first"), F.col("last").alias("_last")), "window")
    asked = claims.select("doc_id", "claim", F.col("_first").alias("first"), F.col("_last").alias("last"), "quotation")
    asked = stored(asked)
    located = S.locate_quotation(asked, passages).select("doc_id", "claim", F.coalesce("pos", "first").cast("int").alias("pos"), "quotation")
    verdicts = verify(stored(located), passages, text, most_rejected)
    kept = claims.drop("doc_id", "_first", "_last", "quotation").join(verdicts, "claim")
    return Pass(found, passages, said, stored(kept))


@dataclass
class Analysis:
    """``nodes``: id, name, kind, registered. ``edges``: of both passes. ``evidence``: source, target, provenance, passage, document, exact, prefix, suffix. ``rejected``: claims with their verdict; ``dropped``: aliases that several entities claim. ``warnings``: groups that named a registered entity there is not."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    rejected: DataFrame
    refused: DataFrame
    assignments: DataFrame
    dropped: DataFrame
    warnings: DataFrame


def _mentions(*passes: Pass) -> DataFrame:
    """All names of all passes in order, with keys; aliases as structs key, form."""
    rows = None
    for n, p in enumerate(passes):
        m = p.extraction.mentions.select(F.struct(F.lit(n).alias("n"), F.col("window"), F.col("at")).alias("ord"), "name", "aliases", "kind")
        rows = m if rows is None else rows.unionByName(m)
    names = rows.select("ord", "name", "kind", form_key(F.col("name")).alias("key"))
    spread = rows.select("ord", F.posexplode("aliases").alias("i", "form")).withColumn("key", form_key(F.col("form")))
    held = spread.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "key", "form"))), lambda a: F.struct(a["key"].alias("key"), a["form"].alias("form"))).alias("aliases"))
    return stored(names.join(held, "ord", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<struct<key:string,form:string>>"))))


def _aggregated(p: Pass, assignments: DataFrame, spans: DataFrame, basis: str, provenance: str):
    sound = p.verdicts.filter(F.col("verdict").isin("kept", "relocated"))
    types = F.col("types") if "types" in sound.columns else F.array().cast("array<string>")
    keyed = sound.select(
        F.struct("window", "at").alias("ord"), form_key(F.col("first")).alias("first_key"), form_key(F.col("second")).alias("second_key"), F.col("pos").cast("long").alias("passage"), "quotation", types.alias("types"), "doc_id"
    )
    found = stored(E.resolved(keyed, assignments))
    made = E.aggregate_claims(found, basis, provenance)
    pieces = E.evidence(found.select("ord", "source", "target", "passage", "quotation", "types")).select("source", "target", F.col("first.passage").alias("passage"), F.col("first.quotation").alias("exact"), F.lit(provenance).alias("provenance"))
    at = p.segments.select("doc_id", F.col("pos").cast("long").alias("passage"), F.col("start").cast("long").alias("offset"), normalise_whitespace(F.col("body")).alias("body"))
    placed = pieces.join(at, "passage", "left").withColumn("c", context(F.col("body"), normalise_whitespace(F.col("exact"))))
    where = S.document_at(placed.select(F.col("doc_id").alias("version"), "offset").distinct(), spans).select(F.col("version").alias("doc_id"), "offset", "document")
    told = placed.join(where, ["doc_id", "offset"], "left").select("source", "target", "provenance", "passage", "document", "exact", F.coalesce("c.prefix", F.lit("")).alias("prefix"), F.coalesce("c.suffix", F.lit("")).alias("suffix"))
    return made, told, E.refused(found).select("ord", "reason")


def analyse(
    version: str, members: DataFrame, documents: DataFrame, replies: DataFrame, registry: DataFrame, prompt_sha256: str, assertion_sha256: str | None = None,
    groups: DataFrame | None = None, target: int = WINDOW, most_rejected: float | None = MOST_REJECTED,
) -> Analysis:
    """The graph of one version, from recorded replies.

    ``members``: version, position, document. ``documents``: document, role, content. ``replies``: fingerprint, reply, ... ``registry``: a row per
    known form: key, entity_id, name, kind. Narrative and reference text are read apart, under their own prompts, and resolved together.
    """
    own = members.filter(F.col("version") == version)
    text, reference = (stored(S.version_text(own, documents, [role]).withColumnRenamed("version", "doc_id").filter(F.trim("text") != "")) for role in ("narrative", "reference"))
    both = {"narrative": text.limit(1).count() > 0, "reference": assertion_sha256 is not None and reference.limit(1).count() > 0}
    if not any(both.values()):
        raise ValueError(f"{version} has no text")
    passes, parts = [], []
    if both["narrative"]:
        passes.append(("narrative", read_pass(text, replies, prompt_sha256, False, target, most_rejected), OBSERVED_BASIS, "observed"))
    if both["reference"]:
        passes.append(("reference", read_pass(reference, replies, assertion_sha256, True, target, most_rejected), ASSERTED_BASIS, "asserted"))
    assignments, entities, dropped, warnings = (stored(t) for t in R.resolve(_mentions(*[p for _, p, *_ in passes]), registry, groups))
    for role, p, basis, provenance in passes:
        spans = S.document_spans(own.join(documents.filter(F.col("role") == role).select("document"), "document", "left_semi"), documents)
        parts.append(_aggregated(p, assignments, spans, basis, provenance))
    union = lambda k: parts[0][k] if len(parts) == 1 else parts[0][k].unionByName(parts[1][k])
    edges = union(0)
    used = assignments.select(F.col("entity_id").alias("id")).union(edges.select("source")).union(edges.select("target")).distinct()
    known = registry.groupBy(F.col("entity_id").alias("id")).agg(F.min("name").alias("_name"), F.min("kind").alias("_kind"))
    fresh = entities.withColumnRenamed("entity_id", "id")
    nodes = used.join(fresh, "id", "left").join(known, "id", "left").select("id", F.coalesce("name", "_name").alias("name"), F.coalesce("kind", "_kind").alias("kind"), F.col("_name").isNotNull().alias("registered"))
    rejected = passes[0][1].verdicts.select("claim", "verdict")
    for _, p, *_ in passes[1:]:
        rejected = rejected.union(p.verdicts.select("claim", "verdict"))
    return Analysis(nodes, edges, union(1), rejected.filter(~F.col("verdict").isin("kept", "relocated")), union(2), assignments, dropped, warnings)
