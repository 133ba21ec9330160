"""Column functions over text: normalisation, quotations, keys, identifiers and hashes."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it, with the four separators that the (?U) class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalise_whitespace(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def canonical_text(text: Column) -> Column:
    """Line feeds only, without byte order marks at the start."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_text(text).cast("binary"), 256)


def quote_offset(text: Column, quotation: Column) -> Column:
    """Offset of the first occurrence in code points, from 0; null where there is none."""
    return F.when(F.length(quotation) > 0, F.nullif(F.instr(text, quotation) - 1, F.lit(-1))).cast("long")


def occurrences(text: Column, quotation: Column, limit: int = 200) -> Column:
    """Offsets of the first ``limit`` occurrences, overlapping ones included."""
    last = F.length(text) - F.length(quotation)
    starts = F.when((last >= 0) & (F.length(quotation) > 0) & F.contains(text, quotation), F.sequence(F.lit(0), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.slice(F.filter(starts, lambda i: F.substr(text, i + 1, F.length(quotation)) == quotation), 1, limit)


def context(text: Column, quotation: Column, reach: int = 40) -> Column:
    """The ``reach`` characters on either side of the first occurrence, without outer space: struct prefix, suffix."""
    at = F.instr(text, quotation)
    first = F.greatest(F.lit(1), at - reach)
    after = at + F.length(quotation)
    prefix = F.trim(F.regexp_replace(F.substr(text, first, at - first), r"^\s+|\s+$", ""))
    suffix = F.trim(F.regexp_replace(F.substr(text, after, F.lit(reach)), r"^\s+|\s+$", ""))
    return F.when(at > 0, F.struct(prefix.alias("prefix"), suffix.alias("suffix")))


def word_occurrences(text: Column, form: Column) -> Column:
    """How often ``form`` stands as a word of its own, in any case."""
    return F.regexp_count(text, F.concat(F.lit(r"(?iU)(?<!\w)"), quoted(form), F.lit(r"(?!\w)"))).cast("long")


def form_key_ascii(form: Column) -> Column:
    """Lookup key of a name whose letters are ASCII; stays in the JVM."""
    return F.lower(normalise_whitespace(form))


def form_key(form: Column) -> Column:
    """Lookup key of a name: white space collapsed, case folded (which ``lower`` does not do for all letters)."""

    @F.udf("string", useArrow=True)
    def folded(x):
        return None if x is None else " ".join(x.split()).casefold()

    return F.when(form.rlike(r"^[\x00-\x7f]*$"), form_key_ascii(form)).otherwise(folded(form))


def slugify(text: str) -> str:
    """ASCII letters and digits joined by single hyphens, 80 at most."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().strip().lower()
    plain = re.sub(r"[^a-z0-9-]+", "-", re.sub(r"[\s_/\\]+", "-", plain))
    return re.sub(r"-{2,}", "-", plain).strip("-")[:80].strip("-")


def slug(text: Column) -> Column:
    @F.udf("string", useArrow=True)
    def made(x):
        return None if x is None else slugify(x)

    return made(text)


def document_id(path: Column, sha256: Column) -> Column:
    name = F.coalesce(F.nullif(slug(path), F.lit("")), F.lit("untitled"))
    return F.concat(F.lit("doc:"), name, F.lit("-"), F.substr(F.sha2(F.concat(path, F.lit("\0"), sha256).cast("binary"), 256), F.lit(1), F.lit(12)))


def collection_id(name: Column) -> Column:
    return F.concat(F.lit("col:"), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("untitled")))


def work_id(title: Column) -> Column:
    return F.concat(F.lit("work:"), F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("untitled")))


def revision_id(sha256: Column) -> Column:
    return F.concat(F.lit("rev:"), F.substr(sha256, F.lit(1), F.lit(12)))


def run_id(material: Column) -> Column:
    """Id of a run, from the canonical JSON of all that determines it, its start included."""
    return F.concat(F.lit("run:"), F.substr(F.sha2(material.cast("binary"), 256), F.lit(1), F.lit(12)))


def snapshot_id(revision: Column, run: Column) -> Column:
    return F.concat(F.lit("snap:"), F.substr(F.sha2(F.concat(revision, F.lit("\n"), run).cast("binary"), 256), F.lit(1), F.lit(12)))


def entity_id(name: Column, apart: Column | None = None) -> Column:
    """Id of an entity by its name; ``apart`` is added where two names share a slug."""
    plain = F.concat(F.lit("char:"), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("unnamed")))
    return plain if apart is None else F.concat(plain, F.lit("-"), F.coalesce(F.nullif(slug(apart), F.lit("")), F.lit("2")))


#: Prefix of entity ids, left out inside edge ids (fixed value).
ENTITY = "char:"


def edge_id(source: Column, target: Column, provenance: Column) -> Column:
    """The same for either order of the ends; the provenance is part of it unless observed."""
    suffix = F.when(provenance == "observed", F.lit("")).otherwise(F.concat(F.lit("@"), provenance))
    bare = lambda end: F.when(F.startswith(end, F.lit(ENTITY)), F.substr(end, F.lit(len(ENTITY) + 1))).otherwise(end)
    return F.concat(F.lit("rel:"), bare(F.least(source, target)), F.lit("--"), bare(F.greatest(source, target)), suffix)


def edge_ends(edge: Column) -> Column:
    """What an edge's id was made of: struct source, target, provenance (nulls where it is no such id).

    ``rel:source--target``, and ``@provenance`` behind the first @ where there is one: plain functions, as there may be very many ids.
    """
    rest = F.substr(edge, F.lit(5))
    at, ends = F.instr(rest, "@"), F.substring_index(rest, "@", 1)
    told = F.substr(rest, at + 1)
    # the first two hyphens that have something before them
    cut = F.locate("--", ends, 2)
    line = r"^(.*)$"  # of one line, and without its end
    fits = F.startswith(edge, F.lit("rel:")) & (cut > 0) & (F.length(ends) >= cut + 2) & ((at == 0) | told.rlike(line))
    provenance = F.when(at == 0, "observed").otherwise(F.coalesce(F.nullif(F.regexp_extract(told, line, 1), F.lit("")), F.lit("observed")))
    found = F.struct(F.concat(F.lit(ENTITY), F.substr(ends, F.lit(1), cut - 1)).alias("source"), F.concat(F.lit(ENTITY), F.substr(ends, cut + 2)).alias("target"), provenance.alias("provenance"))
    none = F.lit(None).cast("string")
    return F.when(fits, found).otherwise(F.struct(none.alias("source"), none.alias("target"), none.alias("provenance")))


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no spaces and no escapes beyond what JSON needs. Numbers keep their form."""

    @F.udf("string", useArrow=True)
    def made(x):
        return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return made(text)


#: A base64 payload in a text. White space and brackets end it, so that prose after it stays.
PAYLOAD = r"data:([\w.+-]+/[\w.+-]+);base64,([A-Za-z0-9+/=]+)"
LEAST_PAYLOAD = 512


def without_payloads(text: Column, least: int = LEAST_PAYLOAD) -> Column:
    """Base64 payloads of ``least`` characters or more give way to a note of their kind and length: struct text, n."""

    @F.udf("string", useArrow=True)
    def cut(x):
        note = lambda m: m[0] if len(m[2]) < least else f"{m[1]} left out, {len(m[2]):,} bytes of base64"
        return None if x is None else re.sub(PAYLOAD, note, x, flags=re.A)

    payloads = F.regexp_extract_all(text, F.lit(PAYLOAD), F.lit(2))
    found = F.size(F.filter(payloads, lambda x: F.length(x) >= least))
    return F.struct(F.when(found > 0, cut(text)).otherwise(text).alias("text"), found.cast("long").alias("n"))


def quoted(text: Column) -> Column:
    """A text as a pattern that matches just it."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def count_occurrences(text: Column, quotation: Column) -> Column:
    """How often a quotation occurs, overlapping occurrences included: places where what follows begins with it."""
    return F.when(F.length(quotation) > 0, F.regexp_count(text, F.concat(F.lit("(?="), quoted(quotation), F.lit(")")))).otherwise(0).cast("long")


def revision_hash(documents: Column) -> Column:
    """Hash of a version: of its documents' contents in order, one after another. ``documents``: array of structs position, content."""
    joined = F.array_join(F.transform(F.array_sort(documents), lambda d: canonical_text(d["content"])), "")
    return F.sha2(joined.cast("binary"), 256)


def edge_context(raw: Column, near: str) -> Column:
    """Context on one line that keeps the space on the side of the name (``end`` or ``start``)."""
    flat = normalise_whitespace(raw)
    if near == "end":
        return F.when((flat != "") & raw.rlike(r"(?U)\s$"), F.concat(flat, F.lit(" "))).otherwise(flat)
    return F.when((flat != "") & raw.rlike(r"(?U)^\s"), F.concat(F.lit(" "), flat)).otherwise(flat)


def split_at(text: Column, start: Column, end: Column) -> Column:
    """A passage around its quotation: struct before, quoted, after; a span that does not fit marks nothing."""
    fits = (start >= 0) & (end > start) & (end <= F.length(text))
    part = lambda a, n: F.when(fits, F.substr(text, a + 1, n))
    return F.struct(
        F.coalesce(part(F.lit(0), start), text).alias("before"),
        F.coalesce(part(start, end - start), F.lit("")).alias("quoted"),
        F.coalesce(part(end, F.length(text) - end), F.lit("")).alias("after"),
    )
