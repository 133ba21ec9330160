"""A reading of a source made one text version of one work."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import canonical_text, content_hash, document_id, slugify
from tessella.operators.structure import kept
from tessella.plans.scratch import release, stored
from tessella.plans.store import file_states
from tessella.sources.files import TEXT_SUFFIXES, positioned, text_folder


class IngestError(ValueError):
    """A source that cannot become a version."""


@dataclass
class Reading:
    """``documents``: path, content. ``skipped``: path, why. ``root`` names the place, ``label`` the source as it calls itself."""

    documents: DataFrame
    skipped: DataFrame
    root: str
    label: str | None = None


class Source(Protocol):
    root: str

    def read(self) -> Reading: ...


@dataclass
class FolderSource:
    spark: SparkSession
    root: str

    def read(self) -> Reading:
        good, bad = text_folder(self.spark, self.root)
        return Reading(good.select("path", "content"), bad, self.root)


@dataclass
class ListingSource:
    """Documents of a recorded listing under a folder: entries (id, name, parent_id, mime_type, body) from the folder down, each place once."""

    listing: DataFrame
    root: str
    label: str | None = None

    def read(self) -> Reading:
        from tessella.sources.files import walked

        good, bad = walked(self.listing, self.root)
        return Reading(good.select("path", F.col("body").alias("content")), bad.select("path", "why"), self.root, self.label)


@dataclass
class Ingested:
    """``documents``: path, position, document, role, sha256, content, characters, state. ``notes``: path, what was left out or cut."""

    collection: str
    work: str
    title: str
    revision: str
    sha256: str
    documents: DataFrame
    skipped: DataFrame
    notes: DataFrame
    compared_with: str | None


def work_of(reading: Reading, works: DataFrame, title: str | None = None) -> tuple[str, str]:
    """Which work a source is read into, and its title: as told, else the work last read from there, else by the source's name."""
    known = works.filter(F.col("root") == reading.root).orderBy("work").limit(1).collect() if not title else []
    if known:
        return known[0]["work"], known[0]["title"]
    name = reading.label or reading.root.rstrip("/").rsplit("/", 1)[-1]
    told = title or name.replace("_", " ").replace("-", " ").strip() or name
    return "work:" + (slugify(told) or "untitled"), told


def collection_of(work: str, title: str, works: DataFrame, collections: DataFrame, name: str | None = None) -> str:
    """The collection a work is in: its own, else the one named, else the only one there is, else a new one. A second collection is refused."""
    own = works.filter(F.col("work") == work).select("collection").limit(1).collect()
    if own and name is None:
        return own[0][0]
    held = [r[0] for r in collections.select("collection").orderBy("collection").limit(2).collect()]
    if name is None and len(held) == 1:
        return held[0]
    made = "col:" + (slugify(name or title) or "untitled")
    if any(c != made for c in held):
        raise IngestError(f"there is a collection {held[0]} already, and one is all a store has")
    return made


def previous_state(work: str, revisions: DataFrame, members: DataFrame, documents: DataFrame) -> tuple[str | None, DataFrame]:
    """The newest version of a work and its documents' hashes by path."""
    last = revisions.filter(F.col("work") == work).agg(F.max_by("revision", F.struct("created_at", "seq")).alias("r")).first()["r"]
    mine = members.filter(F.col("version") == F.lit(last)).join(documents.select("document", "path", "sha256"), "document")
    return last, mine.filter("path is not null").select("path", "sha256")


def version_hash(placed: DataFrame) -> str:
    """Hash of a version: of the contents of ``placed`` (position, content) in order, one after another; nulls add nothing.

    Texts are sorted by a shuffle and pass one task as a stream, which a hash of all in a row needs; it holds a batch of them.
    """
    ordered = placed.select("position", "content").orderBy("position", "content").select(canonical_text(F.col("content")).alias("content")).coalesce(1)

    def digest(batches):
        found = hashlib.sha256()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    found.update(text.as_buffer())
        yield pa.RecordBatch.from_pylist([{"h": found.hexdigest()}])

    told = stored(ordered.mapInArrow(digest, "h string"))
    row = told.first()
    release(told)
    return row["h"] if row else hashlib.sha256().hexdigest()


def ingest(
    reading: Reading, works: DataFrame, collections: DataFrame, revisions: DataFrame, members: DataFrame, documents: DataFrame, plans: DataFrame,
    title: str | None = None, collection: str | None = None, role: str = "narrative",
) -> Ingested:
    """Documents of a source as a version: roles as confirmed (``plans``: path, role, regions), excluded documents left out, excluded regions cut.

    A confirmed exclusion that cannot be applied is refused, and so is a source of which nothing is left. Each
    document is added, changed or unchanged against the newest version of the work.
    """
    if role not in ("narrative", "reference"):
        raise IngestError(f"{role} is not a role")
    work, told = work_of(reading, works, title)
    home = collection_of(work, told, works, collections, collection)
    if not reading.documents.limit(1).count():
        raise IngestError(f"{reading.root} has no readable text, which would end in {', '.join(TEXT_SUFFIXES)}")
    roles = reading.documents.join(plans.select("path", F.col("role").alias("_role")), "path", "left").withColumn("role", F.coalesce("_role", F.lit(role)))
    omitted = roles.filter("role = 'excluded'").select("path", F.lit("left out as no part of the work").alias("note"))
    inside = roles.filter("role <> 'excluded'").drop("_role")
    if not inside.limit(1).count():
        raise IngestError(f"every document of {reading.root} is left out")
    cut = kept(inside, plans)
    failed = cut.filter("note is not null").orderBy("path").limit(1).collect()
    if failed:
        raise IngestError(f"{failed[0]['path']}: {failed[0]['note']}")
    placed = positioned(cut.drop("note")).withColumn("sha256", content_hash(F.col("content")))
    sha = version_hash(placed)
    before, old = previous_state(work, revisions, members, documents)
    states = file_states(old, placed.select("path", "sha256"))
    rows = placed.join(states, "path").withColumn("document", document_id(F.col("path"), F.col("sha256"))).withColumn("characters", F.length("content").cast("long"))
    notes = omitted.union(cut.filter("cut").select("path", F.lit("a region was cut")))
    columns = ["path", "position", "document", "role", "sha256", "content", "characters", "state"]
    return Ingested(home, work, told, "rev:" + sha[:12], sha, rows.select(*columns), reading.skipped, notes, before)


def ingest_file(reading: Reading, plans: DataFrame, *tables: DataFrame, **options) -> Ingested:
    """A source of one document; its plan is found by the document's name."""
    if reading.documents.limit(2).count() != 1:
        raise IngestError(f"{reading.root} is not one document")
    return ingest(reading, *tables, plans, **options)
