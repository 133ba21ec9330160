"""What a new text version leaves stale, loses or supersedes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import edge_context, normalise_whitespace
from tessella.operators.anchors import reanchored
from tessella.operators.opening import require_reproducible
from tessella.plans.scratch import stored


#: Characters of names that one automaton holds (about 100 bytes of memory each); more names are sought in further passes.
BLOCK_CHARS = 500_000


class _Folds(dict):
    """Each character in the one case that stands for it; those whose other case is longer stand for themselves, so places stay."""

    def __missing__(self, code: int) -> int:
        other = chr(code).upper().lower()
        self[code] = ord(other) if len(other) == 1 else code
        return self[code]


FOLDS = _Folds()


def _automaton(forms: list[str]) -> ahocorasick.Automaton:
    found: dict[str, list[str]] = {}
    for form in forms:
        found.setdefault(form.translate(FOLDS), []).append(form)
    made = ahocorasick.Automaton()
    for key, own in found.items():
        made.add_word(key, (len(key), own))
    made.make_automaton()
    return made


def places(automaton: ahocorasick.Automaton, text: str):
    """(form, start) of every form that stands in ``text`` as a word of its own, in any case; those of one form do not overlap."""
    folded, past = text.translate(FOLDS), {}
    inside = lambda i: 0 <= i < len(folded) and (folded[i].isalnum() or folded[i] == "_")
    for last, (size, forms) in automaton.iter(folded):
        start = last + 1 - size
        if inside(start - 1) or inside(last + 1):
            continue
        for form in forms:
            if start >= past.get(form, 0):
                past[form] = last + 1
                yield form, start


def _blocks(forms: DataFrame):
    """The names in lists of at most BLOCK_CHARS characters, one after another."""
    block, size = [], 0
    for row in forms.select("form").filter(F.trim("form") != "").distinct().toLocalIterator():
        if block and size + len(row["form"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(row["form"])
        size += len(row["form"])
    if block:
        yield block


def _scan(forms: DataFrame, docs: DataFrame, emit, schema: str) -> DataFrame:
    """Rows of ``emit(path, text, places)``: texts (path, content) are streamed through an automaton of all names, built in the tasks."""
    spark, found = docs.sparkSession, None
    asked = docs.select(F.col("path").cast("string").alias("path"), "content").filter("content is not null")
    for block in _blocks(forms):
        names = spark.sparkContext.broadcast(block)

        def scan(batches, names=names):
            automaton = _automaton(names.value)
            for batch in batches:
                rows = []
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += emit(path, text, places(automaton, text))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=columns), preserve_index=False)

        columns = [c.split()[0] for c in schema.split(", ")]
        own = asked.mapInArrow(scan, schema)
        found = own if found is None else found.union(own)
    return found if found is not None else spark.createDataFrame([], schema)


def presence(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """(form, path, n): how often each form stands as a word in the documents of a path. Each text is read once, whatever the number of forms."""

    def count(path, text, found):
        return [(form, path, n) for form, n in Counter(form for form, _ in found).items()]

    return _scan(forms, docs, count, "form string, path string, n long").groupBy("form", "path").agg(F.sum("n").alias("n"))


def form_places(forms: DataFrame, docs: DataFrame, reach: int = 40) -> DataFrame:
    """Every place of every form: form, path, at, before, exact, after (up to ``reach`` characters on either side)."""

    def tell(path, text, found):
        return [(form, path, at, text[max(0, at - reach) : at], text[at : at + len(form)], text[at + len(form) : at + len(form) + reach]) for form, at in found]

    return _scan(forms, docs, tell, "form string, path string, at long, before string, exact string, after string")


def locations(stale: DataFrame, docs: DataFrame, reach: int = 40) -> DataFrame:
    """Every place where a stale form (form, remaining) still stands: form, path, at, prefix, exact, suffix."""
    asked = stale.select("form", F.explode("remaining").alias("path"))
    there = form_places(stale, docs.join(asked.select("path").distinct(), "path", "left_semi"), reach).join(asked, ["form", "path"], "left_semi")
    return there.select("form", "path", "at", edge_context(F.col("before"), "end").alias("prefix"), "exact", edge_context(F.col("after"), "start").alias("suffix"))


def stale_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Forms that left some documents and stay in others: form, retired (paths), remaining (paths).

    ``before`` and ``after`` are presences over the paths that both versions have.
    """
    b = before.groupBy("form").agg(F.collect_set("path").alias("was"))
    a = after.groupBy("form").agg(F.collect_set("path").alias("now"))
    both = b.join(a, "form")
    return both.select("form", F.array_sort(F.array_except("was", "now")).alias("retired"), F.array_sort("now").alias("remaining")).filter(F.size("retired") > 0)


def replaced_by(stale: DataFrame, before: DataFrame, after: DataFrame, owners: DataFrame) -> DataFrame:
    """For each stale form the first other form of its entity (form, entity, ord) that is new in all documents it left."""
    pair = before.select("form", "path").withColumn("was", F.lit(True))
    new = after.select("form", "path").join(pair, ["form", "path"], "left_anti").groupBy("form").agg(F.collect_set("path").alias("new"))
    of = stale.join(owners.select("form", "entity"), "form")
    others = owners.select(F.col("form").alias("other"), "entity", "ord").join(new.withColumnRenamed("form", "other"), "other")
    fit = of.join(others, "entity").filter((F.col("other") != F.col("form")) & (F.size(F.array_except("retired", "new")) == 0))
    return fit.groupBy("form").agg(F.min_by("other", "ord").alias("replacement"))


def lost_positions(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Evidence whose address (doc_id, path of ordinals) is no more."""
    return evidence.join(segments.select("doc_id", "path"), ["doc_id", "path"], "left_anti")


def surviving_words(lost: DataFrame, texts: DataFrame) -> DataFrame:
    """Lost evidence (doc_id, exact, prefix, suffix, hint, ...) with ``words_survive``: whether its words are still in the text (doc_id, text)."""
    normal = texts.select("doc_id", normalise_whitespace(F.col("text")).alias("text"))
    found = reanchored(lost.join(normal, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit(""))))
    return found.withColumn("words_survive", F.col("anchor").isNotNull()).drop("text", "anchor")


@dataclass
class Report:
    """``stale``: form, retired, remaining, replacement. ``locations`` of those forms. ``lost``: evidence with words_survive. ``superseded``: documents."""

    stale: DataFrame | None
    locations: DataFrame | None
    lost: DataFrame | None
    superseded: DataFrame
    notes: list[str] = field(default_factory=list)


def report(forms: DataFrame, before: DataFrame, after: DataFrame, evidence: DataFrame, segments: DataFrame, texts: DataFrame, plans: DataFrame, moved: bool, types: list[str] | None = None) -> Report:
    """A reading against the text as it is now.

    ``forms``: form, entity, ord of the reading. ``before`` and ``after``: path, content of the version read and of the one
    compared. Unless the text has ``moved`` nothing can be stale or lost; superseded documents are told always. Positions
    are only checked where the division can be made again.
    """
    old = superseded(plans)
    if not moved:
        return Report(None, None, None, old)
    shared = before.select("path").join(after.select("path"), "path")
    was, now = (presence(forms, docs.join(shared, "path")) for docs in (before, after))
    stale = stale_names(was, now)
    told = stale.join(replaced_by(stale, was, now, forms), "form", "left")
    try:
        require_reproducible(types)
    except ValueError as why:
        return Report(told, locations(stale, after), None, old, [f"positions were not checked: {why}"])
    return Report(told, locations(stale, after), surviving_words(lost_positions(evidence, segments), texts), old)


def superseded(docs: DataFrame) -> DataFrame:
    """Documents of one version that another document there is a revision of."""
    newer = docs.filter("revision_of is not null").select(F.col("version"), F.col("revision_of").alias("path"), F.col("path").alias("by"))
    return docs.join(newer, ["version", "path"]).select("version", "path", "by")


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


#: Counts that a text's characters are told by; characters that share one only widen the bound.
COUNTS = 128


def character_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (ord, path, content) as ord, path, name, size and counts of the characters of the normalised text."""

    def count(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % COUNTS for t in texts]
            told = [np.bincount(c, minlength=COUNTS).astype(np.int32) for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()), pa.array(told, pa.list_(pa.int32()))], names=["ord", "path", "name", "size", "counts"])

    named = docs.filter("content is not null").select("ord", "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), normalise_whitespace(F.col("content")).alias("text"))
    kind = named.schema["ord"].dataType.simpleString()
    return named.mapInArrow(count, f"ord {kind}, path string, name string, size long, counts array<int>")


def compared(docs: DataFrame, first: int = 1) -> tuple[DataFrame, int]:
    """Each document's most similar earlier one of the same name (ord, path, earlier, similarity), and how many pairs of texts were compared.

    A ratio cannot be above twice the characters that two texts have in common, by their counts, over the characters of both.
    Pairs are made of counts only; of each document those with the highest bounds are compared first, ``first`` and then twice as
    many each time, and a pair whose bound is under the best ratio found is never compared. Exact: bounds are not under ratios.
    """

    @F.udf("double", useArrow=True)
    def ratio(a, b):
        return round(similarity(a, b), 4)

    counts = stored(character_counts(docs))
    x, y = counts.alias("x"), counts.alias("y")
    common = F.aggregate(F.zip_with("x.counts", "y.counts", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, v: s + v)
    both = F.col("x.size") + F.col("y.size")
    bound = F.when(both == 0, 1.0).otherwise(2.0 * common / both)
    met = x.join(y, F.expr("x.name = y.name and y.ord < x.ord"))
    pairs = met.select(F.col("x.ord").alias("ord"), F.col("x.path").alias("path"), F.col("y.ord").alias("earlier_ord"), F.col("y.path").alias("earlier"), (F.round(bound, 4) + 0.0001).alias("bound"))
    turn = F.row_number().over(Window.partitionBy("ord", "path").orderBy(F.desc("bound"), "earlier"))
    left = stored(pairs.withColumn("turn", turn))
    texts = docs.filter("content is not null").select("ord", "path", normalise_whitespace(F.col("content")).alias("text"))
    best, n, upto, many = None, 0, 0, first
    while True:
        upto, many = upto + many, 2 * many
        now = left.filter(F.col("turn") <= upto).select("ord", "path", "earlier_ord", "earlier")
        told = now.join(texts, ["ord", "path"]).join(texts.select(F.col("ord").alias("earlier_ord"), F.col("path").alias("earlier"), F.col("text").alias("other")), ["earlier_ord", "earlier"])
        found = stored(told.select("ord", "path", "earlier", ratio("text", "other").alias("similarity")))
        n += found.count()
        rows = found if best is None else best.unionByName(found)
        top = rows.groupBy("ord", "path").agg(F.max(F.struct("similarity", "earlier")).alias("b"))
        best = stored(top.select("ord", "path", F.col("b.earlier").alias("earlier"), F.col("b.similarity").alias("similarity")))
        open_ = left.filter(F.col("turn") > upto).join(best.select("ord", "path", "similarity"), ["ord", "path"]).filter(F.col("bound") >= F.col("similarity"))
        left = stored(open_.drop("similarity"))
        if not left.limit(1).count():
            return best, n


def revision_proposals(docs: DataFrame) -> DataFrame:
    """For each document (ord, path, content) the most similar earlier one of the same name: ord, path, earlier, similarity (four digits). Ties go to the later path."""
    return compared(docs)[0]
