"""Readers of text folders, listings, recorded replies and graph documents."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import canonical_text, content_hash
from tessella.plans.scratch import stored

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".text")


def text_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All files under ``root``: readable ones as (path, content, sha256), the others as (path, why).

    Files must be UTF-8 and hold ink; byte order marks go and line ends become line feeds. Paths are relative.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").partition(":")[2] if ":" in root else root.rstrip("/")
    relative = F.regexp_replace("path", "^.*?\\Q" + base + "/\\E", "")
    suffix = F.lower(F.regexp_extract("relative", r"(\.[^./]+)$", 1))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), canonical_text(F.decode("content", "UTF-8")))
    read = files.withColumn("relative", relative).withColumn("text", text)
    why = (
        F.when(~suffix.isin(*TEXT_SUFFIXES), "not a text file")
        .when(F.col("text").isNull(), "not UTF-8")
        .when(F.length(F.regexp_replace("text", r"(?U)\s+", "")) == 0, "empty")
    )
    judged = read.select(F.col("relative").alias("path"), "text", why.alias("why"))
    good = judged.filter("why is null").select("path", F.col("text").alias("content"), content_hash(F.col("text")).alias("sha256"))
    return good, judged.filter("why is not null").select("path", "why")


def positioned(docs: DataFrame) -> DataFrame:
    """``docs`` of one version with position from 0 in order of path.

    A version is what one source holds, and is read whole; its rows are ordered by one task, without their contents.
    """
    place = docs.select("path").withColumn("position", F.row_number().over(Window.orderBy("path")) - 1)
    return docs.join(place, "path")


#: Hosts whose folder addresses are understood (fixed values).
DRIVE_HOSTS = ("drive.google.com", "docs.google.com")
FOLDER_ID = "^[A-Za-z0-9_-]+$"


def folder_of(address: Column) -> Column:
    """The folder id of a drive address: a URL of the drive with /folders/, ``gdrive:folder/<id>``, or the id itself; null for any other."""
    plain = F.trim(address)
    ours = F.coalesce(F.try_parse_url(plain, F.lit("HOST")).isin(*DRIVE_HOSTS), F.lit(False))
    found = (
        F.when(plain.startswith("gdrive:folder/"), F.substr(plain, F.lit(15)))
        .when(F.contains(plain, F.lit("://")), F.when(ours, F.regexp_extract(F.try_parse_url(plain, F.lit("PATH")), r"/folders/([^/]+)", 1)))
        .otherwise(plain)
    )
    return F.when(found.rlike(FOLDER_ID), found)


def root_of(address: Column) -> Column:
    """The one name of a folder, whichever way it was addressed."""
    return F.concat(F.lit("gdrive:folder/"), folder_of(address))


#: Kinds of entries of a listing (fixed values).
FOLDER_TYPE, DOCUMENT_TYPE = "application/vnd.google-apps.folder", "application/vnd.google-apps.document"


def walked(entries: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents under a folder of a recorded listing (id, name, parent_id, mime_type, body), with their paths, and those that are not read.

    Folders are followed level by level, each once. Of several documents at a path the first id is read.
    """
    spark = entries.sparkSession
    folders = entries.filter(F.col("mime_type") == FOLDER_TYPE).select("id", "name", "parent_id")
    level = spark.createDataFrame([(root, "")], "folder string, prefix string")
    seen = level
    while True:
        below = folders.join(level, folders["parent_id"] == level["folder"]).select(F.col("id").alias("folder"), F.concat("prefix", "name", F.lit("/")).alias("prefix"))
        level = stored(below.join(seen.select("folder"), "folder", "left_anti").groupBy("folder").agg(F.min("prefix").alias("prefix")))
        if not level.limit(1).count():
            break
        seen = stored(seen.unionByName(level))
    files = entries.filter(F.col("mime_type") != FOLDER_TYPE).join(seen, F.col("parent_id") == F.col("folder"))
    exported = F.col("mime_type") == DOCUMENT_TYPE
    placed = files.withColumn("path", exported_path(F.concat("prefix", "name"), exported))
    text = exported | F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*TEXT_SUFFIXES)
    good, bad = listing(placed.withColumn("readable", text & F.col("body").isNotNull()))
    return good, bad


def exported_path(name: Column, exported: Column) -> Column:
    """Exported documents are Markdown and are named so."""
    return F.when(exported & ~F.lower(name).rlike(r"\.(md|markdown)$"), F.concat(name, F.lit(".md"))).otherwise(name)


def listing(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A drive listing (path, id, readable): the first readable entry of each path, and the others with a reason."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("readable"), "id"))
    ranked = entries.withColumn("_n", rank)
    taken = ranked.filter("_n = 1 and readable").drop("_n")
    why = F.when(~F.col("readable"), "cannot be read").otherwise("another document has this path")
    return taken, ranked.filter("not (_n = 1 and readable)").select("path", "id", why.alias("why"))


GRAPH = (
    "snapshot struct<id:string,work_id:string,text_revision_id:string,analysis_run_id:string>,"
    "characters array<struct<id:string,name:string,aliases:array<string>,kind:string,provenance:string,review_status:string,notes:string>>,"
    "relations array<struct<id:string,source:string,target:string,weight:double,weight_basis:string,types:array<string>,provenance:string,confidence:double,"
    "evidence:array<struct<locator:struct<document_id:string,path:array<struct<type:string,index:int>>>,selector:struct<exact:string,prefix:string,suffix:string>,note:string>>>>,"
    "_corrupt string"
)


def graph_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRAPH).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse_errors(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` that are no JSON: path, line, col, message."""

    @F.udf("struct<line:int,col:int,message:string>", useArrow=True)
    def judged(text):
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            return {"line": e.lineno, "col": e.colno, "message": e.msg}
        return None

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("e", judged("value")).filter("e is not null").select("path", "e.*")


def graph_nodes(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("snapshot.id").alias("snapshot"), F.posexplode("characters").alias("ord", "n")).select("snapshot", "ord", "n.*")


def graph_edges(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("snapshot.id").alias("snapshot"), F.posexplode("relations").alias("ord", "e")).select("snapshot", "ord", "e.*")


#: Version of the record of exchanges (fixed value).
RECORD_VERSION = 1


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """A record of exchanges: fingerprint, step, reply, stop_reason, model, provider, input_tokens, output_tokens. Another version is refused."""
    schema = "version int, fingerprint string, step string, reply string, stop_reason string, model string, provider string, input_tokens long, output_tokens long"
    rows = spark.read.schema(schema).json(path)
    other = rows.filter(~F.col("version").eqNullSafe(F.lit(RECORD_VERSION))).limit(1).collect()
    if other:
        raise ValueError(f"the record has version {other[0]['version']}, not {RECORD_VERSION}")
    return rows.drop("version")


def request_fingerprint(**fields: Column) -> Column:
    """SHA-256 of a request without its nulls, as JSON with its fields in order of name: what every kind of record is kept under."""
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])).cast("binary"), 256)


def answered(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (fingerprint, ...) with their recorded reply, and those that have none."""
    return requests.join(replies.select("fingerprint", "reply"), "fingerprint"), requests.join(replies, "fingerprint", "left_anti")


def unusable(replies: DataFrame) -> DataFrame:
    """Why a reply (reply, stop_reason) cannot be read: cut off, refused, no JSON, no object; in that order. Null where it can."""
    why = F.when(F.col("stop_reason") == "max_tokens", "cut off at its limit").when(F.col("stop_reason") == "refusal", "refused").when(F.try_parse_json("reply").isNull(), "not JSON").when(~_is_object(F.try_parse_json("reply")), "no object")
    return replies.withColumn("why", why)


@dataclass
class Extraction:
    """``claims``: window, at, first, second, quotation, types, verdict. ``mentions``: window, at, name, aliases, kind. ``usage``: one row: input_tokens, output_tokens, model, provider."""

    claims: DataFrame
    mentions: DataFrame
    usage: DataFrame


def extract(windows: DataFrame, replies: DataFrame, asserted: bool = False) -> Extraction:
    """What was said about each window (window, fingerprint, text). A window with ink that has no usable reply fails the run.

    Tokens are summed; of models the last one named counts.
    """
    asked = windows.filter(F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0)
    met = unusable(asked.join(replies, "fingerprint", "left").withColumn("_none", F.col("reply").isNull()))
    bad = met.filter("_none or why is not null").orderBy("window").limit(1).collect()
    if bad:
        raise ValueError(f"window {bad[0]['window']}: {'no reply is recorded' if bad[0]['_none'] else bad[0]['why']}")
    named = F.nullif("model", F.lit(""))
    usage = met.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.max_by(named, F.when(named.isNotNull(), F.col("window"))).alias("model"), F.max_by("provider", F.when(named.isNotNull(), F.col("window"))).alias("provider"),
    )
    said = met.select("window", "reply")
    return Extraction(assertions_of(said) if asserted else claims_of(said), mentions_of(said), usage)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _said(item: str, path: str) -> Column:
    """A value as text; what counts as nothing (null, absent, zero, false) is empty."""
    value, text = F.try_variant_get(item, path, "variant"), F.try_variant_get(item, path, "string")
    nothing = (F.schema_of_variant(value) != "STRING") & text.isin("0", "false")
    return F.when(F.coalesce(nothing, F.lit(False)), "").otherwise(F.coalesce(text, F.lit("")))


def _strings(item: str, path: str) -> Column:
    """The strings of a list, stripped, without blank ones; what is no string is left out and not made one."""
    parts = F.coalesce(F.try_variant_get(item, path, "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(parts, lambda x: F.schema_of_variant(x) == "STRING")
    return F.filter(F.transform(kept, lambda x: _stripped(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def _entries(parsed: DataFrame, key: str) -> DataFrame:
    """window, at, item: the entries of a list in replies (window, v) that are objects."""
    path = f"variant_get(v, '$.{key}', 'variant')"
    listed = f"v is not null and schema_of_variant(v) like 'OBJECT%' and schema_of_variant({path}) like 'ARRAY%'"
    return parsed.sparkSession.sql(f"select window, pos as at, value as item from {{r}}, lateral variant_explode({path}) where {listed}", r=parsed)


def mentions_of(replies: DataFrame) -> DataFrame:
    """Names in recorded replies (window, reply): window, at, name, aliases, kind. Nameless and non-object entries go; a name is no alias of itself, and only strings are aliases."""
    items = _entries(replies.withColumn("v", F.try_parse_json("reply")), "characters")
    name, kind = _stripped(_said("item", "$.name")), _said("item", "$.kind")
    aliases = F.filter(_strings("item", "$.aliases"), lambda x: x != name)
    rows = items.select("window", F.col("at").cast("long").alias("at"), name.alias("name"), aliases.alias("aliases"), F.when(kind == "", "unknown").otherwise(kind).alias("kind"), _is_object(F.col("item")).alias("_o"))
    return rows.filter("_o and name <> ''").drop("_o")


def claims_of(replies: DataFrame) -> DataFrame:
    """Claims in recorded replies (window, reply), each with a verdict: ``ok`` or why it is dropped.

    What is no string, or blank, is no participant; two must be left, and differ. A quotation stays as it was said. A reply
    that is no JSON, or no object, gives one row that says so.
    """
    return _claims(replies, "interactions").drop("types")


def assertions_of(replies: DataFrame) -> DataFrame:
    """The same for statements of reference text, which say of what types a relation is (in lower case)."""
    return _claims(replies, "relationships")


def _claims(replies: DataFrame, key: str) -> DataFrame:
    parsed = replies.withColumn("v", F.try_parse_json("reply"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    why = F.when(F.col("v").isNull(), "not JSON").when(~_is_object(F.col("v")), "no object")
    blank = [none("string", n) for n in ("first", "second", "quotation", "note")]
    bad = parsed.select("window", none("long", "at"), *blank, none("array<string>", "types"), why.alias("verdict")).filter("verdict is not null")
    two, quotation, note = _strings("item", "$.participants"), _said("item", "$.quotation"), _stripped(_said("item", "$.note"))
    verdict = (
        F.when(~_is_object(F.col("item")), "no object")
        .when(F.size(two) != 2, "not two names")
        .when(F.get(two, F.lit(0)) == F.get(two, F.lit(1)), "one name twice")
        .when(_stripped(quotation) == "", "no quotation")
        .otherwise("ok")
    )
    types = F.transform(_strings("item", "$.types"), lambda t: F.lower(t))
    rows = _entries(parsed, key).select(
        "window", F.col("at").cast("long").alias("at"), F.get(two, F.lit(0)).alias("first"), F.get(two, F.lit(1)).alias("second"), quotation.alias("quotation"), F.nullif(note, F.lit("")).alias("note"),
        types.alias("types"), verdict.alias("verdict"),
    )
    return rows.unionByName(bad)
