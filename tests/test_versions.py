"""Versions as a whole: analysis, comparison, opening, ingest, decisions, identity, structure."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import compare, continuity, decisions, documents, edges, identity, lineage, opening, segments, structure, validate
from tessella.plans import analyse as A
from tessella.plans import ingest as I  # noqa: E741
from tessella.plans.store import Store, find_store, nearest_recorded
from tessella.sources import files

TEXT = "Ann met Bob at the mill.\n\nBob  laughed\nloudly at Ann.\n\nLater they left for good, and\n\nnobody saw Cy again."


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_payloads_leave_prose_alone(spark):
    long, short = "A" * 600, "B" * 100
    text = f"[image1]: <data:image/png;base64,{long}> The quick fox. ![x](data:image/gif;base64,{short}) end"
    row = frame(spark, [(text,), ("plain words",), (None,)], "t string").select(X.without_payloads(F.col("t")).alias("c")).collect()
    assert row[0]["c"]["n"] == 1 and row[0]["c"]["text"] == f"[image1]: <image/png left out, 600 bytes of base64> The quick fox. ![x](data:image/gif;base64,{short}) end"
    assert row[1]["c"]["text"] == "plain words" and row[1]["c"]["n"] == 0


def test_ids_and_counts(spark):
    one = spark.range(1)
    made = one.select(
        X.edge_id(F.lit("char:bob"), F.lit("char:ann"), F.lit("observed")).alias("e"), X.edge_ends(F.lit("rel:ann--bob@human")).alias("x"), X.edge_ends(F.lit("other")).alias("none"),
        X.work_id(F.lit("The Mill")).alias("w"), X.collection_id(F.lit("!!")).alias("c"), X.count_occurrences(F.lit("aaaa"), F.lit("aa")).alias("n"),
        X.split_at(F.lit("abcdef"), F.lit(2), F.lit(4)).alias("s"), X.split_at(F.lit("abc"), F.lit(2), F.lit(9)).alias("bad"),
    ).first()
    assert made["e"] == "rel:ann--bob" and tuple(made["x"]) == ("char:ann", "char:bob", "human") and tuple(made["none"]) == (None, None, None)
    assert (made["w"], made["c"], made["n"]) == ("work:the-mill", "col:untitled", 3)
    assert tuple(made["s"]) == ("ab", "cd", "ef") and tuple(made["bad"]) == ("abc", "", "")


def test_version_texts_and_spans(spark):
    members = frame(spark, [("v", 1, "b"), ("v", 0, "a"), ("v", 2, "c")], "version string, position int, document string")
    docs = frame(spark, [("a", "one ", "narrative"), ("b", "two", "narrative"), ("c", "three", "reference")], "document string, content string, role string")
    assert segments.version_text(members, docs).first()["text"] == "one twothree"
    assert segments.version_text(members, docs, ["narrative"]).first()["text"] == "one two"
    spans = segments.document_spans(members, docs)
    asked = frame(spark, [("v", 0), ("v", 3), ("v", 4), ("v", 11), ("v", 12), ("v", None)], "version string, offset long")
    got = {r["offset"]: r["document"] for r in segments.document_at(asked, spans).collect()}
    assert got == {0: "a", 3: "a", 4: "b", 11: "c", 12: None, None: "a"}


def test_opening_evidence(spark):
    docs = frame(spark, [("v", TEXT)], "doc_id string, text string")
    found = segments.segments(docs)
    rows = [
        (0, [2], "Bob laughed loudly"), (1, [3], "for good, and nobody saw"), (2, [1], "laughed loudly at Ann"), (3, [9], "nobody saw Cy"), (4, [2], "Bob laughed loudly at Ann, she thought"), (5, [9], "nothing like it at all"), (6, [1], ""),
    ]
    asked = frame(spark, [("v", i, p, q, "", "", None) for i, p, q in rows], "doc_id string, item int, path array<int>, exact string, prefix string, suffix string, hint int")
    at = {r["item"]: r for r in opening.find_passages(asked, found).collect()}
    assert (at[0]["start"], at[0]["widened"]) == (0, False) and at[1]["widened"] and at[1]["passage"] == "Later they left for good, and nobody saw Cy again."
    assert at[2]["widened"] and not at[3]["found"] and at[4]["start"] is None and at[6]["passage"] == "Ann met Bob at the mill."
    got = {r["item"]: r for r in opening.open_evidence(asked, found).collect()}
    assert len(got) == len(rows)
    assert got[0]["passage"] == "Bob laughed loudly at Ann." and not got[0]["moved"]
    assert got[1]["path"] == [3] and got[1]["widened"] and got[1]["passage"].endswith("Cy again.")
    assert got[2]["path"] == [2] and got[2]["moved"] and got[2]["start"] == 4
    assert got[3]["path"] == [4] and got[3]["moved"]
    assert got[5]["path"] is None and got[5]["passage"] is None
    assert got[6]["passage"] == "Ann met Bob at the mill." and got[6]["start"] is None
    with pytest.raises(ValueError):
        opening.require_reproducible(["chapter"])
    one = opening.opened_by_index(asked.withColumn("edge", F.lit("e")).withColumn("stored", F.col("item")).drop("item"), found, "e", 2).first()
    assert one["parts"]["quoted"] == "laughed loudly at Ann" and one["note"].startswith("The passage has moved")


NODE = "snapshot string, ord int, id string, key string, forms array<string>"
EDGE = "snapshot string, ord int, source string, target string, weight double, types array<string>, weight_basis string"


def test_whole_difference_and_guards(spark):
    snaps = frame(spark, [("s1", "w", "r1", "n1"), ("s2", "w", "r2", "n2"), ("s3", "other", "r1", "n1")], "snapshot string, work string, revision string, run string")
    run = "run string, model string, provider string, prompt_version string, prompt_sha256 string, pipeline_version string, parameters string"
    runs = frame(spark, [("n1", "m", "p", "1", "h", "1", "{}"), ("n2", "m", "p", "1", "h", "1", "{}")], run)
    nodes = frame(spark, [("s1", 0, "a", "ann", []), ("s1", 1, "b", "bob", []), ("s2", 0, "a", "ann", ["bob"])], NODE)
    links = frame(spark, [("s1", 0, "a", "b", 1.0, [], "x"), ("s1", 1, "a", "c", 2.0, [], "x"), ("s2", 0, "a", "c", 5.0, [], "x")], EDGE)
    d = compare.diff_snapshots(snaps, runs, nodes, links, "s1", "s2")
    assert d.attribution == "text" and d.basis == "x" and not d.warnings and not d.empty()
    assert [r["id"] for r in d.nodes_of("merged").collect()] == ["b"]
    assert [(r["a"], r["b"], r["delta"]) for r in d.edges_of("strengthened").collect()] == [("a", "c", 3.0)]
    with pytest.raises(compare.NotComparable):
        compare.diff_snapshots(snaps, runs, nodes, links, "s1", "s3")
    of = "snapshot string, prompt_sha256 string, collectives boolean"
    two = snaps.filter("snapshot <> 's3'")
    reason = lambda rows, e=links: compare.guard(frame(spark, rows, of), e, two).first()[0]
    assert reason([("s1", "h", True), ("s2", "h", False)]).startswith("collectives")
    assert reason([("s1", "h", None), ("s2", None, None)]) == "a run has no prompt hash" == reason([("s1", "h", None)])
    assert reason([("s1", "h", None), ("s2", "g", None)]) == "the prompts differ"
    assert reason([("s1", "h", None), ("s2", "h", None)]) is None
    mixed = links.withColumn("weight_basis", F.col("snapshot"))
    assert reason([("s1", "h", None), ("s2", "h", None)], mixed) == "the bases of weights differ"
    assert compare.diff_snapshots(snaps, runs, nodes, mixed, "s1", "s2").warnings


def test_recording_decisions(spark):
    nodes = frame(spark, [(0, "char:a", "Ann", None), (1, "char:b", "Bob", "accepted")], "ord int, id string, name string, review_status string")
    links = frame(spark, [(0, "rel:a--b", "char:a", "char:b", None)], "ord int, id string, source string, target string, review_status string")
    known = decisions.subjects(nodes, links)
    assert [r["label"] for r in known.orderBy("place").collect()] == ["Ann", "Bob", "Ann and Bob"]
    standing = frame(spark, [("character", "char:a", "rejected", "why")], "kind string, id string, status string, note string")
    none = frame(spark, [], "kind string, id string")
    ask = [("character", "char:a", "rejected", " why "), ("character", "char:a", "rejected", None), ("relation", "rel:a--b", "corrected", " "), ("relation", "rel:a--b", "nice", "x"), ("thing", "x", "accepted", None), ("character", "char:z", "accepted", None), ("relation", "rel:a--b", "corrected", "type")]
    good, bad = decisions.record_reviews(frame(spark, ask, "kind string, id string, status string, note string"), known, standing, none)
    assert {(r["id"], r["status"], r["note"]) for r in good.collect()} == {("char:a", "rejected", None), ("rel:a--b", "corrected", "type")}
    assert sorted(r["reason"] for r in bad.collect()) == ["not a kind of subject", "not a status", "not in the snapshot", "says nothing about what is corrected"]
    over = decisions.review_overlay(known, standing)
    assert {r["id"]: r["status"] for r in over.collect()} == {"char:a": "rejected", "char:b": "accepted", "rel:a--b": "proposed"}
    fresh = frame(spark, [("relation", "rel:a--b", "accepted", None)], "kind string, id string, status string, note string")
    assert [(r["status"], r["n"]) for r in decisions.tally(decisions.with_decision(over, fresh)).orderBy("rank").collect()] == [("proposed", 0), ("accepted", 2), ("corrected", 0), ("rejected", 1)]


def test_recording_corrections(spark):
    held = [("character", "1", "name", '"Ann"'), ("character", "1", None, None), ("relation", "2", None, None)]
    ask = [
        ("character", "1", "name", '" Anna "'), ("character", "1", "name", '" "'), ("character", "1", "weight", "3"), ("character", "1", "types", "[]"), ("relation", "2", "types", '[" kin ", ""]'),
        ("relation", "2", "valence", "2"), ("relation", "2", "valence", "0.5"), ("relation", "2", "directed", "1"), ("relation", "2", "directed", "true"), ("character", "9", "notes", '"x"'), ("character", "1", "kind", '"ghost"'), ("character", "1", "colour", '"x"'),
    ]
    requests = frame(spark, [(*a, None) for a in ask], "kind string, id string, field string, value string, note string")
    standing = frame(spark, [("relation", "2", "directed", "true", None)], "kind string, id string, field string, value string, note string")
    good, reviews, bad = decisions.record_corrections(requests, frame(spark, held, "kind string, id string, field string, value string"), standing)
    assert {(r["field"], r["value"], r["was"]) for r in good.collect()} == {("name", '"Anna"', '"Ann"'), ("types", '["kin"]', None), ("valence", "0.5", None)}
    assert bad.count() == 8 and {r["id"] for r in reviews.collect()} == {"1", "2"}
    same = frame(spark, [('""', None, True), ("[]", '"x"', False), ("[1, 2]", "[1,2]", True)], "a string, b string, want boolean").withColumn("got", decisions.same_value(F.col("a"), F.col("b")))
    assert all(r["got"] == r["want"] for r in same.collect())


ENTITY = "entity_id string, collection_id string, name string, kind string, notes string, provenance string, review_status string, merged_into string"
FORM = "entity_id string, collection_id string, ord int, form string, form_key string"


def test_merging_and_splitting(spark):
    ents = frame(spark, [("char:a", "c", "Ann", "unknown", None, "observed", "proposed", None), ("char:b", "c", "Bob", "person", "tall", "observed", "proposed", None), ("char:z", "c", "Zoe", "person", None, "observed", None, None)], ENTITY)
    forms = frame(spark, [("char:a", "c", 0, "Ann", "ann"), ("char:a", "c", 1, "Annie", "annie"), ("char:b", "c", 0, "Bob", "bob"), ("char:z", "c", 0, "Zoe", "zoe")], FORM)
    for bad in (("char:a", "char:a"), ("char:a", "char:q")):
        with pytest.raises(identity.IdentityError):
            identity.merge(ents, forms, "c", *bad)
    fixed = frame(spark, [("w1", "character", "char:a", "aliases")], "work string, kind string, id string, field string")
    m = identity.merge(ents, forms, "c", "char:a", "char:b", "same", fixed)
    rows = {r["entity_id"]: r for r in m.entities.collect()}
    assert (rows["char:a"]["kind"], rows["char:a"]["notes"], rows["char:b"]["merged_into"], len(m.warnings)) == ("person", "tall", "char:a", 1)
    assert [r["form"] for r in m.forms.filter("entity_id = 'char:a'").orderBy("ord").collect()] == ["Ann", "Annie", "Bob"]
    assert m.decision.first()["forms"] == ["Bob"] and [r["entity_id"] for r in identity.retired(m.entities).collect()] == ["char:b"]
    with pytest.raises(identity.IdentityError):
        identity.merge(m.entities, m.forms, "c", "char:z", "char:b")
    many_e, many_f = identity.merged_registry(ents, forms, frame(spark, [("char:b", "char:a")], "from_id string, to_id string"))
    assert sorted(map(tuple, many_f.collect())) == sorted(map(tuple, m.forms.collect()))
    assert {r["entity_id"]: r["merged_into"] for r in many_e.collect()} == {"char:a": None, "char:b": "char:a", "char:z": None}
    for moving, name in ((["Ann", "Annie", "Bob"], None), (["Nobody"], None), ([" "], None), (["Bob"], "Zoe")):
        with pytest.raises(identity.IdentityError):
            identity.split(m.entities, m.forms, "c", "char:a", moving, name)
    s = identity.split(m.entities, m.forms, "c", "char:a", ["Bob", "bob", "Ann"])
    made = s.decision.first()["target_id"]
    assert made == "char:bob" and {r["entity_id"]: r["name"] for r in s.entities.collect()}["char:a"] == "Annie"
    assert [r["form"] for r in s.forms.filter(F.col("entity_id") == made).orderBy("ord").collect()] == ["Bob", "Ann"]
    line = identity.described(s.decision.withColumn("decided_at", F.lit("2020")).withColumn("seq", F.lit(1))).first()["line"]
    assert line == "2020  split char:a => char:bob  (Bob, Ann)"


def test_structure(spark):
    body = "Title page words here\n\nIt began in the rain and went on.\n\nThe end came.\n\nThanks to all."
    docs = frame(spark, [(0, "d1/one.md", body), (1, "d2/one.md", body + " more"), (2, "two.md", "other text")], "ord int, path string, content string")
    plans = structure.proposed(docs)
    by = {r["path"]: r for r in plans.collect()}
    assert by["d2/one.md"]["revision_of"] == "d1/one.md" and "in common" in by["d2/one.md"]["revision_basis"] and by["two.md"]["revision_of"] is None
    said = frame(spark, [("d1/one.md", "narrative", "a story", "It began in the rain", "The end came."), ("d2/one.md", "unsure", None, None, None)], "path string, role string, reason string, begins string, ends string")
    got = {r["path"]: r for r in structure.answered(plans, docs, said).collect()}
    assert [x["label"] for x in got["d1/one.md"]["regions"]] == ["before the narrative", "narrative", "after the narrative"] and got["d2/one.md"]["role"] == "unknown" and got["two.md"]["note"]
    settle = lambda rows: structure.confirmed(structure.answered(plans, docs, said), frame(spark, rows, "path string, role string"))
    for rows in ([("x", "narrative")], [("two.md", "poem")], [("two.md", "reference")]):
        with pytest.raises(structure.StructureError):
            settle(rows)
    with pytest.raises(structure.StructureError):
        structure.require_settled(plans)
    done = settle([("two.md", "excluded"), ("d2/one.md", "reference")])
    assert {r["role"] for r in structure.require_settled(done).collect()} == {"narrative", "excluded", "reference"}
    assert structure.plan_summary(done).first()["sentence"] == "2 documents will be read, 1 left out" and not structure.plan_summary(plans).first()["ready"]
    newer = docs.withColumn("content", F.when(F.col("ord") == 0, F.concat(F.lit("New preface. "), "content")).otherwise(F.col("content")))
    back = {r["path"]: r for r in structure.restored(structure.proposed(newer), newer, done).collect()}
    assert back["d1/one.md"]["role_settled"] and back["d1/one.md"]["regions"][1]["starts_at"] == got["d1/one.md"]["regions"][1]["starts_at"] + len("New preface. ")
    cut = [{"label": "x", "role": "excluded", "begins_with": "", "ends_with": ""}, {"label": "n", "role": "narrative", "begins_with": "It began  in the rain", "ends_with": ""}]
    assert structure.kept_text(body, cut)[0].startswith("It began") and structure.kept_text("no such", cut)[1] and structure.kept_text(body, cut[:1])[1]


def test_a_version_is_hashed_as_a_stream(spark, monkeypatch):
    texts = ["\ufeffone\r\ntwo", None, "", "é" * 3000, "three\rfour"]
    rows = spark.createDataFrame(list(enumerate(texts)), "position long, content string").repartition(3)
    joined = "one\ntwo" + "é" * 3000 + "three\nfour"
    want = hashlib.sha256(joined.encode()).hexdigest()
    boom = lambda *_: (_ for _ in ()).throw(AssertionError("all texts in one array"))
    monkeypatch.setattr(F, "collect_list", boom)
    regions = "path string, role string, regions array<struct<label:string,role:string,starts_at:int,ends_at:int,begins_with:string,ends_with:string>>"
    none = ["work string, title string, collection string, root string", "collection string, name string", "revision string, work string, created_at string, seq long", "version string, position int, document string", "document string, path string, sha256 string", regions]
    docs = rows.select(F.concat(F.lit("p"), F.col("position").cast("string")).alias("path"), "content")
    reading = I.Reading(docs, spark.createDataFrame([], "path string, why string"), "/x")
    assert I.ingest(reading, *[spark.createDataFrame([], x) for x in none]).sha256 == want
    assert I.version_hash(rows) == want and I.version_hash(rows.limit(0)) == hashlib.sha256(b"").hexdigest()


def test_ingest_of_folders_and_listings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "one.md").write_text("first text")
    (tmp_path / "src" / "two.txt").write_text("second text")
    (tmp_path / "src" / "pic.png").write_text("x")
    empty = {
        "works": "work string, title string, collection string, root string", "collections": "collection string, name string", "revisions": "revision string, work string, created_at string, seq long",
        "members": "version string, position int, document string", "documents": "document string, path string, sha256 string", "plans": f"path string, role string, regions array<{structure.REGION}>",
    }
    t = {k: frame(spark, [], v) for k, v in empty.items()}
    order = ["works", "collections", "revisions", "members", "documents", "plans"]
    source = I.FolderSource(spark, str(tmp_path / "src"))
    got = I.ingest(source.read(), *[t[k] for k in order])
    assert (got.work, got.collection, got.compared_with) == ("work:src", "col:src", None) and {r["state"] for r in got.documents.collect()} == {"added"} and got.skipped.count() == 1
    docs = spark.createDataFrame(got.documents.collect(), got.documents.schema)  # as it was before the files change
    t["documents"], t["members"] = docs.select("document", "path", "sha256"), docs.select(F.lit(got.revision).alias("version"), "position", "document")
    t["revisions"] = frame(spark, [(got.revision, got.work, "2020", 1)], empty["revisions"])
    t["works"] = frame(spark, [(got.work, "src", got.collection, source.root)], empty["works"])
    t["collections"] = frame(spark, [(got.collection, "src")], empty["collections"])
    (tmp_path / "src" / "two.txt").write_text("second text, revised")
    again = I.ingest(source.read(), *[t[k] for k in order], title=None)
    assert again.compared_with == got.revision and {r["path"]: r["state"] for r in again.documents.collect()} == {"one.md": "unchanged", "two.txt": "changed"}
    plans = frame(spark, [("one.md", "excluded", [])], empty["plans"])
    left = I.ingest(source.read(), *[t[k] for k in order[:-1]], plans)
    assert [r["path"] for r in left.documents.collect()] == ["two.txt"] and left.notes.count() == 1
    with pytest.raises(I.IngestError):
        I.ingest(source.read(), *[t[k] for k in order], collection="another")
    folder, doc = files.FOLDER_TYPE, files.DOCUMENT_TYPE
    rows = [("f1", "sub", "root", folder, None), ("f1", "loop", "f1", folder, None), ("d1", "a", "f1", doc, "text a"), ("d2", "a.md", "f1", "text/markdown", "text b"), ("d3", "p.png", "root", "image/png", None), ("d4", "far.md", "elsewhere", "text/markdown", "x")]
    read = I.ListingSource(frame(spark, rows, "id string, name string, parent_id string, mime_type string, body string"), "root").read()
    assert [(r["path"], r["content"]) for r in read.documents.collect()] == [("sub/a.md", "text a")] and read.skipped.count() == 2


def test_analysis_from_recorded_replies(spark):
    sha, other = "p1", "p2"
    members = frame(spark, [("v", 0, "d0"), ("v", 1, "d1"), ("v", 2, "d2")], "version string, position int, document string")
    bible = "Ann and Cy are siblings."
    docs = frame(spark, [("d0", TEXT[:55], "narrative"), ("d1", TEXT[55:], "narrative"), ("d2", bible, "reference")], "document string, content string, role string")
    text = frame(spark, [("v", TEXT)], "doc_id string, text string")
    said = {
        "characters": [{"name": "Ann", "aliases": ["Annie", "Ann"], "kind": "person"}, {"name": "Bob", "aliases": ["Annie"]}, {"name": " "}, 3],
        "interactions": [{"participants": ["Ann", "Bob"], "quotation": "Ann met Bob"}, {"participants": ["Bob", "Ann"], "quotation": "Bob laughed loudly"}, {"participants": ["Ann", "Bob"], "quotation": "never said"}, {"participants": ["Ann", "Ghost"], "quotation": "Ann met"}],
    }
    told = {"characters": [{"name": "ann"}, {"name": "Cy"}], "relationships": [{"participants": ["Ann", "Cy"], "quotation": "Ann and Cy are siblings", "types": [" Kin "]}]}
    schema = "fingerprint string, reply string, stop_reason string, model string, provider string, input_tokens long, output_tokens long"
    record = [(A.windows_of(text, segments.segments(text), sha).first()["fingerprint"], json.dumps(said), "end", "m", "p", 10, 5)]
    ref = frame(spark, [("v", bible)], "doc_id string, text string")
    record.append((A.windows_of(ref, segments.segments(ref), other).first()["fingerprint"], json.dumps(told), "end", "m", "p", 7, 2))
    replies = frame(spark, record, schema)
    registry = frame(spark, [("bob", "char:robert", "Robert", "person")], "key string, entity_id string, name string, kind string")
    got = A.analyse("v", members, docs, replies, registry, sha, other, most_rejected=None)
    rows = {(r["source"], r["target"]): r for r in got.edges.collect()}
    assert rows[("char:ann", "char:robert")]["weight"] == 2 and rows[("char:ann", "char:robert")]["id"] == "rel:ann--robert"
    assert rows[("char:ann", "char:cy")]["types"] == ["kin"] and rows[("char:ann", "char:cy")]["provenance"] == "asserted" and len(rows) == 2
    assert {r["id"]: r["registered"] for r in got.nodes.collect()} == {"char:ann": False, "char:robert": True, "char:cy": False}
    assert [r["verdict"] for r in got.rejected.collect()] == ["not in the source"] and [r["reason"] for r in got.refused.collect()] == ["unresolved"]
    assert [r["alias_key"] for r in got.dropped.collect()] == ["annie"]
    pieces = sorted((r["provenance"], r["document"], r["exact"]) for r in got.evidence.collect())
    assert pieces == [("asserted", "d2", "Ann and Cy are siblings"), ("observed", "d0", "Ann met Bob"), ("observed", "d0", "Bob laughed loudly")]
    with pytest.raises(ValueError):
        A.analyse("v", members, docs, replies.limit(0), registry, sha, other)
    with pytest.raises(ValueError):
        A.analyse("v", members, docs, replies.withColumn("stop_reason", F.lit("max_tokens")), registry, sha)
    with pytest.raises(ValueError):
        A.analyse("v", members, docs.withColumn("content", F.lit(" ")), replies, registry, sha)


def test_documents_are_built_checked_and_saved(spark, tmp_path):
    ev = frame(spark, [("char:a", "char:b", 5, "d", [("section", 1)], "hi", "", "x", None), ("char:a", "char:b", None, None, None, "loose", "", "", None), ("char:a", "char:b", 2, "d", [("section", 2)], "yo", "", "", None)],
               "source string, target string, passage long, document string, chain array<struct<type:string,index:int>>, exact string, prefix string, suffix string, note string")
    links = frame(spark, [("rel:a--b", "char:a", "char:b", 3.0, "x", ["kin"], "observed")], "id string, source string, target string, weight double, weight_basis string, types array<string>, provenance string")
    shown = documents.rendered_edges(links, ev)
    assert [p["selector"]["exact"] for p in shown.first()["relation"]["evidence"]] == ["yo", "hi", "loose"]
    run = documents.identified_run(frame(spark, [("m", "p", "1", "h", "1", "{}", "2020")], "model string, provider string, prompt_version string, prompt_sha256 string, pipeline_version string, parameters string, started_at string"))
    head = documents.with_snapshot_id(run.withColumns({c: F.lit(v) for c, v in {"work": "w", "title": "T", "collection": "c", "collection_name": "C", "revision": "rev:1", "revision_sha256": "h", "created_at": "2020"}.items()}))
    snap = head.first()["snapshot"]
    nodes = frame(spark, [(snap, 0, "char:b", "Bob", "person", "observed", None, [], ""), (snap, 1, "char:a", "Ann", "person", "observed", None, ["Annie"], "n")],
                  "snapshot string, ord int, id string, name string, kind string, provenance string, review_status string, aliases array<string>, notes string")
    rel = shown.select(F.lit(snap).alias("snapshot"), F.lit(0).alias("ord"), "relation")
    docs = frame(spark, [("rev:1", 0, "d", "narrative", "h", "one.md")], "revision string, position int, document string, role string, sha256 string, path string")
    built = documents.build_document(head, nodes, rel, docs)
    doc = json.loads(built.first()["document"])
    assert [c["name"] for c in doc["characters"]] == ["Ann", "Bob"] and "notes" not in doc["characters"][1] and doc["relations"][0]["evidence"][0]["selector"] == {"exact": "yo"}
    assert doc["snapshot"]["id"] == snap and doc["documents"][0]["path"] == "one.md"
    flat = frame(spark, [(snap, 0, "rel:a--b", "char:a", "char:b", 3.0, "x", ["kin"], "observed", None, [("d", "hi")])],
                 "snapshot string, ord int, id string, source string, target string, weight double, weight_basis string, types array<string>, provenance string, confidence double, evidence array<struct<document:string,exact:string>>")
    held = docs.select(F.lit(snap).alias("snapshot"), "document")
    assert validate.document_issues(nodes, flat, held).count() == 0
    store = Store(spark, str(tmp_path / "store"))
    documents.save_snapshot(store, built, run, nodes, flat, held)
    documents.save_snapshot(store, built, run, nodes, flat, held)
    assert store.read("snapshots").count() == 1 and store.read("runs").count() == 1
    wrong = flat.withColumns({"target": F.lit("char:z"), "evidence": F.transform("evidence", lambda e: e.withField("document", F.lit("gone")))})
    assert sorted((r["kind"], r["path"]) for r in validate.document_issues(nodes, wrong, held).collect()) == [("reference", "/relations/0/evidence/0"), ("reference", "/relations/0/target")]
    assert [r["kind"] for r in validate.document_issues(nodes, wrong.withColumn("weight", F.lit(-1.0)), held).collect()] == ["schema"]
    with pytest.raises(documents.SnapshotError):
        documents.save_snapshot(store, built, run, nodes, wrong, held)
    axes = validate.axis_issues(head.select("snapshot", "work", "revision", "run"), head.select("work"), frame(spark, [("rev:2",)], "revision string"), run)
    assert [(r["axis"], r["what"]) for r in axes.collect()] == [("revision", "rev:1")]


def test_lineage_registry_and_settings(spark):
    snaps = frame(spark, [("s1", "w1", "r1", "n1", "2020", 1), ("s2", "w1", "r2", "n2", "2021", 2), ("s3", "w2", "r9", "n1", "2019", 3)], "snapshot string, work string, revision string, run string, created_at string, seq long")
    revs = frame(spark, [("r1", "w1", "2020", 1), ("r2", "w1", "2020", 2)], "revision string, work string, created_at string, seq long")
    runs = frame(spark, [("n1", "2020", 2, "c1", '{"effort": "low", "target_characters": 9}'), ("n2", "2020", 1, "c2", "{}")], "run string, started_at string, seq long, configuration string, parameters string")
    members = frame(spark, [("r1", 0, "d")], "version string, position int, document string")
    nodes = frame(spark, [("s1", "a"), ("s2", "a"), ("s2", "b"), ("s3", "a")], "snapshot string, id string")
    links = frame(spark, [("s1", "a", "z"), ("s2", "a", "b")], "snapshot string, source string, target string")
    a, b, c = lineage.lineage_rows("w1", revs, members, snaps, runs, nodes, links)
    assert [(r["revision"], r["n_documents"]) for r in a.collect()] == [("r1", 1), ("r2", 0)] and [r["run"] for r in b.collect()] == ["n2", "n1"]
    assert [(r["snapshot"], r["n_nodes"], r["n_edges"]) for r in c.collect()] == [("s1", 1, 1), ("s2", 2, 1)]
    assert {r["configuration"]: r["place"] for r in lineage.column_order(runs).collect()} == {"c2": 0, "c1": 1}
    placed = snaps.join(runs.select("run", "configuration"), "run")
    assert [r["snapshot"] for r in lineage.orphans(revs, runs, placed).collect()] == ["s3"]
    ents = frame(spark, [("a", "Ann"), ("b", "Bob"), ("q", "Q")], "id string, name string")
    works = frame(spark, [("w1", "One", "c", "/x"), ("w2", "Two", "c", "/y"), ("w3", "Three", "c", "/x")], "work string, title string, collection string, root string")
    reg, never = lineage.registry(ents, works, snaps, nodes, links)
    assert [(r["id"], r["n_works"], r["degree"]) for r in reg.collect()] == [("a", 2, 1), ("b", 1, 1), ("q", 0, 0)] and [r["work"] for r in never.collect()] == ["w3"]
    assert lineage.newest_of_project(snaps) == "s2" and lineage.has_history(snaps)
    held = frame(spark, [("c", "a", None), ("c", "b", "a")], "collection string, id string, merged_into string")
    assert [(r["work"], r["n_revisions"], r["newest"], r["n_entities"]) for r in lineage.status(works, revs, snaps, held).orderBy("work").collect()] == [("w1", 2, "s2", 1), ("w2", 0, "s3", 1), ("w3", 0, None, 1)]
    assert [r["title"] for r in lineage.listed("works", works, collection="c").collect()] == ["One", "Three", "Two"]
    assert {r["root"]: r["work"] for r in lineage.work_at(works, works.select("root").distinct()).collect()} == {"/x": "w1", "/y": "w2"}
    kept, told = lineage.settings_like(snaps, runs, "s1", {"target_characters": 5})
    assert kept == {"effort": "low", "target_characters": 5, "max_rejection_rate": None} and told == ["target_characters: 5 in place of 9"]


def test_continuity_report(spark):
    forms = frame(spark, [("Ann", "e", 0), ("Anna", "e", 1)], "form string, entity string, ord int")
    docs = lambda rows: frame(spark, rows, "path string, content string")
    before, after = docs([("1", "Ann went."), ("2", "So Ann came.")]), docs([("1", "Anna went."), ("2", "So Ann came."), ("3", "new")])
    text = frame(spark, [("v", TEXT)], "doc_id string, text string")
    ev = frame(spark, [("v", [1], "Ann met Bob", "", "", None), ("v", [8], "nobody saw Cy", "", "", None), ("v", [9], "quite absent words", "", "", None)], "doc_id string, path array<int>, exact string, prefix string, suffix string, hint int")
    plans = frame(spark, [("v", "b.md", "a.md"), ("v", "a.md", None)], "version string, path string, revision_of string")
    r = continuity.report(forms, before, after, ev, segments.segments(text), text, plans, moved=True)
    assert [(x["form"], x["replacement"]) for x in r.stale.collect()] == [("Ann", "Anna")]
    assert [(x["path"], x["at"], x["prefix"], x["exact"], x["suffix"]) for x in r.locations.collect()] == [("2", 3, "So ", "Ann", " came.")]
    assert {x["exact"]: x["words_survive"] for x in r.lost.collect()} == {"nobody saw Cy": True, "quite absent words": False}
    assert [(x["path"], x["by"]) for x in r.superseded.collect()] == [("a.md", "b.md")]
    assert continuity.report(forms, before, after, ev, segments.segments(text), text, plans, moved=False).stale is None
    assert continuity.report(forms, before, after, ev, segments.segments(text), text, plans, True, ["chapter"]).notes


def test_views(spark):
    cols = "id string, source string, target string, weight double, weight_basis string, types array<string>, provenance string, valence double, confidence double, directed boolean"
    links = frame(spark, [("1", "a", "b", 2.0, "x", ["kin", "foe"], "observed", 0.4, 0.2, True), ("2", "b", "c", 2.5, "x", ["foe"], "asserted", None, None, None)], cols)
    o = edges.options(links).first()
    assert (o["types"], o["provenances"], o["least"], o["most"], o["weights_usable"], o["basis"]) == (["foe", "kin"], ["observed", "asserted"], 2.0, 2.5, True, "x")
    names = frame(spark, [("a", "Ann"), ("b", "Bob")], "id string, name string")
    shown = {r["id"]: r for r in edges.described_edges(links, names).collect()}
    assert shown["1"]["title"] == "Ann → Bob" and shown["2"]["title"] == "Bob — c"
    assert [(f["label"], f["value"]) for f in shown["1"]["fields"]] == [("Weight", "2 x"), ("Valence", "+0.40"), ("Confidence", "0.20"), ("Provenance", "observed"), ("Id", "1")]
    assert [f["label"] for f in shown["2"]["fields"]] == ["Weight", "Provenance", "Id"]
    found = edges.declared_and_enacted(links.withColumn("ord", F.lit(0)))
    assert {r["id"]: r["finding"] for r in edges.finding_marks(links, found).collect()} == {"1": "enacted_only", "2": "declared_only"}
    assert {r["subject"] for r in edges.finding_list(found, names).collect()} == {"Ann and Bob", "Bob and c"}
    assert edges.finding_sentence(found).first()[0] == "1 declared but never enacted, 1 enacted but never declared; 0 agreed."
    said = edges.confidence_summary(links).select(edges.confidence_sentence(F.col("n"), F.col("n_said"), F.col("n_uncertain")).alias("s")).first()["s"]
    assert said == "1 of 2 relation(s), 1 below 0.50" and [r["id"] for r in edges.uncertain(links).collect()] == ["1"]
    assert [r["id"] for r in edges.edge_between(links, frame(spark, [("b", "a")], "a string, b string")).collect()] == ["1"]


def test_records_and_places(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert find_store(str(tmp_path / "a" / "b")) == str(tmp_path / "store") and find_store(str(tmp_path), explicit="/x") == "/x"
    store = Store(spark, str(tmp_path / "s2"))
    row = lambda f, r: frame(spark, [(f, "extract", r)], "fingerprint string, step string, reply string")
    store.record_replies(row("1", "a"))
    store.record_replies(row("1", "b").union(row("2", "c")))
    assert {(r["fingerprint"], r["reply"]) for r in store.read("replies").collect()} == {("1", "a"), ("2", "c")}
    near = nearest_recorded(row("9", "x").withColumn("p", F.lit(1)).withColumn("q", F.lit(1)), row("1", "a").withColumn("p", F.lit(1)).withColumn("q", F.lit(2)), ["p", "q"]).first()
    assert near["nearest"] == "1" and near["differs"] == ["q"]
    store.write("settings", frame(spark, [("a", "1"), ("b", "2")], "name string, value string"))
    assert store.delete_where("settings", F.col("name") == "a") == 1 and store.read("settings").count() == 1
    store.upsert("settings", frame(spark, [("b", "3", "x")], "name string, value string, extra string"), ["name"])
    assert tuple(store.read("settings").first()) == ("b", "3", "x")
    (tmp_path / "bad.json").write_text('{"a": 1,\n oops}')
    assert files.parse_errors(spark, str(tmp_path / "bad.json")).first()["line"] == 2
    (tmp_path / "tape.json").write_text('{"version": 2, "fingerprint": "x"}')
    with pytest.raises(ValueError):
        files.recorded(spark, str(tmp_path / "tape.json"))
