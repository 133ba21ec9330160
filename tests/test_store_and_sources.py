import pytest
from pyspark.sql import functions as F

from tessella.plans.store import Store
from tessella.sources import files


def test_store_versions_logs_and_guards(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda *r: spark.createDataFrame([r], "id string, title string, lang string")
    assert store.read("works") is None
    store.upsert("works", row("1", "a", "en"), ["id"])
    store.upsert("works", row("1", "b", None), ["id"])
    store.upsert("works", row("2", "c", None), ["id"])
    assert sorted(map(tuple, store.read("works").collect())) == [("1", "b", "en"), ("2", "c", None)]
    log = lambda t: spark.createDataFrame([(t, "x")], "at string, what string")
    store.append("reviews", log("2"), ["at"])
    store.append("reviews", log("1"), ["at"])
    assert sorted((r["seq"], r["at"]) for r in store.read("reviews").collect()) == [(1, "2"), (2, "1")]
    form = lambda f, e: spark.createDataFrame([("c", f, e)], "collection_id string, form_key string, entity_id string")
    store.claim_forms(form("ann", "e1"))
    with pytest.raises(ValueError):
        store.claim_forms(form("ann", "e2"))
    store.claim_forms(form("anna", "e1"))
    assert [r["form_key"] for r in store.read("forms").collect()] == ["anna"]
    snap = lambda i, h: spark.createDataFrame([(i, h)], "id string, sha256 string")
    store.insert_snapshot(snap("s", "1"))
    store.insert_snapshot(snap("s", "1"))
    assert store.read("snapshots").count() == 1
    with pytest.raises(ValueError):
        store.insert_snapshot(snap("s", "2"))


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_bytes("﻿one\r\ntwo".encode())
    (tmp_path / "b.TXT").write_bytes(b"x\ry")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_bytes(b" \n")
    (tmp_path / "e.png").write_bytes(b"z")
    good, skipped = files.text_folder(spark, str(tmp_path))
    assert {(r["path"], r["content"]) for r in good.collect()} == {("sub/a.md", "one\ntwo"), ("b.TXT", "x\ny")}
    assert {(r["path"], r["why"]) for r in skipped.collect()} == {("c.txt", "not UTF-8"), ("d.txt", "empty"), ("e.png", "not a text file")}


def test_claims_in_replies(spark):
    body = '{"interactions": [{"participants": ["Ann", "Bob"], "quotation": "hi"}, {"participants": ["Ann", 3], "quotation": "x"}, {"participants": ["A", "a"], "quotation": "x"}, {"participants": ["A", "B"], "quotation": " "}]}'
    replies = spark.createDataFrame([(1, body), (2, "{nope")], "window int, reply string")
    got = sorted((r["window"], r["at"] if r["at"] is not None else -1, r["verdict"]) for r in files.claims_of(replies).collect())
    assert got == [(1, 0, "ok"), (1, 1, "not two names"), (1, 2, "ok"), (1, 3, "no quotation"), (2, -1, "not JSON")]


def test_listing_and_addresses(spark):
    rows = spark.createDataFrame([("a", "2", True), ("a", "1", False), ("b", "3", True), ("a", "4", True)], "path string, id string, readable boolean")
    taken, skipped = files.listing(rows)
    assert {r["id"] for r in taken.collect()} == {"2", "3"} and skipped.count() == 2
    urls = ["https://drive.google.com/drive/folders/abc_1?x=1", "https://drive.google.com/drive/u/0/folders/Q9/", "gdrive:folder/Z-1", " plain-id ", "https://d.example/drive/folders/abc", "https://drive.google.com/open?id=Q9", ""]
    found = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(files.folder_of(F.col("u")), files.root_of(F.col("u")))
    assert [r[0] for r in found.collect()] == ["abc_1", "Q9", "Z-1", "plain-id", None, None, None]
    assert found.first()[1] == "gdrive:folder/abc_1"


def test_a_log_goes_on_after_a_delete(spark, tmp_path):
    from tessella.plans.store import Store

    store = Store(spark, str(tmp_path))
    row = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    names = lambda: sorted(r["name"] for r in store.read("log_of_names").collect())
    store.append("log_of_names", row("a"), ["name"])
    store.append("log_of_names", row("b", "c"), ["name"])
    assert store.delete_where("log_of_names", F.col("name") == "a") == 1
    assert names() == ["b", "c"]
    store.append("log_of_names", row("d"), ["name"])
    store.append("log_of_names", row("e"), ["name"])
    assert names() == ["b", "c", "d", "e"]
    assert store.delete_where("log_of_names", F.col("name").isin("b", "d")) == 2 and names() == ["c", "e"]
    store.append("log_of_names", row("f"), ["name"])
    assert names() == ["c", "e", "f"]
    numbers = [r["seq"] for r in store.read("log_of_names").orderBy("name").collect()]
    assert numbers == sorted(set(numbers))


def test_claims_and_mentions_follow_the_rules_of_replies(spark):
    from tessella.sources import files

    entry = '{"participants": %s, "quotation": %s}'
    entries = [entry % x for x in [('["A", 7, "B"]', '" q "'), ('["A", " ", "B"]', "5"), ('["Ann", "ANN"]', '"q"'), ('["A", " A"]', '"q"'), ('["A"]', '"q"'), ('["A", "B", "C"]', '"q"'), ('["A", "B"]', '"\\t"'), ("null", '"q"')]]
    replies = [
        (1, '{"interactions": [%s, "no entry"]}' % ", ".join(entries)),
        (2, "[1]"), (3, "{cut"), (4, '{"interactions": null, "characters": [{"name": " Ann ", "aliases": ["An", 3, " ", "Ann", "An"], "kind": ""}, {"name": 3}, {"name": null}, "x", {"name": "Bo", "kind": "person"}]}'),
        (5, '{"interactions": [{"participants": ["A", "B"], "quotation": "q", "note": " n "}]}'),
    ]
    frame = spark.createDataFrame(replies, "window long, reply string")
    got = {(r["window"], r["at"]): (r["verdict"], r["first"], r["second"], r["quotation"]) for r in files.claims_of(frame).collect()}
    assert got[1, 0] == ("ok", "A", "B", " q ") and got[1, 1] == ("ok", "A", "B", "5") and got[1, 2] == ("ok", "Ann", "ANN", "q")
    assert [got[1, i][0] for i in range(3, 9)] == ["one name twice", "not two names", "not two names", "no quotation", "not two names", "no object"]
    assert got[2, None][0] == "no object" and got[3, None][0] == "not JSON" and not any(w == 4 for w, _ in got)
    assert [r["note"] for r in files.claims_of(frame).filter("window = 5").collect()] == ["n"]
    names = [(r["name"], r["aliases"], r["kind"]) for r in files.mentions_of(frame).orderBy("at").collect()]
    assert names == [("Ann", ["An", "An"], "unknown"), ("3", [], "unknown"), ("Bo", [], "person")]
    assert [r["why"] for r in files.unusable(frame.withColumn("stop_reason", F.lit(None).cast("string"))).orderBy("window").collect()] == [None, "no object", "not JSON", None, None]
