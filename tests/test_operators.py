"""Semantics of the graph operators on small invented data."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import anchors, continuity, diff, edges, overlay, resolve, segments, validate, verify

EDGE = "ord long, source string, target string, weight double, types array<string>, weight_basis string"


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ana\t Maria　", "aaaa", "aa", "Straße", "Crème brûlée / Å!")], "a string, h string, n string, s string, g string").select(
        X.normalise_whitespace(F.col("a")).alias("norm"), X.occurrences(F.col("h"), F.col("n")).alias("occ"), X.form_key(F.col("s")).alias("key"),
        X.slug(F.col("g")).alias("slug"), X.quote_offset(F.col("h"), F.col("s")).alias("none"), X.edge_id(F.lit("b"), F.lit("a"), F.lit("asserted")).alias("id"),
        X.canonical_json(F.lit('{"b": 2.50, "a": "é"}')).alias("json"), X.word_occurrences(F.lit("Ann, ann. Anna (ANN)"), F.lit("ann")).alias("n"),
    ).first()
    assert row["norm"] == "Ana Maria" and row["occ"] == [0, 1, 2] and row["key"] == "strasse" and row["none"] is None
    assert row["slug"] == "creme-brulee-a" and row["id"] == "rel:a--b@asserted" and row["json"] == '{"a":"é","b":2.5}' and row["n"] == 3
    ends = spark.createDataFrame([(row["id"],)], "e string").select(X.edge_ends(F.col("e")).alias("x")).first()["x"]
    assert (ends["source"], ends["target"], ends["provenance"]) == ("char:a", "char:b", "asserted")


def test_claims_become_edges(spark):
    rows = [(1, "ann", "bob", 5, "hi", ["speaks"]), (0, "bob", "ann", 5, "first", ["helps"]), (2, "ann", "bob", None, "loose  words", []), (3, "bob", "ann", None, "loose words", ["speaks"])]
    rows += [(4, "ann", "ghost", 1, "x", []), (5, "ann", "ann", 1, "x", [])]
    claims = spark.createDataFrame(rows, "ord long, first_key string, second_key string, passage long, quotation string, types array<string>")
    ids = spark.createDataFrame([("ann", "char:ann"), ("bob", "char:bob")], "form_key string, entity_id string")
    found = edges.resolved(claims, ids)
    assert {(r["ord"], r["reason"]) for r in edges.refused(found).collect()} == {(4, "unresolved"), (5, "one entity")}
    edge = edges.aggregate_claims(found, "interaction_passages").collect()
    assert len(edge) == 1 and edge[0]["weight"] == 2 and edge[0]["types"] == ["helps", "speaks"] and edge[0]["id"] == "rel:ann--bob"
    evidence = edges.nested_evidence(edges.evidence(found)).first()["evidence"]
    assert [(e["passage"], e["quotation"]) for e in evidence] == [(5, "first"), (None, "loose  words")]


def test_mixed_bases_are_refused(spark):
    frame = spark.createDataFrame([(0, "a", "b", 1.0, [], "x"), (1, "a", "c", 1.0, [], "y")], EDGE)
    with pytest.raises(ValueError):
        edges.require_one_basis(frame)
    assert edges.require_one_basis(frame.filter("ord = 0")) == "x"


def test_diff_last_edge_of_a_pair_wins_and_merged_pair_is_removed(spark):
    before = spark.createDataFrame([(0, "a", "b", 1.0, ["x"], "o"), (1, "b", "a", 4.0, ["x"], "o"), (2, "a", "z", 2.0, [], "o"), (3, "z", "y", 2.0, [], "o")], EDGE)
    after = spark.createDataFrame([(0, "a", "b", 5.0, ["y"], "o"), (1, "a", "y", 2.0, [], "o")], EDGE)
    merges = spark.createDataFrame([("z", "a")], "from_id string, to_id string")
    got = {(r["a"], r["b"]): (r["changes"], r["before_weight"]) for r in diff.edge_changes(before, after, merges).collect()}
    assert got == {("a", "b"): (["strengthened", "retyped"], 4.0), ("a", "a"): (["removed"], 2.0)}
    assert {r["changes"][0] for r in diff.edge_changes(before, after, merges, comparable=False).collect()} == {"retyped", "removed"}


def test_node_changes(spark):
    node = "ord int, id string, key string, forms array<string>"
    before = spark.createDataFrame([(0, "1", "ann", []), (1, "2", "bob", ["rob"]), (2, "3", "old", [])], node)
    after = spark.createDataFrame([(0, "1", "ann", ["bob"]), (1, "4", "rob", []), (2, "5", "new", [])], node)
    got = {r["id"]: (r["change"], r["counterparts"]) for r in diff.node_changes(before, after).collect()}
    assert got == {"2": ("merged", ["1"]), "3": ("removed", []), "4": ("added", []), "5": ("added", [])}


def test_merge_chains_and_cycles(spark):
    rows = [("char:a", "char:b"), ("char:b", "char:c"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "u"), ("u", "y")] + [(f"n{i}", f"n{i + 1}") for i in range(100)]
    merges = spark.createDataFrame(rows, "from_id string, to_id string")
    got = {r["from_id"]: r["to_id"] for r in overlay.merge_closure(merges).collect()}
    assert got["char:a"] == got["char:b"] == "char:c" and [got[i] for i in "xyztu"] == ["x", "y", "z", "y", "y"]
    assert all(got[f"n{i}"] == "n100" for i in range(100)) and len(got) == len(rows)
    log = spark.createDataFrame([("rel:a--q@asserted",), ("rel:a--c",)], "id string")
    moved = {r["id"] for r in overlay.redirected_edge_ids(log, overlay.merge_closure(merges), "id").collect()}
    assert moved == {"rel:c--q@asserted", "rel:a--c"}


def test_corrections(spark):
    subjects = spark.createDataFrame([("1", "n1", "observed"), ("2", "n2", "observed")], "id string, name string, provenance string")
    made = spark.createDataFrame([("1", "name", "", "n1"), ("3", "name", "z", "n3")], "id string, field string, value string, was string")
    got = {r["id"]: (r["name"], r["provenance"], r["review_status"]) for r in overlay.apply_corrections(subjects, made, ["name"]).collect()}
    assert got == {"1": (None, "human", "corrected"), "2": ("n2", "observed", None)}
    assert [r["id"] for r in overlay.missing_subjects(subjects, made).collect()] == ["3"]


def test_aliases(spark):
    claims = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "z")], "form string, owner string")
    primaries = spark.createDataFrame([("c",)], "form string")
    assert [(r["form"], r["owner"]) for r in resolve.usable_aliases(claims, primaries).collect()] == [("b", "x")]
    names = spark.createDataFrame([(0, "St. John", "st. john"), (1, "St John", "st john")], "ord int, name string, key string")
    ids = [r["entity_id"] for r in resolve.group_alone(names).orderBy("ord").collect()]
    assert ids[0] == "char:st-john" and ids[1].startswith("char:st-john-")


def test_segments_passages_and_verification(spark):
    text = "One  two.\n\nThree four\nfive.\n \nSix."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = segments.segments(docs)
    assert [text[r["start"] : r["end"]].split()[0] for r in found.orderBy("pos").collect()] == ["One", "Three", "Six."]
    passages = segments.addressable(found)
    rows = passages.orderBy("pos").collect()
    assert [(r["norm_start"], r["norm_end"], r["passage"]) for r in rows] == [(0, 8, "One two."), (9, 25, "Three four five."), (26, 30, "Six.")]
    at = segments.passage_at(spark.createDataFrame([(1, 0), (1, 9), (1, 25), (1, 99)], "doc_id int, offset long"), passages)
    assert {(r["offset"], r["pos"]) for r in at.collect()} == {(0, 0), (9, 1), (25, 1), (99, 2)}
    claims = spark.createDataFrame([(1, 1, 0, "One two."), (1, 2, 0, "four  five"), (1, 3, 0, "never"), (1, 4, 1, " ")], "doc_id int, claim int, pos int, quotation string")
    got = {r["claim"]: (r["verdict"], r["pos"]) for r in verify.verify(claims, passages, docs).collect()}
    assert got == {1: ("kept", 0), 2: ("relocated", 1), 3: ("not in the source", 0), 4: ("empty", 1)}
    with pytest.raises(ValueError):
        verify.verify(claims.union(claims), passages, docs, most_rejected=0.25)


def test_nested_segments(spark):
    text = "Book I\nChapter 1\na\nChapter 2\nb\nBook II\nChapter 1\nc\n"
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = segments.segments(frame, [("book", r"^Book (?P<label>\w+)", "start"), ("chapter", r"^Chapter \d+", "start")]).orderBy("pos").collect()
    assert [(s["type"], s["path"], s["label"]) for s in got] == [
        ("book", [1], "I"), ("chapter", [1, 1], None), ("chapter", [1, 2], None), ("book", [2], "II"), ("chapter", [2, 1], None),
    ]
    assert got[0]["end"] == got[3]["start"] == got[2]["end"]


def test_windows_never_cut_a_piece(spark):
    pieces = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(0, 40), (40, 90), (90, 100), (100, 300), (300, 310)])], "doc_id int, pos int, start int, end int")
    got = [(r["first"], r["last"]) for r in segments.windows(pieces, 100).orderBy("window_index").collect()]
    assert got == [(0, 2), (3, 3), (4, 4)]


def test_reanchoring(spark):
    def reanchor(text, exact, prefix="", suffix="", hint=None):
        rows = spark.createDataFrame([(text, exact, prefix, suffix, hint)], "text string, exact string, prefix string, suffix string, hint int")
        return anchors.reanchored(rows).first()["anchor"]

    assert reanchor("say hello there", "hello")["method"] == "exact"
    got = reanchor("left cat right, wrong cat side", "cat", prefix="wrong ", suffix=" side")
    assert (got["start"], got["method"], got["ambiguous"]) == (22, "context", False)
    assert reanchor("cat cat", "cat")["ambiguous"]
    fuzzy = reanchor("xx the quick brown fox jumped over the lazy dog yy", "the quick brown fox jumps over the lazy dog")
    assert fuzzy["method"] == "fuzzy" and fuzzy["similarity"] > 0.9
    assert reanchor("nothing alike", "the quick brown fox") is None
    rows = spark.createDataFrame([("say hello there", "hello"), ("a a", "a"), ("b", "zz")], "text string, exact string").withColumns({"prefix": F.lit(""), "suffix": F.lit(""), "hint": F.lit(None).cast("int")})
    out = {r["exact"]: r["anchor"] for r in anchors.reanchored(rows).collect()}
    assert out["hello"]["start"] == 4 and out["a"]["ambiguous"] and out["zz"] is None


def test_continuity(spark):
    docs = lambda rows: spark.createDataFrame(rows, "path string, content string")
    forms = spark.createDataFrame([("Ann",), ("Anna",)], "form string")
    before = continuity.presence(forms, docs([("1", "Ann went."), ("2", "Ann came.")]))
    after = continuity.presence(forms, docs([("1", "Anna went."), ("2", "Ann came.")]))
    stale = continuity.stale_names(before, after)
    assert [(r["form"], r["retired"], r["remaining"]) for r in stale.collect()] == [("Ann", ["1"], ["2"])]
    owners = spark.createDataFrame([("Ann", "e", 0), ("Anna", "e", 1)], "form string, entity string, ord int")
    assert continuity.replaced_by(stale, before, after, owners).first()["replacement"] == "Anna"


def test_validation(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    graph = spark.createDataFrame([("1", "a", "b"), ("2", "a", "z"), ("3", "a", "a")], "id string, source string, target string")
    assert {(r["kind"], r["id"]) for r in validate.issues(nodes, graph).collect()} == {("duplicate", "b"), ("reference", "2"), ("reference", "3")}


def test_found_in_meets_short_and_long_quotations(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "xalpha beta gamma deltay"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "alpha  beta gamma delta"), (2, "gamma"), (3, ""), (4, None), (5, "beta delta")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"], r["offset"]) for r in verify.found_in(quotes, docs).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (2, 1, 11), (2, 2, 12)}


def test_groups_do_not_take_registered_ids_and_their_warnings_are_told(spark):
    rows = [(1, "St John", "st john", "person", []), (2, "Johnny", "johnny", "person", []), (3, "Mary", "mary", "person", [])]
    mentions = spark.createDataFrame(rows, "ord long, name string, key string, kind string, aliases array<struct<key:string,form:string>>")
    registry = spark.createDataFrame([("st. john", "char:st-john", "St. John", "person")], "key string, entity_id string, name string, kind string")
    groups = spark.createDataFrame(
        [(1, "St John", "st john", "person", ["st john", "johnny", "no such"], None), (2, "Mary", "mary", "person", ["mary"], "nobody")],
        "group long, canonical string, canonical_key string, kind string, forms array<string>, same_as string",
    )
    assignments, entities, _, warnings = resolve.resolve(mentions, registry, groups)
    ids = {r["form_key"]: r["entity_id"] for r in assignments.collect()}
    assert ids["st john"] == ids["johnny"] == "char:st-john-st-john" and ids["mary"] == "char:mary"
    assert [(r["group"], r["warning"]) for r in warnings.collect()] == [("2", "unknown registered name nobody")]
    assert {r["entity_id"]: r["name"] for r in entities.collect()} == {"char:st-john-st-john": "St John", "char:mary": "Mary"}
    assert resolve.resolve(mentions, registry)[3].count() == 0


def test_attribution_sentences_differ(spark):
    from tessella.operators.compare import attribution_sentence

    rows = spark.createDataFrame([("text",), ("analysis",), ("both",), ("same",), ("other",), (None,)], "of string")
    told = {r["of"]: r["s"] for r in rows.select("of", attribution_sentence(F.col("of")).alias("s")).collect()}
    assert told["other"] is None and told[None] is None and len({told[k] for k in ("text", "analysis", "both", "same")}) == 4
