import random

import pytest
from pyspark.sql import functions as F

from tessella import catalog
from tessella.functions import text as X
from tessella.operators import edges, pairs, validate


def shuffled(df):
    """Rows that all shuffles of a collected DataFrame wrote."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_pairs_within_like_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(k, h) for k in range(60) for h in rnd.sample("abc", rnd.choice([1, 1, 1, 2, 3]))] + [(None, "a"), (7, None), (61, "d")]
    members = spark.createDataFrame(rows + rows[:5], "id long, home string")
    homes = {}
    for k, h in rows:
        if k is not None and h is not None:
            homes.setdefault(k, set()).add(h)
    for size in (1, 7, 256):
        made = pairs.exploded(pairs.cells(pairs.blocked(members, size=size))).collect()
        assert sorted(map(tuple, made)) == [(x, y) for x in sorted(homes) for y in sorted(homes) if x < y and homes[x] & homes[y]]
    once = members.distinct()
    each = sorted(map(tuple, pairs.within_each(once).collect()))
    assert each == sorted((h, x, y) for h in "abc" for x in homes for y in homes if x < y and h in homes[x] and h in homes[y])


def test_declared_within_like_declared_pairs_written_out(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(pairs.blocked, "__defaults__", (False, 5))
    members = spark.createDataFrame([(k, rnd.randrange(3)) for k in range(40)] + [(3, 0), (3, 1), (4, 0), (4, 1)], "id long, home int")
    seen = {tuple(rnd.sample(range(44), 2)) for _ in range(300)}
    seen = {min(p, p[::-1]): n for n, p in enumerate(sorted(seen), 1)}
    turned = [(y, x, n) if n % 2 else (x, y, n) for (x, y), n in seen.items()]
    enacted = spark.createDataFrame(turned, "source long, target long, weight long")
    two = members.alias("a").join(members.alias("b"), F.expr("a.home = b.home and a.id < b.id"))
    declared = two.select(F.col("a.id").alias("source"), F.col("b.id").alias("target")).distinct().withColumns({"weight": F.lit(1), "provenance": F.lit("asserted")})
    both = declared.unionByName(enacted.withColumn("provenance", F.lit("observed"))).withColumn("ord", F.col("source"))
    key = lambda df: sorted(map(str, df.select("a", "b", "finding", "declared", "enacted").collect()))
    got = edges.declared_within(members, enacted)
    assert key(got) == key(edges.declared_and_enacted(both)) and got.count() > 300
    ids = lambda letter: F.concat(F.lit(letter), F.concat_ws("-", "a", "b"))
    marked = edges.marks_of(got, F.when(F.col("finding") != "enacted_only", ids("d")), F.when(F.col("finding") != "declared_only", ids("e")))
    links = got.filter("finding <> 'enacted_only'").select(ids("d").alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), F.lit("asserted").alias("provenance"))
    links = links.union(got.filter("finding <> 'declared_only'").select(ids("e"), "a", "b", F.lit("observed")))
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, edges.finding_marks(links, got).collect()))


@pytest.fixture(scope="module")
def one_nation(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nation"))
    spark.range(500).select((F.col("id") + 1).alias("s_suppkey"), F.lit(7).alias("s_nationkey")).coalesce(1).write.parquet(f"{d}/supplier.parquet")
    lines = spark.range(600).select(F.col("id").alias("l_orderkey"), F.explode(F.array(F.col("id") % 510, F.col("id") % 77)).alias("l_suppkey"))
    lines.withColumns({"l_returnflag": F.lit("R"), "l_quantity": F.lit(45.0)}).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["declared_vs_enacted", "finding_marks", "edge_ids"])
def test_no_shuffle_holds_the_pairs_of_a_nation(spark, one_nation, name):
    made = catalog.QUERIES[name](spark, one_nation)
    rows = made.collect()
    assert len(rows) >= 500 * 499 // 2 and len({r[:2] for r in rows}) == len(rows)
    assert shuffled(made) < 20_000


def test_issue_counts_like_issues_counted(spark):
    rnd = random.Random(4)
    nodes = [(g, n, f"n{rnd.randrange(12)}", " " if g == 4 and n == 3 else "name", "person", "observed", None, []) for g in range(5) for n in range(10)]
    links = [(g, n, f"e{rnd.randrange(30)}", f"n{rnd.randrange(13)}", f"n{rnd.randrange(13)}", -1.0 if g == 3 and n == 2 else 1.0, "x", ["t"], "observed", None, [(rnd.choice(["d1", "d2", None]), "q")]) for g in range(5) for n in range(25)]
    n = spark.createDataFrame(nodes, "snapshot long, ord long, id string, name string, kind string, provenance string, review_status string, aliases array<string>")
    e = spark.createDataFrame(links, "snapshot long, ord long, id string, source string, target string, weight double, weight_basis string, types array<string>, provenance string, confidence double, evidence array<struct<document:string,exact:string>>")
    held = spark.createDataFrame([(0, "d1"), (1, "d2"), (3, "d1")], "snapshot long, document string")
    want = validate.document_issues(n, e, held).groupBy("snapshot", "kind", "what").agg(F.count("*").alias("n"))
    got = sorted(map(tuple, validate.issue_counts(n, e, held).collect()))
    assert got == sorted(map(tuple, want.collect())) and {k for _, k, *_ in got} == {"schema", "duplicate", "reference"}


def test_document_issues_counts_edges_where_they_are(spark, one_nation):
    made = catalog.QUERIES["document_issues"](spark, one_nation)
    assert len(made.collect()) == 499 and shuffled(made) < 20_000


def test_edge_ends_like_their_pattern(spark):
    rnd = random.Random(3)
    parts = ["rel:", "a", "-", "--", "@", "b", "\n", " ", " ", "é", "x--y"]
    texts = {"".join(["rel:" * (rnd.random() < 0.9), *rnd.choices(parts, k=rnd.randint(0, 7))]) for _ in range(5000)}
    pattern = r"^rel:([^@]+?)--([^@]+)(?:@(.*))?$"
    part = lambda k: F.when(F.rlike("id", F.lit(pattern)), F.regexp_extract("id", pattern, k))
    frame = spark.createDataFrame([(t,) for t in [None, *sorted(texts)]], "id string").withColumn("e", X.edge_ends(F.col("id")))
    want = F.struct(F.concat(F.lit("char:"), part(1)), F.concat(F.lit("char:"), part(2)), F.when(part(1).isNotNull(), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("observed"))))
    rows = frame.select("e", want.alias("want")).collect()
    assert all(tuple(r["e"]) == tuple(r["want"]) for r in rows) and sum(r["want"][0] is not None for r in rows) > 300
