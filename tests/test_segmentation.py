import random
import re

from tessella.operators import segments as S


def by_stack(text, rules):
    """Nested segments with a stack over the whole text."""
    marks = sorted((m.start() if side == "start" else m.end(), depth, n, kind, m.groupdict().get("label")) for depth, (kind, pattern, side) in enumerate(rules) for n, m in enumerate(re.finditer(pattern, text, re.M)))
    if not marks:
        return [(0, rules[-1][0], 1, 0, 0, len(text), None, None, [1])]
    found, stack, ordinals = [], [], {}
    for at, depth, _, kind, label in marks:
        while stack and found[stack[-1]][3] >= depth:
            found[stack.pop()][5] = at
        parent = stack[-1] if stack else None
        ordinals[parent, kind] = ordinals.get((parent, kind), 0) + 1
        path = [*(found[parent][8] if stack else []), ordinals[parent, kind]]
        stack.append(len(found))
        found.append([len(found), kind, ordinals[parent, kind], depth, at, len(text), label, parent, path])
    return [tuple(x) for x in found]


RULES = [
    None,
    [("chapter", r"^# (?P<label>.*)$", "start"), ("section", r"^## (?P<label>.*)$", "start"), ("block", S.BLOCK, "end")],
    [("scene", r"^\*\*\*$", "end"), ("line", r"^(?=\S)", "start")],
    [("part", r"=+", "start"), ("part", r"-", "end")],
    [("line", r"^(?=\S)", "start")],
    [("rule", r"^## (?P<label>.*)$", "start")],
    [("rule", r"=+|-", "end")],
]


def test_like_a_stack_over_the_whole_text(spark):
    rnd = random.Random(8)
    pieces = ["# One", "## a", "## Zwei é", "***", "text here", " indented", "", "", "\t", "=", "--", "\U0001f600 wide", "# "]
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(80)] + ["", "x", "﷐ used ﷒\n\nby the text", "\n\n \n", "a\r\n\r\nb"]
    rows = [(i % 90, t) for i, t in enumerate(texts)] + [(200, None), (None, "a\n\nb"), (0, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rules in RULES:
        out = S.segments(frame, rules)
        got = [(r["doc_id"], r["pos"], r["type"], r["index"], r["depth"], r["start"], r["end"], r["label"] or None, r["parent"], r["path"], r["body"]) for r in out.collect()]
        want = []
        for i, t in rows:
            for p in by_stack(t or "", rules or [("section", S.BLOCK, "end")]):
                want.append((i, *p[:6], p[6] or None, *p[7:], (t or "")[p[4] : p[5]]))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert S.segments(frame.limit(0)).count() == 0


def test_no_python_worker(spark):
    plan = S.segments(spark.createDataFrame([(1, "a")], "doc_id long, text string"), RULES[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_text(spark):
    text = "\n\n".join(f"block {i}" for i in range(20_000))
    found = S.segments(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert found.count() == 20_000 and found.orderBy("pos").tail(1)[0]["body"] == "block 19999"
