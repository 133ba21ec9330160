import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessella.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_escape_is_reversible_and_hides_control_strings():
    rnd = random.Random(1)
    for _ in range(2000):
        text = "".join(rnd.choice("<|\\im_end>a") for _ in range(rnd.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)


def test_mask_covers_exactly_the_spans():
    rnd = random.Random(2)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice("ab é\n <|日🙂") for _ in range(rnd.randint(0, 20)))) for _ in range(rnd.randint(0, 5))]
        text, spans = chat.render(turns)
        ids, bounds = chat.encode(text, PATH)
        assert bounds[-1] == len(text) and chat.encoding(PATH).decode(ids.tolist()) == text
        token, first, end = chat.mask(bounds, spans)
        assert "".join(text[a:b] for a, b in zip(first, end)) == "".join(text[a:b] for a, b in spans)
        assert all(bounds[t] <= a < b <= bounds[t + 1] for t, a, b in zip(token, first, end))
        assert (np.diff(first) > 0).all()


def test_report(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>", "x"), (1, 0, "user", "a", "x"), (1, 2, "assistant", None, "x"), (2, 0, None, "", "x"), (None, 0, "user", "q", "x")]
    rows += [(3, t, "assistant" if t % 2 else "user", f"turn {t} é\n", "x") for t in range(500)] + [(4, 0, "assistant", "w " * 200_000, "x"), (1, 0, "user", "a", "x")]
    got = {r["conv_id"]: r for r in chat.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    rows += [(-1, 0, "user", chat.HOSTILE, "x"), (-1, 1, "assistant", chat.HOSTILE, "x")]
    assert set(got) == {-1, 1, 2, 3, 4, None}
    for c, r in got.items():
        own = sorted((t, role or "", text or "") for i, t, role, text, _ in rows if i == c)
        loss = "".join(x for _, role, x in own if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r["n_turns"] == len(own) and r["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for _, a, b in own))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == digest(loss)


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_python_holds_few_conversations_at_once():
    held = []

    class Whole:
        """Stands for a DataFrame: passes one large batch."""

        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            lists = pa.list_(pa.int32())
            columns = [pa.array(range(1000)), pa.array([chat.render([("user", "a"), ("assistant", "b")])[0]] * 1000), pa.array([[]] * 1000, lists), pa.array([[]] * 1000, lists)]
            held.extend(scan([pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "mask_first", "mask_end"])]))

    chat.read_back(Whole())
    assert [x for b in held for x in b.column(0).to_pylist()] == list(range(1000)) and max(b.num_rows for b in held) <= 100
