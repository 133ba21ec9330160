import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing
from tessella.llm.encoding import word_encoder

SCHEMA = "doc_id long, text string, length string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cached_encoding_is_the_tokenizers():
    rnd = random.Random(1)
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = "aAbéÉßñ'stre0123²½.,-_!?<|>\x1c\x85 ​İΣσçĳŉ \n\t日本é" + "abcdefg  "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["It's WE'LL don't", "<|endoftext|> x<|startoftext|>", "", " "]
    for t in texts:
        assert np.frombuffer(word_encoder(PATH).encode(t), np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_plan_holds_all_pieces_within_capacity():
    rnd = random.Random(2)
    for _ in range(300):
        cap = rnd.choice([10, 17, 64])
        counts = {rnd.randint(1, cap): rnd.randint(1, 30) for _ in range(rnd.randint(0, 12))}
        held = {}
        for sequences, runs in packing.plan(counts, cap):
            assert sum(n * k for n, k in runs) <= cap
            assert sum(k for n, k in runs if 3 * n > cap) <= 2
            for n, k in runs:
                held[n] = held.get(n, 0) + sequences * k
        assert held == counts
    many = {n: 200 for n in range(1, 900)}
    used = sum(s for s, _ in packing.plan(many))
    assert used <= 1.01 * sum(n * c for n, c in many.items()) / packing.CAPACITY + 1


def test_pieces_and_places(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "Beta", "gamma's", "déjà"]) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    texts += ["", None, texts[0], "word " * 9000]
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(3), carry_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    whole = {}
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            whole.setdefault((d, at // 2048), []).append(ids[at : at + 2048])
    assert len(got) == sum(map(len, whole.values()))
    sequences = {}
    for r in got:
        ids = whole[r["doc_id"], r["piece"]][0]
        assert r["length"] == len(ids) and r["start"] == 2048 * r["piece"]
        assert np.frombuffer(bytes(r["ids"]), np.uint32).tolist() == ids
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= sum(r["length"] for r in got) // 2048 + 2


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
