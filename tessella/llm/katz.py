"""Katz backoff language model over words, trained and evaluated in three shuffles.

Model. Order two. Tokens are lower-cased words and one end per text; a text's first history is a begin
mark. With c the counts over training texts and N, V their unigram totals::

    P(w | h) = d(c(h,w)) c(h,w) / c(h)     where the pair was seen
             = a(h) P(w)                   where only h was seen
             = P(w)                        where h was not
    P(w)     = e(c(w)) c(w) / N            where w was seen, else all unseen words share the rest

d and e are Good-Turing discounts for counts 1..5 (where the counts of counts give none between 0 and 1:
an absolute discount of one half); pairs counted more often give up 0.01 of a count, so every history
keeps mass for unseen words. a(h) makes the probabilities after h sum to exactly 1.

Tables. Tokens are 64-bit hashes. Each chunk of texts is reduced to its distinct pairs with their
places before anything is shuffled, so a frequent pair is one entry per chunk and text. Pairs go to buckets of their *word*:
there c(h,w) and c(w) are known, and since a word's count is also its count as a history, the whole
score of a seen token is too: the -log c(h) of a token is added where h itself is the word. What a
history gives (how many successors of each count, their unigram mass) goes on to buckets of the
*history*, where a(h) is settled and added for the few unseen tokens. Discounts depend on corpus-wide
counts of counts; scores therefore travel as numbers of tokens of each count, and discounts are applied
last. The counts ("pairs"), history sums ("histories") and weights ("weights") are stored as tables
partitioned by kind, a row per bucket; buckets grow in number with the corpus, not in size.

Defined cases: a null or empty text is its end token alone; a null doc_id counts as the text ``null``;
repeated rows are each counted and scored; a very long text is read whole, in memory in proportion to its words; an empty table gives no rows; without training texts every
token is unseen and has the whole mass; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import pack, pack_sorted, stored, unpack, unpack_sorted

K = 5
EPSILON = 0.01
CHUNK_TOKENS = 1_000_000
BUCKET_BYTES = 12 << 20
UNIT = 2.0**32
#: Words hold no white space, so these names are free.
END, BEGIN = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\n\n")


def held_out(doc_id) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hash, so sorted ids fall into them in order."""
    return ((ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(keys: np.ndarray):
    """(value, first, end) of each run of a sorted array."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    firsts = np.concatenate(([0], edges)) if len(keys) else edges
    return zip(keys[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(keys)])


ROWS = "kind string, key long, data array<binary>"
ARROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("data", pa.list_(pa.binary()))])


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": k, "key": int(key), "data": data} for k, key, data in rows], ARROW)


def _numbers(*values) -> bytes:
    return np.array(values, np.int64).tobytes()


def distinct_pairs(docs: DataFrame, buckets: int, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows ("pairs", bucket, ...) and ("texts", chunk, ...) of every chunk of texts."""

    def scan(batches):
        part, nth = TaskContext.get().partitionId(), 0
        digest = xxhash.xxh64_intdigest
        docs, tokens, n = [], [], 0

        def flush():
            chunk = part << 24 | nth
            yield from _chunk(chunk, docs, tokens, buckets)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                ids = np.empty(len(words) + 1, np.uint64)
                ids[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
                ids[-1] = END
                docs.append(doc_id)
                tokens.append(ids)
                n += len(ids)
                if n >= chunk_tokens:
                    for row in flush():
                        yield _batch([row])
                    docs, tokens, n, nth = [], [], 0, nth + 1
        if docs:
            for row in flush():
                yield _batch([row])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, ROWS)


def _chunk(chunk: int, docs: list, tokens: list, buckets: int):
    # training texts first, so that a place says which kind its text is
    order = sorted(range(len(docs)), key=lambda i: held_out(docs[i]))
    docs, tokens = [docs[i] for i in order], [tokens[i] for i in order]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    training = sum(not held_out(d) for d in docs)
    ids = np.array([0 if d is None else d for d in docs], np.int64)
    null = np.array([d is None for d in docs])
    yield "texts", chunk, [_numbers(training), pack(ids), pack(null), pack(sizes)]
    w = np.concatenate(tokens)
    h = np.concatenate([np.concatenate((np.array([BEGIN], np.uint64), t[:-1])) for t in tokens])
    known, at = np.unique(np.concatenate((w, h)), return_inverse=True)
    code = at[: len(w)] * len(known) + at[len(w) :]
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    of = _bucket(known, buckets)[code // len(known)]
    for bucket, a, b in _slices(of):
        pairs, first, times = np.unique(code[a:b], return_index=True, return_counts=True)
        words, runs = np.unique(pairs // len(known), return_counts=True)
        histories, which = np.unique(pairs % len(known), return_inverse=True)
        yield (
            "pairs",
            bucket,
            [
                _numbers(chunk, training, len(docs)),
                pack_sorted(known[words]),
                pack(runs.astype(np.uint32)),
                pack_sorted(known[histories]),
                pack(which.astype(np.uint32)),
                pack(times.astype(np.uint32)),
                pack(doc[a:b]),
            ],
        )


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows with these keys: the group of each row, and a row of each group; groups are in order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    new[:1] = True
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def count_words(buckets: int, keep_counts: bool):
    """Over a bucket of words: counts, what texts get from them, and what histories get."""

    def count(key, table):
        if key[0].as_py() < 0:
            return table.select(ARROW.names)
        rows = table.column("data").to_pylist()
        heads, words, runs, histories, which, times, docs = [], [], [], [], [], [], []
        for head, a, b, c, d, e, f in rows:
            heads.append(np.frombuffer(head, np.int64))
            words.append(unpack_sorted(a, np.uint64))
            runs.append(unpack(b, np.uint32))
            histories.append(unpack_sorted(c, np.uint64)[unpack(d, np.uint32)])
            times.append(unpack(e, np.uint32).astype(np.int64))
            docs.append(unpack(f, np.uint32))
        w = np.concatenate([np.repeat(x, n) for x, n in zip(words, runs)])
        h = np.concatenate(histories)
        # occurrences in training texts of each chunk's pairs
        seen = np.concatenate([np.add.reduceat((d < head[1]).astype(np.int64), np.cumsum(t) - t) for d, head, t in zip(docs, heads, times)])
        pair, one = _grouped([w, h])
        c_pair = np.bincount(pair, seen, len(one)).astype(np.int64)
        pair_w, pair_h = w[one], h[one]
        word_new = np.concatenate(([True], pair_w[1:] != pair_w[:-1]))
        word = np.cumsum(word_new) - 1
        c_word = np.bincount(word, c_pair).astype(np.int64)
        c_of = c_word[word]  # of each distinct pair's word
        out = []
        of_counts = [np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2] for c in (c_word, c_pair)]
        out.append(("stats", 0, [_numbers(int(c_word.sum()), int((c_word > 0).sum()), *of_counts[0], *of_counts[1])]))
        if keep_counts:
            some = c_pair > 0
            histories, which = np.unique(pair_h[some], return_inverse=True)
            out.append(
                ("counts", key[0].as_py(), [pack_sorted(pair_w[word_new]), pack(c_word), pack(np.bincount(word[some], minlength=len(c_word)).astype(np.uint32)), pack_sorted(histories), pack(which.astype(np.uint32)), pack(c_pair[some].astype(np.uint32))])
            )
        # a history's successors by their pair's count and by their own count, and the sum of large own counts
        train = np.flatnonzero(c_pair > 0)
        order = train[np.argsort(pair_h[train], kind="stable")]
        hs = pair_h[order]
        if len(hs):
            firsts = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
            columns = [np.add.reduceat(x, firsts) for x in _history_columns(c_pair[order], c_of[order])]
            ids = hs[firsts]
            for b, i, j in _slices(_bucket(ids, buckets)):
                out.append(("histories", b, [pack_sorted(ids[i:j]), *(pack(x[i:j]) for x in columns)]))
        # texts, a chunk at a time
        log_pair = np.where(c_pair > K, np.log(np.maximum(c_pair - EPSILON, 1)), np.log(np.maximum(c_pair, 1)))
        log_word = np.log(np.maximum(c_word, 1))
        log_base = np.log10(c_word + 1.0)
        end = pair_w[word_new] == np.uint64(END)
        unseen, at = [], 0
        for head, d, t in zip(heads, docs, times):
            own = np.repeat(pair[at : at + len(t)], t)
            at += len(t)
            out.append(("part", head[0], _text_columns(d, head[2], own, c_pair, c_word, word, log_pair, log_word, log_base, end)))
            lost = c_pair[own] == 0
            if lost.any():
                unseen.append((pair_h[own[lost]], np.full(lost.sum(), head[0]), d[lost]))
        if unseen:
            hs, chunks, ds = map(np.concatenate, zip(*unseen))
            order = np.lexsort((ds, chunks, hs))
            hs, chunks, ds = hs[order], chunks[order], ds[order]
            for b, i, j in _slices(_bucket(hs, buckets)):
                out.append(("unseen", b, [pack_sorted(hs[i:j]), pack(chunks[i:j]), pack(ds[i:j])]))
        return pa.Table.from_batches([_batch([r]) for r in out])

    return count


def _history_columns(c_pair: np.ndarray, c_word: np.ndarray) -> list[np.ndarray]:
    by_pair = [(c_pair == r).astype(np.int64) for r in range(1, K + 1)] + [(c_pair > K).astype(np.int64)]
    by_word = [(c_word == r).astype(np.int64) for r in range(1, K + 1)] + [np.where(c_word > K, c_word, 0)]
    return by_pair + by_word


def _text_columns(d, n, own, c_pair, c_word, word, log_pair, log_word, log_base, end) -> list[bytes]:
    """Sparse sums per text: places, fixed-point logs, base logs, known tokens, then tokens of each count (seen pairs 1..5; unseen pairs by word 0..5 and more)."""
    c, v = c_pair[own], word[own]
    cw = c_word[v]
    seen, known = c > 0, cw > 0
    touched = np.flatnonzero(np.bincount(d, minlength=n))
    logs = np.where(seen, log_pair[own], np.where(cw > K, log_word[v], 0.0)) - np.where(known & ~end[v], log_word[v], 0.0)

    def total(weights):
        return np.bincount(d, weights, n)[touched]

    classes = [np.bincount(d[c == r], minlength=n)[touched] for r in range(1, K + 1)]
    classes += [np.bincount(d[~seen & (np.minimum(cw, K + 1) == r)], minlength=n)[touched] for r in range(K + 2)]
    return [
        pack_sorted(touched.astype(np.uint32)),
        pack(_fixed(total(logs))),
        pack(_fixed(total(log_base[v]))),
        pack(total(known).astype(np.uint32)),
        *(pack(x.astype(np.uint32)) for x in classes),
    ]


def discounts(n: list[int]) -> np.ndarray:
    """Shares kept by counts 1..5, from the numbers n[0..5] of things counted 1..6 times."""
    if n[0] and all(n[:K]):
        top = (K + 1) * n[K] / n[0]
        if top < 1:
            found = np.array([((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, K + 1)])
            if ((found > 0) & (found < 1)).all():
                return found
    return np.array([(r - 0.5) / r for r in range(1, K + 1)])


class Unigrams:
    def __init__(self, total: int, n: list[int]):
        self.kept = discounts(n)
        left = float(sum(n[r] * (r + 1) * (1 - self.kept[r]) for r in range(K)))
        self.total = total if left > 0 else total + 1.0
        self.unseen = (left if left > 0 else 1.0) / self.total
        #: probability of a word counted 1..5 times
        self.rare = np.array([self.kept[r] * (r + 1) / self.total for r in range(K)])


def settle_histories(unigrams: Unigrams, kept: np.ndarray):
    """Over a bucket of histories: log(a(h) c(h)) of each, stored, and added for the unseen tokens after it."""

    def settle(key, table):
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        parts = [[unpack_sorted(d[0], np.uint64), *(unpack(x, np.int64) for x in d[1:])] for k, d in zip(kinds, data) if k == "histories"]
        if not parts:
            return pa.Table.from_batches([], ARROW)
        ids, *columns = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        firsts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        sums = np.array([np.add.reduceat(c[order], firsts) for c in columns], np.float64)
        ids = ids[firsts]
        r = np.arange(1, K + 1)
        left = (r * (1 - kept)) @ sums[:K] + EPSILON * sums[K]
        mass = unigrams.rare @ sums[K + 1 : 2 * K + 1] + sums[2 * K + 1] / unigrams.total
        weight = np.log(left) - np.log(np.maximum(1 - mass, unigrams.unseen))
        out = [("weights", key[0].as_py(), [pack_sorted(ids), pack(weight)])]
        for k, d in zip(kinds, data):
            if k != "unseen":
                continue
            hs, chunks, ds = unpack_sorted(d[0], np.uint64), unpack(d[1], np.int64), unpack(d[2], np.uint32)
            at = np.minimum(np.searchsorted(ids, hs), len(ids) - 1)
            add = np.where(ids[at] == hs, weight[at], 0.0)
            order = np.argsort(chunks, kind="stable")
            for chunk, i, j in _slices(chunks[order]):
                own = order[i:j]
                places, which = np.unique(ds[own], return_inverse=True)
                out.append(("added", chunk, [pack_sorted(places), pack(_fixed(np.bincount(which, add[own])))]))
        return pa.Table.from_batches([_batch([x]) for x in out])

    return settle


def score_texts(unigrams: Unigrams, kept: np.ndarray, total: int, distinct: int, training: int):
    def score(key, table):
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        n_training, ids, null, sizes = next(d for k, d in zip(kinds, data) if k == "texts")
        ids, null, sizes = unpack(ids, np.int64), unpack(null, bool), unpack(sizes, np.int64)
        n_training = int(np.frombuffer(n_training, np.int64)[0])
        n = len(ids)
        logs, base, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        classes = np.zeros((2 * K + 2, n), np.int64)
        for k, d in zip(kinds, data):
            if k == "part":
                at = unpack_sorted(d[0], np.uint32)
                logs[at] += unpack(d[1], np.int64)
                base[at] += unpack(d[2], np.int64)
                known[at] += unpack(d[3], np.uint32)
                for row, x in zip(classes, d[4:]):
                    row[at] += unpack(x, np.uint32)
            elif k == "added":
                logs[unpack_sorted(d[0], np.uint32)] += unpack(d[1], np.int64)
        ln = logs / UNIT - (math.log(training) if training else 0.0)
        ln += np.log(kept) @ classes[:K]
        # an unseen pair's word counted more than K times was added as log c(w); its share is c(w) of the total
        shares = np.concatenate(([unigrams.unseen], unigrams.rare, [1 / unigrams.total]))
        ln += np.log(shares) @ classes[K:]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=null),
                "held_out": np.arange(n) >= n_training,
                "n_tokens": sizes,
                "n_known": known,
                "train_tokens": np.full(n, total, np.int64),
                "base_score": base / UNIT - sizes * math.log10(total + distinct + 1),
                "score": ln / math.log(10),
            }
        )

    return score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, keep_counts: bool = True, chunk_tokens: int = CHUNK_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Trains on the texts that are not held out and scores every text."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(7)) == 2
    size, training = docs.agg(F.sum(F.octet_length("text")), F.count_if(~held)).first()
    buckets = 1 + (size or 0) // bucket_bytes
    pairs = distinct_pairs(docs, buckets, chunk_tokens)
    # texts' own rows go to groups of their own, below zero, and pass through
    keyed = pairs.withColumn("bucket", F.when(F.col("kind") == "pairs", F.col("key")).otherwise(-1 - F.col("key")))
    counted = stored(keyed.groupBy("bucket").applyInArrow(count_words(buckets, keep_counts), ROWS), "kind")

    def of(*kinds):
        return counted.filter(F.col("kind").isin(*kinds)).select("kind", "key", "data")

    stats = [np.frombuffer(r["data"][0], np.int64) for r in of("stats").toLocalIterator()]
    total, distinct, *n = (np.sum(stats, axis=0) if stats else np.zeros(2 + 2 * (K + 1), np.int64)).tolist()
    unigrams, kept = Unigrams(total, n[: K + 1]), discounts(n[K + 1 :])
    settled = stored(of("histories", "unseen").groupBy("key").applyInArrow(settle_histories(unigrams, kept), ROWS), "kind")
    parts = of("texts", "part").union(settled.filter("kind = 'added'").select("kind", "key", "data"))
    return parts.groupBy("key").applyInArrow(score_texts(unigrams, kept, total, distinct, training), RESULT)
