"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. Training words stream through it; at each word
it knows the longest run ending there that some item holds. Where that is ``window`` words or more, the
last ``window`` words are hit, and the state reached names the items. An item shorter than a window is
hit where it occurs whole.

Items are read in blocks of about ``block_words`` words, an automaton each. Tasks get a block's items and build
its automaton themselves, once per worker. Blocks' passes run one after another, so a worker holds one
automaton, however many items there are. Measured with all its tables: 106 MB for 200,000 words of items, 543 MB
for a million, so workers of one executor need as many times that; ``block_words`` bounds it. An item is never divided,
so one longer than a block makes a block of its own length. Texts stream through: a very long text takes memory for its own words.

Words: lower-cased A-Z, then maximal runs of ASCII letters, digits and non-ASCII characters.

Defined cases: a null or empty text has no words and no hits; an item without words hits nothing; an
item with a null id counts under the empty string; equal items all count; an empty benchmark hits
nothing; repeated rows are each judged; other columns are carried by :func:`hits` and :func:`cleaned`.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import free_name, stored

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Documents with more than this share of their words hit go as a whole in :func:`cleaned`.
COVERAGE = 0.5

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
WORDS_ONLY = bytes(b if b >= 128 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS_ONLY).split()


class Automaton:
    """Generalised suffix automaton over words, in flat arrays. State 0 is the empty run.

    Most states go on with one word only, so a state's first step is a number in an array; further steps are in
    a dictionary that only states have where runs part. A state takes 24 bytes and a word of the vocabulary a
    dictionary entry.
    """

    def __init__(self, items, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.ids: list[str] = []
        self.least = window
        texts = []
        for item_id, text in items:
            words = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)])
            if words:
                self.ids.append("" if item_id is None else str(item_id))
                texts.append(words)
                last = 0
                for w in words:
                    last = self._extend(last, w)
        self._settle(texts)

    def _settle(self, texts) -> None:
        """The states that stand for windows, and the items in each; the states that end short items."""
        n, window = len(self.link), self.window
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.owners: dict[int, set[int]] = {}
        #: of a state of window words or more, the state of its last ``window`` words
        self.top = array("i", bytes(4 * n))
        for state in order[1:]:
            if self.length[state] >= window:
                above = self.link[state]
                self.top[state] = self.top[above] if self.length[above] >= window else state
        for own, words in enumerate(texts):
            state = 0
            for k, w in enumerate(words, 1):
                state = self.step(state, w)
                if k >= window:
                    self.owners.setdefault(self.top[state], set()).add(own)
            if len(words) < window:
                self.short.setdefault(state, []).append((len(words), own))
                self.least = min(self.least, len(words))
        #: nearest state at or above each on the suffix links that ends a short item
        self.ends = array("i", bytes(4 * n))
        if self.short:
            for state in order[1:]:
                self.ends[state] = state if state in self.short else self.ends[self.link[state]]

    def step(self, state: int, w: int) -> int:
        """The state after another word; -1 where there is none."""
        if self.word[state] == w:
            return self.to[state]
        further = self.more.get(state)
        return further.get(w, -1) if further else -1

    def _put(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1 if like is None else self.word[like])
        self.to.append(0 if like is None else self.to[like])
        if like is not None and like in self.more:
            self.more[len(self.link) - 1] = dict(self.more[like])
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        known = self.step(last, w)
        if known >= 0:
            return known if length[known] == length[last] + 1 else self._split(last, w, known)
        state = self._new(length[last] + 1, 0)
        at = last
        while at >= 0 and (known := self.step(at, w)) < 0:
            self._put(at, w, state)
            at = link[at]
        if at >= 0:
            link[state] = known if length[known] == length[at] + 1 else self._split(at, w, known)
        return state

    def _split(self, at: int, w: int, known: int) -> int:
        copy = self._new(self.length[at] + 1, self.link[known], known)
        self.link[known] = copy
        while at >= 0 and self.step(at, w) == known:
            self._put(at, w, copy)
            at = self.link[at]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans [first, end) in words, and the items hit."""
        get = self.vocabulary.get
        known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first >= self.least:
                self._run(known[first:end].tolist(), first, spans, items)
        return spans, items

    def _run(self, run: list[int], first: int, spans: list, items: set) -> None:
        word, to, more, link, length, window, ends = self.word, self.to, self.more, self.link, self.length, self.window, self.ends
        state = n = 0
        for at, w in enumerate(run, first + 1):
            while True:
                if word[state] == w:
                    follow = to[state]
                else:
                    further = more.get(state)
                    follow = further.get(w, -1) if further else -1
                if follow >= 0 or not state:
                    break
                state = link[state]
                n = length[state]
            if follow < 0:
                continue
            state, n = follow, n + 1
            hit = 0
            if n >= window:
                hit = window
                items |= self.owners[self.top[state]]
            end = ends[state]
            while end:
                for size, own in self.short[end]:
                    if size <= n:
                        items.add(own)
                        hit = max(hit, size)
                end = ends[link[end]]
            if hit:
                begin = at - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))


def _blocks(benchmark: DataFrame, block_words: int):
    block, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        n += len(words_of(row["text"]))
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


@functools.lru_cache(maxsize=1)
def _built(shared: Block) -> Automaton:
    """A worker keeps the automaton of one block at a time."""
    return Automaton(shared.items, shared.window)


@dataclasses.dataclass(frozen=True)
class Block:
    """Items of at most ``block_words`` words, as they are sent to tasks; told apart by their name."""

    name: str
    window: int = dataclasses.field(compare=False)
    items: list = dataclasses.field(compare=False)


HIT = "struct<n_words:bigint,begins:array<bigint>,ends:array<bigint>,items:array<string>>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``hit``: n_words, begins and ends of merged spans in words, items (sorted ids).

    Without ``keep_text`` the result leaves the text out. One block, the usual case, is one pass over the rows. Of
    several each is a pass of its own that stores the hits of the documents it hits; these are merged by document and joined at the end.
    """
    name = free_name(docs, "hit")
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_words)
    share = lambda items: context.broadcast(Block(uuid.uuid4().hex, window, items))
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _pass(docs, share(first), name, keep_text)
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.md5("text"))
    parts = []
    for items in itertools.chain((first, second), blocks):
        shared = share(items)
        found = _pass(keyed.select(F.col(key).alias("key"), "text").filter("text is not null"), shared, "hit", False)
        parts.append(stored(found.filter("size(hit.begins) > 0").dropDuplicates(["key"])))
        shared.destroy()
    lists = functools.reduce(DataFrame.union, parts).groupBy("key").agg(F.collect_list("hit").alias("found"))

    @F.udf(HIT, useArrow=True)
    def joined(n_words, found):
        spans = merged([x for f in found or [] for x in zip(f["begins"], f["ends"])])
        items = sorted({i for f in found or [] for i in f["items"]})
        return {"n_words": n_words, "begins": [a for a, _ in spans], "ends": [b for _, b in spans], "items": items}

    count, list_ = free_name(keyed, "words"), free_name(keyed, "found")
    counted = _pass(keyed, share([]), count, keep_text)
    out = counted.join(lists.select(F.col("key").alias(key), F.col("found").alias(list_)), key, "left")
    kept = [c for c in docs.columns if keep_text or c != "text"]
    return out.select(*kept, joined(F.col(f"{count}.n_words"), list_).alias(name))


def _pass(docs: DataFrame, shared, name: str, keep_text: bool) -> DataFrame:
    """``docs`` with the hits of one block in a last column."""
    text_at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != text_at]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(name, T.StructType.fromDDL(f"hit {HIT}")["hit"].dataType)])

    def scan(batches):
        automaton = _built(shared.value)
        of = pa.struct([("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        for batch in batches:
            found = []
            for text in batch.column(text_at).to_pylist():
                words = words_of(text)
                spans, items = automaton.match(words)
                found.append({"n_words": len(words), "begins": [a for a, _ in spans], "ends": [b for _, b in spans], "items": sorted({automaton.ids[i] for i in items})})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, of)], names=[*(batch.schema.names[i] for i in kept), name])

    return docs.mapInArrow(scan, schema)


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(name: str):
    return F.aggregate(F.zip_with(F.col(f"{name}.ends"), F.col(f"{name}.begins"), lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = hits(docs.select("doc_id", "text"), benchmark, window, keep_text=False)
    return found.select("doc_id", "hit", _covered("hit").alias("n_hit")).select(
        "doc_id",
        "hit.n_words",
        "n_hit",
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without(text: str, spans) -> str:
    """``text`` without the words of ``spans`` and what lies between them."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without hit spans; documents hit over more than ``coverage`` of their words go. n_chars, where there is one, follows."""
    found = hits(docs, benchmark, window)
    name = found.columns[-1]
    @F.udf("string", useArrow=True)
    def cut(text, begins, ends):
        return without(text, list(zip(begins, ends))) if text is not None and len(begins) else text

    kept = found.filter(_covered(name) <= coverage * F.col(f"{name}.n_words"))
    touched = F.size(F.col(f"{name}.begins")) > 0
    out = kept.withColumn("text", F.when(touched, cut("text", F.col(f"{name}.begins"), F.col(f"{name}.ends"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
