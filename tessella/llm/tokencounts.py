"""Token counts of a document's sections, from one encoding of the whole document.

The whole text is encoded once with a byte-level vocabulary. Token boundaries are the running sums of
the tokens' lengths in bytes; sections are sorted, adjoining spans. Both lists are sorted, so tokens meet
sections by binary search. A token inside one section counts there. One that crosses a boundary counts
for the section that holds most of its bytes, the earlier one if several hold as many. Every token
counts once, so sections' counts add up to the document's.

Sections are lines, each with its line feed, or named fields joined in order (:func:`field_counts`).

Defined cases: a null or empty text is one section without tokens; a section without bytes has no
tokens; repeated rows each give their sections; a very long text is encoded whole, in memory in proportion to it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and each token's length in bytes."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(bounds: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Tokens per section. Both lists are boundaries in bytes, from 0 to the same end."""
    counts = np.zeros(len(sections) - 1, np.int64)
    if len(bounds) < 2:
        return counts
    first = np.searchsorted(sections, bounds[:-1], side="right") - 1
    last = np.searchsorted(sections, bounds[1:], side="left") - 1
    for t in np.flatnonzero(first < last):
        between = np.arange(first[t], last[t] + 1)
        shares = np.minimum(sections[between + 1], bounds[t + 1]) - np.maximum(sections[between], bounds[t])
        first[t] = between[int(np.argmax(shares))]
    counts += np.bincount(first, minlength=len(counts))
    return counts


def lines(raw: bytes) -> np.ndarray:
    """Boundaries of the lines, each with its line feed."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.unique(np.concatenate(([0], ends, [len(raw)]))) if raw else np.array([0, 0])


SECTIONS = pa.schema([(n, pa.int64()) for n in ("doc_id", "section", "start_char", "end_char", "n_tokens", "doc_tokens")])


def section_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per line of each text: section (from 0), its place in code points, its tokens and the document's."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def scan(batches):
        encoding, sizes = vocabulary(path)
        for batch in batches:
            columns = [[] for _ in SECTIONS]
            null = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                raw = text.encode("utf-8")
                ids = np.array(encoding.encode_ordinary(text), np.int64)
                bounds = np.concatenate(([0], np.cumsum(sizes[ids]))) if len(ids) else np.zeros(1, np.int64)
                at = lines(raw)
                counts = attribute(bounds, at)
                chars = at if len(raw) == len(text) else np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[at]
                n = len(counts)
                for column, values in zip(columns, (np.full(n, doc_id or 0), np.arange(n), chars[:-1], chars[1:], counts, np.full(n, len(ids)))):
                    column.append(values)
                null.append(np.full(n, doc_id is None))
            joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            masks = [np.concatenate(null) if null else None, *[None] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=m) for c, m in zip(joined, masks)], schema=SECTIONS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, ", ".join(f"{f.name} long" for f in SECTIONS))


def field_counts(rows: DataFrame, fields: list[str], separator: str = "\n", tokenizer: str | None = None) -> DataFrame:
    """``rows`` with a column ``n_tokens``: tokens of each of ``fields``, which are joined and encoded once. Separators count with the field before."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.udf("array<long>", useArrow=True)
    def count(parts):
        encoding, sizes = vocabulary(path)
        texts = [p + (separator if i < len(parts) - 1 else "") for i, p in enumerate(parts)]
        ids = np.array(encoding.encode_ordinary("".join(texts)), np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes[ids]))) if len(ids) else np.zeros(1, np.int64)
        ends = np.concatenate(([0], np.cumsum([len(t.encode("utf-8")) for t in texts])))
        return attribute(bounds, ends).tolist()

    return rows.withColumn("n_tokens", count(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])))
