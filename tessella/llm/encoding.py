"""Exact, cached encoding of whole texts with public tokenizers, for use inside tasks."""

from __future__ import annotations

import functools

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Texts' white-space-separated chunks made of these characters alone take the cached path. Over them
#: Unicode tables of the libraries involved agree; any other chunk goes to the tokenizer itself.
PLAIN = regex.compile("[!-~¡-įı-ž]+")
#: Pre-tokenisation pattern of the vocabulary file (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: str.split() also splits at these, which the tokenizer does not treat as white space.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Entries that a worker keeps per cache before it starts anew.
CACHE_ENTRIES = 400_000


def byte_alphabet() -> dict[int, int]:
    """Byte value -> code point that byte-level vocabularies print it as: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = found = self.make(key)
        return found


class WordEncoder:
    """Ids of the word-level vocabulary, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are those
    of its chunks in order; chunks, and the letter runs in them, repeat and are cached.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.pieces = _Cache(self._piece)
        self.chunks = _Cache(self._chunk)

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _chunk(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            return self._whole(chunk)
        low = chunk.lower()
        return self.pieces[low] if low.isalpha() else b"".join([self.pieces[p] for p in PIECES.findall(low)])

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self._whole(text)
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.split()])


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, per worker."""
    return WordEncoder(path)


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
