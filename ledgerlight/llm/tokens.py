"""Exact tokenizer ids with a bounded cache of text chunks.

Encoding a chunk costs far more than looking it up, and words repeat. A text is
cut only where the tokenizer itself must cut (a single space between two other
characters), so the ids of the chunks, in order, are the ids of the text.
Texts for which that isn't certain are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks in each of two generations; both take some 150 bytes a chunk.
CACHE_ENTRIES = 150_000
CACHED_CHARS = 40
# A space beside other white space may belong to a longer token.
_RUN = re.compile(r" \s|\s ")
# A single line end between other characters is a piece of its own.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_WORD = re.compile(r" ?[^ ]+| ")
# str.split() takes these for white space, the tokenizers don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# A word of Latin letters with marks behind it: the tokenizers cut between the two.
_MARKED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$#&*|()\"]*)")


def _shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies spell a byte: printable Latin-1 as itself, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = _shown_bytes()


class _Chunks(dict):
    """Ids of chunks; two generations of bounded size, so common chunks outlive rare ones."""

    def __init__(self, learn: Callable[[str], bytes], entries: int):
        self.learn, self.entries, self.older = learn, entries, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.learn(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned integers of ``width`` bytes, two if the vocabulary allows it.

    ``spaced``: a space belongs to the word behind it (byte-level vocabularies);
    otherwise white space is dropped before words are looked up.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        letter = "H" if self.width == 2 else "I"
        self.packs = [struct.Struct(f"<{n}{letter}").pack for n in range(32)]
        self.tokenize = self.tokenizer.model.tokenize
        self.spaced = len(self.tokenizer.encode(" a  a", add_special_tokens=False).ids) != len(
            self.tokenizer.encode("a a", add_special_tokens=False).ids
        )
        spelled = self._word(" äÉs" if self.spaced else "äÉs")
        if spelled != self._packed([" äÉs" if self.spaced else "äÉs"])[0]:
            raise ValueError(f"{path} is no byte-level vocabulary of a known kind")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        self.cache = _Chunks(self.learn, entries)

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _word(self, word: str) -> bytes:
        """Ids of letters that the tokenizer takes as one piece, from its merges directly."""
        if not self.spaced:
            word = word.lower()
        if word.isascii():
            spelled = word.replace(" ", _SHOWN[32])
        else:
            spelled = word.encode().decode("latin-1").translate(_SHOWN)
        ids = [x.id for x in self.tokenize(spelled)]
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else np.array(ids, self.kind).tobytes()

    def learn(self, chunk: str) -> bytes:
        """Ids of an unknown chunk; a word and the marks behind it are looked up apart."""
        m = _MARKED.fullmatch(chunk)
        if m is None:
            return self._packed([chunk])[0]
        marks = m[2]
        return self.cache[m[1]] + self.cache[marks] if marks else self._word(chunk)

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text; an empty text has none."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self._packed([text])[0]
        if not self.spaced:
            return self._packed([text])[0] if _SEPARATORS.search(text) else self._joined(text.split())
        chunks: list[str] = []
        for line in _LINE.split(text):
            if chunks:
                chunks.append("\n")
            if _RUN.search(line):
                chunks.append(line)
            else:
                chunks += _WORD.findall(line)
        return self._joined(chunks)

    def _joined(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, chunks))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.kind)


@lru_cache(maxsize=4)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """One encoder for each file, size of cache and Python worker."""
    return Encoder(path, entries)
