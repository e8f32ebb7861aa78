"""Ids of whole texts from a tokenizer file of the ``tokenizers`` library.

A byte-pair encoder of the library looks at each pre-token by itself, and no pre-token of the patterns used here
reaches over a line feed or a single space between two other characters. So a text can be cut there and the ids of
each different unit asked from the library once. A unit of letters and then punctuation is two pre-tokens at most, for
which the library's model is asked directly. A text with any other white space at such a cut goes to the library
whole, so the ids are the library's in every case.
"""

from __future__ import annotations

import os
import re
import struct

#: Units kept at most; then the table starts anew, so the memory is bounded.
CACHE_UNITS = 300_000


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _WholeText(Exception):
    """The text can't be cut into independent units."""


#: Letters of ASCII and Latin-1, then ASCII punctuation other than the apostrophe.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level encoders write for each byte: printable ones for themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_BYTE_LETTERS = _byte_letters()


class _Units(dict):
    """Unit (bytes) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, model, prefix: str, strict: bool, lower: bool):
        super().__init__()
        self.encode, self.model, self.prefix, self.strict, self.lower = encode, model, prefix, strict, lower
        self.letters: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _letters(self, word: bytes) -> bytes:
        if (ids := self.letters.get(word)) is None:
            written = (word.decode().lower().encode() if self.lower else self.prefix.encode() + word).decode("latin-1").translate(_BYTE_LETTERS)
            ids = packed([t.id for t in self.model.tokenize(written)])
            if len(self.letters) >= CACHE_UNITS:
                self.letters.clear()
            self.letters[word] = ids
        return ids

    def _marks(self, marks: bytes) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= CACHE_UNITS:
                self.marks.clear()
            self.marks[marks] = self.encode(marks.decode())
        return self.marks[marks]

    def __missing__(self, unit: bytes) -> bytes:
        if len(self) >= CACHE_UNITS:
            self.clear()
        if plain := _PLAIN.fullmatch(unit):
            word, marks = plain.groups()
            self[unit] = ids = self._letters(word) + (self._marks(marks) if marks else b"")
            return ids
        text = unit.decode("utf-8", "replace")
        if self.strict and (not text or text[0].isspace() or text[-1].isspace()):
            raise _WholeText
        self[unit] = ids = self.encode(self.prefix + text)
        return ids


class Encoder:
    """``ids(text)`` gives the ids of a text (bytes of UTF-8) as little-endian unsigned 32-bit integers.

    words: the tokenizer drops white space, so that only words matter; else white space counts.
    Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = words
        self.first = _Units(self._library, self.tokenizer.model, "", not words, words)
        self.rest = _Units(self._library, self.tokenizer.model, " ", True, words)
        self.line_end = b"" if words else self._library("\n")

    def _library(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if self.words:
            return b"".join(map(self.first.__getitem__, text.split()))
        out = []
        try:
            for line in text.split(b"\n"):
                head, *tail = line.split(b" ")
                out.append(self.first[head] + b"".join(map(self.rest.__getitem__, tail)))
        except _WholeText:
            return self._library(text.decode("utf-8", "replace"))
        return self.line_end.join(out)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """One encoder for each worker process."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]
