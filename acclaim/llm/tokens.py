"""Byte-level BPE ids of whole texts, from the `tokenizers` library.

The library's pre-tokenizer never lets a token cross a single space between two non-space
characters, so a text is the sequence of its space-led chunks and each chunk has ids of its own.
Chunks and words repeat; each distinct one is merged by the library once per worker while it
stays in a bounded cache.
"""

from __future__ import annotations

import os
import re
from array import array

# A chunk of these characters alone is cut by `_WORDS` just as by the vocabulary's own pattern.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)
# The usual chunk behind a space: letters, then signs.  `_WORDS` would cut it in just these two.
_LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_LONGEST_CACHED = 64


class _Irregular(Exception):
    """A chunk that starts or ends in white space: the text must be cut with care."""


class _Generations(dict):
    """A dictionary that computes missing values and keeps at most two generations of them."""

    def __init__(self, compute, size: int):
        super().__init__()
        self._compute, self._size, self._old = compute, size, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) <= _LONGEST_CACHED:
            if len(self) >= self._size:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


class TextEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in one ``bytes``.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)`` with special tokens in texts
    taken as ordinary text.
    """

    def __init__(self, path: str, cached: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        self._model = self._whole.model
        if hasattr(self._model, "_resize_cache"):
            # words are remembered here, the library need not remember them too
            self._model._resize_cache(0)
        # the byte-level alphabet: printable bytes stand for themselves, others follow from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        self._alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(others)}
        self._space = chr(self._alphabet[32])
        self._word = _Generations(self._merge, cached)
        self._chunk = _Generations(self._spaced, cached)

    def _merge(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self._alphabet)
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _merge_spaced(self, letters: str) -> bytes:
        if not letters.isascii():
            return self._merge(" " + letters)
        # printable ASCII stands for itself
        return array("I", [t.id for t in self._model.tokenize(self._space + letters)]).tobytes()

    def _cut(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece):
            return b"".join(map(self._word.__getitem__, _WORDS.findall(piece)))
        return array("I", self._whole.encode(piece, add_special_tokens=False).ids).tobytes()

    def _spaced(self, chunk: str) -> bytes:
        usual = _LETTERS_SIGNS.fullmatch(chunk)
        if usual:
            letters, signs = usual.groups()
            if not signs:
                # the chunk is remembered as a whole, its only word need not be
                return self._word.get(" " + letters) or self._merge_spaced(letters)
            return (self._chunk.get(letters) or self._word[" " + letters]) + self._word[signs]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        return self._cut(" " + chunk)

    def encode(self, text: str) -> bytes:
        chunks = text.split(" ")
        try:
            # a leading space belongs to the chunk behind it
            if not text or chunks[0][-1:].isspace():
                raise _Irregular
            head = self._cut(chunks[0]) if chunks[0] else b""
            del chunks[0]
            return head + b"".join(map(self._chunk.__getitem__, chunks))
        except _Irregular:
            chunks = _BETWEEN.split(text)
            return self._cut(chunks[0]) + b"".join(self._cut(" " + c) for c in chunks[1:])


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
