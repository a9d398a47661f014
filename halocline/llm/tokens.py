"""Exact tokenizer encoding with a per-worker cache.

Byte-pair merges never cross the pre-tokenizer's pieces, so a text's ids are the ids of its pieces in order. The
library encodes each distinct word about once per worker; a text is then a lookup and a join of bytes. Texts that cannot
be cut at spaces safely, and those that hold a special token's string, go to the library whole, so the ids always equal
those of `Tokenizer.encode(text, add_special_tokens=False)`.

A worker may live as long as its executor, so the cache is bounded: bare words only, in two generations, some 140 bytes
an entry.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Entries of one cache generation; two generations are held at most.
CACHE_ENTRIES = 320_000
#: The same for the pieces of words that hold digits or marks.
PIECE_ENTRIES = 50_000
#: Longer words are encoded but not kept.
CACHED_CHARS = 32


class _Whole(Exception):
    """The text has to be encoded in one call."""


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100, where the pattern means the same in both libraries."""
    return text.isascii() or max(text) < "\u0100"


class _Words(dict):
    """Ids of words, in two generations: what is not asked for during a whole generation is forgotten.

    A word with a full stop or comma is put together from the word's entry and the mark's, and takes none itself."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, key):
        mark = self.marks.get(key[-1:])
        if mark is not None:
            bare = key[:-1]
            if bare.isalpha() and (bare.isascii() or _latin(bare)):
                return self[bare] + mark
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"]
        if pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            # fixed value: the published pattern of the byte-level vocabulary
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self.spaced = True
        elif pre["type"] == "Sequence" and pre["pretokenizers"][0].get("invert") and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
            self.spaced = False
        else:
            raise ValueError(f"no exact cutting rule for the pre-tokenizer of {path}")
        #: What the library looks for before it cuts; where case or form is folded first, the folded text is searched.
        self.special = [x["content"] for x in made["added_tokens"]]
        self.folded = any(x["normalized"] for x in made["added_tokens"])
        self.model = self.tokenizer.model
        # fixed values: the byte-level alphabet shows printable Latin-1 bytes as themselves, the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_chars = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.space = chr(byte_chars[32])
        self.shown = {c: "".join(chr(byte_chars[b]) for b in chr(c).encode()) for c in range(256)}
        self.words = _Words(self._after_space if self.spaced else self._between_spaces, CACHE_ENTRIES)
        self.pieces = _Words(self._piece, PIECE_ENTRIES)
        self.words.marks = {x: self._piece(x) for x in ".,"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """One pre-token of characters below U+0100: straight to the merges, as the library does after cutting."""
        if piece.isascii() and piece.isprintable():  # in the alphabet only the space looks different
            return self._merged(piece.replace(" ", self.space))
        return self._merged(piece.translate(self.shown))

    def _merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _after_space(self, word: str) -> bytes:
        """A word with the space before it; white space at its head would join that space's piece."""
        if word.isascii() and word.isalpha():  # most words, the shortest way
            return self._merged(self.space + word)
        if not word or word[0].isspace():
            raise _Whole
        return self._chunk(" " + word)

    def _between_spaces(self, word: str) -> bytes:
        if word.isascii():
            return self._merged(word.lower()) if word.isalpha() else self._chunk(word) if word else b""
        return self._chunk(word)

    def _chunk(self, chunk: str) -> bytes:
        if chunk and _latin(chunk):
            if not self.spaced:
                chunk = chunk.lower()
            if chunk[chunk[0] == " " :].isalpha():
                return self._piece(chunk)
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))
        return self._whole(chunk)

    def _has_special(self, text: str) -> bool:
        # A mark such as `<` has no case, so a text without it needs no folding.
        near = [x for x in self.special if not x[0].isascii() or x[0].isalpha() or x[0] in text]
        return bool(near) and any(x in folded for folded in [text.lower() if self.folded else text] for x in near)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._has_special(text):
            return self._whole(text)
        if not self.spaced:  # white space only separates pieces here
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        parts = text.split(" ")
        try:
            # A space before a visible character always begins a piece, whatever stands before it.
            if not parts[0]:
                raise _Whole
            head = self._chunk(parts[0])
            del parts[0]
            return head + b"".join(map(self.words.__getitem__, parts))
        except _Whole:
            return self._whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
