"""Byte-level BPE ids through the tokenizers library, one lookup per word.

A byte-level pre-tokenizer never joins what stands on the two sides of a
single space between non-space characters, so a text's ids are the ids of
its space-parted words, one after another. Each distinct word is encoded
once per worker by the library's own model; the rest are dictionary lookups.
A text that holds an added token's content goes to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from . import common

#: Distinct words, and parts of words, that a worker remembers (about 230 bytes each).
WORDS = 500_000
#: The split pattern of the byte-level pre-tokenizer (a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same pattern where a word is ASCII alone.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: A space beside another space character.
_ODD = re.compile(r"[ ](?:\s|(?<=\s[ ]))")
_GAP = re.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte: itself, or from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_word = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.chars = byte_chars()
        self.wide = array("I").itemsize == 4 and array("I", [1]).tobytes() == b"\1\0\0\0"
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encoded(self, piece: str) -> bytes:
        ids = [x.id for x in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))]
        return array("I", ids).tobytes() if self.wide else np.array(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece; one that begins with a space is remembered as a
        word, without the space, so that words and their pieces share it."""
        known, key = (self.words, piece[1:]) if piece[0] == " " and len(piece) > 1 else (self.pieces, piece)
        found = known.get(key)
        if found is None:
            found = self._encoded(piece)
            if len(known) < WORDS:
                known[key] = found
        return found

    @staticmethod
    def _parts(text: str) -> list[str]:
        return (_ASCII_PIECES if text.isascii() else PIECES).findall(text)

    def _ids(self, word: str) -> bytes:
        return b"".join([self._piece(p) for p in self._parts(word)])

    def _word(self, word: str) -> bytes:
        """The ids of a word that follows a space. Words over a line's end seldom
        come again: their pieces alone are remembered."""
        if word.isascii() and word.isalpha():
            return self._piece(" " + word)
        parts = self._parts(" " + word)
        found = b"".join([self._piece(p) for p in parts])
        if len(parts) > 1 and len(self.words) < WORDS and "\n" not in word:
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of text as bytes: those of the library's encode without
        special tokens around them. Added tokens in the text are recognised."""
        if not text:
            return b""
        if not self.by_word or any([t in text for t in self.added]):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _GAP.split(text) if text[0] == " " or text[-1] == " " or _ODD.search(text) else text.split(" ")
        out = [self._ids(first)]
        get = self.words.get
        for w in rest:
            ids = get(w)
            out.append(self._word(w) if ids is None else ids)
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}
common.caches.append(_encoders.clear)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
