"""A word-level BPE vocabulary file: its tables and how a text becomes words.

The file is read once by the driver and broadcast; each Python worker compiles
its tables once and keeps them for later tasks.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property

import numpy as np
import regex

#: Letters and signs that every Unicode version classes alike. A text with others is
#: normalised and split by the library, whose tables may be older or newer than Python's.
_SETTLED = re.compile(r"[^\x00-\u024f\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u205e"
                      r"\u20a0-\u20ac\u3001-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]").search

#: A file's place is a parameter of the operators; this is the name they default to.
DEFAULT_FILE = "word_bpe_49k.json"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordPieces:
    """Tables of one vocabulary file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a lower-casing word BPE vocabulary")
        self._content = content
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern).findall
        # The same for texts of ASCII only: the standard engine is faster.
        narrow = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self._ascii_words = re.compile(narrow, re.ASCII).findall
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], dtype=np.int32)

    @cached_property
    def strings(self) -> list[str]:
        """The token of each id as the file spells it."""
        names = [""] * self.size
        for token, i in (self.vocab | self.special).items():
            names[i] = token
        return names

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_str(self._content.decode())

    @cached_property
    def _bytes(self) -> dict[str, int]:
        return {s: b for b, s in enumerate(byte_symbols())}

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii_words(text.lower())
        if _SETTLED(text):
            lowered = self._library.normalizer.normalize_str(text.encode("utf-8", "replace").decode())
            return [bytes(map(self._bytes.__getitem__, w)).decode()
                    for w, _ in self._library.pre_tokenizer.pre_tokenize_str(lowered)]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Character by character, so a sigma at a word's end stays an inner one.
        return self._words(text.replace("Σ", "σ").lower())

    def words(self, text: str) -> list[str]:
        """The words that merges stay within; special strings are words of their own."""
        if "<|" not in text:
            return self._plain(text)
        parts = self._split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._plain(part))]


_COMPILED: dict[tuple, object] = {}


def compiled(content: bytes, build=WordPieces):
    """``build(content)``, once per worker process."""
    key = (build, hash(content))
    if key not in _COMPILED:
        _COMPILED[key] = build(content)
    return _COMPILED[key]


def read_vocabulary(path: str | None) -> bytes:
    """The vocabulary file's content, read by the driver."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(DEFAULT_FILE)
    with open(path, "rb") as file:
        return file.read()


class WordCache(dict):
    """What was computed for words; a worker keeps it between slices and tasks.

    The first ``core`` words stay, which are mostly the frequent ones; beyond, words
    are held until there are ``limit`` in all. A word that was let go is computed again.
    """

    def __init__(self, core: int = 150_000, limit: int = 220_000) -> None:
        super().__init__()
        self._core, self._limit = core, limit
        self._passing: list[str] = []

    def fill(self, words: list[list[str]], compute) -> None:
        """Makes the cache hold every word of ``words``, by one call of ``compute`` for those it lacks."""
        wanted = set().union(*words)
        fresh = wanted.difference(self)
        if len(self) + len(fresh) > self._limit:
            for word in self._passing:
                del self[word]
            self._passing.clear()
            fresh = wanted.difference(self)
        if fresh:
            found = list(fresh)
            if len(self) >= self._core:
                self._passing += found
            self.update(zip(found, compute(found), strict=True))
