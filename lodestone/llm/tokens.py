"""Tokenizer access with caches on the workers: pre-tokens are split off with a regular expression, and the ids of each
distinct pre-token come from the model of the tokenizers library once per worker.  Texts of common Latin characters have
a faster expression; all others are split with Unicode's classes.  Only a text with a special string, or with a character
that this Python's Unicode does not know (the library's may), goes to the library whole; where the file normalises, so
does a text that is not in composed form or has several combining marks in a row."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters of the faster expression: printable ASCII, tab, line feed, carriage return, and Latin letters, signs
#: and digits that are already composed.
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-žƀ-ǃ", "0-9²³¹¼-¾"
_LATIN = "\t\n\r\x20-\x7e¡-¬®-įĲ-žƀ-ǃ"
#: How each kind of tokenizer file splits text into pre-tokens, for these characters and for all.
_BYTE_PATTERN = rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+"
_ANY_BYTE_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY_WORD_PATTERN = r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _char_class(wanted) -> str:
    """A class of all characters for which wanted(character) holds, as ranges."""
    out, first = [], None
    for c in range(0x110000 + 1):
        inside = c < 0x110000 and wanted(chr(c))
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


@functools.cache
def _unassigned():
    """Finds a character that this Python's Unicode does not know."""
    return re.compile(f"[{_char_class(lambda c: unicodedata.category(c) == 'Cn')}]").search


@functools.cache
def _marks():
    """Finds two combining marks in a row."""
    return re.compile(f"[{_char_class(unicodedata.combining)}]{{2}}").search


@functools.cache
def _beyond(folds: bool):
    """Finds a character that the faster expression is not for; if it folds, one whose lower case is none of them too."""
    latin = re.compile(f"[{_LATIN}]+").fullmatch
    return re.compile(f"[^{_char_class(lambda c: c < chr(0x250) and latin(c) and (not folds or latin(c.lower())))}]").search


#: Entries of a worker's cache, of about 200 bytes each, and the longest pre-token that is kept in any table.
CACHE_ENTRIES, LONGEST = 800_000, 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Cache(dict):
    """Fills itself from a function. A full table becomes the older one, from which what is used again moves back, so that
    frequent keys stay; 1.5 * entries are held at most. Long keys are not kept."""

    def __init__(self, find, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.find, self.entries, self.older = find, entries, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.find(key)
            if len(key) > LONGEST:
                return value
        if 4 * len(self) >= 3 * self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class CachedTokenizer:
    """Ids as the library gives them for a whole text, with a bounded cache by pre-token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        import regex

        self.folds = self.library.normalizer is not None
        self.split = re.compile(_WORD_PATTERN if self.folds else _BYTE_PATTERN).findall
        self.split_any = regex.compile(_ANY_WORD_PATTERN if self.folds else _ANY_BYTE_PATTERN).findall
        self.beyond = _beyond(self.folds)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        start = os.path.commonprefix(special)
        self.special = [start] if start else special
        self.letters, self.model = byte_letters(), self.library.model
        self.ids = Cache(lambda piece: array("I", self.encode_piece(piece)).tobytes())
        self.lengths = Cache(lambda piece: len(self.encode_piece(piece)))

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None if only the library can tell."""
        for s in self.special:
            if s in text:
                return None
        if self.beyond(text) is None:
            return self.split(text.lower() if self.folds else text)
        if _unassigned()(text) is not None:
            return None
        if self.folds:
            # The library's tables of marks are older than Python's, so the order of several marks is its own affair.
            if not unicodedata.is_normalized("NFC", text) or _marks()(text) is not None:
                return None
            text = text.replace("Σ", "σ").lower()  # it folds each character alone: no special form at the end of words
        return self.split_any(text)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        pieces = self.pre_tokens(text)
        if pieces is not None:
            return b"".join(map(self.ids.__getitem__, pieces))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def count(self, text: str, lengths: dict | None = None) -> int:
        """The number of ids of a text; lengths: a table to look pre-tokens up in, which falls back on this cache."""
        pieces = self.pre_tokens(text)
        if pieces is not None:
            return sum(map((self.lengths if lengths is None else lengths).__getitem__, pieces))
        return len(self.library.encode(text, add_special_tokens=False).ids)


class Tier(dict):
    """A table of frequent pre-tokens; what it lacks is asked of the worker's cache."""

    def __init__(self, frequent: dict[str, int], rest: dict[str, int]) -> None:
        super().__init__(frequent)
        self.rest = rest

    def __missing__(self, key: str) -> int:
        return self.rest[key]


_held: dict[str, CachedTokenizer] = {}


def cached(path: str) -> CachedTokenizer:
    """One tokenizer a worker process and path."""
    if path not in _held:
        _held[path] = CachedTokenizer(path)
    return _held[path]
