"""Column functions on text, paths and bytes. Offsets and sizes are in UTF-8 bytes; folding is of A to Z only."""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BINARY_EXTENSIONS, EXTENSIONS, LANGUAGES, MAX_FILE_SIZE, SYMBOL_KINDS


def fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


#: What a byte is in an index: A to Z as a to z.
_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[ord("A") : ord("Z") + 1] += 32


def _byte_runs(contents, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram numbers, row of each, byte offset of each) of an Arrow array of strings or bytes; null rows have none."""
    import pyarrow as pa

    data = contents.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    if len(raw) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    b = _FOLDED[raw] if folded else raw.astype(np.uint32)
    grams = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    row = np.repeat(np.arange(len(data)), np.diff(ends))
    whole = np.flatnonzero(row[:-2] == row[2:])
    return grams[whole].astype(np.int64), row[whole], whole - ends[row[whole]]


def trigram_rows(contents, folded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(trigram numbers, row of each): the distinct byte trigrams of each row of an Arrow array."""
    grams, row, _ = _byte_runs(contents, folded)
    both = np.unique((row << 24) | grams)
    return both & 0xFFFFFF, both >> 24


def trigram_places(contents, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram numbers, row of each, byte offset of each), in order."""
    return _byte_runs(contents, folded)


def trigrams_of(text: str, folded: bool = True) -> list[int]:
    """The distinct trigrams of a text, in order, as numbers: three bytes, the first one highest."""
    data = "".join(c.lower() if folded and c in string.ascii_uppercase else c for c in text).encode()
    return list(dict.fromkeys(int.from_bytes(data[i : i + 3]) for i in range(len(data) - 2)))


def trigram_hex(trigram: Column) -> Column:
    return F.lpad(F.hex(trigram), 6, "0")


def trigram_text(trigram: Column) -> Column:
    """A trigram to read: printable ASCII as it is, other bytes as \\xNN."""
    byte = lambda i: F.shiftright(trigram, 16 - 8 * i).bitwiseAND(F.lit(255)).cast("int")
    shown = lambda b: F.when(b.between(32, 126), F.chr(b)).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(b), 2, "0"))))
    return F.concat(*[shown(byte(i)) for i in range(3)])


def lines(content: Column) -> Column:
    """Lines without a phantom last one and without a closing carriage return."""
    parts = F.split(content, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r\\z", ""))


def newline_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name, if a name stands before it; else empty."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    name = file_name(path)
    return F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "Dockerfile").otherwise(F.coalesce(F.try_element_at(table, extension(path)), F.lit("Unknown")))


def _code_of(name: Column, names: list[str], unknown: int | None) -> Column:
    table = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return F.coalesce(F.try_element_at(table, name), F.lit(unknown).cast("int"))


def _name_of(code: Column, names: list[str], unknown: str | None) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.when(code.between(0, len(names) - 1), code)), F.lit(unknown).cast("string"))


#: The code of an unknown language.
NO_LANGUAGE = 0xFFFF


def language_code(language: Column) -> Column:
    """The number by which a language is stored."""
    return _code_of(language, list(LANGUAGES), NO_LANGUAGE)


def language_of_code(code: Column) -> Column:
    return _name_of(code, list(LANGUAGES), "Unknown")


def kind_code(kind: Column) -> Column:
    """The number by which a kind of symbol is stored; null for an unknown one."""
    return _code_of(kind, list(SYMBOL_KINDS), None)


def kind_of_code(code: Column) -> Column:
    return _name_of(code, list(SYMBOL_KINDS), None)


def is_unsafe_path(path: Column) -> Column:
    """An absolute path, or one with a component that leads upwards."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def is_binary_path(path: Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS)


def has_nul(content: Column) -> Column:
    """A NUL in the first 8192 bytes of a BINARY column."""
    return F.locate("\0", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0


def indexable(path: Column, content: Column, size: Column) -> Column:
    return ~is_binary_path(path) & (size <= MAX_FILE_SIZE) & ~has_nul(content)


def quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def overlapping_starts(line: Column, literal: str) -> Column:
    """1-based code-point positions of a literal in a line, overlapping ones too: the line is cut before each of them, and
    the pieces' lengths are added up."""
    pieces = F.split(line, f"(?={quoted(literal)})", -1)
    at = F.transform(pieces, lambda x, i: F.struct(((i > 0) | line.startswith(literal)).alias("here"), (1 + F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p))).alias("at")))
    return F.transform(F.filter(at, lambda x: x["here"]), lambda x: x["at"])


def byte_offset(line: Column, position: Column) -> Column:
    return F.octet_length(F.substr(line, F.lit(1), position - 1))


def glob_regex(glob: str) -> str:
    """A full-match pattern for a glob of *, ?, [...] and {a,b} (and ** across folders; *, ? and classes stop at a slash)."""
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^"))) if c == "[" else -1
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if close > 0:
            inside = glob[i + 1 : close]
            negated = inside[0] in "!^"
            items = "".join(x if x == "-" else re.sub(r"([\\\[\]&^])", r"\\\1", x) for x in inside[negated:])
            out.append(f"(?!/)[{'^' if negated else ''}{items}]")
            i = close + 1
            continue
        if c == "{" and "}" in glob[i:]:
            out.append("(?:")
            braces += 1
        elif c == "}" and braces:
            out.append(")")
            braces -= 1
        elif c == "," and braces:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or quoted(c))
        i += 1
    return "^" + "".join(out) + r"\z"


def simple_glob_regex(glob: str) -> str:
    """A full-match pattern for an exclude glob, in which only * and ? are special and both match slashes."""
    return r"(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or quoted(c) for c in glob) + r"\z"


def _scaled(n: Column, digits: int) -> Column:
    size = lambda unit, power: F.format_string(f"%.{digits}f {unit}", n / F.lit(float(1 << 10 * power)))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, size("KB", 1)).when(n < 1 << 30, size("MB", 2)).otherwise(size("GB", 3))


def human_bytes(n: Column) -> Column:
    return _scaled(n, 2)


def format_size(n: Column) -> Column:
    return _scaled(n, 1)


def relative_time(seconds: Column) -> Column:
    """How long ago, in the largest unit that fits."""
    say = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, say(60, "m")).when(seconds < 86400, say(3600, "h")).otherwise(say(86400, "d"))


def approximate_duration(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600)
    say = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    plain = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return F.when(seconds < 60, plain(seconds, "seconds")).when(seconds < 3600, plain(F.floor(seconds / 60), "minutes")).when(hours < 24, say(hours, "hour")).otherwise(say(F.floor(seconds / 86400), "day"))


def url_encode(c: Column) -> Column:
    """Percent-encoding of all bytes but the unreserved ones."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def relative_path(path: str, base: str) -> str:
    """A path below the root as seen from a folder below the root."""
    a, b = [x for x in path.split("/") if x], [x for x in base.split("/") if x]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return "/".join([".."] * (len(b) - n) + a[n:])


def rewritten_path(path: Column, base: str = "", root: str | None = None) -> Column:
    """Paths for a reader who stands in the folder `base`; absolute ones if a root is given."""
    if root is not None:
        return F.concat(F.lit(root.rstrip("/") + "/"), path)
    parts = [x for x in base.split("/") if x]
    out = F.concat(F.lit("../" * len(parts)), path)
    for n in range(1, len(parts) + 1):  # the longest folder in common comes last and wins
        inside = "/".join(parts[:n]) + "/"
        out = F.when(path.startswith(inside), F.concat(F.lit("../" * (len(parts) - n)), F.substr(path, F.lit(len(inside) + 1)))).otherwise(out)
    return out


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
