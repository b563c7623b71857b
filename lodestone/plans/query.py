"""The query language: literals, "phrases", /regular expressions/, path: and lang: filters, case:yes, AND by writing
terms side by side, OR, and NOT. A query becomes a tree; filters are evaluated where they stand."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions import regex
from ..functions.tables import language_named

MAX_DEPTH = 128


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    text: str
    case: bool = False
    phrase: bool = False


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class PathFilter:
    prefix: str


@dataclass(frozen=True)
class LanguageFilter:
    language: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


_TOKEN = re.compile(r'\s*(?:(?P<key>NOT|OR)(?=$|[\s"/])|(?P<case>case:yes)(?=$|[\s"/])|(?P<filter>path:|language:|lang:)(?P<value>\S*)|"(?P<phrase>[^"]*)(?P<close>"?)|/(?P<regex>(?:\\.|[^/\\])*)(?P<end>/?)|(?P<word>[^\s"/]+))', re.S)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise QueryError(f"unexpected input at {at}")
        at = m.end()
        if m["key"]:
            out.append((m["key"], ""))
        elif m["case"]:
            out.append(("case", ""))
        elif m["filter"]:
            if not m["value"]:
                raise QueryError(f"{m['filter']} needs a value")
            out.append(("path" if m["filter"] == "path:" else "lang", m["value"]))
        elif m["phrase"] is not None:
            if not m["close"]:
                raise QueryError("unterminated phrase")
            out.append(("phrase", m["phrase"]))
        elif m["regex"] is not None:
            if not m["end"]:
                raise QueryError("unterminated regular expression")
            out.append(("regex", m["regex"]))
        else:
            out.append(("word", m["word"]))
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at, self.case = _tokens(text), 0, False

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def either(self):
        parts = [self.both()]
        while self.peek() == "OR":
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.unary(0)]
        while self.peek() not in ("", "OR"):
            parts.append(self.unary(0))
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unary(self, depth: int):
        if depth > MAX_DEPTH:
            raise QueryError("nested too deep")
        kind = self.peek()
        if not kind or kind == "OR":
            raise QueryError("a term is missing")
        value = self.tokens[self.at][1]
        self.at += 1
        if kind == "NOT":
            return Not(self.unary(depth + 1))
        if kind == "case":
            self.case = True  # holds for the next literal, phrase or regular expression
            return self.unary(depth + 1)
        if kind == "path":
            return PathFilter(value)
        if kind == "lang":
            try:
                return LanguageFilter(language_named(value))
            except ValueError as error:
                raise QueryError(str(error)) from None
        case, self.case = self.case, False
        if kind == "regex":
            try:
                regex.check(value)
            except regex.RegexError as error:
                raise QueryError(f"bad regular expression: {error}") from None
            return Regex(value)
        return Literal(value, case, kind == "phrase")


def parse(text: str):
    """The tree of a query; QueryError if it is empty or malformed."""
    if not text.strip():
        raise QueryError("empty query")
    parser = _Parser(text)
    tree = parser.either()
    if parser.peek():
        raise QueryError("unexpected input")
    return tree


def smart_case(pattern: str) -> bool:
    """Whether a pattern is taken case-sensitively: if it holds an upper-case letter."""
    return any(c.isupper() for c in pattern)


def with_filters(tree, languages: tuple[str, ...] = (), path: str | None = None):
    """The tree restricted to languages (any of them) and to a path prefix."""
    parts = [Or(tuple(map(LanguageFilter, languages))) if len(languages) > 1 else LanguageFilter(languages[0])] if languages else []
    parts += [PathFilter(path)] if path else []
    return And((*parts, tree)) if parts else tree


def show(tree) -> str:
    """Query text for a tree."""
    match tree:
        case Literal(text, case, phrase):
            return ("case:yes " if case else "") + (f'"{text}"' if phrase or " " in text else text)
        case Regex(pattern):
            return f"/{pattern}/"
        case PathFilter(prefix):
            return f"path:{prefix}"
        case LanguageFilter(language):
            return f"lang:{language}"
        case And(parts):
            return " ".join(map(show, parts))
        case Or(parts):
            return " OR ".join(map(show, parts))
        case Not(part):
            return f"NOT {show(part)}"
    raise TypeError(tree)
