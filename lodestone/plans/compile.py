"""Trees to columns: a condition on files, and the matching lines with their numbers of ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..functions.text import fold, lines, quoted
from .query import And, LanguageFilter, Literal, Not, Or, PathFilter, Regex


def condition(tree, content: Column, path: Column, language: Column) -> Column:
    match tree:
        case Literal(text, case):
            return content.contains(text) if case else fold(content).contains(_folded(text))
        case Regex(pattern):
            return content.rlike(to_java(pattern))
        case PathFilter(prefix):
            return F.coalesce(path.startswith(prefix), F.lit(False))
        case LanguageFilter(name):
            return language.eqNullSafe(name)
        case And(parts):
            out = F.lit(True)
            for p in parts:
                out = out & condition(p, content, path, language)
            return out
        case Or(parts):
            out = F.lit(False)
            for p in parts:
                out = out | condition(p, content, path, language)
            return out
        case Not(part):
            return ~condition(part, content, path, language)
    raise TypeError(tree)


def _folded(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _leaf_ranges(tree, line: Column) -> Column:
    """Ranges of a leaf in a line: overlapping for exact literals, not for folded ones and regular expressions."""
    if isinstance(tree, Literal):
        if not tree.text:
            return F.lit(0)
        if tree.case:
            # A look-ahead matches at every start, overlapping ones too, in one pass over the line.
            return F.when(line.contains(tree.text), F.regexp_count(line, F.lit(f"(?={quoted(tree.text)})"))).otherwise(0)
        return F.when(fold(line).contains(_folded(tree.text)), F.regexp_count(fold(line), F.lit(quoted(_folded(tree.text))))).otherwise(0)
    return F.regexp_count(line, F.lit(to_java(tree.pattern)))


def first_column(tree, line: Column) -> Column:
    """1-based byte column of the first match in a line, of the first leaf that matches there; 1 where none does."""
    found: list[Column] = []

    def walk(node) -> None:
        match node:
            case Literal(text, case) if text:
                found.append(F.locate(text if case else _folded(text), line if case else fold(line)))
            case Regex(pattern):
                found.append(F.regexp_instr(line, F.lit(to_java(pattern))))
            case And(parts) | Or(parts):
                for p in parts:
                    walk(p)

    walk(tree)
    at = F.coalesce(*[F.when(p > 0, p) for p in found], F.lit(1))
    return F.octet_length(F.substr(line, F.lit(1), at - 1)) + 1


def line_ranges(tree, line: Column, content: Column, path: Column, language: Column) -> Column:
    """Ranges in a line: those of the first part that has any; parts that the file does not satisfy have none."""
    match tree:
        case Literal() | Regex():
            return _leaf_ranges(tree, line)
        case PathFilter() | LanguageFilter() | Not():
            return F.lit(0)
        case And(parts) | Or(parts):
            own = [line_ranges(p, line, content, path, language) for p in parts]
            if isinstance(tree, Or):
                # The ranges come first: the condition reads the whole file and is asked only for lines that have some.
                own = [F.when(n > 0, F.when(condition(p, content, path, language), n).otherwise(0)).otherwise(0) for p, n in zip(parts, own, strict=True)]
            out = F.lit(0)
            for n in reversed(own):
                out = F.when(n > 0, n).otherwise(out)
            return out
    raise TypeError(tree)


def matched_lines(tree, content: Column, path: Column, language: Column) -> Column:
    """array<struct<line_number, content, ranges>> of the lines that match."""
    numbered = F.transform(lines(content), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("content"), line_ranges(tree, x, content, path, language).alias("ranges")))
    return F.filter(numbered, lambda x: x["ranges"] > 0)
