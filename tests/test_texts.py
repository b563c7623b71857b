"""Regular expressions, highlights, symbols, posting codes and small formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import regex, text
from lodestone.operators import postings
from lodestone.operators.search import Engine
from lodestone.plans.query import QueryError, parse
from lodestone.sources import highlights
from lodestone.sources.symbols import extract_symbols
from test_engine import FILES, files  # noqa: F401

ALL = {p for p, _, _ in FILES}


@pytest.mark.parametrize("bad", ["(", "a)", "[a", "*a", "a{2", r"\1", "(?=a)", "(?<!a)", r"\q", "[b-a]", r"\p{Nonsense}", "a{5000}", "(" * 300 + ")" * 300])
def test_bad_expressions(spark, bad):
    with pytest.raises(QueryError):
        parse(f"/{bad}/")


@pytest.mark.parametrize(("pattern", "paths"), [
    (r"\p{Lu}\p{Ll}+::new", {"src/main.rs"}), (r"pass\n\z", {"src/util.py"}), (r"\x{66}n \x6dain", {"src/main.rs"}), (r"(?P<word>Http)Req(?<x>uest)", {"README.md"}), (r"[[:alpha:]]+::new", {"src/main.rs"}),
    (r"(?m)^class$|^class \w+$", set()), (r"(?m)^class \w+:$", {"src/util.py"}), (r"\bmain\b", {"src/main.rs"}), (r"(?i)ÉTUDE", {"README.md"}), (r"(?i)TITLE", {"README.md"}), (r"[^\W\d_]+Request", {"README.md"}), (r"a{4}", {"README.md"}),
    (r"(?x) f n [\ ] main # spaces", {"src/main.rs"}), (r"[a-z&&[^b-z]]{4}", {"README.md"}), (r"\d", set()), (r"here,.aaaa", {"README.md"}), (r"aaaa\..\nÉ", {"README.md"}), (r"aaaa.\nÉ", set()), (r"a|", ALL), (r"(?:README)?fn", {"src/main.rs"}),
])
def test_expressions(files, pattern, paths):  # noqa: F811
    """What is good finds what it should, with and without the index."""
    found = lambda e: {r["path"] for r in e.matches(parse(f"/{pattern}/")).collect()}
    assert found(Engine(files)) == found(Engine(files, postings.build(files))) == paths


def test_runs_of_literals():
    assert regex.runs(r"fn\s+(\w+)\(ab*c[x]d") == ["fn", "(ab", "c", "d"] and regex.runs("a|bc") == ["a", "bc"] and regex.runs(r"\d") == []


def test_highlights(spark):
    """Runs above two bytes are divided, unknown kinds and cut-off data are read, names of captures, HTML with marks."""
    h = highlights
    assert h.decode_runs(h.encode_runs([(70_000, 1), (10, 1), (0, 3), (5, 2)])) == [(65_535, 1), (4475, 1), (5, 2)]
    assert h.decode_runs(b"\x05\x00\x63\x01\x00") == [(5, len(h.KINDS) - 1)]
    assert h.painted(8, [(4, 6, 2), (0, 8, 1), (4, 5, 3)]).tolist() == [1, 1, 1, 1, 3, 2, 1, 1]
    for name, kind in (("keyword.return", "Keyword"), ("keyword.operator", "Operator"), ("constant.builtin", "Number"), ("string.special.symbol", "String"), ("property", "Variable"), ("function.x", "Function"), ("operators", "Plain"), ("none", "Plain")):
        assert h.kind_of_capture(name) == kind
    assert h.html_of_line("a<b & c", [(3, 1), (4, 0)], [(1, 5)]) == '<span class="tok-keyword">a<mark>&lt;b</mark></span><mark> &amp;</mark> c'
    assert h.html_of_line("é!", [], [(0, 2)]) == "<mark>é</mark>!"
    code = 'fn é() { "x" } // end\n\n'
    rows = spark.createDataFrame([(1, code, "Rust"), (2, "x", "Unknown"), (3, None, "Rust"), (4, "", "Rust")], "file_id long, content string, language string")
    rows = h.decoded(h.highlights(rows, ("file_id",))).orderBy("file_id", "line", "place").collect()
    assert sum(r["len"] for r in rows if r["file_id"] == 1) == len(code.encode()) and [r["kind"] for r in rows if r["file_id"] == 2] == ["Plain"] and not [r for r in rows if r["file_id"] > 2]


def test_symbols_of_a_line(spark):
    code = {"Rust": "fn f() {}\npub fn b() {}\nstruct A; enum B {}\n", "JavaScript": "export const go = (x) => x; class K {}\n", "Java": "public class T { private static int n(int a) { return a; } }\n", "C": "int main(void) {\n", "Go": "func (s *S) M() {}\ntype T struct {}\n"}
    rows = spark.createDataFrame([(lang, lang, c) for lang, c in code.items()] + [("x", "Rust", None)], "path string, language string, content string")
    found = {(r["path"], r["name"], r["kind"], r["line"], r["column"]) for r in extract_symbols(rows).collect()}
    assert found == {
        ("Rust", "f", "Function", 1, 3), ("Rust", "b", "Function", 2, 7), ("Rust", "A", "Struct", 3, 7), ("Rust", "B", "Enum", 3, 15), ("JavaScript", "go", "Function", 1, 13), ("JavaScript", "K", "Class", 1, 34),
        ("Java", "T", "Class", 1, 13), ("Java", "n", "Method", 1, 36), ("C", "main", "Function", 1, 4), ("Go", "M", "Method", 1, 12), ("Go", "T", "Type", 2, 5),
    }


def test_varints():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**35 - 1, 2**35, 2**52, 2**53 + 1, 2**62 + 5, 2**63 - 1], np.uint64)
    data = postings.varints(numbers)
    assert postings.from_varints(data).tolist() == numbers.tolist() and postings.from_varints(data[:-1]).tolist() == numbers[:-1].tolist()
    assert postings.from_varints(b"").tolist() == [] and postings.from_varints(b"\xff" * 12 + b"\x01").tolist() == []


def test_small_formats(spark):
    assert text.relative_path("src/a/x.rs", "src/b") == "../a/x.rs" and text.relative_path("x", "") == "x"
    row = spark.range(1).select(text.approximate_duration(F.lit(30)), text.approximate_duration(F.lit(900)), text.approximate_duration(F.lit(3600)), text.approximate_duration(F.lit(200_000))).first()
    assert list(row) == ["30 seconds", "15 minutes", "1 hour", "2 days"]
    assert Engine(None).explain('lang:rust "a b" NOT c').startswith('query: lang:Rust "a b" NOT c')


def test_runs_of_lines_at_once():
    """Runs of all lines equal those of each line; offsets are in bytes."""
    rng, kinds = np.random.default_rng(3), lambda n, spans: highlights.painted(n, spans)
    for text in ("", "\n", "a", "\n\nab\n", "fn é() {\n  \U0001f600 x\n}", "x" * 200_000 + "\ny"):
        raw = text.encode()
        spans = [(int(a), int(a) + 5, int(k)) for a, k in zip(rng.integers(0, max(1, len(raw)), 9), rng.integers(1, 5, 9), strict=True)]
        lines = raw.split(b"\n")[: -1 if raw.endswith(b"\n") else None]
        at, expected, painted = 0, [], kinds(len(raw), spans)
        for line in lines:
            end = min(len(raw), at + len(line) + 1)
            expected.append(highlights.encode_runs(highlights.runs_of(painted[at:end])))
            at = end
        assert highlights.line_runs(text, spans) == expected
    assert highlights.spans_of('é\U0001f600 = "ࠀ"', "Python")[-1][1] == len('é\U0001f600 = "ࠀ"'.encode())
