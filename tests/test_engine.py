import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.functions import text
from lodestone.operators import postings
from lodestone.operators.search import Engine, with_context
from lodestone.plans.prune import required
from lodestone.plans.query import And, Literal, Not, Or, QueryError, parse, show
from lodestone.sources.symbols import extract_symbols

FILES = [
    ("src/main.rs", "use x;\n\nfn main() {\n    let a = Config::new();\n}\nfn helper() {}\n", "Rust"),
    ("src/util.py", "import os\n\ndef process(x):\n    return x\n\nclass Thing:\n    def run(self):\n        pass\n", "Python"),
    ("README.md", "# Title\nThe println here, aaaa.\r\nÉtude HttpRequest\n", "Markdown"),
]


@pytest.fixture
def files(spark):
    rows = [(0, i, p, c, lang, len(c.encode()), c.count("\n"), 1_700_000_000) for i, (p, c, lang) in enumerate(FILES)]
    return spark.createDataFrame(rows, "segment_id long, file_id long, path string, content string, language string, size_bytes long, line_count long, mtime long")


def test_parse_shapes():
    assert parse("a b OR c d") == Or((And((Literal("a"), Literal("b"))), And((Literal("c"), Literal("d")))))
    assert parse("NOT NOT foo") == Not(Not(Literal("foo")))
    assert parse("case:yes A b") == And((Literal("A", True), Literal("b")))
    assert parse("ORacle") == Literal("ORacle")
    assert show(parse('path:src/ "a b" /x+/')) == 'path:src/ "a b" /x+/'


@pytest.mark.parametrize("bad", ["", "  ", '"open', "/open", "/(/", "path:", "lang:nonsense", "a OR", "NOT"])
def test_parse_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


@pytest.mark.parametrize(("query", "paths"), [
    ("fn", {"src/main.rs"}), ("FN MAIN", {"src/main.rs"}), (r"/def \w+/", {"src/util.py"}), ("path:src/ config OR lang:py", {"src/main.rs", "src/util.py"}), ("NOT path:src/", {"README.md"}),
    (r"/Http(Request|Response)/", {"README.md"}), ("case:yes println NOT eprintln", {"README.md"}), ("étude", set()), ("case:yes Étude", {"README.md"}), ('""', {"src/main.rs", "src/util.py", "README.md"}), ("/^import/", {"src/util.py"}), (r"/pass\n$/", {"src/util.py"}),
])
def test_scan_and_index_agree(files, query, paths):
    index = postings.build(files)
    found = lambda e: {r["path"] for r in e.matches(query).collect()}
    assert found(Engine(files)) == found(Engine(files, index)) == found(Engine(files, index, postings.statistics(index))) == paths


def test_lines_ranges_context(files):
    row = Engine(files).search("case:yes aa").first()
    assert [(x["line_number"], x["content"], x["ranges"]) for x in row["lines"]] == [(2, "The println here, aaaa.", 3)]
    assert Engine(files).search("aa").first()["match_count"] == 2
    rows = with_context(Engine(files).search("path:src/main.rs fn"), files, 1).orderBy("line_number").collect()
    assert [(r["line_number"], r["is_match"]) for r in rows] == [(2, False), (3, True), (4, False), (5, False), (6, True)]


def test_pages_and_slices(files):
    page, stats = Engine(files, now=1_700_000_000).page("e", 1, 2)
    assert page.count() == 2 and stats["files_matched"] == 3 and stats["has_next"]
    assert [r["content"] for r in Engine(files).slice("src/main.rs", 3, 4).collect()] == ["fn main() {", "    let a = Config::new();"]


def test_required_is_sound():
    assert required(parse("/colou?r/")) == [frozenset(text.trigrams_of("colo"))]
    assert required(parse("/a|b/")) is None and required(parse("ab")) is None
    assert len(required(parse("/Http(Request|Response)/"))) == 2
    assert required(parse("/(?i)tasks/")) is None and required(parse("/(?i)monad/")) == [frozenset(text.trigrams_of("monad"))]  # k and s fold beyond ASCII
    assert required(parse("/x(abc){0,2}y/")) is None and required(parse("/[abc][d]efg/")) == [frozenset(text.trigrams_of("efg"))]


def test_binary_and_language(spark):
    rows = spark.createDataFrame([("a/x.PNG", b"x"), ("b.rs", b"a\0b"), ("Dockerfile.dev", b"ok"), (".hidden", b"ok")], "path string, content binary")
    out = rows.select(text.indexable(F.col("path"), F.col("content"), F.octet_length("content")), text.language_of(F.col("path"))).collect()
    assert [r[0] for r in out] == [False, False, True, True] and [r[1] for r in out] == ["Unknown", "Rust", "Dockerfile", "Unknown"]


def test_symbols(files):
    found = {(r["name"], r["kind"], r["line"]) for r in extract_symbols(files).collect()}
    assert {("main", "Function", 3), ("process", "Function", 3), ("Thing", "Class", 6), ("run", "Function", 7)} <= found


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sinks(spark, files):
    import json

    from lodestone.operators.search import json_lines, vimgrep

    found = Engine(files).search("/fn [a-z]+/")
    rows = [json.loads(r["value"]) for r in json_lines(found).collect()]
    assert rows and all(r["lines"] and r["match_count"] >= 1 for r in rows)
    assert all(len(r["text"].split(":", 3)) == 4 and int(r["text"].split(":")[2]) >= 1 for r in vimgrep(found, "/fn [a-z]+/").collect())
