"""Requests, tools, resources and HTTP over a stored index."""

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import Store
from lodestone.service import Service
from test_engine import files  # noqa: F401


@pytest.fixture
def service(spark, files, tmp_path):  # noqa: F811
    store = Store(spark, f"file://{tmp_path}/index")
    store.add(files)
    return Service({"demo": store}, lambda name: files.withColumn("content", F.concat("content", F.lit("added\n"))), 1_700_000_000)


def _ask(service, type_, **request):
    return list(service.frames({"type": type_, **request}))


def test_requests(service):
    assert _ask(service, "ping") == [("pong", "{}"), ("done", "{}")]
    assert [d for e, d in _ask(service, "search", query="fn main", cwd="src") if e == "line"] == ["main.rs:3:1:fn main() {"]
    assert [d for e, d in _ask(service, "search", query="FN MAIN") if e == "line"] == []  # smart case
    assert len([d for e, d in _ask(service, "search", query="FN MAIN", case="insensitive") if e == "line"]) == 1
    assert [d.split(":")[0] for e, d in _ask(service, "search", query=r"def \w+", regex=True, language="py") if e == "line"] == ["src/util.py"] * 2
    events = _ask(service, "json_search", query="fn", per_page=1, context=1)
    found = json.loads(events[0][1])
    assert [e for e, _ in events] == ["result", "stats", "done"] and found["path"] == "src/main.rs" and [x["line_number"] for x in found["blocks"][0]] == [2, 3, 4, 5, 6]
    assert json.loads(events[1][1])["files_matched"] == 1
    assert [json.loads(d)["path"] for e, d in _ask(service, "files", language="markdown") if e == "result"] == ["README.md"]
    assert [json.loads(d)["content"] for e, d in _ask(service, "get_file", path="src/main.rs", first=3, last=3) if e == "result"] == ["fn main() {"]
    assert {json.loads(d)["name"] for e, d in _ask(service, "symbols", kind="fn") if e == "result"} >= {"main", "helper"}
    assert json.loads(_ask(service, "status")[0][1])["live_files"] == 3 and json.loads(_ask(service, "health")[0][1])["status"] == "ok"
    assert _ask(service, "search", query="x", repo="none")[0][0] == _ask(service, "query_search", query="/(/")[0][0] == _ask(service, "search", query="")[0][0] == "error"
    _ask(service, "shutdown")
    assert service.stopped


def test_tools_and_resources(service):
    assert service.call("ping") == "pong" and service.call("nothing").startswith("Error")
    text = service.call("search_code", query="lang:rust fn", context=0)
    assert text.splitlines()[0] == "Found 2 matches across 1 files (showing 1-1)" and "## src/main.rs (Rust, 2 matches)\nL3:* fn main() {\nL6:* fn helper() {}" in text
    assert service.call("search_code", query="fn", context=11).startswith("Error") and service.call("search_code", query="").startswith("Error")
    assert service.call("search_files", query="*.py") == "Found 1 files\nsrc/util.py" and "live_files: 3" in service.call("index_status")
    assert "src/util.py:6 Class Thing" in service.call("search_symbols", query="thing")
    assert service.read("lodestone://demo/tree").split("\n") == ["README.md", "src/main.rs", "src/util.py"] and service.read("lodestone://demo/file/src/util.py").startswith("import os\n")
    assert json.loads(service.read("lodestone://status"))["demo"]["files"] == 3 and "lodestone://demo/tree" in service.resources()
    assert '"changes_applied": 3' in service.call("reindex") and service.call("search_code", query="added").startswith("Found 3 matches across 3 files")


def test_http(service):
    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path, **k: urllib.request.urlopen(urllib.request.Request(base + path, **k), timeout=120).read().decode()
    try:
        assert json.loads(get("/repos")) == {"repos": ["demo"]}
        body = json.loads(get("/demo/search?q=fn+main&per_page=5"))
        assert body["stats"]["files_matched"] == 1 and body["results"][0]["path"] == "src/main.rs"
        events = [x.split("\n")[0] for x in get("/demo/search?q=fn&stream=1").strip().split("\n\n")]
        assert events == ["event: result", "event: stats", "event: done"]
        for path, status in (("/demo/search", 400), ("/none/search?q=x", 404), ("/demo/search?q=%2F(%2F", 400), ("/x", 404), ("/demo/refresh", 404)):
            with pytest.raises(urllib.error.HTTPError) as told:
                get(path)
            assert told.value.code == status
        assert json.loads(get("/demo/refresh", method="POST"))["results"][-1]["event"] == "complete"
    finally:
        server.shutdown()
