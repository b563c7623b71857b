"""Requests to indexes, as a daemon, an assistant's tools and a web server take them.

`Service.frames` answers a request with (event, data) pairs as they come; `call` answers an assistant's tool with text;
`read` gives a resource; `handler` serves the same over HTTP, streams as server-sent events.  Results are pages, so what
comes to the driver is bounded by what is asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.tables import language_named
from .functions.text import relative_path
from .operators.search import Engine, report_heading, search_symbols, text_report, vimgrep
from .operators.store import Store
from .plans.query import Literal, QueryError, Regex, parse, smart_case, with_filters
from .streaming.changes import catch_up

MAX_RESULTS, DEFAULT_SYMBOLS, TOOL_SYMBOLS = 500, 100, 20
TOOLS = ("ping", "search_code", "search_files", "index_status", "reindex", "search_symbols")


class Service:
    """One index by name: its store, and how to see the files it should hold (None: it cannot be brought up to date)."""

    def __init__(self, stores: dict[str, Store], present: Callable[[str], DataFrame] | None = None, now: int = 0) -> None:
        self.stores, self.present, self.now, self.stopped = stores, present, now, False

    def store(self, name: str | None = None) -> Store:
        if name is None and len(self.stores) == 1:
            return next(iter(self.stores.values()))
        if name not in self.stores:
            raise KeyError(f"no index named {name}")
        return self.stores[name]

    def _engine(self, name: str | None) -> Engine:
        return self.store(name).engine(self.now)

    @staticmethod
    def _tree(request: dict):
        """The tree of a search: a pattern or a query, with filters."""
        text = request.get("query") or ""
        if request["type"] == "search":
            case = {"sensitive": True, "insensitive": False}.get(request.get("case", "smart"), smart_case(text))
            if request.get("regex"):
                tree = parse(f"/{'' if case else '(?i)'}{text.replace('/', chr(92) + '/')}/")
            elif text:
                tree = Literal(text, case)
            else:
                raise QueryError("empty query")
        else:
            tree = parse(text)
        languages = tuple(language_named(x) for x in ([request["language"]] if request.get("language") else []))
        return with_filters(tree, languages, request.get("path"))

    def frames(self, request: dict) -> Iterator[tuple[str, str]]:
        """(event, data) of a request: `line`, `result`, `stats`, `progress`, `pong`; at the end `done` or `error`."""
        try:
            yield from getattr(self, "_" + request["type"])(request)
        except (QueryError, KeyError, ValueError, FileNotFoundError) as error:
            yield "error", str(error.args[0] if error.args else error)
            return
        yield "done", "{}"

    def _ping(self, request: dict) -> Iterator[tuple[str, str]]:
        yield "pong", "{}"

    def _shutdown(self, request: dict) -> Iterator[tuple[str, str]]:
        self.stopped = True
        return iter(())

    def _search(self, request: dict) -> Iterator[tuple[str, str]]:
        """Lines as path:line:column:content, the best files first; with a path of the reader, relative to it."""
        tree = self._tree(request)
        rows = self._engine(request.get("repo")).search(tree, "regex" if isinstance(tree, Regex) else "substring", request.get("glob"))
        for row in vimgrep(Engine.top(rows, min(int(request.get("limit", 100)), MAX_RESULTS)), tree).toLocalIterator():
            path, rest = row["text"].split(":", 1)
            yield "line", f"{relative_path(path, request.get('cwd') or '')}:{rest}"

    _query_search = _search

    def _json_search(self, request: dict) -> Iterator[tuple[str, str]]:
        tree = self._tree(request)
        engine = self._engine(request.get("repo"))
        rows, stats = engine.page(tree, int(request.get("page", 1)), int(request.get("per_page", 20)), int(request.get("context", 2)), request.get("glob"))
        for row in rows.select(F.to_json(F.struct("path", "language", "match_count", "score", "lines", "blocks")).alias("value")).toLocalIterator():
            yield "result", row["value"]
        yield "stats", json.dumps(stats)

    def _files(self, request: dict) -> Iterator[tuple[str, str]]:
        rows = self._engine(request.get("repo")).list_files(request.get("name"), request.get("language"), request.get("sort", "path"), min(int(request.get("limit", MAX_RESULTS)), MAX_RESULTS))
        for row in rows.toLocalIterator():
            yield "result", json.dumps(row.asDict())

    def _get_file(self, request: dict) -> Iterator[tuple[str, str]]:
        rows = self._engine(request.get("repo")).slice(request["path"], int(request.get("first", 1)), request.get("last")).orderBy("line_number")
        for row in rows.toLocalIterator():
            yield "result", json.dumps(row.asDict())

    def _symbols(self, request: dict) -> Iterator[tuple[str, str]]:
        limit = min(int(request.get("limit", DEFAULT_SYMBOLS)), MAX_RESULTS)
        rows = search_symbols(self.store(request.get("repo")).symbols(), request.get("query") or "", request.get("kind"), request.get("language"), request.get("path"), limit, int(request.get("offset", 0)))
        for row in rows.select("name", "kind", "path", "line", "column", "score").toLocalIterator():
            yield "result", json.dumps(row.asDict())

    _json_symbols = _symbols

    def _status(self, request: dict) -> Iterator[tuple[str, str]]:
        store = self.store(request.get("repo"))
        yield "result", json.dumps({**store.status(), "checkpoint": store.checkpoint()})

    def _health(self, request: dict) -> Iterator[tuple[str, str]]:
        yield "result", json.dumps({"status": "ok", "indexes": sorted(self.stores), "stopped": self.stopped})

    def _reindex(self, request: dict) -> Iterator[tuple[str, str]]:
        if self.present is None:
            raise ValueError("there is nothing to index from")
        events: list[dict] = []
        name = request.get("repo") or next(iter(self.stores))
        catch_up(self.store(name), self.present(name), request.get("git"), self.now, events.append, bool(request.get("compact")))
        for event in events:
            yield "progress", json.dumps(event)

    def call(self, tool: str, **arguments) -> str:
        """The text of an assistant's tool; a bad request is a line that says why."""
        if tool not in TOOLS:
            return f"Error: no tool named {tool}"
        try:
            return getattr(self, "_tool_" + tool)(arguments)
        except (QueryError, KeyError, ValueError, FileNotFoundError) as error:
            return f"Error: {error.args[0] if error.args else error}"

    def _tool_ping(self, arguments: dict) -> str:
        return "pong"

    def _tool_search_code(self, arguments: dict) -> str:
        context, limit, offset = (int(arguments.get(k, d)) for k, d in (("context", 2), ("limit", 20), ("offset", 0)))
        if not 0 <= context <= 10 or not 1 <= limit <= 100 or offset < 0:
            raise ValueError("context is 0 to 10, limit 1 to 100, offset 0 or more")
        rows = self._engine(arguments.get("repo")).search(self._tree({"type": "query_search", **arguments}), context=context)
        totals = rows.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines"))
        page = Engine.top(rows, limit, offset)
        sections = [r["text"] for r in text_report(page.select("path", "language", "lines", "blocks")).collect()]  # a page
        return "\n\n".join([report_heading(totals, len(sections), offset).first()["text"], *sections])

    def _tool_search_files(self, arguments: dict) -> str:
        rows = [r["path"] for r in self._engine(arguments.get("repo")).list_files(arguments.get("query"), arguments.get("language"), limit=min(int(arguments.get("limit", 50)), MAX_RESULTS)).collect()]
        return "\n".join([f"Found {len(rows)} files", *rows])

    def _tool_index_status(self, arguments: dict) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.store(arguments.get("repo")).status().items())

    def _tool_reindex(self, arguments: dict) -> str:
        return "\n".join(data for _, data in self._reindex(arguments))

    def _tool_search_symbols(self, arguments: dict) -> str:
        found = [json.loads(data) for _, data in self._symbols({**arguments, "limit": min(int(arguments.get("limit", TOOL_SYMBOLS)), 100)})]
        return "\n".join([f"Found {len(found)} symbols", *(f"{s['path']}:{s['line']} {s['kind']} {s['name']}" for s in found)])

    def resources(self) -> list[str]:
        """The resources there are; {path} stands for any file."""
        return ["lodestone://status", *(f"lodestone://{n}/{kind}" for n in sorted(self.stores) for kind in ("status", "tree", "file/{path}"))]

    def read(self, uri: str) -> str:
        """The text of a resource."""
        name, _, rest = uri.removeprefix("lodestone://").partition("/")
        if name == "status" and not rest:
            return json.dumps({n: s.status() for n, s in self.stores.items()})
        if rest == "status":
            return json.dumps(self.store(name).status())
        if rest == "tree":
            return "\n".join(r["path"] for r in self.store(name).live_ids().select("path").orderBy("path").toLocalIterator())
        if rest.startswith("file/"):
            return "\n".join(r["content"] for r in self._engine(name).slice(unquote(rest[5:])).orderBy("line_number").toLocalIterator())
        raise KeyError(f"no resource {uri}")

    def handler(self) -> type[BaseHTTPRequestHandler]:
        """For http.server: /repos; /health; /NAME/search, /NAME/files, /NAME/symbols, /NAME/file, /NAME/status, and
        /NAME/refresh by POST. With stream=1 the events come as they are made, else one JSON object at the end."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                parts = urlsplit(self.path)
                given = {k: v[-1] for k, v in parse_qs(parts.query).items()}
                names = [unquote(x) for x in parts.path.split("/") if x]
                kinds = {"search": "json_search", "files": "files", "symbols": "json_symbols", "file": "get_file", "status": "status", "refresh": "reindex"}
                if names == ["repos"]:
                    return self.answer(200, {"repos": sorted(service.stores)})
                if names == ["health"]:
                    return self.answer(200, json.loads(next(service._health({}))[1]))
                if len(names) != 2 or names[1] not in kinds or (names[1] == "refresh") != (self.command == "POST"):
                    return self.answer(404, {"error": "not found"})
                if names[0] not in service.stores:
                    return self.answer(404, {"error": f"no index named {names[0]}"})
                request = {**given, "type": kinds[names[1]], "repo": names[0], "query": given.get("q") or given.get("query"), "last": int(given["last"]) if "last" in given else None}
                if names[1] == "search" and not request["query"]:
                    return self.answer(400, {"error": "missing or empty query 'q'"})
                if given.get("stream"):
                    return self.stream(request)
                events = list(service.frames(request))
                if events[-1][0] == "error":
                    return self.answer(400, {"error": events[-1][1]})
                body = {"results": [json.loads(d) for e, d in events if e in ("result", "progress")]}
                self.answer(200, body | {e: json.loads(d) for e, d in events if e == "stats"})
                return None

            do_POST = do_GET

            def answer(self, status: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def stream(self, request: dict) -> None:
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                for event, data in service.frames(request):
                    self.wfile.write(f"event: {event}\ndata: {data}\n\n".encode())
                    self.wfile.flush()

            def log_message(self, *arguments) -> None:
                """Requests are not logged."""

        return Handler

