"""The engine: queries over a table of files, with or without an index of trigrams."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.regex import to_java
from ..functions.tables import KIND_ALIASES, SYMBOL_KINDS, language_named
from ..functions.text import fold, glob_regex, html_escape, lines, quoted, trigrams_of
from ..plans.compile import condition, first_column, matched_lines
from ..plans.prune import required
from ..plans.query import Literal, QueryError, Regex, parse, show, smart_case, with_filters
from . import postings

MAX_CONTEXT, MAX_PER_PAGE = 1000, 100


def newest(files: DataFrame, *extra: str) -> DataFrame:
    """The row of each path with the highest segment."""
    place = F.row_number().over(Window.partitionBy("path", *extra).orderBy(F.col("segment_id").desc(), F.col("file_id").desc()))
    return files.withColumn("_place", place).where("_place = 1").drop("_place")


def live(files: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    return files if tombstones is None else files.join(tombstones.select("segment_id", "file_id"), ["segment_id", "file_id"], "left_anti")


#: Ids of files that may be broadcast: two numbers each, so 16 MB at most.
BROADCAST_IDS = 1_000_000
IDS = ["segment_id", "file_id"]


def restricted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with those ids. Ids are narrow; few of them come to the rows, so that no content is shuffled."""
    ids = ids.select(*IDS)
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, IDS, "left_semi")


class Engine:
    """files: segment_id, file_id, path, content, language, size_bytes, line_count, mtime.  postings and statistics are
    optional; without them a query scans, with them it reads the content of candidates only.  live: the ids of the entries
    to see, where files holds dead ones and older versions too; they are decided on before any content is read."""

    def __init__(self, files: DataFrame, index: DataFrame | None = None, statistics: DataFrame | None = None, now: int = 0, live: DataFrame | None = None) -> None:
        self.all_files, self.index, self.statistics, self.now, self.live = files, index, statistics, now, live

    def live_files(self) -> DataFrame:
        """The files to see. Where most are, the few others are taken away."""
        if self.live is None:
            return self.all_files
        ids = self.live.select(*IDS)
        gone = self.all_files.select(*IDS).join(ids, IDS, "left_anti")
        if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            return self.all_files.join(F.broadcast(gone), IDS, "left_anti")
        return restricted(self.all_files, ids)

    @property
    def files(self) -> DataFrame:
        return self.live_files()

    def _tree(self, query):
        return parse(query) if isinstance(query, str) else query

    def candidates(self, query) -> DataFrame | None:
        """(segment_id, file_id) of the live files that may match, from the index alone; None if it cannot tell."""
        branches = required(self._tree(query)) if self.index is not None else None
        if branches is None:
            return None
        found = postings.candidates(self.index, branches, self.statistics)
        return found if self.live is None else found.join(self.live.select(*IDS), IDS, "left_semi")

    def matches(self, query) -> DataFrame:
        """Files that satisfy a query."""
        tree = self._tree(query)
        found = self.candidates(tree)
        if found is None:
            rows = self.live_files()
        elif self.live is None:
            rows = self.all_files.join(found, IDS, "left_semi")
        else:
            rows = restricted(self.all_files, found)
        return rows.where(condition(tree, F.col("content"), F.col("path"), F.col("language")))

    def search(self, query, match_type: str = "substring", glob: str | None = None, context: int | None = None) -> DataFrame:
        """Matching files with their lines, match_count and score, unordered; with `context` also `blocks`, the lines around
        matches: an array of blocks, each an array of (line_number, content, is_match)."""
        tree = self._tree(query)
        rows = self.matches(tree)
        if glob:
            rows = rows.where(F.col("path").rlike(glob_regex(glob)))
        found = matched_lines(tree, F.col("content"), F.col("path"), F.col("language"))
        rows = rows.withColumn("lines", found)
        total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["ranges"])
        rows = rows.withColumn("match_count", F.greatest(total, F.lit(1)).cast("long"))
        score = ranking.score(F.col("path"), F.col("match_count"), F.col("line_count"), F.col("mtime"), self.now, "", match_type)
        blocks = [] if context is None else [blocks_of(F.col("lines.line_number"), F.col("content"), context).alias("blocks")]
        return rows.select("segment_id", "file_id", "path", "language", "line_count", "lines", "match_count", score.alias("score"), *blocks)

    def filtered(self, query, languages: tuple[str, ...] = (), path: str | None = None, **options) -> DataFrame:
        """search, restricted to languages (by any name) and to a path prefix."""
        return self.search(with_filters(self._tree(query), tuple(map(language_named, languages)), path), **options)

    def pattern(self, text: str, regex: bool = False, case: bool | None = None, glob: str | None = None) -> DataFrame:
        """Search for one literal (smart case unless `case` is given) or regular expression."""
        sensitive = smart_case(text) if case is None else case
        return self.search(Regex(text if sensitive else f"(?i){text}") if regex else Literal(text, sensitive), "regex" if regex else "substring", glob)

    @staticmethod
    def top(results: DataFrame, limit: int, offset: int = 0) -> DataFrame:
        """The best results: score, then path."""
        return results.orderBy(F.col("score").desc(), "path").offset(offset).limit(limit)

    def with_options(self, query, context: int = 0, limit: int | None = None, offset: int = 0, **options) -> DataFrame:
        """search with lines around matches, in order, from an offset on and up to a limit."""
        results = self.search(query, context=context, **options)
        return self.top(results, limit if limit is not None else (1 << 31) - 1, offset)

    def stream(self, query, limit: int | None = None) -> Iterator[Row]:
        """Results as they are found, the newest segment first and unordered within it.  Segments are read in groups, each of
        twice as many as the one before, so that the first results come soon and many segments are few jobs; a group is read
        when the ones before it are used up, and none after the limit."""
        tree, left, done = self._tree(query), limit, 0
        segments = [r["segment_id"] for r in self.all_files.select("segment_id").distinct().orderBy(F.col("segment_id").desc()).toLocalIterator()]
        while done < len(segments) and (left is None or left > 0):
            group = segments[done : 2 * done + 1]
            done += len(group)
            own = F.col("segment_id").between(group[-1], group[0])
            part = Engine(self.all_files.where(own), None if self.index is None else self.index.where(own), None, self.now, None if self.live is None else self.live.where(own))
            found = part.search(tree)
            if len(group) > 1:
                found = found.persist()  # else a sort makes its input twice
            try:
                rows = found.orderBy(F.col("segment_id").desc()) if len(group) > 1 else found
                for row in (rows if left is None else rows.limit(left)).toLocalIterator():
                    yield row
                    left = None if left is None else left - 1
            finally:
                found.unpersist()

    def page(self, query, page: int = 1, per_page: int = 20, context: int | None = None, glob: str | None = None) -> tuple[DataFrame, dict]:
        """A page of results and exact totals; the search of all files runs once."""
        per_page, page = max(1, min(per_page, MAX_PER_PAGE)), max(1, page)
        narrow = self.search(query, glob=glob).select(*IDS, "path", "score", F.size("lines").alias("n")).persist()
        try:
            total = narrow.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).first()
            best = self.top(narrow, per_page, (page - 1) * per_page).select(*IDS).collect()  # a page
        finally:
            narrow.unpersist()
        pages = -(-total["files"] // per_page)
        wanted = self.all_files.sparkSession.createDataFrame([tuple(r) for r in best], "segment_id long, file_id long")
        rows = Engine(self.all_files.join(F.broadcast(wanted), IDS, "left_semi"), now=self.now).search(query, context=context)
        return self.top(rows, per_page), {"total_matches": total["lines"], "files_matched": total["files"], "page": page, "per_page": per_page, "total_pages": pages, "has_next": page < pages}

    def explain(self, query) -> str:
        tree = self._tree(query)
        branches = required(tree)
        return f"query: {show(tree)}\nindex: " + ("full scan" if branches is None or self.index is None else " or ".join(f"{len(b)} trigrams" for b in branches)) + "\nverify: on content"

    def slice(self, path: str, first: int = 1, last: int | None = None) -> DataFrame:
        """Lines first to last of the newest version of a path: line_number, content."""
        rows = newest(self.files.where(F.col("path") == path)).select(F.posexplode(lines(F.col("content"))).alias("i", "content"))
        rows = rows.select((F.col("i") + 1).alias("line_number"), "content").where(F.col("line_number") >= max(1, first))
        return rows.where(F.col("line_number") <= last) if last is not None else rows

    def preview(self, path: str, line: int, context: int = 20) -> DataFrame:
        """A window of 2 * context + 1 lines around a line of the newest version of a path."""
        context = min(context, MAX_CONTEXT)
        return self.slice(path, max(1, line - context), max(line, 1) + context)

    def list_files(self, name: str | None = None, language: str | None = None, sort: str = "path", limit: int | None = None) -> DataFrame:
        rows = newest(self.files)
        if name:
            own = F.element_at(F.split("path", "/"), -1)
            rows = rows.where(own.rlike(glob_regex(name)) if any(c in name for c in "*?[{") else fold(F.col("path")).contains(name.lower()))
        if language:
            rows = rows.where(F.col("language") == language_named(language))
        order = {"path": [F.col("path")], "modified": [F.col("mtime").desc(), F.col("path")], "size": [F.col("size_bytes").desc(), F.col("path")]}[sort]
        rows = rows.orderBy(*order).select("path", "language", "size_bytes", "mtime")
        return rows.limit(limit) if limit is not None else rows


def blocks_of(hits: Column, content: Column, context: int) -> Column:
    """array<array<struct<line_number, content, is_match>>>: lines around matching lines (numbers in order).  Matches whose
    context touches share a block (gap of at most 2 * context + 1 lines).  All of a file is in one row: no shuffle."""
    context = min(context, MAX_CONTEXT)
    start = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("done"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    closed = lambda s: F.when(s["lo"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))

    def step(s, at):
        joined = s["hi"].isNotNull() & (at - s["hi"] <= 2 * context + 1)
        return F.struct(F.when(joined, s["done"]).otherwise(closed(s)).alias("done"), F.when(joined, s["lo"]).otherwise(at).alias("lo"), at.alias("hi"))

    def block(v, r):
        first = F.greatest(r["lo"] - context, F.lit(1))
        return F.transform(F.slice(v["all"], first, r["hi"] + context - first + 1), lambda x, i: F.struct((first + i).cast("int").alias("line_number"), x.alias("content"), F.array_contains(v["hits"], (first + i).cast("int")).alias("is_match")))

    # Bound as a lambda's variable, lines and matches are made once for all blocks; only lines in blocks are looked at.
    whole = F.array(F.struct(lines(content).alias("all"), F.transform(hits, lambda x: x.cast("int")).alias("hits")))
    return F.flatten(F.transform(whole, lambda v: F.transform(F.aggregate(v["hits"], start, step, closed), lambda r: block(v, r))))


def with_context(results: DataFrame, files: DataFrame | None = None, context: int = 0) -> DataFrame:
    """Lines to show around matches, in blocks: path, block, line_number, content, is_match; from `blocks` in results, or
    from the content in files."""
    if "blocks" not in results.columns:
        joined = results.select(*IDS, "path", "lines").join(files.select(*IDS, "content"), IDS)
        results = joined.select("path", blocks_of(F.col("lines.line_number"), F.col("content"), context).alias("blocks"))
    rows = results.select("path", F.posexplode("blocks").alias("b", "rows"))
    rows = rows.select("path", (F.col("b") + 1).alias("block"), F.explode("rows").alias("l"))
    return rows.select("path", "block", "l.line_number", "l.content", "l.is_match")


def vimgrep(results: DataFrame, query) -> DataFrame:
    """One row a matching line, as path:line:column:content; the column counts bytes from 1."""
    tree = parse(query) if isinstance(query, str) else query
    rows = results.select("path", F.explode("lines").alias("l")).select("path", "l.line_number", "l.content")
    return rows.select(F.concat_ws(":", "path", F.col("line_number").cast("string"), first_column(tree, F.col("content")).cast("string"), "content").alias("text"))


def text_report(results: DataFrame) -> DataFrame:
    """One row a file: a heading with path, language and number of matching lines, and the lines; those that match have a
    star.  With `blocks` in results the lines around matches are shown too."""
    heading = F.concat(F.lit("## "), "path", F.lit(" ("), "language", F.lit(", "), F.size("lines").cast("string"), F.lit(" matches)"))
    line = lambda number, star, content: F.concat(F.lit("L"), number.cast("string"), star, content)
    if "blocks" in results.columns:
        shown = F.transform(F.flatten("blocks"), lambda x: line(x["line_number"], F.when(x["is_match"], ":* ").otherwise(":  "), x["content"]))
    else:
        shown = F.transform("lines", lambda x: line(x["line_number"], F.lit(":* "), x["content"]))
    return results.select("path", F.concat_ws("\n", heading, F.array_join(shown, "\n")).alias("text"))


def report_heading(totals: DataFrame, shown: int, offset: int = 0) -> DataFrame:
    """One row from (lines, files): the summary above a report of `shown` files from `offset` on, with a hint if there are
    many."""
    found = F.concat(F.lit("Found "), F.col("lines").cast("string"), F.lit(" matches across "), F.col("files").cast("string"), F.lit(f" files (showing {offset + 1}-{offset + shown}"))
    part = F.when((F.col("files") > shown) | F.lit(offset > 0), F.lit(f", offset={offset})")).otherwise(F.lit(")"))
    hint = F.when(F.col("files") > 100, F.lit("\nTip: Consider narrowing with path:, language:, or a more specific query.")).otherwise(F.lit(""))
    return totals.select(F.concat(found, part, hint).alias("text"))


def marked(results: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """One row a matching line, as HTML with what matches in mark elements: path, line_number, html.  The raw line is cut
    at the matches first, and each piece is escaped, so nothing is marked inside an entity."""
    rows = results.select("path", F.explode("lines").alias("l")).select("path", "l.line_number", "l.content")
    java = to_java(pattern) if regex else quoted(pattern)
    between, found = F.split("content", java, -1), F.regexp_extract_all("content", F.lit(f"({java})"), 1)
    mark = F.transform(found, lambda m: F.concat(F.lit("<mark>"), html_escape(m), F.lit("</mark>")))
    html = F.array_join(F.transform(between, lambda x, i: F.concat(html_escape(x), F.coalesce(F.get(mark, i), F.lit("")))), "")
    return rows.select("path", "line_number", html.alias("html"))


def json_lines(results: DataFrame) -> DataFrame:
    """One row a file, as a JSON object."""
    return results.select(F.to_json(F.struct("path", "language", "match_count", "score", "lines")).alias("value"))


def frames(results: DataFrame) -> DataFrame:
    """(turn, event, data): result frames in order of score, one of totals, and the last one, as a server sends them."""
    ranked = results.select("score", "path", F.to_json(F.struct(F.lit("result").alias("type"), "path", "language", "match_count", "score", "lines")).alias("data"))
    rows = ranked.select(F.struct((-F.col("score")).alias("a"), F.col("path").alias("b")).alias("turn"), F.lit("result").alias("event"), "data")
    after = lambda n: F.struct(F.lit(float(n)).alias("a"), F.lit("").alias("b")).alias("turn")
    stats = results.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("total_matches"), F.count("*").alias("files_matched"))
    stats = stats.select(after(1), F.lit("stats").alias("event"), F.to_json(F.struct(F.lit("stats").alias("type"), "total_matches", "files_matched")).alias("data"))
    done = results.sparkSession.range(1).select(after(2), F.lit("done").alias("event"), F.lit("{}").alias("data"))
    return rows.unionByName(stats).unionByName(done)


def served(engine: Engine, query: str, page: int = 1, per_page: int = 20) -> Iterator[tuple[str, str]]:
    """(event, data) of a request: results of a page, totals and the end; a bad query is one error."""
    try:
        rows, stats = engine.page(query, page, per_page)
    except QueryError as error:
        yield "error", str(error)
        return
    for row in json_lines(rows).toLocalIterator():
        yield "result", row["value"]
    yield "stats", json.dumps(stats)
    yield "done", "{}"


def search_symbols(symbols: DataFrame, query: str = "", kind: str | None = None, language: str | None = None, path: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Symbols whose folded name contains the query: exact names, then prefixes, then the others.  Of the same name on the
    same line of a path in several segments the newest segment's stays."""
    folded = "".join(c.lower() if c.isascii() else c for c in query)
    rows = symbols.where(fold(F.col("name")).contains(folded))
    if kind:
        rows = rows.where(F.col("kind") == KIND_ALIASES[kind.lower()])
    if language:
        rows = rows.where(F.col("language") == language_named(language))
    if path:
        rows = rows.where(F.col("path").contains(path))
    rows = rows.withColumn("score", ranking.symbol_score(F.col("name"), query, fold))
    if "segment_id" in rows.columns:
        rest = [c for c in rows.columns if c not in ("path", "name", "line")]
        kept = F.max_by(F.struct(*rest), F.struct("segment_id", "file_id")).alias("kept")
        rows = rows.groupBy("path", "name", "line").agg(kept).select("path", "name", "line", "kept.*")
    return rows.orderBy(F.col("score").desc(), "name", "path", "line").offset(offset).limit(limit)


def indexed_symbols(symbols: DataFrame, index: DataFrame, query: str, keys: tuple[str, ...] = ("path", "name", "line"), **filters) -> DataFrame:
    """search_symbols by way of an index of trigrams over names (postings.build with these keys); names too short for a
    trigram are scanned."""
    grams = trigrams_of(query)
    if not grams:
        return search_symbols(symbols, query, **filters)
    hits = index.where(F.col("trigram").isin(grams)).groupBy(*keys).agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams))
    return search_symbols(symbols.join(hits.drop("n"), list(keys), "left_semi"), query, **filters)


def symbols_with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path, language, size and time of their files' entries."""
    own = files.select(*IDS, "path", "language", "size_bytes", "mtime")
    return symbols.drop("path", "language").join(own, IDS)


def kind_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (label, _) in SYMBOL_KINDS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out
