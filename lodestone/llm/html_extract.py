"""Main text of web pages: page structure, and a suffix array over the pages of a host for what structure leaves open.

A page is parsed into blocks.  Scripts, styles, menus, forms, footers, sidebars and hidden elements are known by their
elements, roles and states, and some kinds of blocks by a whole class or id that has one meaning (`SURE`: reader comments,
adverts, share buttons).  An article or main element is a container of the main text, unless it stands inside one of
these.  Text inside a container is kept.  Where only a word of a class or id speaks against a block (`MARKED`), it is
suspect, and the host decides: the token streams of all that is suspect or lies outside containers are joined for the
pages of a host, and a suffix array with its longest common prefixes finds substrings of at least RUN tokens that stand on
at least PAGES distinct pages.  The tokens they cover, and shorter suspect blocks that are repeated whole on so many
pages, are removed; unique runs of any length are kept.  On pages without a container the same is done with all text
that no element marks.

A host's distinct streams are dealt over shards of about SHARD by a hash of their text, so that a host of any size is
spread over tasks.  Each shard has a suffix array; it says on how many distinct pages of the shard each substring of RUN
tokens stands, the shards' numbers are added up by the substring's hash, and those that reach PAGES in the host go back
to the shards that hold them.  So a host of many shards has the result of one.  Only suspect text and text outside
containers is shuffled; rows of a page that is repeated stay where they are when the decisions come back.

Cases: a null or empty page, and one without text, gives an empty text; a page whose url has no host belongs to the
empty host; rows that repeat are pages of their own, except that copies of one page do not make its text boilerplate;
unclosed elements end where HTML ends them (paragraphs, list items, cells) or with the element around them; pages of any
length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, ids_of, materialize, small_or_shuffled, splitmix, spread_join

RUN, PAGES, SHARD = 8, 3, 512

#: Elements whose text is no text of the page, and elements that stand around the main text.
DROPPED = frozenset("script style noscript template head title iframe object embed svg canvas video audio map".split())
CHROME = frozenset("nav aside footer form button select option textarea dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
CONTAINERS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening element ends if it is still open: elements whose end tags may be left out.
_CELLS = frozenset(("td", "th"))
ENDS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"}, "option": frozenset(("option",))}
#: Words of a class or id that make a block suspect.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments "
    "respond reply replies share sharing social related recommended newsletter subscribe footer header masthead toolbar widget pagination pager login signup".split()
)
#: Whole classes and ids that mean one thing.
SURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comment comments comment-list commentlist comments-area comments-section comment-section comment-form disqus_thread respond cookie-notice cookie-banner "
    "cookie-consent newsletter-signup share-buttons social-share related-posts related-articles sidebar breadcrumb breadcrumbs pagination navbar".split()
)
CONTAINER_NAMES = frozenset(("post-content", "entry-content", "article-body", "article-content", "post-body", "story-body"))
_PARTS, _HIDDEN = re.compile(r"[a-z]+"), re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class PageBlocks(HTMLParser):
    """Blocks of a page: (kind, text). Kinds: "main" and, where a container's block is marked, "suspect"; outside
    containers "open" and "marked"; "chrome" by element, role or whole name.  A "form" is chrome too, but as it may be put
    around a whole page, a container counts inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str]] = []  # (tag, state around it)
        self.state, self.parts, self.has_container = "open", [], False

    def _close(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and self.state != "out":
                self.blocks.append((self.state, text))
            self.parts = []

    def _leave(self, k: int) -> None:
        self._close()
        self.state = self.stack[k][1]
        del self.stack[k:]

    def _end_open(self, tag: str) -> None:
        """Ends what an opening block element ends."""
        ended = ENDS.get(tag, ())
        for k in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[k][0]
            if open_tag == "p" or open_tag in ended:
                self._leave(k)
                if open_tag != "p":
                    return
            elif open_tag not in INLINE and not (tag == "tr" and open_tag in _CELLS):
                return

    def _state_in(self, tag: str, attrs: list) -> str:
        """The state inside an element that opens now."""
        state = self.state
        if state in ("out", "chrome"):
            return "out" if state == "out" or tag in DROPPED else state
        given = {k: (v or "") for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        if tag in DROPPED or "hidden" in given or given.get("aria-hidden") == "true" or ("style" in given and _HIDDEN.search(given["style"].lower())):
            return "out"
        whole = set(given.get("class", "").lower().split()) | {given.get("id", "").lower()}
        inside = state in ("main", "suspect")
        if whole & SURE or given.get("role") in ROLES - {"form"} or tag in CHROME or (tag == "header" and not inside):
            return "form" if tag == "form" and not inside else "chrome"
        if not inside and (tag in CONTAINERS or whole & CONTAINER_NAMES or given.get("role") in CONTAINERS):
            self.has_container = True
            return "main"
        if state in ("suspect", "form") or tag in ("body", "html", "header") or (inside and tag in CONTAINERS):
            return state
        if MARKED.isdisjoint(_PARTS.findall(f"{given.get('class', '')} {given.get('id', '')}".lower())):
            return state
        return "suspect" if inside else "marked"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self.parts.append("\n") if tag == "br" else self._close()
            return
        if tag not in INLINE:
            self._close()
            self._end_open(tag)
        state = self._state_in(tag, attrs) if attrs or tag not in INLINE else self.state
        if state != self.state:
            self._close()
        self.stack.append((tag, self.state))
        self.state = state

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append("\n")
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag not in INLINE or self.stack[k][1] != self.state:
                    self._close()
                self.state = self.stack[k][1]
                del self.stack[k:]
                return
            if self.stack[k][0] in CONTAINERS and tag not in ("body", "html") and tag not in CONTAINERS:
                return  # a stray end tag does not leave the container

    def handle_data(self, data: str) -> None:
        if self.state != "out":
            self.parts.append(data)

    def result(self, html: str) -> list[tuple[str, str]]:
        self.feed(html)
        self.close()
        self._close()
        return self.blocks


def parse(html: str | None) -> tuple[bool, list[tuple[str, str]]]:
    """(whether the page has a container, its blocks)."""
    if not html:
        return False, []
    page = PageBlocks()
    blocks = page.result(html)
    return page.has_container, blocks


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order of the suffixes, ranks of substrings of length 1, 2, 4, ... from each position) by prefix doubling."""
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64)
    ranks, step, n = [rank], 1, len(ids)
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else []
        order = np.lexsort((ahead, rank))
        a, b = rank[order], ahead[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        rank = new
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of each suffix in order with the one before it."""
    n = len(order)
    out = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        length += same * (1 << k)
        a, b = np.minimum(a + same * (1 << k), n), np.minimum(b + same * (1 << k), n)
    out[1:] = length
    return out


def gram_hashes(tokens: list[str], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the `run` tokens from each place of a page on; shorter ends have none."""
    import xxhash

    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = splitmix(out ^ h[k : k + n])
    return out.view(np.int64)


def repeated_runs(pages: list[list[str]], weights: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, distinct pages) of every substring of `run` tokens, from a suffix array over the joined token streams, of
    which each stands for as many distinct pages as its weight says."""
    names: dict[str, int] = {}
    ids, owner, hashes, whole = [], [], [], []
    for p, tokens in enumerate(pages):
        ids += [names.setdefault(t, len(names)) for t in tokens]
        ids.append(-p - 1)  # separators are all different
        owner += [p] * (len(tokens) + 1)
        found = gram_hashes(tokens, run)
        short = len(tokens) + 1 - len(found)
        hashes += [found, np.zeros(short, np.int64)]
        whole += [np.ones(len(found), bool), np.zeros(short, bool)]
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, ranks = suffix_array(np.array(ids, np.int64))
    fresh = common_prefixes(order, ranks) < run
    group = np.cumsum(fresh) - 1  # suffixes that share their first `run` tokens
    pair = np.unique(np.stack([group, np.array(owner, np.int64)[order]], axis=1), axis=0)
    n_pages, first = np.bincount(pair[:, 0], np.array(weights, float)[pair[:, 1]], minlength=group[-1] + 1).astype(np.int64), order[fresh]
    good = np.concatenate(whole)[first]
    return np.concatenate(hashes)[first][good], n_pages[good]


def cover_of(tokens: list[str], wide: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a substring of `run` tokens whose hash is in `wide`."""
    marks = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(np.isin(gram_hashes(tokens, run), wide))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + run, -1)
    return np.cumsum(marks)[:-1] > 0


def unique_runs(tokens: list[str], cover: np.ndarray) -> list[str]:
    """Tokens outside the covered runs, however few stand together."""
    return [t for t, gone in zip(tokens, cover.tolist(), strict=True) if not gone]


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


#: How a stream's blocks are written: text that may be kept, chrome, and suspect blocks of a container.
FLAGS = {"open": "0", "marked": "0", "chrome": "1", "form": "1", "suspect": "2"}


def _stream(host: str, has_main: bool, blocks: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(key, texts, flags) of a page's suspect blocks and of what lies outside its containers; the key names equal streams."""
    import xxhash

    around = [(FLAGS[kind], t) for kind, t in blocks if kind != "main"]
    texts, flags = "\n".join(t for _, t in around), "".join(f for f, _ in around)
    key = xxhash.xxh3_64_intdigest(f"{host}\n{has_main:d}{flags}\n{texts}".encode("utf-8", "surrogatepass"))
    return key - (1 << 64) * (key >> 63), texts, flags


def short_hash(block: str) -> int:
    """A hash of a whole suspect block of fewer than RUN tokens."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(block.encode("utf-8", "surrogatepass"), 11)
    return h - (1 << 64) * (h >> 63)


def short_blocks(streams: list[tuple[str, str]], weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, distinct pages) of the short suspect blocks of streams (texts, flags)."""
    found: dict[int, int] = {}
    for (texts, flags), weight in zip(streams, weights, strict=True):
        for x in {short_hash(t) for f, t in zip(flags, texts.split("\n"), strict=True) if f == "2" and t.count(" ") + 1 < RUN}:
            found[x] = found.get(x, 0) + weight
    return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)


def kept_runs(texts: str, flags: str, has_main: bool, wide: np.ndarray) -> tuple[str | None, int]:
    """(what stays of a stream, its tokens that the host repeats): the unique runs of a page without a container; else
    those of each suspect block, by lines, or null if there is none."""
    words = texts.replace("\n", " ").split(" ")
    cover = cover_of(words, wide)
    gone, lines, lo = cover.copy(), [], 0
    for b, flag in zip(texts.split("\n"), flags, strict=True):
        n = b.count(" ") + 1
        if flag == "1":
            gone[lo : lo + n] = True
        elif flag == "2":
            if n < RUN and short_hash(b) in wide:
                cover[lo : lo + n] = gone[lo : lo + n] = True
            lines.append(" ".join(unique_runs(words[lo : lo + n], gone[lo : lo + n])))
        lo += n
    if has_main:
        return ("\n".join(lines) if lines else None), int(cover.sum())
    return " ".join(unique_runs(words, gone)), int(cover.sum())


def page_hash(blocks: list[tuple[str, str]]) -> int:
    """Names pages with equal text."""
    import xxhash

    h = xxhash.xxh3_64_intdigest("\n".join(t for _, t in blocks).encode("utf-8", "surrogatepass"), 5)
    return h - (1 << 64) * (h >> 63)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(key, kept, n_boilerplate, copies) of the distinct streams: what stays of each (see kept_runs), how many of its
    tokens the host repeats, and how many pages have it."""
    rows = pages.select(_host(F.col("url")).alias("host"), "html")

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Thin rows (key, page), with the stream itself where a key is new to the task."""
        sent: set[int] = set()
        for batch in batches:
            out = []
            for host, html in zip(batch["host"], batch["html"], strict=True):
                has, blocks = parse(html)
                key, texts, flags = _stream(host, has, blocks)
                if flags:
                    new = key not in sent
                    out.append((key, page_hash(blocks), *((host, has, texts, flags) if new else (None,) * 4)))
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(key)
            yield pd.DataFrame(out, columns=["key", "page", "host", "has_main", "texts", "flags"], dtype=object).astype({"key": np.int64, "page": np.int64})

    streams = rows.mapInPandas(outside, "key long, page long, host string, has_main boolean, texts string, flags string")
    streams = streams.withColumn("stream", F.when(F.col("flags").isNotNull(), F.struct("host", "has_main", "texts", "flags")))
    streams = streams.groupBy("key", "page").agg(F.max("stream").alias("stream"), F.count("*").alias("copies"))
    streams = streams.groupBy("key").agg(F.max("stream").alias("stream"), F.count("*").alias("pages"), F.sum("copies").alias("copies")).select("key", "stream.*", "pages", "copies")
    streams = materialize(streams, "page-streams")
    hosts = streams.groupBy("host").agg(F.ceil(F.count("*") / F.lit(SHARD)).cast("int").alias("shards"))
    # A stream is in one shard, with all pages that have it, so the shards' numbers of distinct pages add up to the host's.
    sharded = streams.join(small_or_shuffled(hosts), "host").withColumn("shard", F.pmod("key", F.col("shards")).cast("int"))

    def repeats(group: pd.DataFrame) -> pd.DataFrame:
        weights = group["pages"].tolist()
        tokens = [t.replace("\n", " ").split(" ") for t in group["texts"]]
        run, n = (np.concatenate(x) for x in zip(repeated_runs(tokens, weights), short_blocks(list(zip(group["texts"], group["flags"], strict=True)), weights), strict=True))
        if group["shards"].iloc[0] == 1:  # nothing to add from other shards
            run, n = run[n >= PAGES], n[n >= PAGES]
        return pd.DataFrame({"host": group["host"].iloc[0], "shard": group["shard"].iloc[0], "run": run, "n": n})

    def decide(group: pd.DataFrame, wide: pd.DataFrame) -> pd.DataFrame:
        runs = wide["run"].to_numpy(np.int64)
        out = [(key, *kept_runs(texts, flags, has, runs), copies) for key, has, texts, flags, copies in zip(group["key"], group["has_main"], group["texts"], group["flags"], group["copies"], strict=True)]
        return pd.DataFrame(out, columns=["key", "kept", "n_boilerplate", "copies"])

    runs = materialize(sharded.groupBy("host", "shard").applyInPandas(repeats, "host string, shard int, run long, n long"), "page-repeats")
    wide = runs.groupBy("host", "run").agg(F.sum("n").alias("pages")).where(F.col("pages") >= PAGES).select("host", "run")
    wide = runs.join(wide, ["host", "run"], "left_semi")
    return sharded.groupBy("host", "shard").cogroup(wide.groupBy("host", "shard")).applyInPandas(decide, "key long, kept string, n_boilerplate long, copies long")


def _own(blocks: list[tuple[str, str]]) -> tuple[str | None, list[tuple[str, int]] | None]:
    """A page's text inside containers: whole, or in blocks with the number of each suspect one (-1: not suspect)."""
    inside = [(kind, t) for kind, t in blocks if kind in ("main", "suspect")]
    if all(kind == "main" for kind, _ in inside):
        return " ".join(t for _, t in inside), None
    parts, n = [], 0
    for kind, t in inside:
        parts.append((t, n if kind == "suspect" else -1))
        n += kind == "suspect"
    return None, parts


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_boilerplate (tokens outside the main text that the host repeats)."""

    def main_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse(h) for h in batch["html"]]
            own = [_own(b) for _, b in parsed]
            yield pd.DataFrame(
                {
                    "page_id": ids_of(batch, "page_id"), "url": batch["url"], "key": [_stream(host, *p)[0] for host, p in zip(batch["host"], parsed, strict=True)],
                    "has_main": [h for h, _ in parsed], "own": [o for o, _ in own], "parts": [None if p is None else [{"t": t, "s": s} for t, s in p] for _, p in own],
                }
            )

    found = materialize(boilerplate(pages), "page-runs")
    keyed = pages.select(*id_columns("page_id"), "url", _host(F.col("url")).alias("host"), "html")
    rows = keyed.mapInPandas(main_text, "page_id long, url string, key long, has_main boolean, own string, parts array<struct<t:string,s:int>>")
    rows = spread_join(rows, found, "key", "copies", "left", F.octet_length(F.coalesce("kept", F.lit(""))) + 48)
    kept = F.coalesce("kept", F.lit(""))
    pieces = F.transform("parts", lambda p: F.when(p["s"] < 0, p["t"]).otherwise(F.coalesce(F.get(F.split(kept, "\n"), p["s"]), F.lit(""))))
    text = F.when(~F.col("has_main"), kept).when(F.col("parts").isNull(), F.col("own")).otherwise(F.array_join(F.filter(pieces, lambda t: t != ""), " "))
    rows = rows.withColumn("text", text)
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.coalesce("n_boilerplate", F.lit(0)).cast("long").alias("n_boilerplate"))
