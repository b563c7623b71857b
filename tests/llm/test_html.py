"""Main text of pages: containers and what stands around them, marked blocks, repeats of a host, brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import html_extract as h


def _main(body: str) -> str:
    """The text of a page alone on its host, without repeats."""
    has, blocks = h.parse(f"<html><head><title>t</title></head><body>{body}</body></html>")
    if has:
        return " ".join(t for kind, t in blocks if kind in ("main", "suspect"))
    return " ".join(t for kind, t in blocks if h.FLAGS[kind] == "0")


@pytest.mark.parametrize(("body", "text"), [
    ("<main>real text</main><aside><article>teaser</article></aside><footer><article>foot</article></footer>", "real text"),
    ("<div hidden><article>secret</article></div><article>seen</article>", "seen"),
    ("<div style='display: none'><main>secret</main></div><p>open</p>", "open"),
    ("<nav><main>menu</main></nav><article>a</article>", "a"),
    ("<template><article>t</article></template><article>a</article>", "a"),
    ('<main><p class="social-history">It was a time of change.</p><p>More.</p></main>', "It was a time of change. More."),
    ('<article><div class="header-ad-note">x y</div>z</article>', "x y z"),
    ('<article>a<div class="comments"><p>reader</p></div><div id="disqus_thread">r</div><section class="comment-list"><article class="comment">r2</article></section>b</article>', "a b"),
    ('<article>a<aside>side</aside><form><p>f</p></form><button>go</button><nav>n</nav><footer>by</footer>b</article>', "a b"),
    ('<article><header><h1>Title</h1></header><p>one</article>', "Title one"),
    ('<form id="page"><nav>m</nav><article>kept</article><p>label</p></form>', "kept"),
    ('<form><aside><article>no</article></aside></form><p>yes</p>', "yes"),
    ('<article><div class="ad">buy now<p>still an advert</article><p>after</p>', ""),
    ('<article><p class="ad">buy<p>text</article>', "text"),
    ('<article><ul><li class="ads">buy<li>item</ul>end</article>', "item end"),
    ('<article><table><tr><td class="sidebar">s<td>cell<tr><td>next</table></article>', "cell next"),
    ('<article>one<b>two</b>&#233;&amp;  x<br>y</article>', "onetwoé& x y"),
    ('<div role="main">r</div><div role="navigation">n</div>', "r"),
    ('<div class="entry-content">e</div><div class="sidebar">s</div>', "e"),
    ('<article>outer <article>inner</article> tail</article>', "outer inner tail"),
    ('<section><article>first</article></section><article>second</article>', "first second"),
    ('<p>unclosed <b>text', "unclosed text"), ("<article>a</div>b</article>", "ab"), ("", ""),
])
def test_structure(body, text):
    assert _main(body) == text


def _pages(spark, bodies, url="http://h.x/"):
    rows = [(i, url, f"<html><body>{b}</body></html>", "k", 1, True) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, key string, copies int, has_main boolean")
    return {r["page_id"]: (r["text"], r["n_chars"], r["n_boilerplate"]) for r in h.extract(frame).collect()}


def test_the_host_decides_on_suspect_blocks(spark):
    """Inside a container a block with a marked word goes where the host repeats it, and stays where it does not."""
    long_note = "this notice stands word for word on every page of the host"
    bodies = [f"<article><p>story {i} of a{i}</p><div class='top-notice'>{long_note}</div><p>end {i}</p><div class='related-note'>Read more</div></article><footer>f</footer>" for i in range(4)]
    bodies += ["<article><p>about</p><div class='notice-text'>A notice that only this page has, of more than eight words.</div><p class='share-price'>Up 3</p></article>"]
    bodies += [f"<article><p>x{i}</p><div class='notice-a'>{long_note} and u{i} v{i}</div></article>" for i in range(2)]
    out = _pages(spark, bodies)
    assert [out[i][0] for i in range(4)] == [f"story {i} of a{i} end {i}" for i in range(4)]
    assert out[4][0] == "about A notice that only this page has, of more than eight words. Up 3" and out[4][1] == len(out[4][0])
    assert [out[5 + i][0] for i in range(2)] == [f"x{i} and u{i} v{i}" for i in range(2)]


def test_repeated_text_of_articles_stays(spark):
    """What is not suspect inside a container is kept, though many pages share it."""
    shared = " ".join(f"w{k}" for k in range(60))
    out = _pages(spark, [f"<article><p>{shared}</p><p>own {i}</p></article><div>{shared}</div>" for i in range(5)])
    assert all(out[i][0] == f"{shared} own {i}" and out[i][2] == 60 for i in range(5))


def _brute_runs(pages, run):
    found = defaultdict(set)
    for who, tokens in enumerate(pages):
        for k in range(len(tokens) - run + 1):
            found[tuple(tokens[k : k + run])].add(who)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_repeated_runs_equal_brute_force(seed):
    r = random.Random(seed)
    pages = [[r.choice("abc") for _ in range(r.randrange(0, 40))] for _ in range(14)]
    weights = [r.randrange(1, 4) for _ in pages]
    for run in (1, 3, 5):
        hashes, n = h.repeated_runs(pages, weights, run)
        want = {t: sum(weights[i] for i in who) for t, who in _brute_runs(pages, run).items()}
        assert dict(zip(hashes.tolist(), n.tolist(), strict=True)) == {int(h.gram_hashes(list(t), run)[0]): k for t, k in want.items()}
        wide = np.array([int(h.gram_hashes(list(t), run)[0]) for t, k in want.items() if k >= 6], np.int64)
        for tokens in pages:
            cover = [False] * len(tokens)
            for k in range(len(tokens) - run + 1):
                if want[tuple(tokens[k : k + run])] >= 6:
                    cover[k : k + run] = [True] * run
            assert h.cover_of(tokens, wide, run).tolist() == cover


def test_odd_pages(spark):
    """Nulls, repeated rows, a very long page, odd urls, clashing extra columns."""
    long_page = "<article>" + "<p>word</p>" * 40_000 + "</article>"
    rows = [(1, None, None), (2, "http://a.b/x", ""), (None, "HTTP://A.B", "<p>x</p>"), (4, "not a url", "<p>y</p>"), (5, "http://a.b/", long_page), (5, "http://a.b/", long_page), (6, "http://u@c.d:1/", "<p>퟿ &#x41;</p>")]
    frame = spark.createDataFrame([(*x, 1, "z", "q") for x in rows], "page_id long, url string, html string, host int, kept string, own string")
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in h.extract(frame).collect()), key=repr)
    text = " ".join(["word"] * 40_000)
    want = [(1, None, "", 0), (2, "http://a.b/x", "", 0), (None, "HTTP://A.B", "x", 1), (4, "not a url", "y", 1), (5, "http://a.b/", text, len(text)), (5, "http://a.b/", text, len(text)), (6, "http://u@c.d:1/", "퟿ A", 3)]
    assert out == sorted(want, key=repr)


def test_test_table(spark):
    """On the test table the main text is exactly the articles' text, recovered by plain means."""
    import html as entities
    import re

    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in h.extract(frame).collect()}
    for row in frame.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner)
        texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert got[row["page_id"]] == " ".join(t for t in texts if t)
