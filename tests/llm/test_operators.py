"""Edge cases and brute-force comparisons of the training-data operators."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, exact_dedup, html_extract, lm, minhash_dedup, mixing, packing, quality, token_counts, token_io
from lodestone.llm.queries import QUERIES
from lodestone.llm.tokens import cached, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, score double, row string, h long"
LONG = "word " * 30_000
ODD = [
    (1, "a b c d e f g", "x", 0.1, "r", 1), (2, "a  b\tc d\ne f g", "x", 0.1, "r", 1), (3, None, None, None, None, None), (4, "", "y", 0.0, "", 0), (5, "  \n", "y", 0.0, "", 0), (6, LONG, "x", 0.0, "", 0),
    (7, "Don't <|endoftext|> stop 中文 \x1c x", None, 0.0, "", 0), (8, "one", "z", 0.0, "", 0), (8, "one", "z", 0.0, "", 0), (None, "null id", "z", 0.0, "", 0), (-3, "É é ﬁ", "x", 0.0, "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 1), (8, 0), (99, 1), (6, None)], "doc_id long, quality int")


def _sha(text):
    import hashlib
    import re

    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def test_empty_tables(spark, empty, labels):
    for f in (lambda d: quality.score(d, labels), lambda d: packing.pack_documents(d), token_counts.count_tokens, exact_dedup.find_copies, exact_dedup.drop_copies, lm.score, mixing.mix, mixing.apply_mix, token_io.round_trip, minhash_dedup.find_near_copies, minhash_dedup.drop_near_copies):
        assert f(empty).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.find_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_exact_dedup(odd):
    rows = exact_dedup.find_copies(odd).collect()
    assert len(rows) == len(ODD) and Counter(r["text_sha256"] for r in rows) == Counter(_sha(x[1]) for x in ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["keep_id"] == 1 and by[1]["group_size"] == 2 and by[4]["keep_id"] == 3 and by[5]["keep_id"] == 5
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 8) == [False, True]
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.count() == sum(r["kept"] for r in rows)


def test_quotient_filter():
    random.seed(2)
    a, b = ([random.choice([0, 1, 5, 2**63, 2**64 - 1, random.getrandbits(64)]) for _ in range(n)] for n in (300, 500))
    build = exact_dedup.CountingQuotientFilter.build
    read = exact_dedup.CountingQuotientFilter.from_bytes
    merged = read(build(np.array(a, np.uint64)).to_bytes()).merge(read(build(np.array(b, np.uint64)).to_bytes()))
    assert dict(zip(merged.keys().tolist(), merged.counts.tolist(), strict=True)) == Counter(a + b)
    assert len(read(build(np.zeros(0, np.uint64)).to_bytes())) == 0
    # Runs hold sorted remainders; any number of filters of any sizes merges to the counts of all.
    parts = [[random.getrandbits(12) for _ in range(n)] for n in (0, 1, 900, 3, 50, 2000, 7)]
    whole = exact_dedup.merged([read(build(np.array(x, np.uint64), 12).to_bytes()) for x in parts])
    assert dict(zip(whole.keys().tolist(), whole.counts.tolist(), strict=True)) == Counter(sum(parts, []))
    for lo, hi in zip([0, *whole.ends[:-1].tolist()], whole.ends.tolist(), strict=True):
        assert (np.diff(whole.remainders[lo:hi].astype(np.int64)) > 0).all()


def test_token_counts_and_output(odd):
    tokenizer = cached(tokenizer_path("byte_bpe_50k.json")).library
    want = Counter((x[0], len((x[1] or "").encode()), len(tokenizer.encode(x[1] or "", add_special_tokens=False).ids)) for x in ODD)
    assert Counter((r[0], r[1], r[2]) for r in token_counts.count_tokens(odd).collect()) == want
    tokenizer = cached(tokenizer_path("word_bpe_49k.json")).library
    rows = sorted(token_io.round_trip(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((x[0] for x in ODD), key=lambda d: (d is not None, d))
    crc = Counter((x[0], zlib.crc32(np.array([*tokenizer.encode(x[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for x in ODD)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == crc
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("top", [1, 2, 50, 50_000, 1 << 20, 1 << 40])
def test_simple8b(top):
    r = np.random.default_rng(top)
    for n in (1, 2, 3, 500, 5000):
        ids = r.integers(0, top, n).astype(np.uint64)
        words, at, escaped = token_io.encode_words(ids)
        assert (token_io.decode_words(words, n, at, escaped) == ids).all()


def test_packing(odd):
    rows = packing.pack_documents(odd).collect()
    tokenizer = cached(tokenizer_path("byte_bpe_50k.json")).library
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    pieces = {}
    for r in rows:
        if r["doc_id"] != 8:
            pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for doc_id, text, *_ in ODD:
        if doc_id != 8:
            whole = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert b"".join(p for _, p in sorted(pieces[doc_id])) == whole


def test_differencing_is_even():
    random.seed(5)
    lengths = [random.randint(1, 256) for _ in range(3000)]
    windows = packing.windows_of(lengths)
    sums = [sum(lengths[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(3000)) and max(sums) <= 2048 and sum(sums) / 2048 / len(sums) > 0.98
    assert sum(packing.powers_of_two(3000)) == 3000


def test_mixing(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    per = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["k"]) <= r["m"] / 2 + 1 and r["t"] <= 2 * r["s"] + 1e-6 for r in per)
    assert math.isclose(sum(r["t"] for r in per), 1.5 * sum(r["s"] for r in per))
    assert mixing.apply_mix(docs).columns == docs.columns


def test_minhash_equals_brute_force(spark, odd):
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(120)]
    rows = [(i, " ".join(w if random.random() > 0.01 * (i % 4) else "x" for w in base)) for i in range(60)] + [(100 + i, " ".join(random.choice(words) for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shingler, up = minhash_dedup.Shingler(), {i: i for i, _ in rows}
    sets = {i: shingler.shingles(t) for i, t in rows}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and minhash_dedup.linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.find_near_copies(docs).collect()} == {i: find(i) for i in up}
    out = {r["doc_id"]: r for r in minhash_dedup.find_near_copies(odd).collect()}
    assert out[2]["component_id"] == 1 and out[4]["n_shingles"] == 0 and out[4]["component_id"] == 4 and out[8]["n_shingles"] == 1 and out[None]["component_id"] is None
    assert minhash_dedup.drop_near_copies(odd).columns == odd.columns


def test_quality(spark, odd, labels):
    rows = quality.score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.score(docs, marks).where("held_out").join(marks.where("quality is not null"), "doc_id").collect()
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_html(spark):
    def page(body):
        return f"<html><head><title>t</title></head><body>{body}</body></html>"

    repeated = "subscribe to our weekly letter and read more of this site today"
    rows = [(i, "http://h.x/1", page(f"<div>story number {i} tells of a{i} b{i} c{i}</div><div>{repeated}</div><nav>menu</nav>")) for i in range(5)]
    rows += [(10, "https://h.y/", page("<nav>no</nav><article><h1>T&amp;t</h1><p>one<b>two</b>&#233;  x<p>y<div class='comments'>c</div><script>s()</script></article><footer>f</footer>")), (11, None, None), (12, "", ""), (13, "x", "<p>unclosed <b>text")]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[10] == "T&t onetwoé x y" and out[11] == out[12] == "" and out[13] == "unclosed text"
    assert all(out[i] == f"story number {i} tells of a{i} b{i} c{i}" for i in range(5))


def test_html_keeps_short_unique_runs(spark):
    """Without a container, one or two words beside menus or repeated runs are text of the page."""
    repeated = "these ten words stand on every single page of host"
    bodies = ["<nav>Home</nav><p>Hello world</p>", "<nav>Home</nav><h1>Breaking News</h1><aside>more</aside><p>Some longer text of a story</p>", "<p>Alone</p><footer>f</footer>"]
    bodies += [f"<div>{repeated}</div><p>word{i}</p><div>{repeated}</div>" for i in range(4)]
    rows = [(i, "http://h.w/", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "Hello world" and out[1] == "Breaking News Some longer text of a story" and out[2] == "Alone"
    assert all(out[3 + i] == f"word{i}" for i in range(4))


def test_html_shards_add_up(spark, monkeypatch):
    """A run on just three pages of a host is found whether the host is one shard or many; equal pages count once."""
    body = "<html><body><div>{}</div><div>{}</div></body></html>"
    thrice, twice = "these ten words stand on exactly three pages of host", "these ten words stand on two pages and their copies"
    rows = [(i, "http://h.z/", body.format(" ".join(f"u{i}x{k}" for k in range(12)), thrice if i < 3 else twice if i < 5 else f"end{i}")) for i in range(40)]
    rows += [(100 + i, "http://h.z/", rows[3][2]) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for shard in (512, 3):
        monkeypatch.setattr(html_extract, "SHARD", shard)
        found.append({r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()})
    assert found[0] == found[1]
    assert all((thrice in found[0][i]) is False and f"u{i}x0" in found[0][i] for i in range(3)) and all(twice in found[0][i] for i in (3, 4, 100, 103))


def test_suffix_array():
    random.seed(1)
    ids = np.array([random.randint(0, 2) for _ in range(60)])
    order, ranks = html_extract.suffix_array(ids)
    assert order.tolist() == sorted(range(60), key=lambda i: ids[i:].tolist())


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_near_copies_of_repeated_ids(spark):
    """Documents that repeat an id are documents of their own: a clean text stays where another with its id is a copy."""
    r = random.Random(21)
    base = [f"b{r.randrange(10**6)}" for _ in range(150)]
    near = " ".join([*base[:-1], "changed"])
    clean = " ".join(f"c{r.randrange(10**6)}" for _ in range(150))
    other = " ".join([*clean.split()[:-1], "changed"])
    rows = [(3, " ".join(base)), (7, clean), (7, near), (9, other), (9, " ".join(base)), (None, clean), (2, "x"), (2, "x"), (5, clean), (5, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["doc_id"], x["component_id"]) for x in minhash_dedup.find_near_copies(docs).collect()}
    assert found == {(3, 3), (7, 5), (7, 3), (9, 5), (9, 3), (None, None), (2, 2), (5, 5)}
    kept = sorted((tuple(x) for x in minhash_dedup.drop_near_copies(docs).collect()), key=repr)
    assert len(kept) == 4 and (3, " ".join(base)) in kept and (2, "x") in kept and (None, clean) in kept and ((5, clean) in kept) != ((5, other) in kept)


def test_minhash_equals_sets_of_words(spark, monkeypatch):
    """Against sets of word tuples, for groups larger than a block, with shingles, counts and links by their definition."""
    monkeypatch.setattr(minhash_dedup, "SMALL_BLOCK", 8)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(100)]
    rows = [(i, " ".join(w if r.random() > 0.004 * (i % 6) else r.choice(vocabulary) for w in base)) for i in range(90)]
    rows += [(200, "one TWO three"), (201, "One two  THREE"), (202, " \t "), (203, ""), (204, None), (205, "a b c d e"), (206, "a b c d e f"), (207, "É a b c d"), (208, "é a b c d")]
    sets = {}
    for i, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash_dedup.find_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert out == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_quality_score_recomputed(spark):
    """Scores from the weights by a plain sum over n-grams; a word's whole form counts, however long it is."""
    import xxhash

    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.train(docs, marks)
    mask = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def form(word):
        import itertools

        out = ""
        for kind, run in itertools.groupby(word, key=lambda c: "L" if c.isalpha() else "0" if c.isdecimal() else "-"):
            run = "".join(run)
            if kind == "L":
                out += "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "C" if run[0].isupper() and (len(run) == 1 or run[1:].islower()) else "x"
            else:
                out += "0" if kind == "0" else run
        return out

    def score(text):
        words = [w for w in re.split("[ \t-\r]+", text or "") if w]
        total = float(weights[0])
        low = [xxhash.xxh3_64_intdigest(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode()) for w in words]
        forms = [xxhash.xxh3_64_intdigest(form(w).encode(), 7) ^ (0x5555 if k and low[k] == low[k - 1] else 0) for k, w in enumerate(words)]
        for salt, (base, n) in enumerate(((low, 1), (low, 2), (forms, 1), (forms, 2), (forms, 3)), 1):
            counts = Counter()
            for k in range(len(base) - n + 1):
                h = salt
                for x in base[k : k + n]:
                    h = mix(h ^ x)
                counts[h >> (64 - quality.BITS)] += 1
            norm = math.sqrt(sum(counts.values()))
            total += sum(float(weights[i]) * math.sqrt(c) / norm for i, c in counts.items())
        return 1 / (1 + math.exp(-total))

    rows = [(i, t) for i, t in enumerate(["", "The cat sat on 3 mats.", "BUY NOW!!! buy now", "x" * 39 + "1 " + "-" * 50 + "9", "ab." * 30 + "Z"])]
    rows += [(100 + r["doc_id"], r["text"]) for r in docs.limit(30).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", quality.scorer(spark, weights)("text").alias("s")).collect()}
    assert {i: got[i] for i, t in rows} == pytest.approx({i: score(t) for i, t in rows}, rel=1e-4)


def test_mixing_of_repeated_ids(spark):
    """Rows that repeat an id, or have none, are divided; a source's words come near its target; reruns agree."""
    rows = [(k % 3 if k % 2 else None, f"w{k} " * (1 + k % 4), "a" if k % 3 else "b") for k in range(900)] + [(1, "same words here", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    per = mixing.mix(docs).groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert len(per) == 2 and all(abs(r["t"] - r["k"]) <= 15 for r in per)
    once = lambda: sorted((tuple(r) for r in mixing.mix(docs).collect()), key=repr)
    assert once() == once()


def test_extra_columns_of_labels(spark, odd):
    """Columns of the labels that clash with others are ignored; null and repeated label rows do no harm."""
    rows = [(1, 1, "x", 0.5, 3, 1, 0), (2, 0, "y", 0.1, 4, 0, 1), (2, 0, "y", 0.1, 4, 0, 1), (3, None, None, None, None, None, None), (None, 1, "z", 0.0, 0, 0, 0), (77, 1, "gone", 0.0, 0, 0, 0)]
    marks = spark.createDataFrame(rows, "doc_id long, quality int, text string, score double, turn int, y int, toxic int")
    assert quality.score(odd, marks).count() == len(ODD) and quality.keep_good(odd, marks).columns == odd.columns


def test_ids_beyond_2_to_53(spark):
    """Ids of any size stay exact in batches that hold a null id."""
    big = [2**53 + 1, 2**62 + 3, -(2**61) - 1, None]
    docs = spark.createDataFrame([(d, f"text number {k} of these", "s") for k, d in enumerate(big)], "doc_id long, text string, source string").coalesce(1)
    ids = lambda frame, name="doc_id": {r[name] for r in frame.collect()}
    for f in (packing.pack_documents, token_counts.count_tokens, token_io.round_trip, lm.score, minhash_dedup.find_near_copies, mixing.mix, exact_dedup.find_copies):
        assert ids(f(docs)) == set(big), f
    pages = spark.createDataFrame([(d, "http://x/", f"<p>{k}</p>") for k, d in enumerate(big)], "page_id long, url string, html string").coalesce(1)
    assert ids(html_extract.extract(pages), "page_id") == set(big)
