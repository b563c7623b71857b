"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard verification.

A document's set holds the 64-bit hashes of its distinct word shingles.  Two permutations make the whole signature: sigma
scatters the elements, and pi, shifted circularly by one place for each coordinate, gives that coordinate's minimum
(both are bijections of the 32-bit integers, so no table is stored).  Documents with equal sets form a class; classes
that agree in a band of the signature are candidates.

Candidates are not paired with each other.  In each bucket members are held against one centre, the member with most
company in all its buckets; those whose signatures agree with it enough belong together, and only the others are held
against the rest, in blocks of bounded size.  Components of that are families.  In each family all full texts are
verified against the centre, and again only nodes that this leaves in different components are verified against each
other, in blocks.  So every pair of a family is verified or within one component, groups of any size are spread over
tasks, and a group of near copies costs time in proportion to its size.

Bands have 4 rows.  Their number follows from the threshold, such that a pair at it shares no band with a probability of
at most MISS: 28 bands for 0.80, 20 for 0.85.  Signatures agree enough if so many of 77 coordinates (one byte kept of
each) do that a pair at the threshold fails with a probability of at most FAIL: 40 for 0.80, 46 for 0.85.

Rows of a hot bucket, class or family stay where they are and the few facts of hot keys come to them (`spread_join`).

Cases: documents without words have an empty set and link with nothing; fewer words than a shingle form one shingle;
a null doc_id links with nothing and is its own component; rows that repeat an id are documents of their own, and where
several of one component have its smallest id, `drop_near_copies` keeps one; texts of any length are read whole; an empty
table gives an empty result; extra columns are ignored by `find_near_copies` and kept by `drop_near_copies`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, ids_of, lower_words, materialize, small_batches, small_or_shuffled, splitmix, spread_join, tidy
from .graph import connected_components

SHINGLE, ROWS = 5, 4
#: Links hold where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Coordinates kept for the comparison before verification, 7 bytes to a 64-bit word.
WORDS = 11
#: Probabilities that a pair at the threshold shares no band, and that too few of its coordinates agree.
MISS, FAIL = 5e-7, 2e-8
#: Rows of a block: a share of its group, so that a large group is many tasks' work, but within these bounds.
BLOCK, SMALL_BLOCK, BLOCKS = 1024, 64, 24


@functools.cache
def bands_for(percent: int) -> int:
    """Bands for links at `percent`; never fewer than the kept coordinates need."""
    shared = (percent / 100) ** ROWS
    return max(math.ceil(7 * WORDS / ROWS), math.ceil(math.log(MISS) / math.log1p(-shared)) if shared < 1 else 1)


@functools.cache
def agree_for(percent: int) -> int:
    """How many of the kept coordinates must agree: the most that a pair at `percent` reaches but for FAIL."""
    n, p, below = 7 * WORDS, percent / 100, 0.0
    for k in range(n):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > FAIL:
            return k
    return n


class Shingler:
    """Sets of 64-bit shingle hashes, with a bounded cache of word hashes."""

    def __init__(self, n: int = SHINGLE) -> None:
        import xxhash

        self.n, self.hash, self.seen = n, xxhash.xxh3_64_intdigest, {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = lower_words(text) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = self.hash(w)
        h = np.array([seen[w] for w in words], np.uint64)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = splitmix(out ^ h[k : len(h) - n + 1 + k])
        return np.unique(out)


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(elements: np.ndarray, bands: int) -> np.ndarray:
    """bands * ROWS coordinates: the minimum over the set of pi(sigma(x) - k) for each shift k."""
    scattered = _mix32((elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(bands * ROWS, dtype=np.uint32)[:, None]
    low = np.full(len(shifts), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(scattered), 1024):
        low = np.minimum(low, _mix32(scattered[None, lo : lo + 1024] - shifts, 0x21F0AAAD, 0xD35A2D97).min(axis=1))
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, ROWS).astype(np.uint64)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = splitmix(out ^ parts[:, k])
    return out.view(np.int64)


def coordinate_bytes(sig: np.ndarray) -> np.ndarray:
    parts = (sig[: 7 * WORDS] >> np.uint32(11)).astype(np.uint8).reshape(WORDS, 7)
    wide = np.zeros((WORDS, 8), np.uint8)
    wide[:, :7] = parts
    return wide.reshape(-1).view("<i8")


def agreeing(a: str, b: str):
    """How many coordinates agree in two columns of coordinate_bytes: bytes of the exclusive or that are zero."""
    low, high = F.lit(0x007F7F7F7F7F7F7F), F.lit(0x0080808080808080)
    differ = F.lit(0)
    for i in range(WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differ = differ + F.bit_count(((x.bitwiseAND(low) + low).bitwiseOR(x)).bitwiseAND(high))
    return F.lit(7 * WORDS) - differ


def set_key(elements: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([elements.sum(dtype=np.uint64), splitmix(elements ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64)], np.uint64).view(np.int64))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, fp (of the text), n_shingles, k1, k2 (the set's key), bands, marks."""
    n_bands = bands_for(percent)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                elements = shingler.shingles(text)
                sig = signature(elements, n_bands)
                rows.append((len(elements), *set_key(elements), band_keys(sig) if len(elements) else np.zeros(0, np.int64), coordinate_bytes(sig)))
            out = pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "bands", "marks"])
            out.insert(0, "doc_id", ids_of(batch, "doc_id"))
            out.insert(1, "fp", batch["fp"].to_numpy())
            yield out

    rows = docs.select(*id_columns("doc_id"), F.xxhash64("text").alias("fp"), "text")
    return rows.mapInPandas(tidy(sketch), "doc_id long, fp long, n_shingles long, k1 long, k2 long, bands array<long>, marks array<long>")


def blocked(rows: DataFrame) -> DataFrame:
    """Spreads rows (key, node, main, ...) over blocks such that any two rows of one key meet in a block unless both are
    main.  Rows of a key that has nothing left to compare are dropped.  Adds grp, kind (0: main against others, 1:
    others among themselves) and own (the row's block)."""
    sizes = rows.groupBy("key").agg(F.count_if("main").alias("mains"), F.count_if(~F.col("main")).alias("others"))
    sizes = materialize(sizes.where("others > 0 and (mains > 1 or others > 1)").withColumn("members", F.col("mains") + F.col("others")), "minhash-sizes")
    n = lambda c: F.ceil(F.col(c) / F.least(F.lit(BLOCK), F.greatest(F.lit(SMALL_BLOCK), F.col(c) / BLOCKS))).cast("int")
    rows = spread_join(rows, sizes, "key", "members").drop("members").withColumn("mb", n("mains")).withColumn("ob", n("others"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mb")).otherwise(F.col("ob"))).cast("int"))
    upto = lambda c, top: F.transform(F.sequence(F.lit(1), F.col(top)), c)
    place = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    nowhere = F.array().cast("array<struct<kind:int,a:int,b:int>>")
    of_main = upto(lambda i: place(0, F.col("own"), i - 1), "ob")
    with_main = F.when(F.col("mb") > 0, upto(lambda i: place(0, i - 1, F.col("own")), "mb")).otherwise(nowhere)
    among = upto(lambda i: place(1, F.least(i - 1, F.col("own")), F.greatest(i - 1, F.col("own"))), "ob")
    rows = rows.withColumn("p", F.explode(F.when(F.col("main"), of_main).otherwise(F.concat(with_main, among))))
    return rows.withColumn("grp", F.xxhash64("key", "p.kind", "p.a", "p.b")).withColumn("kind", F.col("p.kind")).drop("p", "mb", "ob", "mains", "others")


def grouped(batches: Iterator[pd.DataFrame], by: str = "grp") -> Iterator[pd.DataFrame]:
    """Whole groups, one at a time, of batches that are sorted by the group."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys = batch[by].to_numpy()
        cuts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.iloc[lo:hi]
        rest = batch.iloc[cuts[-1] :] if len(batch) else None
    if rest is not None and len(rest):
        yield rest


class Forest:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int, edge: bool = True) -> bool:
        x, y = self.find(a), self.find(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        if edge:
            self.edges.append((a, b))
        return True


def _candidates(g: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of a block that must be compared and whose signatures agree enough."""
    main, own, n = g["main"].to_numpy(bool), g["own"].to_numpy(), g["n"].to_numpy()
    first = np.flatnonzero(main) if g["kind"].iloc[0] == 0 else np.arange(len(g))
    second = np.flatnonzero(~main)
    if not len(first) or not len(second):
        return first[:0], first[:0]
    marks = np.stack(g["marks"].to_numpy()).astype("<i8").view(np.uint8).reshape(len(g), WORDS, 8)[:, :, :7].reshape(len(g), -1)
    same = np.zeros((len(first), len(second)), np.uint8)
    for c in range(marks.shape[1]):
        same += marks[first, c][:, None] == marks[second, c][None, :]
    fits = (same >= agree_for(percent)) & (100 * np.minimum(n[first][:, None], n[second][None, :]) >= percent * np.maximum(n[first][:, None], n[second][None, :]))
    if g["kind"].iloc[0] == 1:
        fits &= first[:, None] < second[None, :]
        if own.min() != own.max():
            fits &= own[first][:, None] != own[second][None, :]
    i, j = np.nonzero(fits)
    return first[i], second[j]


def _families(members: DataFrame, percent: int) -> DataFrame:
    """(node, component): nodes joined by agreeing signatures of one bucket, directly or in steps."""
    centre = F.max(F.struct(F.col("size").alias("w"), F.col("node").alias("b"), F.col("n").alias("cn"), F.col("marks").alias("cmarks"))).alias("c")
    centres = materialize(members.groupBy("bucket").agg(centre, F.count("*").alias("held")).select("bucket", "held", "c.b", "c.cn", "c.cmarks"), "minhash-centres")
    near = (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")) & (agreeing("marks", "cmarks") >= agree_for(percent))
    stars = spread_join(members, centres, "bucket", "held", width=F.lit(240)).select(F.col("bucket").alias("key"), "node", "n", "marks", "b", (near | (F.col("node") == F.col("b"))).alias("main"))
    stars = materialize(stars, "minhash-stars")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges: list[tuple] = []
        for g in grouped(batches):
            i, j = _candidates(g, percent)
            if len(i):
                node, forest = g["node"].to_numpy(), Forest(len(g))
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    forest.join(a, b)
                edges += [(node[a], node[b]) for a, b in forest.edges]
            if len(edges) > 10_000:
                yield pd.DataFrame(edges, columns=["u", "v"])
                edges = []
        if edges:
            yield pd.DataFrame(edges, columns=["u", "v"])

    rest = blocked(stars.drop("b")).repartition("grp").sortWithinPartitions("grp", "node")
    more = rest.select("grp", "kind", "own", "main", "node", "n", "marks").mapInPandas(tidy(compare), "u long, v long")
    return connected_components(stars.where("main").select(F.col("node").alias("u"), F.col("b").alias("v")).distinct().unionByName(more))


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of a forest of verified links, from blocks of rows (key, node, main, comp, n, marks, text)."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for g in grouped(batches):
            i, j = _candidates(g, percent)
            comp = g["comp"].to_numpy()
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            used = np.unique(np.concatenate([i, j]))
            texts, node = g["text"].to_numpy(), g["node"].to_numpy()
            sets = {int(x): shingler.shingles(texts[x]) for x in used}
            _, dense = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
            sizes = np.array([len(s) for s in sets.values()])
            at = dict(zip(sets, zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True), strict=True))
            forest, here = Forest(len(g)), {}
            for x in used.tolist():
                forest.join(here.setdefault(comp[x], x), x, edge=False)
            marked = np.zeros(int(dense.max(initial=-1)) + 1, bool)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for x, lo, hi in zip(*(a.tolist() for a in (lambda f: (i[f], f, np.append(f[1:], len(i))))(np.flatnonzero(np.append(True, i[1:] != i[:-1])))), strict=True):
                mine = dense[slice(*at[x])]
                marked[mine] = True
                for y in j[lo:hi].tolist():
                    if forest.find(x) != forest.find(y):
                        theirs = dense[slice(*at[y])]
                        both = int(np.count_nonzero(marked[theirs]))
                        if both and 100 * both >= percent * (len(mine) + len(theirs) - both):
                            forest.join(x, y)
                marked[mine] = False
            if forest.edges:
                yield pd.DataFrame([(node[a], node[b]) for a, b in forest.edges], columns=["u", "v"])

    placed = blocked(rows).repartition("grp").sortWithinPartitions("grp", "node")
    return placed.select("grp", "kind", "own", "main", "node", "comp", "n", "marks", "text").mapInPandas(tidy(verify), "u long, v long")


def _star_links(rows: DataFrame, percent: int) -> DataFrame:
    """Verified links (u, v) of the nodes of a family with its centre: rows (key, node, company, text)."""
    centres = rows.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("b"), F.count("*").alias("held"))
    centres = centres.join(rows.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").where("held > 1")
    centres = materialize(centres, "minhash-family-centres")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held_text, held = Shingler(), None, None
        for batch in batches:
            out = []
            for a, ta, b, tb in zip(batch["node"], batch["text"], batch["b"], batch["tb"], strict=True):
                if tb != held_text:
                    held_text, held = tb, shingler.shingles(tb)
                if linked(shingler.shingles(ta), held, percent):
                    out.append((a, b))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    pairs = spread_join(rows, centres, "key", "held", width=F.octet_length("tb") + 64).where("node <> b")
    return pairs.select("node", "text", "b", "tb").mapInPandas(tidy(verify), "u long, v long")


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes of equal sets: k1, k2, copies, component_id)."""
    small_batches(docs.sparkSession)
    rows = materialize(sketches(docs, percent), "minhash-rows")
    own = F.first(F.struct("bands", "marks", F.col("n_shingles").alias("n"))).alias("own")
    rep = F.min(F.struct(F.col("doc_id").alias("first_id"), F.col("fp").alias("rep_fp"))).alias("rep")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(rep, own, F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "copies", "rep.*", "own.*"), "minhash-classes")
    comps = _linked_nodes(docs, classes, percent)
    firsts = comps.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.select("k1", "k2", "copies", "node", "first_id").join(comps.join(firsts, "component").select("node", "component_id"), "node", "left")
    return rows, materialize(named.select("k1", "k2", "copies", F.coalesce("component_id", "first_id").alias("component_id")), "minhash-named")


def _linked_nodes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that link with others."""
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    busy = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "minhash-full")
    busy = materialize(spread_join(buckets, busy, "bucket", "size"), "minhash-busy")
    company = busy.groupBy("node").agg(F.sum("size").alias("company"))
    known = materialize(classes.drop("bands", "k2", "copies").join(company, "node"), "minhash-known")
    members = busy.select("bucket", "node").join(known.select("node", "n", "marks", F.col("company").alias("size")), "node")

    families = materialize(_families(members, percent), "minhash-families")
    inside = families.withColumnRenamed("component", "key").join(known, "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.xxhash64("text").alias("rep_fp"), "text")
    wanted = materialize(inside.select("first_id", "rep_fp"), "minhash-wanted")
    texts = texts.join(small_or_shuffled(wanted), ["first_id", "rep_fp"], "left_semi").dropDuplicates(["first_id", "rep_fp"])
    inside = materialize(inside.join(texts, ["first_id", "rep_fp"]).drop("first_id", "rep_fp"), "minhash-texts")
    stars = materialize(_star_links(inside, percent), "minhash-star-links")
    comps = materialize(connected_components(stars), "minhash-star-components")
    # Main in its family: joined with the most nodes by now. Families of one component are done.
    placed = inside.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    largest = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("best"), F.count("*").alias("parts"), F.sum("c").alias("held")).where("parts > 1")
    placed = spread_join(placed, materialize(largest, "minhash-largest"), "key", "held").select("node", "comp", (F.col("comp") == F.col("best")).alias("main"))
    links = materialize(_linked(inside.join(placed, "node"), percent), "minhash-links")
    return connected_components(stars.unionByName(links))


def _found(docs: DataFrame, percent: int) -> DataFrame:
    rows, classes = _classes(docs, percent)
    out = spread_join(rows.select("doc_id", "fp", "n_shingles", "k1", "k2", (F.col("n_shingles") > 0).alias("some")), classes, ["k1", "k2"], "copies", "left")
    linkable = F.col("some") & F.col("doc_id").isNotNull()
    component = F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "fp", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def find_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return _found(docs, percent).drop("fp")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with all its columns, one document of each component (the one with the smallest doc_id)."""
    found = materialize(_found(docs, percent), "minhash-found")
    gone = found.where("not kept").select("doc_id", "fp")
    # Rows with the smallest id of their component: the one whose text has the smallest hash stays.
    firsts = found.where("kept and doc_id is not null and n_shingles > 0")
    again = materialize(firsts.groupBy("doc_id").agg(F.min("fp").alias("keep_fp"), F.count("*").alias("n")).where("n > 1"), "minhash-again")
    repeats = again.take(1)
    if repeats:
        gone = gone.unionByName(firsts.join(small_or_shuffled(again), "doc_id").where("fp <> keep_fp").select("doc_id", "fp"))
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")).distinct(), "minhash-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_fp"))
    rows = rows.join(small_or_shuffled(gone), (F.col("own_id") == F.col("gone_id")) & (F.col("own_fp") == F.col("gone_fp")), "left_anti")
    if repeats:
        again = again.select(F.col("doc_id").alias("again_id"))
        same = F.col("own_id") == F.col("again_id")
        rows = rows.join(small_or_shuffled(again), same, "left_anti").unionByName(rows.join(small_or_shuffled(again), same, "left_semi").dropDuplicates(["own_id", "own_fp"]))
    return rows.select("row.*")
