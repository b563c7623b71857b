"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector of unit length is turned by fixed random rotations; the signs of its turned coordinates are its code.  Two codes
differ in a share of their bits that is, on average over rotations, the angle between the vectors over pi.  How many bits
of a code a small angle flips depends on how many of the vector's own turned coordinates lie near zero; that ratio,
against an average vector, is its correction factor.  With the factors of both vectors the number of differing bits gives
an unbiased estimate of the angle at the threshold, so of the inner product there, and Bernstein's inequality bounds its
error by the number of bits.  Codes (packed) and factors are written once.  Only pairs whose estimate comes within the
bound of the threshold are computed exactly, in double precision, and only their vectors are read for that.

Candidates come from the same codes: bits are grouped into tables, and vectors of one label that agree in all bits of a
table meet in a bucket.  The bits of a table follow the size of the label, so that unlike vectors rarely meet; the number
of tables follows from the bits, so that a pair at the threshold is missed with a probability of MISS at most.  Equal
vectors are one class before that, so a vector that is repeated in a third of all rows is one row.  Thin rows (bucket,
node) find the buckets with company; codes travel to those alone.  Buckets above BLOCK rows are divided into blocks that
are compared in pairs of blocks.  A pair that meets in several tables counts in the first.  A block gives numbers of
links and edges of a forest, never all its pairs.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with
nothing; vectors of different lengths never link; rows that repeat count as vectors of their own; a null vec_id counts
as a vector, also where all its equals have none, but is not the id of a component; labels may have any type; vectors of
any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_or_shuffled, splitmix, spread_join
from .graph import connected_components

THRESHOLD, MISS, BLOCK = 0.98, 1e-6, 512
#: Bits of a code at least, and the probability with which the bound may fail for a pair at the threshold.
CODE_BITS, FAIL = 512, 1e-7
SEED = 20_240_501


@functools.lru_cache(8)
def rotations(dim: int, bits: int) -> np.ndarray:
    """dim x bits: columns of random orthonormal blocks."""
    rng, blocks = np.random.default_rng(SEED + dim), []
    while sum(b.shape[1] for b in blocks) < bits:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        blocks.append(q * np.sign(np.diag(r)))
    return np.concatenate(blocks, axis=1)[:, :bits]


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(bits of a table, number of tables, bits of a code) for n vectors of a label."""
    bits = max(8, math.ceil(math.log2(max(n, 1))) + 3)
    agree = 1 - math.acos(threshold) / math.pi
    tables = math.ceil(math.log(miss) / math.log1p(-(agree**bits)))
    return bits, tables, -(-max(CODE_BITS, bits * tables) // 64) * 64


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Of x >= 0, by the approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * x)
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - tail


def encode(unit: np.ndarray, bits: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(codes as rows of 64-bit words, correction factors) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, bits)
    words = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    angle = math.acos(threshold)
    # Of a vector at that angle, a coordinate is normal about cos * x with the deviation sin * sqrt((1 - x^2) / (dim - 1)).
    spread = math.tan(angle) * np.sqrt(np.maximum(1 - turned**2, 1e-12) / max(1, dim - 1))
    flips = (1 - _normal_cdf(np.abs(turned) / spread)).mean(axis=1)
    return words, (flips / (angle / math.pi)).astype(np.float32)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """len(a) x len(b): in how many bits codes differ."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return out


def estimate(differ: np.ndarray, factor: np.ndarray, bits: int) -> np.ndarray:
    """The inner product, from differing bits and the mean of the two factors."""
    return np.cos(np.pi * differ / bits / factor)


def most_differing(factor: np.ndarray, bits: int, threshold: float = THRESHOLD, fail: float = FAIL) -> np.ndarray:
    """How many bits differ at most between vectors at the threshold, but for a probability of `fail` (Bernstein)."""
    share = factor * (math.acos(threshold) / math.pi)
    rare = -math.log(fail)
    return bits * share + rare / 3 + np.sqrt((rare / 3) ** 2 + 2 * rare * bits * share * (1 - share))


def buckets(words: np.ndarray, n_bits: int, tables: int) -> np.ndarray:
    """n x tables bucket numbers."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little", count=n_bits * tables)
    return bits.reshape(len(words), tables, n_bits) @ (1 << np.arange(n_bits, dtype=np.int64))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, k1, k2; classes of equal vectors: node, k1, k2, label, embedding, first_id, copies)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & ~zero, F.lit(False))
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", usable.alias("usable"))
    key = lambda salt: F.when(F.col("usable"), F.xxhash64(F.lit(salt), "label", "embedding"))
    keyed = keyed.withColumn("k1", key(1)).withColumn("k2", key(2))
    found = keyed.where("usable").groupBy("k1", "k2", "label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    found = materialize(found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    return keyed.select("vec_id", "k1", "k2"), found


def codes_of(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The written codes: node, size (vectors of the label and length), code, factor, and the bucket of each table."""
    space = F.xxhash64("label", F.size("embedding")).alias("space")
    sizes = found.groupBy(space).agg(F.count("*").alias("size"))
    rows = found.select("node", space, "embedding").join(small_or_shuffled(sizes), "space")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (space, size), part in batch.groupby(["space", "size"], sort=False):
                n_bits, tables, bits = plan_tables(size, threshold)
                words, factors = encode(unit_vectors(np.array(part["embedding"].tolist(), float)), bits, threshold)
                with np.errstate(over="ignore"):
                    tab = splitmix(np.uint64(int(space) % (1 << 64)) ^ np.arange(1, tables + 1, dtype=np.uint64))
                groups = splitmix(tab[None, :] ^ splitmix(buckets(words, n_bits, tables).astype(np.uint64))).view(np.int64)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "size": size, "code": [w.tobytes() for w in words], "factor": factors, "groups": list(groups)})

    return materialize(rows.mapInPandas(coded, "node long, size long, code binary, factor float, groups array<long>"), "vector-codes")


#: The columns of a row in a block: grp is the block or pair of blocks, tab the table whose bucket it divides.
PLACED = "grp long, tab int, own int, first int, second int, node long, size long, code binary, factor float"


def in_blocks(codes: DataFrame) -> DataFrame:
    """Codes of the nodes that have company, once for each bucket and pair of blocks in it."""
    thin = codes.select("node", F.posexplode("groups").alias("tab", "bucket"))
    busy = materialize(thin.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "vector-busy")
    met = spread_join(thin, busy, "bucket", "members").groupBy("node").agg(F.collect_list(F.struct("tab", "bucket", "members")).alias("met"))  # at most one a table
    rows = codes.drop("groups").join(met, "node").withColumn("m", F.explode("met")).withColumn("n_blocks", F.ceil(F.col("m.members") / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    return rows.withColumn("grp", F.xxhash64("m.bucket", "first", "second")).withColumn("tab", F.col("m.tab")).select(*[c.split()[0] for c in PLACED.split(", ")])


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, which come sorted by grp, cut so that no group is divided."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys = batch["grp"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            yield batch.iloc[: cuts[-1]]
        rest = batch.iloc[cuts[-1] if len(cuts) else 0 :]
    if rest is not None and len(rest):
        yield rest


#: Groups of up to this many rows are compared together, by the distance of their rows.
FEW = 48


def _pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places (i < j) with equal, neighbouring values of a sorted array."""
    i, j, at = [], [], np.arange(len(group))
    for d in range(1, len(group)):
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        i.append(at)
        j.append(at + d)
    return (np.concatenate(i), np.concatenate(j)) if i else (at[:0], at[:0])


def close_pairs(rows: pd.DataFrame, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in rows of whole groups, of pairs that meet in their group first and whose estimate comes within the
    bound."""
    grp, tab, own = (rows[c].to_numpy() for c in ("grp", "tab", "own"))
    divided = (rows["first"] != rows["second"]).to_numpy()
    factor, size = rows["factor"].to_numpy(np.float64), rows["size"].to_numpy()
    for n in np.unique(size).tolist():
        n_bits, tables, bits = plan_tables(n, threshold)
        at = np.flatnonzero(size == n)  # a hash may bring buckets of several labels into one group
        words = np.frombuffer(b"".join(rows["code"].iloc[at]), "<u8").reshape(len(at), -1)
        met = buckets(words, n_bits, tables)
        key = grp[at]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(at)]])
        lengths = np.diff(cuts)
        few = np.flatnonzero(np.repeat(lengths <= FEW, lengths))
        todo = [tuple(few[x] for x in _pairs(key[few]))]
        todo += [(None, np.arange(cuts[g], cuts[g + 1])) for g in np.flatnonzero(lengths > FEW).tolist()]
        for i, j in todo:
            if i is None:  # one large group: all against all
                differ = differing(words[j], words[j])
                maybe = differ <= most_differing((factor[at[j]][:, None] + factor[at[j]][None, :]) / 2, bits, threshold)
                i, j = (j[x] for x in np.nonzero(np.triu(maybe, 1)))
            else:
                differ = np.bitwise_count(words[i] ^ words[j]).sum(axis=1)
                near = differ <= most_differing((factor[at[i]] + factor[at[j]]) / 2, bits, threshold)
                i, j = i[near], j[near]
            if not len(i):
                continue
            a, b = at[i], at[j]
            good = (tab[a] == tab[b]) & (met[i, tab[a]] == met[j, tab[a]])
            good &= ~divided[a] | (own[a] != own[b])  # in a pair of blocks only rows from either are compared
            before = (met[i] == met[j]) & (np.arange(tables)[None, :] < tab[a][:, None])
            good &= ~before.any(axis=1)
            if good.any():
                yield a[good], b[good]


def link_blocks(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (node, links, root): links found in one bucket, and an edge to the smallest node joined with it there."""
    names = [c.split()[0] for c in PLACED.split(", ")]

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            close = [np.unique(np.concatenate(p)) for p in close_pairs(rows, threshold)]
            if close:
                yield rows.iloc[np.unique(np.concatenate(close))]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            label, vectors = rows["label"].to_numpy(), rows["embedding"].to_numpy()
            node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
            for i, j in close_pairs(rows, threshold):
                alike = np.array([len(vectors[a]) == len(vectors[b]) and label[a] == label[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[alike], j[alike]
                linked = np.zeros(len(i), bool)
                for lo in range(0, len(i), 16_384):
                    for dim in {len(vectors[x]) for x in i[lo : lo + 16_384].tolist()}:
                        own = [x for x in range(lo, min(lo + 16_384, len(i))) if len(vectors[i[x]]) == dim]
                        a, b = (unit_vectors(np.array(vectors[x[own]].tolist(), float)) for x in (i, j))
                        linked[own] = (a * b).sum(axis=1) >= threshold
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                degree = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
                root, changed = np.arange(len(rows)), True
                while changed:  # the smallest place joined with each row
                    before = root.copy()
                    np.minimum.at(root, i, root[j])
                    np.minimum.at(root, j, root[i])
                    root = root[root]
                    changed = bool((before != root).any())
                some = np.flatnonzero(degree)
                yield pd.DataFrame({"node": node[some], "links": degree[some].astype(np.int64), "root": node[root[some]]})

    placed = in_blocks(codes_of(found, threshold)).repartition("grp").sortWithinPartitions("grp", "node")
    close = materialize(placed.mapInPandas(screen, PLACED), "vector-close")
    whole = close.join(found.select("node", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), "copies"), "node")
    return whole.repartition("grp").sortWithinPartitions("grp", "node").select(*names, "label", "embedding", "copies").mapInPandas(compare, "node long, links long, root long")


def find_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows, found = classes(vectors)
    blocks = materialize(link_blocks(found, threshold), "vector-links")
    degrees = blocks.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(blocks.select(F.col("node").alias("u"), F.col("root").alias("v")))
    ids = found.select("node", "first_id")
    firsts = comps.join(ids, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = found.select("k1", "k2", "node", "first_id", "copies").join(degrees, "node", "left").join(comps.join(firsts, "component"), "node", "left")
    known = materialize(known.select("k1", "k2", "copies", "links", F.coalesce("component_id", "first_id").alias("component_id")), "vector-known")
    out = spread_join(rows, known, ["k1", "k2"], "copies", "left")
    n_links = F.when(F.col("copies").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
