"""Exact deduplication with counting quotient filters.

A 64-bit fingerprint of the normalised text is split into a quotient and a remainder.  Every partition builds one filter
for each range of quotients: runs of sorted remainders with counts, and two bit vectors that say which quotients occur
and where runs end.  Filters of one range merge losslessly by their sorted remainders.  Fingerprints whose count is one
belong to unique texts; only rows with other fingerprints have their texts compared byte by byte, by grouping on the
whole normalised text with a combine on the map side, so that a group of any size is reduced before it is shuffled.

Cases: a null text counts as empty; all empty texts form one group; rows that repeat a doc_id and its text count each,
and one of them is kept; the smallest doc_id of a group stays, null ids come last; an empty table gives an empty result;
columns other than doc_id and text are ignored by `find_copies` and kept by `drop_copies`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, small_or_shuffled, spread_join

#: Expected fingerprints in one merged range; the number of ranges follows the input.
RANGE_ROWS = 250_000
#: Fingerprints that a partition gathers before it makes a filter of them.
PART_ROWS = 500_000


class CountingQuotientFilter:
    """Fingerprints of `bits` bits with counts.  The quotient is a fingerprint's top q bits and names its run; a run holds
    the sorted remainders of its fingerprints.  occupied: the quotients that have a run; ends: where their runs end."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.q, self.occupied, self.ends, self.remainders, self.counts = bits, q, occupied, ends, remainders, counts

    @staticmethod
    def quotient_bits(n: int, bits: int) -> int:
        """So many that three of four quotients have a fingerprint, of n."""
        return max(1, min(bits - 1, int(np.ceil(np.log2(max(n, 1) / 0.75 + 1)))))

    @classmethod
    def of_sorted(cls, keys: np.ndarray, counts: np.ndarray, bits: int, q: int | None = None) -> CountingQuotientFilter:
        """From sorted distinct fingerprints."""
        q = cls.quotient_bits(len(keys), bits) if q is None else q
        r = np.uint64(bits - q)
        quotients = (keys >> r).astype(np.int64)
        last = np.flatnonzero(np.append(quotients[1:] != quotients[:-1], True)) if len(keys) else np.zeros(0, np.int64)
        return cls(bits, q, quotients[last], last + 1, keys & ((np.uint64(1) << r) - np.uint64(1)), counts.astype(np.uint64))

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls.of_sorted(keys, counts, bits)

    def __len__(self) -> int:
        return len(self.remainders)

    def keys(self) -> np.ndarray:
        """The fingerprints, in order: a remainder after the quotient of its run."""
        runs = np.repeat(self.occupied.astype(np.uint64), np.diff(self.ends, prepend=0))
        return (runs << np.uint64(self.bits - self.q)) | self.remainders

    def resized(self, q: int) -> CountingQuotientFilter:
        """The same fingerprints with q bits in the quotient: bits move between quotients and remainders, the order stays."""
        return self if q == self.q else self.of_sorted(self.keys(), self.counts, self.bits, q)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' fingerprints, counts added: the remainders of a run are merged with those of the same run."""
        q = self.quotient_bits(max(len(self), len(other)), self.bits)
        a, b = self.resized(q), other.resized(q)
        if len(a) < len(b):
            a, b = b, a
        if not len(b):
            return a
        mine, theirs = a.keys(), b.keys()
        at = np.searchsorted(mine, theirs)  # the place of each remainder in the run of its quotient
        here = at < len(mine)
        here[here] = mine[at[here]] == theirs[here]
        counts = a.counts.copy()
        counts[at[here]] += b.counts[here]
        new = ~here
        return self.of_sorted(np.insert(mine, at[new], theirs[new]), np.insert(counts, at[new], b.counts[new]), self.bits)

    def to_bytes(self) -> bytes:
        r = self.bits - self.q
        occupied = np.zeros(1 << self.q, bool)
        occupied[self.occupied] = True
        closes = np.zeros(len(self), bool)
        closes[self.ends - 1] = True
        tails = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (r + 7) // 8]
        more = self.counts > 1
        head = struct.pack("<QBB", len(self), self.q, self.bits)
        return head + np.packbits(occupied).tobytes() + np.packbits(closes).tobytes() + tails.tobytes() + np.packbits(more).tobytes() + self.counts[more].astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        n, q, bits = struct.unpack_from("<QBB", data)
        at, width = 10, (bits - q + 7) // 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
        ends = np.flatnonzero(np.unpackbits(take((n + 7) // 8), count=n)) + 1
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(n * width).reshape(n, width)
        more = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        counts = np.ones(n, np.uint64)
        counts[more] = np.frombuffer(data, "<u8", int(more.sum()), at)
        return cls(bits, q, occupied, ends, wide.reshape(-1).view("<u8").astype(np.uint64), counts)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        more = self.counts > 1
        return self.keys()[more], self.counts[more]


def merged(parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """A balanced merge of at least one filter."""
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def repeated_fingerprints(rows: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints in rows.fp that occur more than once."""
    shard_bits = max(3, int(np.ceil(np.log2(max(1, n_rows / RANGE_ROWS)))))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [CountingQuotientFilter.build(np.zeros(0, np.uint64))]
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch["fp"].to_numpy().view(np.uint64))
            if sum(map(len, held)) >= PART_ROWS:
                parts.append(CountingQuotientFilter.build(np.concatenate(held)))
                held = []
                while len(parts) > 2 and 2 * len(parts[-1]) >= len(parts[-2]):  # few filters, each twice the next: n log n in all
                    parts[-2:] = [parts[-2].merge(parts[-1])]
        if held:
            parts.append(CountingQuotientFilter.build(np.concatenate(held)))
        whole = merged(parts[::-1])
        keys, counts = whole.keys(), whole.counts
        cuts = np.flatnonzero(np.diff((keys >> np.uint64(64 - shard_bits)).astype(np.int64))) + 1
        for own, n in zip(np.split(keys, cuts), np.split(counts, cuts), strict=True):
            if len(own):
                low = own & np.uint64((1 << (64 - shard_bits)) - 1)
                yield pd.DataFrame({"shard": [int(own[0] >> np.uint64(64 - shard_bits))], "filter": [CountingQuotientFilter.of_sorted(low, n, 64 - shard_bits).to_bytes()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged([CountingQuotientFilter.from_bytes(x) for x in group["filter"]]).repeated()
        full = keys | np.uint64(int(key[0]) << (64 - shard_bits))
        return pd.DataFrame({"fp": full.view(np.int64), "n": counts.astype(np.int64)})

    filters = rows.select("fp").mapInPandas(build, "shard int, filter binary")
    return filters.groupBy("shard").applyInPandas(merge, "fp long, n long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(thin rows, groups): doc_id, sha, fp of each row; sha, keep_id, group_size, n_keep of each text that repeats."""
    text = normalised(F.col("text"))
    read = docs.select("doc_id", text.alias("body"))
    thin = materialize(read.select("doc_id", F.unhex(F.sha2(F.col("body"), 256)).alias("sha"), F.xxhash64("body").alias("fp")), "copies-thin")
    repeats = materialize(repeated_fingerprints(thin, thin.count()), "copies-fingerprints").select("fp")
    suspects = read.withColumn("fp", F.xxhash64("body")).join(small_or_shuffled(repeats), "fp", "left_semi")
    groups = suspects.groupBy("body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    return thin, materialize(groups, "copies-groups")


def find_copies(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    thin, groups = _classes(docs)
    out = spread_join(thin.select("doc_id", "sha"), groups, "sha", "group_size", "left")
    out = out.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha")
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if _repeats(thin, groups):
        # Rows that repeat the kept id: one of them stays.
        place = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy(F.lit(0)))
        out = out.where(~keeper).withColumn("kept", F.lit(False)).unionByName(out.where(keeper).withColumn("kept", place == 1))
    else:
        out = out.withColumn("kept", keeper)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _repeats(thin: DataFrame, groups: DataFrame) -> bool:
    """Whether any group's kept id stands in more than one of its rows."""
    keepers = spread_join(thin, groups, "sha", "group_size").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return bool(keepers.groupBy("sha").count().where("count > 1").take(1))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with all its columns, one row of each group of equal texts."""
    thin, groups = _classes(docs)
    gone = spread_join(thin, groups, "sha", "group_size").where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")).distinct()
    gone = materialize(gone, "copies-gone")
    fp = F.xxhash64(normalised(F.col("text")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), fp.alias("own_fp"))
    rows = rows.join(small_or_shuffled(gone), F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_fp") == F.col("gone_fp")), "left_anti")
    if _repeats(thin, groups):
        rows = rows.withColumn("body", normalised(F.col("row.text"))).dropDuplicates(["own_id", "body"])
    return rows.select("row.*")
