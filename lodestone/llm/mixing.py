"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Each source has a target of words; a document's copies follow from where its hash lies against its source's threshold.
The threshold is found by nested histograms: words are summed by source and hash bucket, the bucket where the budget is
reached is found from running sums, and only that bucket is divided again, until it is one hash value.  Documents are
then filtered against the thresholds; nothing is sorted by document.

Cases: a null text has size 0; a null source is a source of its own, last in order; rows with equal ids and texts share
one hash and are taken or left together, others have hashes of their own also where they repeat an id or have none; very
long texts are counted whole; an empty table gives an empty result; other columns are ignored by `mix` and kept by
`apply_mix`.  A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialize, small_or_shuffled

WEIGHTS = (3.0, 1.0, 2.0)
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id and the MD5 of the text, both as text, so that any SQL engine can repeat it."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size): the budget is shared by weight, no target exceeds
    `cap` times its source's size, and what is above goes to the others by weight, until none is above.  With sources
    in the order of cap over weight, those that end at their cap are a prefix, so running sums give the result."""
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("w", F.element_at(wheel, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("place", F.row_number().over(by_ratio))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("w_from"))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    )
    final = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)
    return rows.withColumn("final", final).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final.level") * F.col("w")).alias("target"))


def thresholds(thin: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row a source from rows (source, size, h): source, source_size, target, copies (whole copies of every
    document), h_below (documents with a smaller hash are taken once more) and at_edge (so are those with this hash)."""
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, share, cap, weights)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = materialize(goals.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-goals")
    n_sources = goals.count()
    edge = goals.select(F.col("source").alias("s"), F.col("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        above, here = HASH_BITS - LEVEL_BITS * (level - 1), HASH_BITS - LEVEL_BITS * level
        inside = thin.join(small_or_shuffled(edge, n_sources), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", above) == F.col("prefix")))
        histogram = inside.groupBy("s", "rest", F.shiftright("h", here).alias("bucket")).agg(F.sum("size").alias("mass"))
        running = F.sum("mass").over(Window.partitionBy("s").orderBy("bucket"))
        edge = (
            histogram.withColumn("upto", running)
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("mass") <= F.col("rest")))
            .select("s", (F.col("rest") - (F.col("upto") - F.col("mass"))).alias("rest"), F.col("bucket").alias("prefix"), "mass")
        )
    edge = edge.select("s", F.col("prefix").alias("h_below"), (2 * F.col("rest") >= F.col("mass")).alias("at_edge"))
    return goals.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "copies", "h_below", "at_edge")


def _decided(rows: DataFrame, limits: DataFrame) -> DataFrame:
    limits = materialize(limits, "mix-thresholds")
    limits = limits.withColumnRenamed("source", "s")
    extra = (F.col("h") < F.col("h_below")) | ((F.col("h") == F.col("h_below")) & F.col("at_edge"))
    joined = rows.join(small_or_shuffled(limits), F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("times", F.col("copies") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).drop("s")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted)."""
    thin = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-thin")
    out = _decided(thin, thresholds(thin, share, cap, weights))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed documents with the columns of docs: each row as often as the mix takes it, so none, once or twice."""
    thin = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-thin")
    limits = thresholds(thin, share, cap, weights)
    packed = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    out = _decided(packed, limits)
    out = out.where(F.col("times") > 0).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"))
    return out.select("row.*")
