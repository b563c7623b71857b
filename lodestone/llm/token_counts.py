"""Token counts by two-tier lookup of pre-tokens.

A first pass counts pre-tokens in every partition with a bounded summary of heavy hitters; summaries merge in a few
tasks, and the most frequent pre-tokens with their lengths in ids become a hash table that is broadcast: at most
TABLE_ENTRIES pre-tokens of at most LONGEST characters.  The second pass looks every pre-token up there; misses are
encoded once per worker and kept in its bounded cache.  Pre-tokens themselves are never shuffled.  The table only
saves time: a pre-token that is not in it gets the same length from the tokenizer.

Cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; rows that repeat are
counted each; special strings inside texts count as the library counts them; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, ids_of, small_batches
from .tokens import LONGEST, Tier, cached, tokenizer_path

#: Bounds: entries of the broadcast table, and of one task's summary.
TABLE_ENTRIES, SUMMARY_ENTRIES = 65_536, 16_384
LIMIT = 1024


def _pruned(counts: Counter, entries: int) -> Counter:
    return Counter(dict(counts.most_common(entries)))


def frequent_pre_tokens(docs: DataFrame, path: str) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their lengths in ids."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, counts = cached(path), Counter()
        for batch in batches:
            for text in batch["text"]:
                pieces = tokenizer.pre_tokens(text) if text else None
                if pieces:
                    counts.update(pieces if max(map(len, pieces), default=0) <= LONGEST else [p for p in pieces if len(p) <= LONGEST])
            if len(counts) > 8 * SUMMARY_ENTRIES:
                counts = _pruned(counts, 2 * SUMMARY_ENTRIES)
        yield pd.DataFrame({"summary": [pickle.dumps(dict(_pruned(counts, SUMMARY_ENTRIES)))]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for data in batch["summary"]:
                counts.update(pickle.loads(data))
                if len(counts) > 4 * TABLE_ENTRIES:
                    counts = _pruned(counts, 2 * TABLE_ENTRIES)
        if counts:
            yield pd.DataFrame({"summary": [pickle.dumps(dict(_pruned(counts, TABLE_ENTRIES)))]})

    merged = docs.select("text").mapInPandas(summarise, "summary binary").repartition(8).mapInPandas(merge, "summary binary")
    total: Counter = Counter()
    for row in merged.toLocalIterator():  # at most 8 rows of bounded size
        total.update(pickle.loads(row["summary"]))
        total = _pruned(total, TABLE_ENTRIES)
    tokenizer = cached(path)
    return {item: len(tokenizer.encode_piece(item)) for item in total}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = cached(path)
        tiers = Tier(table.value, tokenizer.lengths)
        for batch in batches:
            totals = [tokenizer.count(text, tiers) if text else 0 for text in batch["text"]]
            yield pd.DataFrame({"doc_id": ids_of(batch, "doc_id"), "n_bytes": batch["n_bytes"].to_numpy(), "n_tokens": totals})

    rows = docs.select(*id_columns("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
