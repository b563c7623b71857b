"""Token ids in a word-aligned binary format (Simple-8b) and back.

Documents are put in ascending order of doc_id by ranges, encoded, and written in blocks of whole documents.  In a block
ids are packed into 64-bit words: the top 4 bits select how many ids of how many bits fill the other 60.  Ids of
ESCAPE_BITS bits or more are written as 0 and listed as escapes with their positions.  A block holds its offset in its
part (`first`), so that blocks decode independently and whole blocks decode with array operations.

A file set is a Parquet folder written by Spark, so it can lie in any store; its rows are blocks:
part, block, first, n_ids, doc_ids, doc_nulls, lengths, words, escape_at, escape_value (binary, little-endian).

Cases: a null or empty text is the end id alone; null doc_ids come first; rows with equal ids follow each other in any
order; texts of any length are one document in one block; an empty table gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_columns, small_batches, tidy, work_path
from .tokens import cached, tokenizer_path

END_ID = 2
BLOCK_IDS = 1 << 16
#: Ids in a word and bits of each, by selector. Selectors 0 and 1 are runs of zeros.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE_BITS = 20

BLOCK_SCHEMA = "part int, block int, first long, n_ids long, doc_ids binary, doc_nulls binary, lengths binary, words binary, escape_at binary, escape_value binary"


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escape positions, escape values) of unsigned ids."""
    values = ids.astype(np.uint64)
    at = np.flatnonzero(values >= np.uint64(1 << ESCAPE_BITS)).astype(np.uint32)
    escaped = values[at]
    values = values.copy()
    values[at] = 0
    n = len(values)
    # For every position the selector that takes most ids from there; the chain of jumps then gives the words.
    width = np.frexp(values.astype(np.float32))[1].astype(np.int8)  # bits; exact below 2^24
    narrow = np.cumsum(np.bincount(width, minlength=ESCAPE_BITS + 1))
    # Any 3 ids fit a word, as none has more than ESCAPE_BITS bits; at the end there are 2 or 1.
    best = np.full(n, 13, np.int8)
    best[-2:] = (14, 15)[2 - min(n, 2) :]
    for s in range(12, -1, -1):
        k, w = COUNTS[s], WIDTHS[s]
        # Long runs of narrow ids are looked for only where such ids are common.
        if k > narrow[min(w, ESCAPE_BITS)] or (k >= 12 and 8 * narrow[w] < n):
            continue
        over = np.concatenate([[0], np.cumsum(width > w, dtype=np.int32)])
        fits = np.flatnonzero(over[k:] == over[:-k])
        best[fits] = s
    jump = np.array(COUNTS)[best].tolist()
    starts, i = [], 0
    add, stop = starts.append, n
    while i < stop:
        add(i)
        i += jump[i]
    starts_a = np.array(starts, np.int64)
    sel = best[starts_a].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        here = np.flatnonzero(sel == s)
        if len(here):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[here] |= np.bitwise_or.reduce(values[starts_a[here][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words, at, escaped


def decode_words(words: np.ndarray, n: int, at: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[sel]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        here = np.flatnonzero(sel == s)
        if len(here):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            out[starts[here][:, None] + np.arange(COUNTS[s])] = (words[here][:, None] >> shifts) & mask
    out = out[:n]
    out[at] = escaped
    return out


def write_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, parts: int | None = None) -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to the folder `out`."""
    path = path or tokenizer_path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokenizer, part, end = cached(path), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        block, first, doc_ids, chunks, n_held = 0, 0, [], [], 0

        def close() -> pd.DataFrame:
            nonlocal block, first, doc_ids, chunks, n_held
            words, at, escaped = encode_words(np.concatenate(chunks))
            row = (
                part, block, first, n_held, np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.packbits([d is None for d in doc_ids]).tobytes(),
                np.array([len(c) for c in chunks], "<u4").tobytes(), words.astype("<u8").tobytes(), at.astype("<u4").tobytes(), escaped.astype("<u8").tobytes(),
            )
            block, first = block + 1, first + n_held
            doc_ids, chunks, n_held = [], [], 0
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, null, text in zip(batch["doc_id"].tolist(), batch["doc_id_null"].tolist(), batch["text"], strict=True):
                doc_ids.append(None if null else doc_id)
                chunks.append(np.frombuffer(tokenizer.encode(text or "") + end, "<u4"))
                n_held += len(chunks[-1])
                if n_held >= BLOCK_IDS:
                    yield close()
        if chunks:
            yield close()

    # The place of a row in the input divides rows with one id, or none, over ranges.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    by = [F.col("doc_id").asc_nulls_first(), "place"]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*id_columns("doc_id"), "text")
    ordered.mapInPandas(tidy(encode), BLOCK_SCHEMA).write.parquet(out)


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, and ids (binary,
    little-endian uint32) or, for a digest, their unsigned crc32 as ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                lengths = np.frombuffer(b.lengths, "<u4").astype(np.int64)
                ids = decode_words(np.frombuffer(b.words, "<u8"), b.n_ids, np.frombuffer(b.escape_at, "<u4"), np.frombuffer(b.escape_value, "<u8")).astype("<u4")
                ends = np.cumsum(lengths)
                nulls = np.unpackbits(np.frombuffer(b.doc_nulls, np.uint8), count=len(lengths)).astype(bool)
                doc_ids = pd.array(np.frombuffer(b.doc_ids, "<i8"), dtype="Int64")
                doc_ids[nulls] = pd.NA
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                data = {"ids_crc32": [zlib.crc32(x) for x in own]} if digest else {"ids": [x.tobytes() for x in own]}
                yield pd.DataFrame({"doc_id": doc_ids, "start": b.base + b.first + ends - lengths, "n_tokens": lengths, **data})

    # One row a part, so as many as the parameter `parts` says.
    placed = blocks.join(F.broadcast(bases), "part")
    return placed.mapInPandas(tidy(decode), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all ids to a folder beside the checkpoints, reads them back, and gives the digest of each document."""
    out = work_path(docs.sparkSession, "token-ids")
    write_ids(docs, out, path)
    return read_ids(docs.sparkSession, out, digest=True)
