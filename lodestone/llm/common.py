"""Shared helpers: durable intermediate tables, hashing, and hot-safe joins."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: A table of at most this many rows of a few dozen bytes may be broadcast (about 50 MB in the JVM).
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a temporary folder if all runs on one
    machine (tests), else a folder in the warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            key = id(spark.sparkContext)
            base = _own[key] = _own.get(key) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodestone-work"
    return base.rstrip("/")


_own: dict[int, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Rows in a batch that Python workers get: texts may be long, and workers keep what a batch took.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of a batch for Python workers, unless the session has set them itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables of a session, once nothing that was made from them will be read again."""
    for item in [x for x in _written if x[0] is spark]:
        remove(*item)
        _written.remove(item)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None:
            return
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001,S112  the session is ending; the folder's owner clears what is left
            continue


def small_or_shuffled(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` narrow rows, else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


#: A key is hot if it has more than this share of all rows, and so many at least; so there are at most HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 1000, 10_000
#: Bytes of a broadcast table of rows of any width.
BROADCAST_BYTES = 8 << 20


def spread_join(rows: DataFrame, facts: DataFrame, on: str | list[str], weight: str, how: str = "inner", width: Column | None = None) -> DataFrame:
    """rows joined with facts, which has one row for each key and says in `weight` how many of rows have it; `width` is the
    size of a row of facts in bytes.  Few facts are broadcast.  Otherwise the facts of hot keys are (HOT_SHARE of them at
    most), so that their rows stay where they are, and the other rows meet theirs by a shuffle.  Nothing above
    BROADCAST_BYTES is broadcast.  facts must be cheap to read again."""
    size = F.coalesce(F.sum(F.lit(64) if width is None else width), F.lit(0))
    held, total = facts.agg(size, F.coalesce(F.sum(weight), F.lit(0))).first()
    if held <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), on, how)
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = facts.where(F.col(weight) > least)
    n, held = hot.agg(F.count("*"), size).first()
    if not n or held > BROADCAST_BYTES:
        return rows.join(facts, on, how)
    keys = [on] if isinstance(on, str) else on
    rest = rows.join(F.broadcast(hot.select(*keys)), on, "left_anti").join(facts.where(F.col(weight) <= least), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, vectorised."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def tidy(f):
    """f, a function of batches to batches, that gives memory back to the system when a task ends: idle Python workers
    stay beside the executor, and what they keep is missing there."""

    def run(batches):
        import pyarrow as pa

        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


def id_columns(name: str) -> list[Column]:
    """An id for Python workers, as (name, name_null): pandas would make inexact floats of a column with nulls."""
    value = F.col(name).cast("long")
    return [F.coalesce(value, F.lit(0).cast("long")).alias(name), value.isNull().alias(f"{name}_null")]


def ids_of(batch, name: str):
    """The ids of a batch as a nullable array."""
    import pandas as pd

    return pd.arrays.IntegerArray(batch[name].to_numpy(np.int64).copy(), batch[f"{name}_null"].to_numpy(bool).copy())


def words_of(text: str) -> list[bytes]:
    """The runs of characters other than space and U+0009 to U+000D, as UTF-8. bytes.split() cuts at just these."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str) -> list[bytes]:
    """The same with A to Z in lower case; bytes.lower() changes no other characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc_remainder(column, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
