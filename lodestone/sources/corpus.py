"""Files to search: a directory tree, or the test tables seen as files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import MAX_FILE_SIZE
from ..functions.text import file_name, indexable, is_binary_path, is_unsafe_path, language_of, newline_count, simple_glob_regex
from .ignore import IgnoreRules

NOW = 1_700_000_000
#: Extension and language by the remainder of doc_id by 8, for the table of documents seen as files.
DEMO_EXTENSIONS = (("rs", "Rust"), ("py", "Python"), ("ts", "TypeScript"), ("go", "Go"), ("md", "Markdown"), ("toml", "TOML"), ("java", "Java"), ("sh", "Shell"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents as files: file_id, content, path, language, segment_id, size_bytes, line_count, mtime."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.coalesce("text", F.lit(""))
    kind = (F.col("doc_id") % 8 + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in DEMO_EXTENSIONS]), kind)
    return docs.select(
        F.col("doc_id").alias("file_id"), content.alias("content"), F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), pick(0)).alias("path"), pick(1).alias("language"),
        F.floor(F.col("doc_id") / 64).cast("long").alias("segment_id"), F.octet_length(content).cast("long").alias("size_bytes"), newline_count(content).cast("long").alias("line_count"), (F.lit(NOW) - F.col("doc_id") * 86400).alias("mtime"),
    )


#: Names of files with ignore rules, the later ones stronger, and folders that are never read.
IGNORE_FILES, SKIPPED = (".gitignore", ".ignore", ".lodestoneignore"), (".git", ".lodestone")


def text_of(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes the replacement character, so one odd file does not end a job."""
    return F.make_valid_utf8(content.cast("string"))


def as_files(raw: DataFrame) -> DataFrame:
    """Files from (path, content as bytes, size_bytes, mtime): unsafe, binary and very large ones are left out."""
    rows = raw.where(indexable(F.col("path"), F.col("content"), F.col("size_bytes")) & ~is_unsafe_path(F.col("path")))
    text = text_of(F.col("content"))
    return rows.select("path", text.alias("content"), language_of(F.col("path")).alias("language"), "size_bytes", newline_count(text).cast("long").alias("line_count"), "mtime", F.sha2("content", 256).alias("content_hash"))


def excluded(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether any glob matches the name or the whole path; * and ? alone are special there and match slashes too."""
    out = F.lit(False)
    for glob in globs:
        pattern = simple_glob_regex(glob)
        out = out | path.rlike(pattern) | file_name(path).rlike(pattern)
    return out


def _file_system(uri: str):
    """(an Arrow file system, the path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _listed(uri: str, recursive: bool = True) -> list[tuple[str, int, int, bool]]:
    """(path, size, seconds of change, whether a folder) below a folder. Links are not followed."""
    from pyarrow import fs

    system, base = _file_system(uri)
    out: list[tuple[str, int, int, bool]] = []
    if system.type_name == "local":
        for folder, folders, names in os.walk(base):
            folders[:] = [f for f in folders if f not in SKIPPED and not os.path.islink(os.path.join(folder, f))]
            if not recursive:
                out += [(os.path.join(folder, f), 0, 0, True) for f in folders]
                folders[:] = []
            for name in names:
                path = os.path.join(folder, name)
                if not os.path.islink(path) and os.path.isfile(path):
                    facts = os.stat(path)
                    out.append((path, facts.st_size, int(facts.st_mtime), False))
        return out
    for info in system.get_file_info(fs.FileSelector(base, recursive=recursive)):
        folder = info.type == fs.FileType.Directory
        if not folder or not recursive:
            out.append((info.path, info.size or 0, int((info.mtime_ns or 0) // 10**9), folder))
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below the root, uri, size_bytes, mtime) of all files. The folders in the root are listed by the executors.
    Spark's own reader does not serve: it passes over names that begin with a line or a dot, such as __init__.py."""
    system, base = _file_system(root)
    base = base.rstrip("/")
    entries = _listed(root, recursive=False)
    scheme = "file://" if system.type_name == "local" else root.partition("://")[0] + "://"
    rows = [(p[len(base) + 1 :], scheme + p, n, t) for p, n, t, folder in entries if not folder]
    folders = [(scheme + p,) for p, _, _, folder in entries if folder and p.rpartition("/")[2] not in SKIPPED]
    schema = "path string, uri string, size_bytes long, mtime long"

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                found = [(p[len(base) + 1 :], scheme + p, n, t) for p, n, t, _ in _listed(uri)]
                yield pd.DataFrame(found, columns=["path", "uri", "size_bytes", "mtime"])

    out = spark.createDataFrame(rows, schema)
    if folders:
        parts = min(len(folders), 10 * spark.sparkContext.defaultParallelism)
        out = out.unionByName(spark.createDataFrame(folders, "uri string").repartition(parts).mapInPandas(below, schema))
    return out


#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20


def contents_of(files: DataFrame) -> DataFrame:
    """Files (path, uri, size_bytes, mtime) with their bytes as `content`; a file that is gone is left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                data: list[bytes | None] = []
                for uri in part["uri"]:
                    try:
                        system, path = _file_system(uri)
                        with system.open_input_file(path) as stream:
                            data.append(stream.read())
                    except FileNotFoundError:
                        data.append(None)
                out = part.assign(content=data)
                yield out[[d is not None for d in data]]

    total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    n = max(1, files.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
    return files.select("path", "uri", "size_bytes", "mtime").repartition(n).mapInPandas(read, "path string, uri string, size_bytes long, mtime long, content binary").drop("uri")


def directory_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include_hidden: bool = False, ignore: bool = True, extra_rules: str = "") -> DataFrame:
    """Text files below a folder: path, content, language, size_bytes, line_count, mtime, content_hash.  Left out are binary
    and very large files, hidden ones, those in the folders SKIPPED, what matches an exclude glob, and what the ignore
    files in the folders say (and .git/info/exclude, and `extra_rules`, which are weakest, such as a user's own file of
    them).  What is left out by its path or size is not read."""
    listed = list_files(spark, root)
    raw = listed.where(~F.col("path").rlike(r"(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    if not include_hidden:
        raw = raw.where(~F.col("path").rlike(r"(^|/)\.[^/]"))
    if exclude:
        raw = raw.where(~excluded(F.col("path"), exclude))
    if ignore:
        names = F.substring_index("path", "/", -1)
        # One row a folder that has rules; the rules of a whole tree are text of a few kilobytes.
        found = [(r["path"], bytes(r["content"]).decode("utf-8", "replace")) for r in contents_of(listed.where(names.isin(*IGNORE_FILES))).select("path", "content").collect()]
        found.sort(key=lambda x: (x[0].count("/"), x[0].rpartition("/")[0], IGNORE_FILES.index(x[0].rpartition("/")[2])))
        rules = [("", extra_rules), ("", _git_excludes(root)), *((p.rpartition("/")[0], text) for p, text in found)]
        own = IgnoreRules(rules)
        if own.rules:
            raw = raw.where(~own.column(F.col("path")))
    raw = raw.where(~is_binary_path(F.col("path")) & (F.col("size_bytes") <= MAX_FILE_SIZE))
    return as_files(contents_of(raw))


def _git_excludes(root: str) -> str:
    system, base = _file_system(root)
    try:
        with system.open_input_file(f"{base.rstrip('/')}/.git/info/exclude") as stream:
            return stream.read().decode("utf-8", "replace")
    except (FileNotFoundError, OSError):
        return ""
