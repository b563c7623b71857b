"""Queries of stored indexes, positions, ingestion, symbols, highlights and feeds over the test tables, each with SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranking, text
from .functions.tables import LANGUAGES, SYMBOL_KINDS
from .operators import postings
from .operators.search import Engine, frames, kind_label, report_heading, search_symbols, symbols_with_files
from .operators.store import Store, budget_segments
from .queries import _CONTEXT, _EVENTS, _SIGNALS, _SYMBOLS, FILES, FOLD, FOLDED, GRAMS, LINES, _changes, _found, _has, _symbols, engine, query
from .sources import highlights
from .sources.corpus import NOW, as_files, directory_files, document_files, excluded
from .sources.ignore import IgnoreRules
from .sources.symbols import extract_symbols
from .streaming.changes import catch_up, hybrid, last_of_path, relevant


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


# Postings with raw bytes, to read, and with places.

_PLACES = f"""{FILES}, coded AS (SELECT *, hex(encode({FOLDED})) AS digits FROM files), places AS (
  SELECT segment_id, file_id, digits, unnest(range(0, length(digits) // 2 - 2)) AS i FROM coded),
found AS (SELECT segment_id, file_id, ('0x' || substr(digits, 2 * i + 1, 6))::INT AS trigram, i::INT AS place FROM places)"""


@query(f"WITH {GRAMS.replace(FOLDED, 'content')} SELECT trigram, count(*) AS df FROM postings GROUP BY trigram")
def raw_trigrams(spark, sf_dir):
    return postings.statistics(postings.build(document_files(spark, sf_dir), folded=False))


_BYTES = ", ".join(f"(trigram // {1 << s}) % 256 AS b{i}" for i, s in enumerate((16, 8, 0)))
_SHOWN = " || ".join(f"CASE WHEN b{i} BETWEEN 32 AND 126 THEN chr(b{i}::INT) ELSE '\\x' || printf('%02x', b{i}::INT) END" for i in range(3))


@query(f"WITH {GRAMS}, bytes AS (SELECT DISTINCT trigram, {_BYTES} FROM postings) SELECT trigram, printf('%06X', trigram) AS digits, {_SHOWN} AS shown FROM bytes")
def trigram_display(spark, sf_dir):
    t = F.col("trigram")
    return postings.statistics(postings.build(document_files(spark, sf_dir))).select("trigram", text.trigram_hex(t).alias("digits"), text.trigram_text(t).alias("shown"))


@query(f"WITH {_PLACES} SELECT segment_id, file_id, trigram, place AS \"at\" FROM found WHERE trigram IN ({', '.join(map(str, text.trigrams_of('ungen')))})")
def positional_lookup(spark, sf_dir):
    return postings.look_up_places(postings.build_positional(document_files(spark, sf_dir)), text.trigrams_of("ungen"))


@query(f"WITH {_PLACES} SELECT segment_id, file_id, i::INT AS \"at\" FROM places WHERE substr(digits, 2 * i + 1, 12) = '{b'the of'.hex().upper()}'")
def phrase_positions(spark, sf_dir):
    return postings.phrase_places(postings.build_positional(document_files(spark, sf_dir)), text.trigrams_of("the of"))


@query(f"WITH {_PLACES} SELECT segment_id, trigram, count(*) AS n, sum(file_id * 7 + place)::BIGINT AS places FROM found GROUP BY ALL")
def positional_round_trip(spark, sf_dir):
    rows = postings.decoded_places(postings.build_encoded_places(document_files(spark, sf_dir)))
    return rows.groupBy("segment_id", "trigram").agg(F.count("*").alias("n"), F.sum(F.col("file_id") * 7 + F.col("at")).alias("places"))


@query(f"WITH {GRAMS} SELECT trigram, segment_id, file_id * 65537 + {1 << 40} AS file_id FROM postings")
def wide_ids_round_trip(spark, sf_dir):
    """Ids far apart and above 2^35."""
    rows = postings.build(document_files(spark, sf_dir)).withColumn("file_id", F.col("file_id") * 65537 + F.lit(1 << 40))
    return postings.decoded_lists(postings.encoded_lists(rows))


# Regular expressions of the query language, through the index.

_DIALECT = {
    r"\p{Lu}\p{Ll}+ung": r"\p{Lu}\p{Ll}+ung", r"\x{54}he\z|ende?\.?\z": r"\x{54}he\z|ende?\.?\z", r"(?P<n_1>d)er": r"(?P<n_1>d)er", r"[[:alpha:]]+[[:punct:]] [[:upper:]][^[:lower:]]": r"[[:alpha:]]+[[:punct:]] [[:upper:]][^[:lower:]]",
    r"(?i)DIE [a-z]+UNG": r"(?i)DIE [a-z]+UNG", r"(?m)^[A-Z][a-z]+\.$": r"(?m)^[A-Z][a-z]+\.$", r"(?s)tion.{0,3}the|(?x) un d \s the # x": r"(?s)tion.{0,3}the|und\sthe", r"(?:th|st)(?:at|er)ion": r"(?:th|st)(?:at|er)ion",
}


@query(" UNION ALL ".join(f"SELECT {i} AS pattern, file_id FROM ({_found(f'''regexp_matches(content, '{sql}')''')})" for i, sql in enumerate(_DIALECT.values())))
def regex_dialect(spark, sf_dir):
    e, out = engine(spark, sf_dir, indexed=True), None
    for i, pattern in enumerate(_DIALECT):
        rows = e.matches(f"/{pattern}/").select(F.lit(i).alias("pattern"), "file_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {FILES} SELECT file_id FROM files WHERE language IS DISTINCT FROM 'Rust' OR file_id % 9 = 0")
def unknown_language(spark, sf_dir):
    """A file without a language is no Rust file."""
    files = document_files(spark, sf_dir).withColumn("language", F.when(F.col("file_id") % 9 != 0, F.col("language")))
    return Engine(files).matches("NOT lang:rust").select("file_id")


@query(_found(f"language IN ('Rust', 'Python') AND starts_with(path, 'src1') AND {_has('und')}"))
def filtered_search(spark, sf_dir):
    return engine(spark, sf_dir).filtered("und", ("rs", "python"), "src1").select("file_id", "path")


# Stored indexes.

_stores: dict[tuple[str, str], Store] = {}
_INDEXED = "path", "content", "language", "size_bytes", "line_count", "mtime"


def _new_store(spark: SparkSession, files: DataFrame, name: str, budget: int = 1 << 20) -> Store:
    store = Store(spark, work_folder(spark, name), budget)
    store.add(files.select(*_INDEXED))
    return store


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The documents as files in a store, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        _stores[key] = _new_store(spark, document_files(spark, sf_dir), "store", 8 << 20)
    return _stores[key]


@query(f"WITH {FILES} SELECT path FROM files WHERE {_has('the of')} OR regexp_matches(content, 'ver[0-9]|(un|er)gen')")
def index_lookup(spark, sf_dir):
    return stored(spark, sf_dir).engine(NOW).matches('"the of" OR /ver[0-9]|(un|er)gen/').select("path")


@query(f"WITH {_SIGNALS} SELECT path, score, match_count FROM ranked ORDER BY score DESC, path LIMIT 20")
def index_ranked(spark, sf_dir):
    return Engine.top(stored(spark, sf_dir).engine(NOW).search("und").withColumn("score", F.round("score", 6)), 20).select("path", "score", "match_count")


@query(f"WITH {GRAMS} SELECT trigram, count(*) AS df FROM postings GROUP BY trigram")
def index_statistics(spark, sf_dir):
    return postings.statistics(stored(spark, sf_dir)._table("postings", None))


@query(f"WITH {FILES}, versions AS (SELECT path, content, file_id FROM files) SELECT path, md5(CASE WHEN file_id % 5 = 1 THEN content || '+' ELSE content END) AS digest FROM versions WHERE file_id % 5 <> 0")
def store_delete(spark, sf_dir):
    """Every file is there twice; then a fifth is deleted, a fifth changed, a fifth sent again as it is."""
    return _changed_store(spark, sf_dir).files().select("path", F.md5("content").alias("digest"))


def _changed_store(spark: SparkSession, sf_dir: str) -> Store:
    files = document_files(spark, sf_dir)
    store = _new_store(spark, files.withColumn("content", F.concat("content", F.lit(" old"))), "changed")
    store.add(files.select(*_INDEXED))
    kind = F.element_at(F.array(*map(F.lit, ("Deleted", "Modified", "Created", "", ""))), (F.col("file_id") % 5 + 1).cast("int"))
    changes = files.select("path", kind.alias("kind")).where("kind <> ''")
    store.apply(changes, files.withColumn("content", F.when(F.col("file_id") % 5 == 1, F.concat("content", F.lit("+"))).otherwise(F.col("content"))))
    return store


@query(f"WITH {FILES} SELECT path, md5(CASE WHEN file_id % 5 = 1 THEN content || '+' ELSE content END) AS digest, 0 AS dead FROM files WHERE file_id % 5 <> 0")
def store_compact(spark, sf_dir):
    """The same after compaction and recovery: nothing is dead, and only the new segments are there."""
    store = _changed_store(spark, sf_dir)
    store.compact()
    store.recover()
    return store.files().select("path", F.md5("content").alias("digest"), F.lit(store.status()["tombstones"]).alias("dead"))


@query(f"WITH {FILES} SELECT path, md5(content) AS digest FROM files")
def store_recover(spark, sf_dir):
    """A writer ended between its folders and its manifest, and left a manifest that is cut off."""
    files = document_files(spark, sf_dir)
    store = _new_store(spark, files, "recover")
    manifest = store.manifest()
    store.add(files.select(*_INDEXED).limit(3), manifest)
    path, fs = store.manifests.path(f"manifest_{manifest['number'] + 1:08d}.json")
    out = fs.create(path, True)
    out.write(bytearray(b'{"version": 2, "adds": ['))
    out.close()
    store.recover()
    return store.files().select("path", F.md5("content").alias("digest"))


@query(f"WITH {FILES} SELECT 2 * count(*) + count(*) FILTER (WHERE file_id % 5 = 1) AS files, 2 * count(*) FILTER (WHERE file_id % 5 < 2) AS tombstones, 2 * count(*) - 2 * count(*) FILTER (WHERE file_id % 5 = 0) - count(*) FILTER (WHERE file_id % 5 = 1) AS live_files FROM files")
def store_status(spark, sf_dir):
    status = _changed_store(spark, sf_dir).status()
    return spark.createDataFrame([(status["files"], status["tombstones"], status["live_files"])], "files long, tombstones long, live_files long")


@query(f"WITH {FILES} SELECT path, size_bytes, (coalesce(sum(size_bytes) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100000)::BIGINT AS segment FROM files")
def budget_batches(spark, sf_dir):
    return budget_segments(document_files(spark, sf_dir), 100_000)


@query(f"""WITH {FILES} SELECT path, md5(content || CASE WHEN file_id % 2 = 0 THEN '+' ELSE '' END) AS digest FROM files WHERE file_id % 3 <> 0""")
def catch_up_flow(spark, sf_dir):
    """An index lacks multiples of 5; of what is there multiples of 3 are gone and even files have changed."""
    files = document_files(spark, sf_dir)
    store = _new_store(spark, files.where("file_id % 5 <> 0"), "catch-up")
    catch_up(store, files.where("file_id % 3 <> 0").withColumn("content", F.concat("content", F.when(F.col("file_id") % 2 == 0, "+").otherwise(""))), now=NOW)
    return store.files().select("path", F.md5("content").alias("digest"))


# Results as they are shown.


@query(f"WITH {FILES} SELECT path FROM files WHERE {_has('ungen')}")
def streamed_results(spark, sf_dir):
    rows = [(r["path"],) for r in stored(spark, sf_dir).engine(NOW).stream("ungen")]
    return spark.createDataFrame(rows, "path string")


@query(f"""WITH {LINES}, hits AS (SELECT * FROM line_rows WHERE contains({FOLD.format('line')}, 'und')), totals AS (SELECT count(DISTINCT file_id) AS files, count(*) AS lines FROM hits)
SELECT lines AS total_matches, files AS files_matched, ceil(files / 7.0)::BIGINT AS total_pages, least(7, files - 14) AS shown, files > 21 AS has_next FROM totals""")
def page_totals(spark, sf_dir):
    rows, stats = engine(spark, sf_dir).page("und", 3, 7)
    return spark.createDataFrame([(stats["total_matches"], stats["files_matched"], stats["total_pages"], rows.count(), stats["has_next"])], "total_matches long, files_matched long, total_pages long, shown long, has_next boolean")


@query(f"""{_CONTEXT}, shown AS (SELECT l.path, b.block, count(*) AS n FROM line_rows l JOIN blocks b ON l.path = b.path AND l.line_number BETWEEN b.lo - 1 AND b.hi + 1 GROUP BY ALL)
SELECT path, count(*) AS blocks, sum(n)::BIGINT AS shown FROM shown GROUP BY path""")
def search_options(spark, sf_dir):
    rows = engine(spark, sf_dir).with_options("tionen", context=1)
    return rows.select("path", F.size("blocks").cast("long").alias("blocks"), F.size(F.flatten("blocks")).cast("long").alias("shown"))


@query(f"""WITH {LINES}, totals AS (SELECT count(DISTINCT file_id) AS files, count(*) AS lines FROM line_rows WHERE contains({FOLD.format('line')}, 'und'))
SELECT 'Found ' || lines || ' matches across ' || files || ' files (showing 11-15, offset=10)' || CASE WHEN files > 100 THEN chr(10) || 'Tip: Consider narrowing with path:, language:, or a more specific query.' ELSE '' END AS text FROM totals""")
def report_summary(spark, sf_dir):
    totals = engine(spark, sf_dir).search("und").agg(F.count("*").alias("files"), F.sum(F.size("lines")).alias("lines"))
    return report_heading(totals, 5, 10)


@query(f"""WITH {LINES}, hits AS (SELECT path, count(*) AS n FROM line_rows WHERE contains({FOLD.format('line')}, 'ungen') GROUP BY path)
SELECT 'result' AS event, path, n AS lines FROM hits UNION ALL SELECT 'stats', NULL, sum(n)::BIGINT FROM hits UNION ALL SELECT 'done', NULL, NULL""")
def event_frames(spark, sf_dir):
    rows = frames(engine(spark, sf_dir).search("ungen"))
    lines = F.coalesce(F.get_json_object("data", "$.total_matches").cast("long"), F.size(F.from_json(F.get_json_object("data", "$.lines"), "array<struct<line_number:int>>")).cast("long"))
    return rows.select("event", F.get_json_object("data", "$.path").alias("path"), F.when(F.col("event") != "done", lines).alias("lines"))


@query(f"WITH {FILES} SELECT path, CASE WHEN contains('doc_' || file_id, 'doc_1') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM files")
def file_name_score(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", ranking.name_score(F.col("path"), "Doc_1").alias("score"))


# Symbols and highlights.

_CODE = "'pub fn get_' || p_partkey || '() {{}}' || chr(10) || 'struct S' || p_partkey || '; enum E_' || p_partkey || ' {{}}' || chr(10) || '    fn m' || p_partkey || '(&self) {{}}' || chr(10) || 'é; fn uni_' || p_partkey || '() {{}} // fn no()'"


@query("""WITH found AS (SELECT p_partkey AS k, unnest([{'name': 'get_', 'kind': 'Function', 'line': 1, 'at': 7}, {'name': 'S', 'kind': 'Struct', 'line': 2, 'at': 7}, {'name': 'E_', 'kind': 'Enum', 'line': 2, 'at': 15 + length(p_partkey::VARCHAR)},
  {'name': 'm', 'kind': 'Method', 'line': 3, 'at': 7}, {'name': 'uni_', 'kind': 'Function', 'line': 4, 'at': 7}]) AS s FROM part)
SELECT 'src/' || k || '.rs' AS path, 'Rust' AS language, s.name || k AS name, s.kind AS kind, s.line AS line, s.at::INT AS "column" FROM found""")
def symbols_extracted(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    code = c("pub fn get_", key, "() {}\nstruct S", key, "; enum E_", key, " {}\n    fn m", key, "(&self) {}\né; fn uni_", key, "() {} // fn no()")
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("src/", key, ".rs").alias("path"), F.lit("Rust").alias("language"), code.alias("content"))
    return extract_symbols(files)


_SEGMENTED = f"{_SYMBOLS}, segmented AS (SELECT name, kind, 'src/' || line % 50 || '.rs' AS path, language, line % 20 AS line, line % 3 AS segment_id, line AS file_id FROM symbols)"


def _segmented(spark, sf_dir):
    line = F.col("line")
    return _symbols(spark, sf_dir).withColumn("file_id", line).withColumn("segment_id", line % 3).withColumn("path", F.concat(F.lit("src/"), (line % 50).cast("string"), F.lit(".rs"))).withColumn("line", line % 20)


@query(f"""WITH {_SEGMENTED} SELECT name, path, line, segment_id, file_id FROM segmented WHERE contains({FOLD.format('name')}, 'red')
QUALIFY row_number() OVER (PARTITION BY path, name, line ORDER BY segment_id DESC, file_id DESC) = 1""")
def symbol_newest(spark, sf_dir):
    return search_symbols(_segmented(spark, sf_dir), "Red", limit=1 << 30).select("name", "path", "line", "segment_id", "file_id")


@query(f"WITH {FILES}, {_SEGMENTED} SELECT s.name, s.kind, f.path, f.language, f.size_bytes FROM segmented s JOIN files f ON s.file_id = f.file_id AND s.segment_id = f.segment_id % 3")
def symbol_metadata(spark, sf_dir):
    files = document_files(spark, sf_dir).withColumn("segment_id", F.col("segment_id") % 3)
    return symbols_with_files(_segmented(spark, sf_dir), files).select("name", "kind", "path", "language", "size_bytes")


_LABELS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, (label, _) in SYMBOL_KINDS.items()) + " END"


@query(f"WITH {_SYMBOLS} SELECT line, {_LABELS} AS label, list_position([{', '.join(repr(k) for k in SYMBOL_KINDS)}], kind) - 1 AS code, kind FROM symbols")
def kind_codes(spark, sf_dir):
    kind = F.col("kind")
    return _symbols(spark, sf_dir).select("line", kind_label(kind).alias("label"), text.kind_code(kind).alias("code"), text.kind_of_code(text.kind_code(kind)).alias("kind"))


_LANGUAGE_LIST = ", ".join(f"'{x}'" for x in LANGUAGES)


@query(f"SELECT p_partkey, coalesce([{_LANGUAGE_LIST}][p_partkey % 70 + 1], 'Unknown') AS language, CASE WHEN p_partkey % 70 < {len(LANGUAGES)} THEN p_partkey % 70 ELSE 65535 END::INT AS code FROM part")
def language_codes(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 70 < len(LANGUAGES), F.col("p_partkey") % 70).otherwise(text.NO_LANGUAGE).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.language_of_code(code).alias("language"))
    return rows.withColumn("code", text.language_code(F.col("language")))


def _spans(content: str, language: str) -> list[tuple[int, int, int]]:
    """For the tests: ASCII words, and each digit and capital in them, in bytes."""
    import re

    return [(m.start(), m.end(), highlights.CODES[kind]) for kind, pattern in (("Variable", rb"[A-Za-z0-9]+"), ("Number", rb"[0-9]"), ("Type", rb"[A-Z]")) for m in re.finditer(pattern, content.encode())]


@query(f"""WITH {FILES}, chars AS (SELECT file_id, unnest(string_split(content, '')) AS ch, generate_subscripts(string_split(content, ''), 1) AS i FROM files WHERE content <> ''),
placed AS (SELECT *, 1 + coalesce(sum((ch = chr(10))::INT) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, octet_length(encode(ch)) AS len,
  CASE WHEN regexp_matches(ch, '^[0-9]$') THEN 'Number' WHEN regexp_matches(ch, '^[A-Z]$') THEN 'Type' WHEN regexp_matches(ch, '^[a-z]$') THEN 'Variable' ELSE 'Plain' END AS kind FROM chars),
marked AS (SELECT *, (lag(kind) OVER w IS DISTINCT FROM kind)::INT AS fresh FROM placed WINDOW w AS (PARTITION BY file_id, line ORDER BY i)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id, line ORDER BY i) - 1 AS place FROM marked)
SELECT file_id, line::INT AS line, place::INT AS place, sum(len)::INT AS len, any_value(kind) AS kind FROM runs GROUP BY file_id, line, place""")
def highlight_round_trip(spark, sf_dir):
    """Overlapping spans, painted; a word lies below its digits and capitals."""
    rows = highlights.decoded(highlights.highlights(document_files(spark, sf_dir), ("file_id",), _spans))
    return rows.select("file_id", "line", "place", "len", "kind")


# Numbers, paths and other text.


def _odd_number(column):
    return column * column * 1000 + 7


_N = "(p_partkey * p_partkey * 1000 + 7)"


def _scaled_sql(digits: int) -> str:
    size = lambda unit, power: f"printf('%.{digits}f {unit}', {_N} / {float(1 << 10 * power)}::DOUBLE)"
    return f"CASE WHEN {_N} < 1024 THEN {_N} || ' B' WHEN {_N} < {1 << 20} THEN {size('KB', 1)} WHEN {_N} < {1 << 30} THEN {size('MB', 2)} ELSE {size('GB', 3)} END"


@query(f"""SELECT p_partkey, {_scaled_sql(2)} AS human, {_scaled_sql(1)} AS short,
CASE WHEN {_N} < 60 THEN 'just now' WHEN {_N} < 3600 THEN {_N} // 60 || 'm ago' WHEN {_N} < 86400 THEN {_N} // 3600 || 'h ago' ELSE {_N} // 86400 || 'd ago' END AS ago FROM part""")
def number_formats(spark, sf_dir):
    n = _odd_number(F.col("p_partkey"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.human_bytes(n).alias("human"), text.format_size(n).alias("short"), text.relative_time(n).alias("ago"))


@query("SELECT p_partkey, url_encode(p_name || '/é ~*+&?' || p_brand) AS encoded FROM part")
def url_encoding(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.url_encode(F.concat("p_name", F.lit("/é ~*+&?"), "p_brand")).alias("encoded"))


@query(f"WITH {FILES} SELECT file_id, CASE WHEN starts_with(path, 'src1/en/') THEN substr(path, 9) WHEN starts_with(path, 'src1/') THEN '../' || substr(path, 6) ELSE '../../' || path END AS seen, '/repo/' || path AS whole FROM files")
def path_rewrite(spark, sf_dir):
    path = F.col("path")
    return document_files(spark, sf_dir).select("file_id", text.rewritten_path(path, "src1/en").alias("seen"), text.rewritten_path(path, root="/repo/").alias("whole"))


@query(f"WITH {FILES} SELECT file_id, path FROM files WHERE regexp_matches(path, '^src[0-4]/[^/]*/doc_[^/2][^/2][^/2]?[.](rs|py)$')")
def glob_classes(spark, sf_dir):
    return document_files(spark, sf_dir).where(F.col("path").rlike(text.glob_regex("src[0-4]/*/doc_[!2][!2]{,[!2]}.{rs,py}"))).select("file_id", "path")


@query(f"WITH {FILES} SELECT file_id, path FROM files WHERE NOT (path LIKE '%1.rs' OR path LIKE 'src0/%' OR regexp_matches(path, '(^|/)doc_.[.]py$'))")
def exclude_globs(spark, sf_dir):
    return document_files(spark, sf_dir).where(~excluded(F.col("path"), ("*1.rs", "src0/*", "doc_?.py"))).select("file_id", "path")


_RULES = "*.rs\n!doc_1*.rs\nen/\n/src1/*/*.md\nsrc2/**/doc_*.py\n# nothing\n"


@query(f"""WITH {FILES} SELECT file_id, path FROM files WHERE NOT (lang_dir = 'en' OR (ext = 'rs' AND NOT starts_with(name, 'doc_1')) OR (starts_with(path, 'src1/') AND ext = 'md') OR (starts_with(path, 'src2/') AND ext = 'py'))""".replace("FROM files WHERE", "FROM (SELECT *, string_split(path, '/')[2] AS lang_dir, string_split(path, '/')[3] AS name, string_split(path, '.')[-1] AS ext FROM files) WHERE"))
def ignore_rules(spark, sf_dir):
    return document_files(spark, sf_dir).where(~IgnoreRules([("", _RULES)]).column(F.col("path"))).select("file_id", "path")


# What is read from folders and feeds.


@query("""SELECT file_id, path, size_bytes, line_count, md5(content) AS digest FROM (
  SELECT doc_id AS file_id, 'd/' || doc_id || '.py' AS path, length(t)::BIGINT AS size_bytes, length(t) - length(replace(t, chr(10), '')) AS line_count, regexp_replace(t, '[^\\x00-\\x7F]', chr(65533), 'g') AS content
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\xFF]', '?', 'g') AS t FROM documents)) WHERE file_id % 7 <> 0 AND file_id % 11 <> 0""")
def odd_bytes(spark, sf_dir):
    """Files in Latin-1, with NUL bytes, and with unsafe paths."""
    k = F.col("doc_id")
    content = F.encode(F.coalesce("text", F.lit("")), "ISO-8859-1")
    path = F.concat(F.when(k % 11 == 0, F.lit("../d/")).otherwise(F.lit("d/")), k.cast("string"), F.lit(".py"))
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path.alias("path"), F.when(k % 7 == 0, F.concat(F.lit(b"\0"), content)).otherwise(content).alias("content"))
    files = as_files(raw.select("path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(NOW).alias("mtime")))
    return files.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("file_id"), "path", "size_bytes", "line_count", F.md5("content").alias("digest"))


@query("""SELECT CASE n_nationkey % 6 WHEN 0 THEN n_name || '.rs' WHEN 5 THEN 'sub/' || n_name || '.py' END AS path, CASE n_nationkey % 6 WHEN 0 THEN 'Rust' ELSE 'Python' END AS language, length(n_name) + 1 AS size_bytes FROM nation WHERE n_nationkey % 6 IN (0, 5) AND NOT (n_nationkey % 6 = 5 AND n_nationkey % 4 = 1)""")
def directory_walk(spark, sf_dir):
    """A written folder: sources; logs that a rule ignores; a hidden file; a picture; a folder that is ignored; and a folder
    with rules of its own."""
    root = work_folder(spark, "walk")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def put(name: str, data: bytes) -> None:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(data))
        out.close()

    put(".gitignore", b"*.log\nout/\n")
    names = [(r["n_nationkey"], r["n_name"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()]  # 25 rows
    put("sub/.gitignore", "".join(f"{n}.py\n" for k, n in names if k % 4 == 1).encode())
    for k, n in names:
        put([f"{n}.rs", f"{n}.log", f".{n}.rs", f"{n}.png", f"out/{n}.rs", f"sub/{n}.py"][k % 6], f"{n}\n".encode())
    return directory_files(spark, root).select("path", "language", "size_bytes")


@query(f"WITH {_EVENTS}, fed AS (SELECT * FROM changes WHERE event_id % 2 = 0 UNION ALL SELECT * FROM changes WHERE event_id % 3 = 0) SELECT path, kind, event_id FROM fed QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1")
def hybrid_feed(spark, sf_dir):
    """What a watcher and a poll saw, some of it both."""
    changes = _changes(spark, sf_dir)
    return last_of_path(hybrid(changes.where("event_id % 2 = 0"), changes.where("event_id % 3 = 0")))


@query(f"WITH {_EVENTS} SELECT event_id FROM changes WHERE event_id % 5 NOT IN (1, 2, 3)")
def relevant_changes(spark, sf_dir):
    """Changes in .git, in the index's folder, and of ignored files are not told."""
    start = F.element_at(F.array(*map(F.lit, ("", "a/.git/", ".lodestone/", "tmp/", ".gitx/"))), (F.col("event_id") % 5 + 1).cast("int"))
    changes = _changes(spark, sf_dir).withColumn("path", F.concat(start, "path"))
    return relevant(changes, IgnoreRules([("", "tmp/\n")])).select("event_id")
