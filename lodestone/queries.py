"""Queries of the search engine over the test tables, each with SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranking, text
from .functions.tables import EXTENSIONS, SYMBOL_KINDS
from .operators import postings, reports
from .operators.search import Engine, indexed_symbols, live, marked, newest, search_symbols, text_report, vimgrep, with_context
from .plans.prune import required
from .plans.query import And, parse
from .sources import git
from .sources.corpus import NOW, document_files
from .streaming.changes import actions, caught_up, event_changes, hash_diff, last_of_path, quiet_sessions, split_renames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FILES = """files AS (SELECT doc_id AS file_id, coalesce(text, '') AS content,
  source || '/' || lang || '/doc_' || doc_id || '.' || ['rs','py','ts','go','md','toml','java','sh'][doc_id % 8 + 1] AS path,
  ['Rust','Python','TypeScript','Go','Markdown','TOML','Java','Shell'][doc_id % 8 + 1] AS language, doc_id // 64 AS segment_id,
  octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS line_count,
  1700000000 - doc_id * 86400 AS mtime FROM documents)"""
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FOLDED = FOLD.format("content")
#: Lines of files, without a phantom last one.
LINES = f"""{FILES}, split_up AS (SELECT *, string_split(content, chr(10)) AS parts FROM files), line_rows AS (
  SELECT file_id, path, language, content, i AS line_number, parts[i] AS line FROM (
    SELECT *, unnest(range(1, len(parts) + 1 - (parts[-1] = '')::INT)) AS i FROM split_up))"""
GRAMS = f"""{FILES}, coded AS (SELECT *, hex(encode({FOLDED})) AS digits FROM files), postings AS (
  SELECT DISTINCT ('0x' || substr(digits, 2 * i + 1, 6))::INT AS trigram, segment_id, file_id FROM (SELECT *, unnest(range(0, length(digits) // 2 - 2)) AS i FROM coded))"""


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def engine(spark: SparkSession, sf_dir: str, indexed: bool = False) -> Engine:
    files = document_files(spark, sf_dir)
    return Engine(files, postings.build(files) if indexed else None, now=NOW)


def _found(sql_condition: str) -> str:
    return f"WITH {FILES} SELECT file_id, path FROM files WHERE {sql_condition}"


def _matching(name: str, text_query: str, sql_condition: str) -> None:
    """Registers the files that satisfy a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).matches(text_query).select("file_id", "path")

    run.__name__, run.__doc__ = name, f"Files for: {text_query}"
    query(_found(sql_condition))(run)


def _has(word: str) -> str:
    return f"contains({FOLDED}, '{word}')"


_matching("lit_sensitive", 'case:yes "The"', "contains(content, 'The')")
_matching("lit_folded", "the", _has("the"))
_matching("phrase", '"of the"', _has("of the"))
_matching("regex_match", r"/[Tt]he [a-z]+tion/", "regexp_matches(content, '[Tt]he [a-z]+tion')")
_matching("regex_alternation", r"/licen[cs]e|wh(ere|ich)/", "regexp_matches(content, 'licen[cs]e|wh(ere|ich)')")
_matching("regex_anchor", r"/^The/", "starts_with(content, 'The')")
_matching("bool_and", "the und", f"{_has('the')} AND {_has('und')}")
_matching("bool_or", "tionen OR ungen", f"{_has('tionen')} OR {_has('ungen')}")
_matching("bool_not", "the NOT of", f"{_has('the')} AND NOT {_has('of')}")
_matching("not_not", "NOT NOT the", _has("the"))
_matching("query_mixed", 'language:rust "the of" NOT xyz', f"language = 'Rust' AND {_has('the of')} AND NOT {_has('xyz')}")
_matching("precedence", "the und OR path:src1/ lang:py", f"({_has('the')} AND {_has('und')}) OR (starts_with(path, 'src1/') AND language = 'Python')")
_matching("path_prefix", "path:src1", "starts_with(path, 'src1')")
_matching("not_path", "the NOT path:src0/", f"{_has('the')} AND NOT starts_with(path, 'src0/')")
_matching("lang_filter", "lang:python", "language = 'Python'")
_matching("lang_alias", "lang:ts OR lang:md", "language IN ('TypeScript', 'Markdown')")
_matching("filter_in_or", "xyzzy OR path:src2/", f"{_has('xyzzy')} OR starts_with(path, 'src2/')")
_matching("short_query", "zu", _has("zu"))
_matching("case_next_term", "case:yes The und", f"contains(content, 'The') AND {_has('und')}")


@query(f"WITH {FILES} SELECT file_id, path, language, segment_id, size_bytes, line_count, mtime FROM files")
def scan_files(spark, sf_dir):
    return document_files(spark, sf_dir).select("file_id", "path", "language", "segment_id", "size_bytes", "line_count", "mtime")


@query(f"WITH {FILES} SELECT file_id, path FROM files WHERE size_bytes <= 1048576 AND NOT contains(content, chr(0))")
def filter_indexable(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return files.where(text.indexable(F.col("path"), F.encode("content", "UTF-8"), F.col("size_bytes"))).select("file_id", "path")


@query("SELECT p_partkey, p_name || '.' || ['png','rs','EXE','zip','md'][p_partkey % 5 + 1] AS path FROM part WHERE p_partkey % 5 IN (1, 4)")
def filter_binary_ext(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("png", "rs", "EXE", "zip", "md")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.lit("."), ext).alias("path"))
    return rows.where(~text.is_binary_path(F.col("path")))


@query(f"WITH {FILES} SELECT file_id, path FROM files WHERE regexp_matches(path, '^src1[0-9]/[^/]*/doc_[^/]*[.]rs$')")
def path_glob(spark, sf_dir):
    return document_files(spark, sf_dir).where(F.col("path").rlike(text.glob_regex("src1?/*/doc_*.rs"))).select("file_id", "path")


_NAMED = ", ".join(f"('{e}', '{name}')" for e, name in EXTENSIONS.items())
_N_EXTENSIONS = len(EXTENSIONS)


@query(f"""WITH exts AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_NAMED}) t(ext, language))
SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN 'Dockerfile' WHEN 4 THEN 'Unknown' ELSE language END AS detected FROM part JOIN exts ON p_partkey % {_N_EXTENSIONS} = k""")
def language_detection(spark, sf_dir):
    """Every extension of the table, file names without one, and names that decide alone."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % _N_EXTENSIONS + 1).cast("int"))
    dot = F.concat(F.lit("dir.rs/a.b."), ext)
    name = F.when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("x/Dockerfile."), ext)).when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("y/."), ext)).otherwise(dot)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.language_of(name).alias("detected"))


@query(f"WITH {GRAMS} SELECT trigram, segment_id, file_id FROM postings")
def postings_build(spark, sf_dir):
    return postings.build(document_files(spark, sf_dir))


@query(f"WITH {GRAMS} SELECT trigram, count(*) AS df FROM postings GROUP BY trigram")
def trigram_stats(spark, sf_dir):
    return postings.statistics(postings.build(document_files(spark, sf_dir)))


def _grams_sql(word: str) -> str:
    grams = ", ".join(map(str, text.trigrams_of(word)))
    return f"SELECT segment_id, file_id FROM postings WHERE trigram IN ({grams}) GROUP BY ALL HAVING count(*) = {len(text.trigrams_of(word))}"


@query(f"WITH {GRAMS} {_grams_sql('the of')}")
def candidates_all(spark, sf_dir):
    return postings.candidates(postings.build(document_files(spark, sf_dir)), required(parse('"the of"')))


@query(f"WITH {GRAMS} {_grams_sql('tionen')} UNION {_grams_sql('ungen')}")
def candidates_any(spark, sf_dir):
    return postings.candidates(postings.build(document_files(spark, sf_dir)), required(parse("tionen OR ungen")))


@query(_found(f"{_has('the of')} OR regexp_matches(content, 'ver[0-9]|(un|er)gen')"))
def index_equals_scan(spark, sf_dir):
    return engine(spark, sf_dir, indexed=True).matches('"the of" OR /ver[0-9]|(un|er)gen/').select("file_id", "path")


@query(f"WITH {LINES} SELECT file_id, line_number, line AS content FROM line_rows WHERE contains({FOLD.format('line')}, 'tionen')")
def line_matches(spark, sf_dir):
    rows = engine(spark, sf_dir).search("tionen").select("file_id", F.explode("lines").alias("l"))
    return rows.select("file_id", F.col("l.line_number").alias("line_number"), F.col("l.content").alias("content"))


@query(f"""WITH {LINES}, places AS (SELECT file_id, line_number, line, unnest(range(1, length(line) - 1)) AS k FROM line_rows WHERE contains(line, 'ana'))
SELECT file_id, line_number, octet_length(encode(substr(line, 1, k - 1)))::BIGINT AS start FROM places WHERE substr(line, k, 3) = 'ana'""")
def ranges_overlapping(spark, sf_dir):
    rows = document_files(spark, sf_dir).where(F.col("content").contains("ana")).select("file_id", F.posexplode(text.lines(F.col("content"))).alias("i", "line")).where(F.col("line").contains("ana"))
    rows = rows.select("file_id", (F.col("i") + 1).alias("line_number"), "line", F.explode(text.overlapping_starts(F.col("line"), "ana")).alias("k"))
    return rows.select("file_id", "line_number", text.byte_offset(F.col("line"), F.col("k")).cast("long").alias("start"))


@query(f"""WITH {LINES} SELECT file_id, count(*) AS n_lines, sum(len(regexp_extract_all({FOLD.format('line')}, 'und')))::BIGINT AS match_count
FROM line_rows WHERE contains({FOLD.format('line')}, 'und') GROUP BY file_id""")
def match_counts(spark, sf_dir):
    return engine(spark, sf_dir).search("und").select("file_id", F.size("lines").cast("long").alias("n_lines"), "match_count")


_CONTEXT = f"""WITH {LINES}, hits AS (SELECT path, line_number, coalesce(line_number - lag(line_number) OVER w > 3, true)::INT AS apart FROM line_rows
  WHERE contains({FOLD.format('line')}, 'tionen') WINDOW w AS (PARTITION BY path ORDER BY line_number)),
blocks AS (SELECT path, block, min(line_number) AS lo, max(line_number) AS hi FROM (SELECT *, sum(apart) OVER (PARTITION BY path ORDER BY line_number) AS block FROM hits) GROUP BY ALL)"""


@query(f"{_CONTEXT} SELECT path, block::BIGINT AS block, lo, hi FROM blocks")
def context_blocks(spark, sf_dir):
    rows = with_context(engine(spark, sf_dir).search("tionen", context=1)).where("is_match")
    return rows.groupBy("path", F.col("block").cast("long").alias("block")).agg(F.min("line_number").cast("long").alias("lo"), F.max("line_number").cast("long").alias("hi"))


@query(f"""{_CONTEXT} SELECT l.path, block::BIGINT AS block, l.line_number, l.line AS content, contains({FOLD.format('l.line')}, 'tionen') AS is_match
FROM line_rows l JOIN blocks b ON l.path = b.path AND l.line_number BETWEEN b.lo - 1 AND b.hi + 1""")
def context_lines(spark, sf_dir):
    return with_context(engine(spark, sf_dir).search("tionen", context=1)).withColumn("block", F.col("block").cast("long"))


_SIGNALS = f"""{FILES}, counted AS (SELECT *, greatest(len(regexp_extract_all({FOLDED}, 'und')), 1) AS match_count FROM files WHERE contains({FOLDED}, 'und')),
scored AS (SELECT *, CASE WHEN len(string_split(path, '/')) >= 10 THEN 0 ELSE 1 - len(string_split(path, '/')) / 10.0::DOUBLE END AS depth,
  least(greatest(ln(1.0::DOUBLE + match_count) / ln(1.0::DOUBLE + greatest(line_count, 1)), 0), 1) AS amount, pow(2.0::DOUBLE, -greatest(1700000000 - mtime, 0) / 2592000.0::DOUBLE) AS recency FROM counted),
ranked AS (SELECT *, round(0.3::DOUBLE * 0.6::DOUBLE + 0.15::DOUBLE * depth + 0.15::DOUBLE + 0.25::DOUBLE * amount + 0.15::DOUBLE * recency, 6) AS score FROM scored)"""


@query(f"WITH {_SIGNALS} SELECT file_id, round(depth, 6) AS depth, round(amount, 6) AS amount, round(recency, 6) AS recency FROM ranked")
def score_signals(spark, sf_dir):
    rows = engine(spark, sf_dir).search("und")
    rows = rows.join(document_files(spark, sf_dir).select("file_id", "mtime"), "file_id")
    return rows.select("file_id", F.round(ranking.depth_score(F.col("path")), 6).alias("depth"), F.round(ranking.count_score(F.col("match_count"), F.col("line_count")), 6).alias("amount"), F.round(ranking.recency_score(F.col("mtime"), NOW), 6).alias("recency"))


def _scored(spark, sf_dir):
    return engine(spark, sf_dir).search("und").withColumn("score", F.round("score", 6))


@query(f"WITH {_SIGNALS} SELECT path, score, match_count FROM ranked ORDER BY score DESC, path LIMIT 20")
def ranked_topk(spark, sf_dir):
    return Engine.top(_scored(spark, sf_dir), 20).select("path", "score", "match_count")


@query(f"WITH {_SIGNALS} SELECT path, score FROM ranked ORDER BY score DESC, path LIMIT 10 OFFSET 20")
def paginate(spark, sf_dir):
    return Engine.top(_scored(spark, sf_dir), 10, 20).select("path", "score")


@query(f"WITH {LINES} SELECT count(DISTINCT file_id) AS files, count(*) AS lines FROM line_rows WHERE contains({FOLD.format('line')}, 'und')")
def result_totals(spark, sf_dir):
    return engine(spark, sf_dir).search("und").agg(F.count("*").alias("files"), F.sum(F.size("lines")).alias("lines"))


@query(f"WITH {LINES} SELECT path || ':' || line_number || ':' || octet_length(encode(substr(line, 1, instr({FOLD.format('line')}, 'ungen') - 1))) + 1 || ':' || line AS text FROM line_rows WHERE contains({FOLD.format('line')}, 'ungen')")
def vimgrep_lines(spark, sf_dir):
    return vimgrep(engine(spark, sf_dir).search("ungen"), "ungen")


@query(f"""WITH {LINES}, hits AS (SELECT * FROM line_rows WHERE contains({FOLD.format('line')}, 'ungen'))
SELECT path, '## ' || path || ' (' || any_value(language) || ', ' || count(*) || ' matches)' || chr(10)
  || string_agg('L' || line_number || ':* ' || line, chr(10) ORDER BY line_number) AS text FROM hits GROUP BY path""")
def report_text(spark, sf_dir):
    return text_report(engine(spark, sf_dir).search("ungen"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query(f"""WITH {LINES} SELECT path, line_number, array_to_string(list_transform(string_split(line, 'tion'), lambda x: {_ESCAPED.format('x')}), '<mark>tion</mark>') AS html
FROM line_rows WHERE contains(line, 'tion')""")
def marked_lines(spark, sf_dir):
    return marked(engine(spark, sf_dir).search('case:yes "tion"'), "tion")


@query(f"""WITH {LINES.replace("coalesce(text, '')", "coalesce(replace(text, 'a', '&a<'), '')")} SELECT path, line_number, array_to_string(list_transform(string_split(line, 'a'), lambda x: {_ESCAPED.format('x')}), '<mark>a</mark>') AS html
FROM line_rows WHERE contains(line, 'a')""")
def marked_entities(spark, sf_dir):
    """The word is a letter of an entity's name, and stands beside characters that become entities."""
    e = Engine(document_files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("a"), F.lit("&a<"))), now=NOW)
    return marked(e.search('case:yes "a"'), "a")


@query(_found("contains(content, 'The')"))
def smart_case_pattern(spark, sf_dir):
    return engine(spark, sf_dir).pattern("The").select("file_id", "path")


@query(_found("regexp_matches(content, '(?i)the [a-z]+tion')"))
def pattern_regex_folded(spark, sf_dir):
    return engine(spark, sf_dir).pattern("the [a-z]+tion", regex=True, case=False).select("file_id", "path")


@query(f"WITH {LINES} SELECT line_number, line AS content FROM line_rows WHERE file_id = 3 AND line_number BETWEEN 3 AND 7")
def preview_window(spark, sf_dir):
    e = engine(spark, sf_dir)
    path = e.files.where("file_id = 3").select("path").first()
    return e.preview(path["path"] if path else "", 5, 2)


@query(f"WITH {FILES} SELECT file_id, sha256(content) AS content_hash FROM files")
def content_hashes(spark, sf_dir):
    return document_files(spark, sf_dir).select("file_id", F.sha2("content", 256).alias("content_hash"))


@query("SELECT p_partkey, starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') AS unsafe FROM (SELECT p_partkey, ['', '/', '../', 'a/../', 'a..b/'][p_partkey % 5 + 1] || p_name AS path FROM part)")
def unsafe_paths(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "/", "../", "a/../", "a..b/")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.is_unsafe_path(F.concat(start, "p_name")).alias("unsafe"))


@query(f"WITH {FILES} SELECT max(mtime) AS newest, 1700001000 - max(mtime) AS age, 1700001000 - max(mtime) >= 600 AS stale FROM files")
def index_staleness(spark, sf_dir):
    return reports.staleness(document_files(spark, sf_dir), NOW + 1000)


@query(f"""WITH {FILES}, coded AS (SELECT *, hex(encode({FOLDED})) AS digits FROM files), found AS (
  SELECT file_id, ('0x' || substr(digits, 2 * i + 1, 6))::INT AS trigram, i AS place FROM (SELECT *, unnest(range(0, length(digits) // 2 - 2)) AS i FROM coded))
SELECT trigram, count(*) AS occurrences, count(DISTINCT file_id) AS files, sum(place)::BIGINT AS offsets FROM found GROUP BY trigram""")
def positional_postings(spark, sf_dir):
    rows = postings.build_positional(document_files(spark, sf_dir))
    return rows.groupBy("trigram").agg(F.count("*").alias("occurrences"), F.count_distinct("file_id").alias("files"), F.sum("at").alias("offsets"))


@query(f"WITH {GRAMS} SELECT trigram, segment_id, file_id FROM postings")
def postings_round_trip(spark, sf_dir):
    return postings.decoded_lists(postings.encoded_lists(postings.build(document_files(spark, sf_dir))))


@query(f"WITH {LINES} SELECT line_number, line AS content FROM line_rows WHERE file_id = 3 AND line_number BETWEEN 2 AND 6")
def get_file_slice(spark, sf_dir):
    e = engine(spark, sf_dir)
    path = "".join(r["path"] for r in e.files.where("file_id = 3").select("path").collect())
    return e.slice(path, 2, 6)


@query(f"WITH {FILES} SELECT language, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY language ORDER BY files DESC, language LIMIT 10")
def status_languages(spark, sf_dir):
    return reports.languages(document_files(spark, sf_dir))


@query(f"WITH {FILES} SELECT language, regexp_extract(path, '[.]([^.]+)$', 1) AS ext, count(*) AS files FROM files GROUP BY ALL")
def status_lang_ext(spark, sf_dir):
    return reports.extensions(document_files(spark, sf_dir))


@query(f"WITH {FILES} SELECT language, regexp_extract(path, '[.]([^.]+)$', 1) AS ext, count(*) AS files FROM files GROUP BY ROLLUP (1, 2)")
def status_rollup(spark, sf_dir):
    return reports.language_rollup(document_files(spark, sf_dir))


def _dead(files: DataFrame) -> DataFrame:
    """For the tests: every seventh file, and all in every fifth segment, is dead."""
    return files.where("file_id % 7 = 0 OR segment_id % 5 = 0").select("segment_id", "file_id")


_DEAD = "(file_id % 7 = 0 OR segment_id % 5 = 0)"


@query(f"""WITH {FILES} SELECT segment_id, count(*) AS entries, max(mtime) AS newest, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (WHERE {_DEAD}) AS dead,
count(*) FILTER (WHERE {_DEAD}) / count(*) AS ratio, count(*) FILTER (WHERE {_DEAD}) / count(*) > 0.3 AS compact FROM files GROUP BY segment_id""")
def segment_stats(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return reports.segments(files, _dead(files))


@query(f"WITH {FILES} SELECT DISTINCT segment_id FROM files GROUP BY segment_id HAVING count(*) FILTER (WHERE {_DEAD}) / count(*) > 0.3")
def compaction_candidates(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return reports.segments(files, _dead(files)).where("compact").select("segment_id")


@query(f"WITH {FILES} SELECT segment_id, file_id FROM files WHERE NOT {_DEAD}")
def tombstone_anti(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return live(files, _dead(files)).select("segment_id", "file_id")


def _versions(files: DataFrame) -> DataFrame:
    """For the tests: files whose paths repeat, a tenth as many as there are files."""
    return files.withColumn("path", F.concat(F.lit("v/"), (F.col("file_id") % 97).cast("string"), F.lit(".rs")))


_VERSIONS = f"{FILES}, versions AS (SELECT * REPLACE ('v/' || (file_id % 97) || '.rs' AS path) FROM files)"
_NEWEST = "row_number() OVER (PARTITION BY path ORDER BY segment_id DESC, file_id DESC) = 1"


@query(f"WITH {_VERSIONS} SELECT path, segment_id, file_id FROM versions QUALIFY {_NEWEST}")
def newest_wins(spark, sf_dir):
    return newest(_versions(document_files(spark, sf_dir))).select("path", "segment_id", "file_id")


@query(f"WITH {_VERSIONS} SELECT path FROM versions WHERE NOT {_DEAD} GROUP BY path")
def live_paths(spark, sf_dir):
    files = _versions(document_files(spark, sf_dir))
    return live(files, _dead(files)).select("path").distinct()


@query(f"WITH {_VERSIONS}, kept AS (SELECT path, content, size_bytes, mtime FROM versions WHERE NOT {_DEAD} QUALIFY {_NEWEST}) SELECT path, md5(content) AS digest, size_bytes, mtime FROM kept")
def compact_live(spark, sf_dir):
    files = _versions(document_files(spark, sf_dir))
    return newest(live(files, _dead(files))).select("path", F.md5("content").alias("digest"), "size_bytes", "mtime")


_EVENTS = """changes AS (SELECT event_id, ts, 'user_' || user_id AS path, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'purchase' THEN 'Renamed' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS kind FROM events)"""


def _changes(spark, sf_dir):
    return event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(f"WITH {_EVENTS} SELECT path, kind, event_id FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1")
def event_dedup(spark, sf_dir):
    return last_of_path(_changes(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT event_id, kind IN ('Modified', 'Renamed', 'Deleted') AS tombstone, kind <> 'Deleted' AS entry FROM changes")
def change_actions(spark, sf_dir):
    return actions(_changes(spark, sf_dir)).select("event_id", "tombstone", "entry")


@query(f"""WITH {_EVENTS} SELECT event_id, path, CASE kind WHEN 'Renamed' THEN 'Deleted' ELSE kind END AS kind FROM changes
UNION ALL SELECT event_id, path || '.new', 'Created' FROM changes WHERE kind = 'Renamed'""")
def rename_split(spark, sf_dir):
    return split_renames(_changes(spark, sf_dir).withColumn("new_path", F.concat("path", F.lit(".new"))))


@query(f"""WITH {_EVENTS}, last AS (SELECT kind FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1)
SELECT count(*) FILTER (WHERE kind = 'Created') AS created, count(*) FILTER (WHERE kind IN ('Modified', 'Renamed')) AS modified, count(*) FILTER (WHERE kind = 'Deleted') AS deleted FROM last""")
def catch_up_counts(spark, sf_dir):
    return caught_up(last_of_path(_changes(spark, sf_dir)))


@query(f"WITH {_EVENTS} SELECT count(*) FILTER (WHERE kind = 'Created') AS created, count(*) FILTER (WHERE kind IN ('Modified', 'Renamed')) AS modified, count(*) FILTER (WHERE kind = 'Deleted') AS deleted FROM changes")
def change_counts(spark, sf_dir):
    return caught_up(_changes(spark, sf_dir))


@query(f"""WITH {_EVENTS}, marked AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000, true)::INT AS apart FROM changes WINDOW w AS (PARTITION BY path ORDER BY ts, event_id))
SELECT path, session::BIGINT AS session, count(*) AS n FROM (SELECT *, sum(apart) OVER (PARTITION BY path ORDER BY ts, event_id) AS session FROM marked) GROUP BY path, session""")
def debounce_sessions(spark, sf_dir):
    rows = quiet_sessions(_changes(spark, sf_dir), 12 * 3600)
    return rows.select("path", F.col("session").cast("long").alias("session"), "n")


@query(f"""WITH {FILES} SELECT path, CASE WHEN file_id % 5 = 0 THEN 'Created' WHEN file_id % 3 = 0 THEN 'Deleted' ELSE 'Modified' END AS kind
FROM files WHERE (file_id % 5 = 0 AND file_id % 3 <> 0) OR (file_id % 3 = 0 AND file_id % 5 <> 0) OR (file_id % 5 <> 0 AND file_id % 3 <> 0 AND file_id % 2 = 0)""")
def hash_differences(spark, sf_dir):
    files = document_files(spark, sf_dir)
    # For the tests: the index lacks multiples of 5, the folder lacks multiples of 3, even files have changed.
    old = files.where("file_id % 5 <> 0").select("path", F.sha2("content", 256).alias("content_hash"))
    new = files.where("file_id % 3 <> 0").select("path", F.sha2(F.concat("content", F.when(F.col("file_id") % 2 == 0, "+").otherwise("")), 256).alias("content_hash"))
    return hash_diff(old, new)


@query(f"""WITH {_EVENTS}, sourced AS (SELECT path, kind, event_id % 3 AS prio, event_id FROM changes) SELECT path, kind FROM sourced QUALIFY row_number() OVER (PARTITION BY path ORDER BY prio DESC, event_id DESC) = 1""")
def git_merge_precedence(spark, sf_dir):
    rows = _changes(spark, sf_dir).select("path", "kind", (F.col("event_id") % 3).alias("source"), F.col("event_id").alias("turn"))
    return git.merged(rows)


_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in SYMBOL_KINDS) + "]"
_SYMBOLS = f"symbols AS (SELECT p_name AS name, {_KIND_LIST}[p_size % 11 + 1] AS kind, p_brand || '/' || p_partkey || '.rs' AS path, 'Rust' AS language, p_partkey AS line FROM part)"


def _symbols(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in SYMBOL_KINDS]), (F.col("p_size") % 11 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"), kind.alias("kind"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("path"), F.lit("Rust").alias("language"), F.col("p_partkey").alias("line"))


_SYMBOL_SCORE = f"CASE WHEN {FOLD.format('name')} = 'red' THEN 1.0 WHEN starts_with({FOLD.format('name')}, 'red') THEN 0.8 ELSE 0.5 END::DOUBLE"


@query(f"WITH {_SYMBOLS} SELECT name, kind, path, line, {_SYMBOL_SCORE} AS score FROM symbols WHERE contains({FOLD.format('name')}, 'red') ORDER BY score DESC, name, path, line LIMIT 100")
def symbol_search(spark, sf_dir):
    return search_symbols(_symbols(spark, sf_dir), "Red").select("name", "kind", "path", "line", "score")


@query(f"WITH {_SYMBOLS} SELECT name, path, line FROM symbols WHERE contains({FOLD.format('name')}, 'red') ORDER BY {_SYMBOL_SCORE} DESC, name, path, line LIMIT 100")
def symbol_index_search(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    index = postings.build(symbols, "name", ("path", "name", "line"))
    return indexed_symbols(symbols, index, "Red").select("name", "path", "line")


@query(f"WITH {_SYMBOLS} SELECT name, path, line FROM symbols WHERE kind = 'Function' AND contains({FOLD.format('path')}, '1') ORDER BY name, path, line LIMIT 50")
def symbol_filters(spark, sf_dir):
    return search_symbols(_symbols(spark, sf_dir), "", "fn", "rust", "1", 50).select("name", "path", "line")


@query(f"WITH {FILES} SELECT path, language, size_bytes, mtime FROM files WHERE contains({FOLD.format('path')}, 'doc_1') AND language = 'Python' ORDER BY size_bytes DESC, path LIMIT 25")
def file_search(spark, sf_dir):
    return engine(spark, sf_dir).list_files("doc_1", "py", "size", 25)


@query(f"WITH {GRAMS} SELECT trigram, segment_id, file_id, file_id - coalesce(lag(file_id) OVER (PARTITION BY trigram, segment_id ORDER BY file_id), 0) AS gap FROM postings")
def delta_gaps(spark, sf_dir):
    return postings.gaps(postings.build(document_files(spark, sf_dir)))


@query(f"""WITH {GRAMS}, gaps AS (SELECT *, file_id - coalesce(lag(file_id) OVER (PARTITION BY trigram, segment_id ORDER BY file_id), 0) AS gap FROM postings),
lists AS (SELECT segment_id, count(DISTINCT trigram) AS trigrams, count(*) AS postings, sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END)::BIGINT AS encoded_bytes FROM gaps GROUP BY segment_id),
raw AS (SELECT segment_id, count(*) AS files, sum(size_bytes)::BIGINT AS raw_bytes FROM files GROUP BY segment_id)
SELECT segment_id, files, raw_bytes, trigrams, postings, encoded_bytes, raw_bytes + 64 * trigrams + 4 * postings AS build_bytes FROM raw LEFT JOIN lists USING (segment_id)""")
def estimate_index(spark, sf_dir):
    return postings.estimate(document_files(spark, sf_dir))


@query("""WITH tokens AS (SELECT conv_id AS line_id, turn AS place, length(text) AS len, role AS kind FROM conversations),
marked AS (SELECT *, (lag(kind) OVER (PARTITION BY line_id ORDER BY place) IS DISTINCT FROM kind)::INT AS fresh FROM tokens),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY place) AS run FROM marked) SELECT line_id, run::BIGINT AS run, any_value(kind) AS kind, sum(len)::BIGINT AS len FROM runs GROUP BY line_id, run""")
def rle_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("line_id"), F.col("turn").alias("place"), F.length("text").alias("len"), F.col("role").alias("kind"))
    return postings.run_lengths(rows).select("line_id", F.col("run").cast("long").alias("run"), "kind", F.col("len").cast("long").alias("len"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS match_count FROM pages WHERE contains(html, '<p>')")
def search_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = pages.select(F.col("page_id").alias("file_id"), F.lit(0).cast("long").alias("segment_id"), F.coalesce("html", F.lit("")).alias("content"), F.coalesce("url", F.lit("")).alias("path"), F.lit("HTML").alias("language"), F.lit(1).alias("line_count"), F.lit(NOW).alias("mtime"))
    return Engine(files, now=NOW).search('case:yes "<p>"').select(F.col("file_id").alias("page_id"), "match_count")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best files for a mixed query, through an index of trigrams."""
    e = engine(spark, sf_dir, indexed=True)
    tree = And((parse('"of the" OR /[a-z]+ungen/'), parse("NOT xyzzy")))
    return Engine.top(e.search(tree), 50).select("path", "language", "match_count", "score", F.size("lines").alias("n_lines"))


