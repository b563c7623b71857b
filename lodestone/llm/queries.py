"""Queries over the test tables for the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, html_extract, lm, minhash_dedup, mixing, packing, quality, token_counts, token_io


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.find_links(_table(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.find_near_copies(_table(spark, sf_dir, "documents"), percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_packing, op3_token_counts, op4_exact_dedup, op5_html_extraction, op6_lm_scoring, op7_mixing, op8_token_output, op9_embedding_dedup, op10_minhash_dedup)
}

_OP4_SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), numbered AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) AS place
  FROM rows
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM numbered
"""

_OP7_SQL = r"""
WITH thin AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM thin GROUP BY source
), weighted AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sizes
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
         (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), goals AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * w THEN cap ELSE arg_min(level, place) FILTER (WHERE cap > level * w) OVER () * w END AS target FROM levels
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM goals
), masses AS (SELECT source, h, sum(size) AS mass FROM thin GROUP BY source, h
), running AS (SELECT *, sum(mass) OVER (PARTITION BY source ORDER BY h) AS upto FROM masses
), taken AS (
  SELECT r.source, r.h, CASE WHEN r.upto <= g.target - g.copies * g.source_size THEN 1
           WHEN r.upto - r.mass <= g.target - g.copies * g.source_size AND 2 * (g.target - g.copies * g.source_size - (r.upto - r.mass)) >= r.mass THEN 1 ELSE 0 END AS extra
  FROM running r JOIN rests g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT t.doc_id, t.size, g.source_size, g.target, (t.size * (g.copies + k.extra))::BIGINT AS taken
FROM thin t JOIN rests g ON t.source IS NOT DISTINCT FROM g.source JOIN taken k ON t.source IS NOT DISTINCT FROM k.source AND t.h = k.h
"""

#: Components: each node's smallest reachable one. Expects nodes (id) and links (x, y).
_COMPONENTS = """
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id AS node, id AS seen FROM nodes WHERE id IS NOT NULL UNION SELECT reach.node, edges.y FROM reach JOIN edges ON reach.seen = edges.x),
components AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

_OP9_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings
), nodes AS (SELECT vec_id AS id FROM vectors
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE a.usable AND b.usable AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), {_COMPONENTS}, degrees AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN components ON vec_id = node LEFT JOIN degrees ON vec_id = x
"""

_OP10_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), sets AS (
  SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), nodes AS (SELECT id, len(s)::BIGINT AS n FROM sets
), flat AS (SELECT id, unnest(s) AS g FROM sets
), pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.id < b.id GROUP BY ALL
), links AS (SELECT x, y FROM pairs JOIN nodes p ON p.id = x JOIN nodes q ON q.id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), {_COMPONENTS}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN components ON id = node
"""

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": _OP4_SQL, "op7_mixing": _OP7_SQL, "op9_embedding_dedup": _OP9_SQL, "op10_minhash_dedup": _OP10_SQL}
