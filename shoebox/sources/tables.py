"""The library's input tables, derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both read, so that a query and its oracle see the same input; ``_DIALECTS`` has
the few functions whose names differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_DIALECTS = {
    "spark": {"slice": "slice({0}, {1}, {2} - {1} + 1)", "array": "array({0})", "json": "get_json_object({0}, '$.{1}')", "split": "split({0}, ' ')"},
    "duckdb": {"slice": "list_slice({0}, {1}, {2})", "array": "[{0}]", "json": "json_extract_string({0}, '$.{1}')", "split": "string_split({0}, ' ')"},
}

_TABLES: dict[str, str] = {
    "projects": """
SELECT DISTINCT o_custkey % 7 AS id, 'Project ' || CAST(o_custkey % 7 AS STRING) AS name, '/lib/p' || CAST(o_custkey % 7 AS STRING) AS root,
  o_custkey % 7 <> 6 AS available FROM orders""",
    "photos": """
SELECT o_orderkey AS id, o_custkey % 7 AS project_id, 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS file_name,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'y' || CAST(year(o_orderdate) AS STRING) ELSE 'y' || CAST(year(o_orderdate) AS STRING) || '/m' || CAST(month(o_orderdate) AS STRING) END AS folder_path,
  '/lib/p' || CAST(o_custkey % 7 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '/y' || CAST(year(o_orderdate) AS STRING) || '/'
    ELSE '/y' || CAST(year(o_orderdate) AS STRING) || '/m' || CAST(month(o_orderdate) AS STRING) || '/' END || 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS file_path,
  CASE WHEN o_orderkey % 17 <> 0 THEN md5(CAST(o_custkey % 97 AS STRING) || o_orderpriority) END AS file_hash,
  CAST(floor(o_totalprice) AS BIGINT) AS file_size, CASE WHEN o_orderkey % 10 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS taken_at, o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 5 AS INT) AS created_at,
  CASE o_orderstatus WHEN 'P' THEN 'quarantined' WHEN 'F' THEN 'indexed' ELSE 'ai_indexed' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at, CAST(o_orderkey % 32 * 100 AS INT) AS iso,
  o_orderpriority AS camera_make, 'Model ' || CAST(o_custkey % 10 AS STRING) AS camera_model,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 1800 AS DOUBLE) / 10 - 90 END AS gps_latitude,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 3600 AS DOUBLE) / 10 - 180 END AS gps_longitude,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE n_name END AS country_name, r_name AS admin1, 'City ' || CAST(o_custkey % 40 AS STRING) AS city,
  CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate END AS location_resolved_at,
  'Area ' || CAST(o_custkey % 30 AS STRING) AS admin2, CASE WHEN o_orderkey % 8 <> 0 THEN 'District ' || CAST(o_orderkey % 50 AS STRING) END AS district,
  'Street ' || CAST(o_orderkey % 12 AS STRING) || ', City ' || CAST(o_custkey % 40 AS STRING) AS formatted_address
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "analysis": """
SELECT doc_id AS photo_id, o_custkey % 7 AS project_id, text AS caption, source || ' ' || lang AS ocr_text,
  {slice|w|1|2} AS scene_tags, {slice|w|3|5} AS object_tags, {slice|w|6|6} AS activity_tags, {array|lang} AS quality_tags,
  {array|source} AS location_clues, {slice|w|1|8} AS search_keywords, {slice|w|2|4} AS semantic_concepts,
  CAST(n_chars % 5 AS INT) AS people_count, CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence, o_orderdate AS created_at,
  CASE WHEN n_chars % 5 >= 2 THEN {array|'people', 'group_photo'} WHEN n_chars % 5 = 1 THEN {array|'people'} END AS semantic_facets
FROM (SELECT *, {split|lower(text)} AS w FROM documents) d JOIN orders ON o_orderkey = doc_id""",
    "face_embeddings": """
SELECT vec_id AS face_id, vec_id % 2 AS project_id, vec_id % 97 AS photo_id, label, embedding, CAST(vec_id * 37 % 100 AS DOUBLE) / 100 AS quality,
  CASE WHEN vec_id % 19 = 0 THEN 'failed' ELSE 'embedded' END AS status FROM embeddings""",
    "assignments": """
SELECT vec_id AS id, vec_id % 2 AS project_id, vec_id AS face_id, vec_id % 2 * 100 + label AS person_id,
  CASE vec_id % 5 WHEN 0 THEN 'review_pending' WHEN 1 THEN 'auto_assigned' WHEN 2 THEN 'human_confirmed' WHEN 3 THEN 'human_corrected' ELSE 'rejected' END AS assignment_status,
  CAST(vec_id % 100 AS DOUBLE) / 100 AS confidence, CAST(vec_id * 7 % 100 AS DOUBLE) / 100 AS similarity, vec_id % 5 IN (2, 3) AS is_positive FROM embeddings
UNION ALL
SELECT vec_id + 1000000000 AS id, vec_id % 2 AS project_id, vec_id AS face_id, vec_id % 2 * 100 + (label + 1) % 10 AS person_id,
  CASE vec_id % 3 WHEN 0 THEN 'review_pending' WHEN 1 THEN 'auto_assigned' ELSE 'rejected' END AS assignment_status,
  CAST(vec_id % 90 AS DOUBLE) / 100 AS confidence, CAST(vec_id * 11 % 100 AS DOUBLE) / 100 AS similarity, false AS is_positive FROM embeddings WHERE vec_id % 4 = 0""",
    "persons": """
SELECT DISTINCT vec_id % 2 * 100 + label AS id, vec_id % 2 AS project_id, 'Person ' || CAST(label AS STRING) || ' #p' || CAST(label AS STRING) || ' #P' || CAST(label AS STRING) || ' #all' AS display_name,
  label % 4 <> 0 AS is_named FROM embeddings""",
    "jobs": """
SELECT event_id AS id, user_id % 7 AS project_id, event_id % 1009 AS photo_id, CASE WHEN event_id % 3 = 0 THEN 'embed' ELSE 'analyze' END AS job_type,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'success' WHEN 'purchase' THEN 'running' ELSE 'paused' END AS status,
  CASE WHEN event_type = 'error' THEN 'code ' || {json|props|k} END AS error_message, ts AS created_at FROM events""",
    "items": """
SELECT d.doc_id AS id, d.doc_id AS photo_id, d.doc_id % 7 AS project_id, CASE d.n_chars % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'review' WHEN 2 THEN 'delete_queued' ELSE 'quarantined' END AS status,
  CASE WHEN toxic = 1 OR d.n_chars % 3 = 0 THEN 'QUARANTINE' ELSE 'KEEP' END AS decision, CASE d.lang WHEN 'en' THEN 'meaningless_test' WHEN 'fr' THEN 'meaningless_test_image' ELSE d.lang END AS classification,
  CAST(d.n_chars % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN quality = 1 THEN 'KEEP' WHEN quality = 0 THEN 'TRASH' END AS human_label,
  d.n_chars % 6 = 0 AS is_video, o_orderdate AS created_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN orders ON o_orderkey = d.doc_id""",
    "searches": """
SELECT item_id AS query_id, item_id % 7 AS project_id, {slice|w|1|2} AS exact_terms, {slice|w|3|5} AS expanded_terms, w[{zero}] AS concept_term, text,
  CASE WHEN item_id % 3 = 0 THEN 1993 + CAST(item_id % 6 AS INT) END AS year, item_id % 4 = 0 AS needs_gps, CAST(item_id % 5 * 400 AS INT) AS iso_min,
  {slice|w|6|7} AS support_terms, {slice|w|8|9} AS broad_terms, {slice|w|10|10} AS negative_terms, CASE WHEN item_id % 4 = 1 THEN 'animal_search' ELSE 'photo_search' END AS intent
FROM (SELECT *, {split|lower(text)} AS w FROM benchmark) b""",
}

#: The same tables with what a join carries made small first: Spark would send each text's words through the join with it.
_ON_SPARK: dict[str, str] = {
    "analysis": """
SELECT photo_id, o_custkey % 7 AS project_id, caption, ocr_text, scene_tags, object_tags, activity_tags, quality_tags, location_clues, search_keywords, semantic_concepts, people_count, confidence,
  o_orderdate AS created_at, semantic_facets
FROM (SELECT doc_id AS photo_id, text AS caption, source || ' ' || lang AS ocr_text, {slice|w|1|2} AS scene_tags, {slice|w|3|5} AS object_tags, {slice|w|6|6} AS activity_tags, {array|lang} AS quality_tags,
  {array|source} AS location_clues, {slice|w|1|8} AS search_keywords, {slice|w|2|4} AS semantic_concepts, CAST(n_chars % 5 AS INT) AS people_count, CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN n_chars % 5 >= 2 THEN {array|'people', 'group_photo'} WHEN n_chars % 5 = 1 THEN {array|'people'} END AS semantic_facets
  FROM (SELECT *, {split|lower(text)} AS w FROM documents)) d JOIN orders ON o_orderkey = photo_id""",
}


def table_sql(name: str, dialect: str, text: str | None = None) -> str:
    """SQL of a derived table over the driver's tables, or ``text`` in its place."""
    words = _DIALECTS[dialect]
    text = (text or _TABLES[name]).replace("{zero}", "0" if dialect == "spark" else "1")

    def call(match: re.Match) -> str:
        function, *arguments = match[1].split("|")
        return words[function].format(*arguments)

    return re.sub(r"\{(\w+\|[^{}]*)\}", call, text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one derived from them."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = table_sql(name, "spark", _ON_SPARK.get(name))
    used = [b for b in BASE if re.search(rf"(FROM|JOIN) {b}\b", text)]
    for b in used:
        text = re.sub(rf"(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **{b: load(spark, sf_dir, b) for b in used})


def oracle(select: str, *names: str) -> str:
    """DuckDB SQL: the derived tables ``names`` in front of ``select``, which may go on with its own tables (``, x AS (…) SELECT …``)."""
    heads = ", ".join(f"{n} AS ({table_sql(n, 'duckdb')})" for n in names if n in _TABLES)
    return f"WITH {heads} {select}" if not select.lstrip().startswith(",") else f"WITH {heads}{select}"
