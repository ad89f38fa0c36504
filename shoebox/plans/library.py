"""Browse, cleanup and job queries over the derived tables, each with SQL that gives the same rows."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators import browse, cleanup
from shoebox.sources.tables import load, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *names: str):
    """Register a function of derived tables under its name, with the SQL of its rows over the same tables.

    Without names the tables are the parameters and the SQL stands alone; without SQL there is no oracle."""

    def add(function):
        tables = names or tuple(inspect.signature(function).parameters)
        QUERIES[function.__name__] = lambda spark, sf_dir: function(*(load(spark, sf_dir, n) for n in tables))
        if sql:
            SQL[function.__name__] = oracle(sql, *names) if names else sql
        return function

    return add


ACTIVE = "deleted_at IS NULL AND status <> 'quarantined'"
NEWEST = "taken_at DESC NULLS LAST, created_at DESC, id DESC"


@query(
    f"""SELECT * FROM (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY {NEWEST}) AS position, id, taken_at,
  count(*) OVER (PARTITION BY project_id) AS total FROM photos WHERE {ACTIVE}) WHERE position BETWEEN 21 AND 40""",
    "photos",
)
def brw1_photo_page(photos: DataFrame) -> DataFrame:
    return browse.photo_page(photos, 2, 20).withColumn("position", F.col("position").cast("bigint"))


@query(
    f""", c AS (SELECT project_id, taken_at AS t, created_at AS c, id AS i FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {NEWEST}) AS n FROM photos WHERE {ACTIVE}) WHERE n = 30),
r AS (SELECT p.project_id, id, row_number() OVER (PARTITION BY p.project_id ORDER BY {NEWEST}) AS position FROM photos p JOIN c USING (project_id)
  WHERE {ACTIVE} AND CASE WHEN t IS NULL THEN taken_at IS NULL AND (created_at < c OR created_at = c AND id < i) ELSE taken_at IS NULL OR taken_at < t OR taken_at = t AND (created_at < c OR created_at = c AND id < i) END)
SELECT project_id, position, id, max(position) OVER (PARTITION BY project_id) > 25 AS has_more FROM r QUALIFY position <= 25""",
    "photos",
)
def brw2_keyset_page(photos: DataFrame) -> DataFrame:
    page = browse.photo_page(photos, 1, 30).where("position = 30").select("project_id", "id")
    cursors = page.join(photos, ["project_id", "id"]).select("project_id", F.col("taken_at").alias("c_taken"), F.col("created_at").alias("c_created"), F.col("id").alias("c_id"))
    return browse.keyset_page(photos, cursors, 25).withColumn("position", F.col("position").cast("bigint"))


@query(
    f""", r AS (SELECT project_id, id, status <> 'quarantined' AS is_browsable, sum(CASE WHEN status <> 'quarantined' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, folder_path) AS total,
  1 + coalesce(sum(CASE WHEN status <> 'quarantined' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, folder_path ORDER BY {NEWEST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM photos WHERE deleted_at IS NULL)
SELECT project_id, id, is_browsable, CAST(total AS BIGINT) AS total, CAST(position AS BIGINT) AS position, CAST(least(ceil(position / 10), greatest(1, ceil(total / 10))) AS BIGINT) AS page FROM r""",
    "photos",
)
def brw3_locate(photos: DataFrame) -> DataFrame:
    return browse.locate(photos, 10)


@query(
    f"""SELECT project_id, CAST(year(taken_at) AS INT) AS year, CAST(month(taken_at) AS INT) AS month, count(*) AS count, strftime(taken_at, '%Y-%m') AS key
FROM photos WHERE {ACTIVE} AND taken_at IS NOT NULL GROUP BY ALL""",
    "photos",
)
def brw4_timeline(photos: DataFrame) -> DataFrame:
    return browse.timeline(photos)


@query(f"SELECT project_id, id, folder_path FROM photos WHERE {ACTIVE} AND (folder_path = 'y1995' OR starts_with(folder_path, 'y1995/'))", "photos")
def brw5_folder_scope(photos: DataFrame) -> DataFrame:
    return browse.in_folder(photos, "y1995").select("project_id", "id", "folder_path")


_TAGS = " UNION ALL ".join(f"SELECT project_id, photo_id, '{c}' AS category, unnest(list_distinct({c})) AS tag FROM k" for c in browse.TAG_CATEGORIES)


@query(
    f""", k AS (SELECT a.* FROM analysis a JOIN photos p ON p.project_id = a.project_id AND p.id = a.photo_id WHERE p.deleted_at IS NULL),
t AS ({_TAGS}), c AS (SELECT project_id, category, tag, count(*) AS cnt FROM t GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY project_id, category ORDER BY cnt DESC, tag) AS INT) AS rank FROM c QUALIFY rank <= 100""",
    "analysis", "photos",
)
def brw6_tag_counts(analysis: DataFrame, photos: DataFrame) -> DataFrame:
    return browse.tag_counts(analysis, photos)


@query(
    """SELECT a.project_id, a.photo_id, p.taken_at, CAST(1 AS DOUBLE) AS score FROM analysis a JOIN photos p ON p.project_id = a.project_id AND p.id = a.photo_id
WHERE p.deleted_at IS NULL AND list_has_any(object_tags, ['the', 'la', 'der'])""",
    "analysis", "photos",
)
def brw7_exact_tag_filter(analysis: DataFrame, photos: DataFrame) -> DataFrame:
    return browse.with_tag(analysis, photos, "object_tags", ["the", "la", "der"])


@query("SELECT project_id, photo_id, id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id, photo_id ORDER BY created_at DESC, id DESC) = 1", "jobs")
def brw8_latest_row(jobs: DataFrame) -> DataFrame:
    return browse.latest(jobs, ["project_id", "photo_id"], F.desc("created_at"), F.desc("id")).select("project_id", "photo_id", "id", "status")


_COUNTERS = """, c AS (SELECT project_id, person_id, count(*) AS face_count, count(*) FILTER (is_positive) AS positive_count, count(*) FILTER (assignment_status = 'auto_assigned') AS auto_count,
  count(*) FILTER (assignment_status = 'review_pending') AS pending_count FROM assignments WHERE assignment_status <> 'rejected' GROUP BY ALL),
x AS (SELECT p.project_id, p.id AS person_id, is_named, coalesce(face_count, 0) AS face_count, coalesce(positive_count, 0) AS positive_count, coalesce(auto_count, 0) AS auto_count, coalesce(pending_count, 0) AS pending_count
  FROM persons p LEFT JOIN c ON c.project_id = p.project_id AND c.person_id = p.id) """


@query(
    _COUNTERS + """SELECT project_id, person_id, face_count, CAST(row_number() OVER (PARTITION BY project_id ORDER BY is_named DESC, positive_count DESC, face_count DESC, person_id DESC) AS INT) AS rank,
  count(*) OVER (PARTITION BY project_id) AS total FROM x WHERE face_count >= 2 QUALIFY rank <= 8""",
    "assignments", "persons",
)
def brw9_people_list(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    return browse.people_list(assignments, persons, 8, 2).select("project_id", "person_id", "face_count", "rank", "total")


@query(
    """, b AS (SELECT project_id, face_id, count(DISTINCT person_id) AS n FROM assignments WHERE assignment_status = 'rejected' GROUP BY ALL)
SELECT a.project_id, a.face_id, a.id, a.person_id, f.photo_id, CAST(coalesce(n, 0) AS INT) AS n_barred FROM assignments a JOIN face_embeddings f ON f.project_id = a.project_id AND f.face_id = a.face_id
LEFT JOIN b ON b.project_id = a.project_id AND b.face_id = a.face_id WHERE a.assignment_status = 'review_pending'""",
    "assignments", "face_embeddings",
)
def brw10_review_list(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    barred = assignments.where("assignment_status = 'rejected'").select("project_id", "face_id", F.col("person_id").alias("not_person_id"))
    return browse.review_list(assignments, faces, barred).drop("barred")


@query(
    """SELECT project_id, person_id, id, CAST(row_number() OVER (PARTITION BY project_id, person_id ORDER BY is_positive DESC, id DESC) AS INT) AS rank,
  count(*) OVER (PARTITION BY project_id, person_id) AS total FROM assignments QUALIFY rank <= 15""",
    "assignments",
)
def brw11_person_detail(assignments: DataFrame) -> DataFrame:
    return browse.person_detail(assignments, 15)


@query("SELECT project_id, face_id, photo_id, status, CAST(row_number() OVER (PARTITION BY project_id ORDER BY face_id DESC) AS INT) AS rank FROM face_embeddings WHERE status = 'embedded' QUALIFY rank BETWEEN 31 AND 60", "face_embeddings")
def brw12_face_list(faces: DataFrame) -> DataFrame:
    return browse.face_list(faces, 2, 30, "embedded")


@query(
    """SELECT project_id, face_id, person_id, assignment_status FROM assignments WHERE assignment_status <> 'rejected' QUALIFY row_number() OVER (PARTITION BY project_id, face_id
  ORDER BY CASE WHEN assignment_status LIKE 'human%' THEN 0 WHEN assignment_status = 'auto_assigned' THEN 1 ELSE 2 END, id DESC) = 1""",
    "assignments",
)
def brw13_best_assignment(assignments: DataFrame) -> DataFrame:
    return browse.best_assignment(assignments)


@query(_COUNTERS + "SELECT project_id, person_id, face_count, positive_count, auto_count, pending_count FROM x", "assignments", "persons")
def ppl8_person_counters(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    return browse.person_counters(assignments, persons).select("project_id", "person_id", "face_count", "positive_count", "auto_count", "pending_count")


_DUPLICATES = f""", d AS (SELECT project_id, id, first_value(id) OVER w AS source_id, first_value(file_name) OVER w AS source_name FROM photos
  WHERE {ACTIVE} AND file_hash IS NOT NULL WINDOW w AS (PARTITION BY project_id, file_hash ORDER BY id)) """


@query(_DUPLICATES + "SELECT project_id, id, source_id, source_name, 'REVIEW' AS decision, 'suspected_duplicate' AS classification, CAST(1 AS DOUBLE) AS confidence FROM d WHERE id <> source_id", "photos")
def cln1_exact_duplicates(photos: DataFrame) -> DataFrame:
    return cleanup.exact_duplicates(photos)


@query(f"SELECT p.project_id, p.id, CAST(row_number() OVER (PARTITION BY p.project_id ORDER BY p.id) AS INT) AS place FROM photos p WHERE {ACTIVE} AND NOT EXISTS (FROM items i WHERE i.project_id = p.project_id AND i.photo_id = p.id)", "photos", "items")
def cln3_review_candidates(photos: DataFrame, items: DataFrame) -> DataFrame:
    return cleanup.review_candidates(photos, items)


_CLASS = "CASE classification WHEN 'meaningless_test' THEN 'meaningless_test_image' ELSE classification END"


@query(f"SELECT project_id, {_CLASS} AS classification, count(*) AS count FROM items WHERE status IN ('review', 'kept') AND NOT is_video GROUP BY ALL", "items")
def cln4_class_counts(items: DataFrame) -> DataFrame:
    return cleanup.class_counts(items, ["review", "kept"])


@query(
    f"""SELECT project_id, id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS INT) AS rank, count(*) OVER (PARTITION BY project_id) AS total
FROM items WHERE {_CLASS} = 'meaningless_test_image' QUALIFY rank BETWEEN 1 AND 50""",
    "items",
)
def cln5_item_list(items: DataFrame) -> DataFrame:
    return cleanup.item_page(items, ["meaningless_test"], 1, 50)


# Both passes of a model, written as it answers: some in a code fence, some with words around, some not readable.
_CLASSES = "CASE photo_id % 4 WHEN 0 THEN 'severe_blur' WHEN 1 THEN 'Blank_Image' WHEN 2 THEN 'landscape' ELSE 'meaningless_test_image' END"
_PASSES = f""", ps AS (SELECT project_id, photo_id, classification, human_label, CASE WHEN photo_id % 3 = 0 THEN 'KEEP' ELSE 'QUARANTINE' END AS decision, lower({_CLASSES}) AS c1, CASE WHEN photo_id % 5 = 0 THEN 'severe_blur' ELSE lower({_CLASSES}) END AS c2, photo_id % 7 = 3 AS flagged,
  photo_id % 11 = 5 AS valuable, CASE WHEN photo_id % 6 = 1 THEN 0.9 ELSE 0.99 END AS confidence, photo_id % 9 = 2 AS sensitive, photo_id % 13 = 0 AS broken, photo_id % 8 = 7 AS single FROM items),
a1 AS (SELECT *, decision = 'QUARANTINE' AND c1 <> 'landscape' AND confidence >= 0.98 AND NOT flagged AND NOT valuable AS auto FROM ps),
vf AS (SELECT *, auto AND NOT single AND c2 = c1 AS verified FROM a1)"""


def _passes(items: DataFrame) -> DataFrame:
    n = F.col("photo_id")
    klass = F.when(n % 4 == 0, "severe_blur").when(n % 4 == 1, "Blank_Image").when(n % 4 == 2, "landscape").otherwise("meaningless_test_image")
    flags = lambda on, name: F.when(on, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    def answer(classification):
        return F.to_json(F.struct(
            F.when(n % 3 == 0, "keep").otherwise("QUARANTINE").alias("decision"), classification.alias("classification"), F.when(n % 6 == 1, 0.9).otherwise(0.99).alias("confidence"), F.lit("as seen").alias("reason"), flags(n % 7 == 3, "people").alias("preservation_flags"),
            (n % 11 == 5).alias("has_record_value"), flags(n % 9 == 2, "nudity").alias("sensitive_content_flags"),
        ))

    first = F.when(n % 13 == 0, "I can't say").when(n % 2 == 0, F.concat(F.lit("```json\n"), answer(klass), F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), answer(klass)))
    second = F.when((n % 13 != 0) & (n % 8 != 7), answer(F.when(n % 5 == 0, "severe_blur").otherwise(klass)))
    return items.select("project_id", "photo_id", "classification", "human_label", first.alias("first"), second.alias("second"))


@query(
    _PASSES + """, l AS (SELECT project_id, classification, verified AND NOT broken AS p, human_label = 'TRASH' AS h FROM vf WHERE human_label IS NOT NULL),
s AS (SELECT project_id, classification, count(*) FILTER (p AND h) AS tp, count(*) FILTER (p AND NOT h) AS fp, count(*) FILTER (NOT p AND NOT h) AS tn, count(*) FILTER (NOT p AND h) AS fn
  FROM l GROUP BY GROUPING SETS ((project_id), (project_id, classification)))
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr, tp + fp + tn + fn >= 300 AND tp + fn >= 100 AND tn + fp >= 100 AND fp = 0 AS ready FROM s""",
    "items",
)
def cln6_calibration(items: DataFrame) -> DataFrame:
    rows = _passes(items)
    return cleanup.calibration(rows.withColumns({"first": cleanup.read_pass(F.col("first")), "second": cleanup.read_pass(F.col("second"))}))


@query(
    _DUPLICATES.replace(", d AS", _PASSES + ", d AS", 1) + """, r AS (SELECT p.project_id, p.id AS photo_id, starts_with(p.mime_type, 'video/') AS is_video, d.id IS NOT NULL AS is_duplicate, vf.* EXCLUDE (project_id, photo_id) FROM photos p JOIN vf ON vf.project_id = p.project_id AND vf.photo_id = p.id LEFT JOIN d ON d.project_id = p.project_id AND d.id = p.id AND d.id <> source_id),
j AS (SELECT *, CASE WHEN sensitive OR auto AND NOT verified THEN 'REVIEW' ELSE decision END AS judged FROM r)
SELECT project_id, photo_id, CASE WHEN is_duplicate THEN 'review' WHEN is_video THEN 'kept' WHEN broken THEN 'analysis_failed' WHEN judged = 'KEEP' THEN 'kept' ELSE 'review' END AS status, CASE WHEN is_duplicate THEN 'REVIEW' WHEN is_video THEN 'KEEP' WHEN broken THEN 'REVIEW' ELSE judged END AS decision,
  CASE WHEN is_duplicate THEN 'suspected_duplicate' WHEN is_video THEN 'video_out_of_scope' WHEN broken THEN 'uncertain' ELSE c1 END AS classification, CAST(CASE WHEN is_duplicate OR is_video THEN 1 WHEN broken THEN 0 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN is_duplicate OR is_video OR broken OR NOT sensitive THEN 'SAFE' ELSE 'ADULT' END AS content_rating FROM j""",
    "photos", "items",
)
def cln2_two_passes(photos: DataFrame, items: DataFrame) -> DataFrame:
    return cleanup.decide_passes(photos, _passes(items).select("project_id", "photo_id", "first", "second"), cleanup.exact_duplicates(photos))


_VERSIONED = """, it AS (SELECT *, CASE WHEN photo_id % 3 = 0 THEN 'old' ELSE 'm' END AS model_name, CASE WHEN photo_id % 5 = 0 THEN '1' ELSE '2' END AS prompt_version, CASE WHEN photo_id % 15 = 0 THEN 'analysis_retry_queued' ELSE status END AS state FROM items)"""


@query(
    _VERSIONED + f""" SELECT p.project_id, p.id, CAST(row_number() OVER (PARTITION BY p.project_id ORDER BY CASE WHEN state = 'analysis_retry_queued' THEN 0 ELSE 1 END, p.id) AS INT) AS place FROM (SELECT project_id, id FROM photos WHERE {ACTIVE}) p LEFT JOIN it ON it.project_id = p.project_id AND it.photo_id = p.id
WHERE it.id IS NULL OR model_name <> 'm' OR prompt_version <> '2' QUALIFY place <= 40""",
    "photos", "items",
)
def cln3_next_candidates(photos: DataFrame, items: DataFrame) -> DataFrame:
    n = F.col("photo_id")
    known = items.withColumns({"model_name": F.when(n % 3 == 0, "old").otherwise("m"), "prompt_version": F.when(n % 5 == 0, "1").otherwise("2"), "status": F.when(n % 15 == 0, "analysis_retry_queued").otherwise(F.col("status"))})
    return cleanup.next_candidates(photos, known, "m", "2", 40)


_ACTIONS = """, ac AS (SELECT project_id, photo_id, max_by(CASE WHEN id % 2 = 0 THEN 'delete' ELSE 'label' END, id) AS action, max_by(CASE WHEN id % 3 = 0 THEN 'KEEP' ELSE 'TRASH' END, id) AS label, max_by(CASE WHEN id % 5 = 0 THEN 'x' ELSE md5(CAST(photo_id AS STRING)) END, id) AS now_hash FROM jobs GROUP BY ALL),
o0 AS (SELECT coalesce(i.project_id, ac.project_id) AS project_id, coalesce(i.photo_id, ac.photo_id) AS photo_id, CASE WHEN i.photo_id % 6 = 0 THEN 'restored' ELSE i.status END AS status, human_label, action, label, CASE WHEN i.photo_id IS NOT NULL AND i.photo_id % 4 <> 0 THEN md5(CAST(i.photo_id AS STRING)) END AS h, now_hash FROM items i FULL JOIN ac ON ac.project_id = i.project_id AND ac.photo_id = i.photo_id),
o1 AS (SELECT *, CASE WHEN action IS NULL THEN NULL WHEN status IS NULL THEN 'not_found' WHEN action = 'label' THEN 'done' WHEN status IN ('delete_queued', 'quarantined') THEN 'unchanged' WHEN status NOT IN ('review', 'kept', 'restored') OR h IS NOT NULL AND h <> now_hash THEN 'conflict' ELSE 'done' END AS outcome FROM o0)"""


def _labelled(jobs: DataFrame, items: DataFrame, photos: DataFrame) -> dict[str, DataFrame]:
    n = F.col("id")
    actions = jobs.select("project_id", "photo_id", F.when(n % 2 == 0, "delete").otherwise("label").alias("action"), F.when(n % 3 == 0, "KEEP").otherwise("TRASH").alias("label"), F.when(n % 5 == 0, "x").otherwise(F.md5(F.col("photo_id").cast("string"))).alias("file_hash"), n.alias("seq"))
    p = F.col("photo_id")
    known = items.withColumns({"status": F.when(p % 6 == 0, "restored").otherwise(F.col("status")), "content_hash": F.when(p % 4 != 0, F.md5(p.cast("string")))})
    return cleanup.apply_labels(known, actions, photos)


@query(_ACTIONS + " SELECT project_id, photo_id, action, outcome FROM o1 WHERE outcome IS NOT NULL", "jobs", "items", "photos")
def cln8_label_outcomes(jobs: DataFrame, items: DataFrame, photos: DataFrame) -> DataFrame:
    return _labelled(jobs, items, photos)["outcome"]


@query(
    _ACTIONS + """ SELECT 'item' AS kind, project_id, photo_id, CASE WHEN action = 'delete' AND outcome = 'done' THEN 'delete_queued' ELSE status END AS status, CASE WHEN action = 'label' THEN label WHEN action = 'delete' AND outcome IN ('done', 'unchanged') THEN 'TRASH' ELSE human_label END AS human_label FROM o1 WHERE status IS NOT NULL
UNION ALL SELECT 'photo', p.project_id, p.id, CASE WHEN o1.photo_id IS NOT NULL THEN 'quarantined' ELSE p.status END, NULL FROM photos p LEFT JOIN o1 ON o1.project_id = p.project_id AND o1.photo_id = p.id AND action = 'delete' AND outcome = 'done'""",
    "jobs", "items", "photos",
)
def cln8_label_tables(jobs: DataFrame, items: DataFrame, photos: DataFrame) -> DataFrame:
    made = _labelled(jobs, items, photos)
    return made["items"].select(F.lit("item").alias("kind"), "project_id", "photo_id", "status", "human_label").union(made["photos"].select(F.lit("photo"), "project_id", "id", "status", F.lit(None).cast("string")))


@query(
    """SELECT i.project_id, i.photo_id, CASE WHEN NOT coalesce(r.available, false) THEN 'failed' WHEN p.id IS NOT NULL THEN 'remaining' ELSE 'confirmed' END AS state
FROM items i LEFT JOIN projects r ON r.id = i.project_id LEFT JOIN photos p ON p.project_id = i.project_id AND p.id = i.photo_id WHERE i.status IN ('delete_queued', 'quarantined')""",
    "items", "photos", "projects",
)
def cln7_deletion_reconcile(items: DataFrame, photos: DataFrame, projects: DataFrame) -> DataFrame:
    return cleanup.deletion_reconcile(items, photos, projects)


# Actions come in the order of jobs; several meet one item. The SQL goes through them one by one.
_REVIEW = """RECURSIVE it AS (SELECT i.project_id, i.photo_id, CASE WHEN i.photo_id % 5 = 0 THEN 'analysis_failed' ELSE i.status END AS status, i.decision, i.human_label, CASE WHEN i.photo_id % 3 = 0 THEN 'ai_indexed' END AS prev, CAST(p.status AS VARCHAR) AS photo, p.deleted_at IS NOT NULL AS gone FROM items i LEFT JOIN photos p ON p.project_id = i.project_id AND p.id = i.photo_id),
ac AS (SELECT photo_id % 7 AS project_id, photo_id, id AS seq, ['keep', 'delete', 'undo', 'restore', 'retry', 'label_trash', 'dance', 'label_keep'][id % 8 + 1] AS action, id % 5 <> 0 AS present, id % 11 <> 0 AS matches, id % 9 <> 0 AS writable, id % 13 = 0 AS claimed, id % 17 <> 0 AS stored FROM jobs),
nu AS (SELECT *, row_number() OVER (PARTITION BY project_id, photo_id ORDER BY seq) AS n FROM ac),
st AS (
  SELECT project_id, photo_id, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS action, '' AS outcome, status, decision, human_label, prev, photo, gone, false AS reset, false AS touched FROM it
  UNION ALL
  SELECT project_id, photo_id, n, seq, action, CASE WHEN o IN ('missing', 'not queued') THEN 'invalid' WHEN o = 'occupied' THEN 'conflict' ELSE o END,
    CASE WHEN o = 'done' THEN CASE action WHEN 'keep' THEN 'kept' WHEN 'delete' THEN 'delete_queued' WHEN 'undo' THEN 'restored' WHEN 'restore' THEN 'restored' WHEN 'retry' THEN 'analysis_retry_queued' ELSE status END WHEN o = 'not queued' THEN 'queue_failed' WHEN o = 'occupied' THEN 'restore_conflict' WHEN o = 'missing' THEN 'restore_failed' ELSE status END,
    CASE WHEN o = 'done' AND action IN ('keep', 'undo') THEN 'KEEP' WHEN o = 'done' AND action = 'delete' THEN 'QUARANTINE' WHEN o = 'done' AND action = 'retry' THEN 'REVIEW' ELSE decision END,
    CASE WHEN o IN ('done', 'unchanged') AND action IN ('keep', 'restore') OR o = 'done' AND action IN ('undo', 'label_keep') THEN 'KEEP' WHEN o IN ('done', 'unchanged') AND action = 'delete' OR o = 'done' AND action = 'label_trash' THEN 'TRASH' ELSE human_label END,
    CASE WHEN o = 'done' AND action = 'delete' THEN coalesce(prev, photo) ELSE prev END,
    CASE WHEN o = 'done' AND action = 'delete' THEN 'quarantined' WHEN o = 'done' AND action IN ('undo', 'restore') THEN coalesce(prev, 'indexed') ELSE photo END,
    CASE WHEN o = 'done' AND action = 'delete' THEN true WHEN o = 'done' AND action IN ('undo', 'restore') THEN false ELSE gone END, reset OR o = 'done' AND action = 'retry', touched OR o = 'done' AND action IN ('delete', 'undo', 'restore')
  FROM (SELECT st.project_id, st.photo_id, nu.n, nu.seq, nu.action, status, decision, human_label, prev, photo, gone, reset, touched, CASE nu.action
    WHEN 'keep' THEN CASE WHEN status = 'kept' THEN 'unchanged' WHEN status NOT IN ('review', 'analysis_failed', 'move_failed', 'queue_failed', 'restored') OR gone OR coalesce(photo = 'quarantined', false) THEN 'conflict' ELSE 'done' END
    WHEN 'delete' THEN CASE WHEN status IN ('delete_queued', 'quarantined') THEN 'unchanged' WHEN status NOT IN ('review', 'moving', 'move_failed', 'queue_failed', 'analysis_failed', 'kept', 'restored') THEN 'conflict' WHEN NOT present THEN 'invalid' WHEN NOT matches THEN 'conflict' WHEN NOT writable THEN 'not queued' ELSE 'done' END
    WHEN 'undo' THEN CASE WHEN status <> 'delete_queued' OR NOT present OR claimed THEN 'conflict' ELSE 'done' END
    WHEN 'restore' THEN CASE WHEN status = 'restored' THEN 'unchanged' WHEN status NOT IN ('quarantined', 'restoring', 'restore_conflict', 'restore_failed') THEN 'conflict' WHEN present AND NOT stored THEN CASE WHEN matches THEN 'done' ELSE 'conflict' END WHEN present THEN 'occupied' WHEN NOT stored THEN 'missing' ELSE 'done' END
    WHEN 'retry' THEN CASE WHEN status = 'analysis_retry_queued' THEN 'unchanged' WHEN status <> 'analysis_failed' OR gone OR coalesce(photo = 'quarantined', false) THEN 'conflict' ELSE 'done' END
    WHEN 'label_keep' THEN 'done' WHEN 'label_trash' THEN 'done' ELSE 'invalid' END AS o
    FROM st JOIN nu ON nu.project_id = st.project_id AND nu.photo_id = st.photo_id AND nu.n = st.n + 1)),
fi AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY project_id, photo_id ORDER BY n DESC) = 1)"""


def _reviewed(jobs: DataFrame, items: DataFrame, photos: DataFrame) -> dict[str, DataFrame]:
    n = F.col("id")
    names = F.array(*map(F.lit, ("keep", "delete", "undo", "restore", "retry", "label_trash", "dance", "label_keep")))
    facts = {"file_present": n % 5 != 0, "hash_matches": n % 11 != 0, "queue_writable": n % 9 != 0, "claimed": n % 13 == 0, "stored_present": n % 17 != 0}
    actions = jobs.select((F.col("photo_id") % 7).alias("project_id"), "photo_id", n.alias("seq"), F.get(names, (n % 8).cast("int")).alias("action"), *(c.alias(k) for k, c in facts.items()))
    items = items.withColumns({"status": F.when(F.col("photo_id") % 5 == 0, "analysis_failed").otherwise(F.col("status")), "previous_photo_status": F.when(F.col("photo_id") % 3 == 0, "ai_indexed")})
    return cleanup.review_actions(items, actions, photos)


def _review_oracle(select: str) -> str:
    """The recursive part must stand right behind WITH."""
    text = oracle(f", {_REVIEW.removeprefix('RECURSIVE ')} {select}", "jobs", "items", "photos")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(None, "jobs", "items", "photos")
def cln8_review_actions(jobs: DataFrame, items: DataFrame, photos: DataFrame) -> DataFrame:
    return _reviewed(jobs, items, photos)["results"]


SQL["cln8_review_actions"] = _review_oracle("SELECT project_id, photo_id, seq, action, outcome FROM st WHERE n > 0 UNION ALL SELECT project_id, photo_id, seq, action, 'not_found' FROM nu WHERE NOT EXISTS (FROM it WHERE it.project_id = nu.project_id AND it.photo_id = nu.photo_id)")


@query(None, "jobs", "items", "photos")
def cln8_review_tables(jobs: DataFrame, items: DataFrame, photos: DataFrame) -> DataFrame:
    made = _reviewed(jobs, items, photos)
    rows = made["items"].select(F.lit("item").alias("kind"), *("project_id", "photo_id", "status", "decision", "human_label", "previous_photo_status", "answer_reset"))
    return rows.union(made["photos"].select(F.lit("photo"), "project_id", "id", "status", *(F.lit(None).cast("string"),) * 3, "deleted"))


SQL["cln8_review_tables"] = _review_oracle(
    """SELECT 'item' AS kind, project_id, photo_id, status, decision, human_label, prev AS previous_photo_status, reset AS answer_reset FROM fi
UNION ALL SELECT 'photo', p.project_id, p.id, CASE WHEN touched THEN fi.photo ELSE p.status END, NULL, NULL, NULL, CASE WHEN touched THEN fi.gone ELSE p.deleted_at IS NOT NULL END FROM photos p LEFT JOIN fi ON fi.project_id = p.project_id AND fi.photo_id = p.id"""
)


@query("SELECT DISTINCT j.project_id, j.photo_id AS id, p.id IS NOT NULL AS found FROM jobs j LEFT JOIN photos p ON p.project_id = j.project_id AND p.id = j.photo_id AND p.deleted_at IS NULL", "jobs", "photos")
def cln9_batch_delete(jobs: DataFrame, photos: DataFrame) -> DataFrame:
    return cleanup.batch_delete(jobs.select("project_id", F.col("photo_id").alias("id")), photos)


@query(
    f""", j AS (SELECT project_id, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("failed", "paused", "queued", "running", "success"))} FROM jobs GROUP BY ALL),
d AS (SELECT project_id, count(DISTINCT photo_id) AS analysed FROM analysis GROUP BY ALL), t AS (SELECT project_id, count(*) AS photos FROM photos WHERE {ACTIVE} GROUP BY ALL)
SELECT t.project_id, t.photos, coalesce(failed, 0) AS failed, coalesce(paused, 0) AS paused, coalesce(queued, 0) AS queued, coalesce(running, 0) AS running, coalesce(success, 0) AS success, coalesce(analysed, 0) AS analysed
FROM t LEFT JOIN j USING (project_id) LEFT JOIN d USING (project_id)""",
    "jobs", "photos", "analysis",
)
def job1_status_rollup(jobs: DataFrame, photos: DataFrame, analysis: DataFrame) -> DataFrame:
    return cleanup.job_rollup(jobs, photos, analysis)


_BUSY = "status IN ('queued', 'running', 'paused')"


@query(
    f"""SELECT project_id, id FROM photos p WHERE {ACTIVE} AND NOT EXISTS (FROM jobs j WHERE j.{_BUSY} AND j.project_id = p.project_id AND j.photo_id = p.id)
  AND NOT EXISTS (FROM analysis a WHERE a.project_id = p.project_id AND a.photo_id = p.id)""",
    "photos", "jobs", "analysis",
)
def job2_analysis_candidates(photos: DataFrame, jobs: DataFrame, analysis: DataFrame) -> DataFrame:
    return cleanup.analysis_candidates(photos, jobs, analysis)


@query(
    f"""SELECT p.project_id, p.photo_id, CASE WHEN EXISTS (FROM jobs j WHERE j.{_BUSY} AND j.job_type = 'embed' AND j.project_id = p.project_id AND j.photo_id = p.photo_id) THEN 'skipped' ELSE 'created' END AS outcome
FROM (SELECT DISTINCT project_id, photo_id FROM analysis) p""",
    "analysis", "jobs",
)
def job3_unique_enqueue(analysis: DataFrame, jobs: DataFrame) -> DataFrame:
    return cleanup.enqueue(analysis, jobs, "embed")


@query("SELECT project_id, job_type, error_message, count(*) AS n, max(created_at) AS last_at FROM jobs WHERE status = 'failed' AND error_message IS NOT NULL GROUP BY ALL", "jobs")
def job4_task_failures(jobs: DataFrame) -> DataFrame:
    return cleanup.failures(jobs)


@query(
    """, r AS (SELECT project_id, id, photo_id, status, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM jobs WHERE status IN ('failed', 'paused') QUALIFY rank BETWEEN 41 AND 80)
SELECT r.*, p.file_name FROM r LEFT JOIN photos p ON p.project_id = r.project_id AND p.id = r.photo_id""",
    "jobs", "photos",
)
def job5_job_list(jobs: DataFrame, photos: DataFrame) -> DataFrame:
    return cleanup.job_page(jobs, photos, ["failed", "paused"], 2, 40).drop("total")


@query(
    """, f AS (SELECT * FROM jobs WHERE status IN ('failed', 'paused') AND job_type = 'embed'), r AS (SELECT project_id, id, photo_id, status, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS INT) AS rank, count(*) OVER (PARTITION BY project_id) AS total FROM f QUALIFY rank <= 20)
SELECT r.*, p.file_name FROM r LEFT JOIN photos p ON p.project_id = r.project_id AND p.id = r.photo_id""",
    "jobs", "photos",
)
def job5_typed_page(jobs: DataFrame, photos: DataFrame) -> DataFrame:
    return cleanup.job_page(jobs, photos, ["failed", "paused"], 1, 20, ["embed"])


@query(
    """, st AS (SELECT project_id, photo_id, CASE photo_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'stale' ELSE 'missing' END AS state FROM analysis), c AS (SELECT project_id, count(DISTINCT photo_id) AS analysed FROM analysis GROUP BY ALL),
s AS (SELECT project_id, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'stale') AS stale FROM st GROUP BY ALL)
SELECT project_id, analysed, ready, failed, stale, greatest(0, analysed - ready - failed - stale) AS missing FROM c JOIN s USING (project_id)""",
    "analysis",
)
def job1_embedding_counts(analysis: DataFrame) -> DataFrame:
    n = F.col("photo_id") % 4
    states = analysis.select("project_id", "photo_id", F.when(n == 0, "ready").when(n == 1, "failed").when(n == 2, "stale").otherwise("missing").alias("state"))
    return cleanup.embedding_rollup(states, analysis)


@query(
    f""", fr AS (SELECT project_id, id FROM photos p WHERE {ACTIVE} AND NOT EXISTS (FROM jobs j WHERE j.{_BUSY} AND j.project_id = p.project_id AND j.photo_id = p.id))
SELECT 'completed' AS scope, fr.* FROM fr WHERE EXISTS (FROM analysis a WHERE a.project_id = fr.project_id AND a.photo_id = fr.id) UNION ALL SELECT 'failed', fr.* FROM fr WHERE EXISTS (FROM jobs j WHERE j.status = 'failed' AND j.project_id = fr.project_id AND j.photo_id = fr.id)
UNION ALL SELECT 'selected', fr.* FROM fr WHERE EXISTS (FROM items i WHERE i.project_id = fr.project_id AND i.photo_id = fr.id) UNION ALL SELECT 'all', fr.* FROM fr""",
    "photos", "jobs", "analysis", "items",
)
def job2_reanalysis_scopes(photos: DataFrame, jobs: DataFrame, analysis: DataFrame, items: DataFrame) -> DataFrame:
    selected = items.select("project_id", F.col("photo_id").alias("id"))
    parts = [cleanup.reanalysis_candidates(photos, jobs, analysis, scope, selected).select(F.lit(scope).alias("scope"), "project_id", "id") for scope in ("completed", "failed", "selected", "all")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_TASKS = """, tk AS (SELECT project_id, id, CASE WHEN id % 4 = 0 THEN ' ' WHEN id % 4 = 1 THEN 'broke ' ELSE NULL END AS e, 't' || CAST(id % 3 AS STRING) AS f FROM jobs),
fl AS (SELECT project_id, id, 0 AS o, 'task_error' AS source, trim(e) AS message, NULL AS path, 'failed' AS status, f AS timestamp FROM tk WHERE trim(e) <> ''
  UNION ALL SELECT project_id, id, 1, 'file_progress', CASE WHEN id % 2 = 0 THEN 'error' ELSE 'late' END, 'b', 'error', '2' FROM tk UNION ALL SELECT project_id, id, 2, 'file_progress', 'slow', 'a', NULL, '1' FROM tk WHERE id % 5 = 0
  UNION ALL SELECT project_id, id, 3, 'recent_error', 'second', NULL, 'failed', NULL FROM tk UNION ALL SELECT project_id, id, 4, 'recent_error', 'first', NULL, 'failed', NULL FROM tk UNION ALL SELECT project_id, id, 5, 'file_progress', 'p', 'c', 'failed', '3' FROM tk WHERE id % 3 = 0)"""


def _tasks(jobs: DataFrame) -> DataFrame:
    n = F.col("id")
    entry = lambda path, status, message, time: F.struct(F.lit(path).alias("path"), status.alias("status"), message.alias("message"), F.lit(time).alias("timestamp"))
    old = entry("a", F.lit(""), F.when(n % 5 == 0, " slow "), "1")
    new = entry("b", F.lit("Error"), F.when(n % 2 == 1, "late"), "2")
    result = F.to_json(F.struct(F.array(old, new).alias("recent_files"), F.array(F.lit("first"), F.lit(" "), F.lit("second")).alias("recent_errors")))
    progress = F.when(n % 3 == 0, F.to_json(F.struct(F.array(entry("c", F.lit("failed"), F.lit("p"), "3")).alias("recent_files"), F.array(F.lit("second")).alias("recent_errors"))))
    error = F.when(n % 4 == 0, " ").when(n % 4 == 1, "broke ")
    return jobs.select("project_id", "id", error.alias("error_message"), F.concat(F.lit("t"), (n % 3).cast("string")).alias("finished_at"), result.alias("result_payload"), progress.alias("progress_payload"))


@query(_TASKS + " SELECT project_id, id AS task_id, CAST(row_number() OVER (PARTITION BY project_id, id ORDER BY o) - 1 AS INT) AS place, source, message, path, status, timestamp FROM fl", "jobs")
def job4_payload_failures(jobs: DataFrame) -> DataFrame:
    return cleanup.task_failures(_tasks(jobs))


@query(_TASKS + " SELECT project_id, id AS task_id, count(*) AS failures, arg_min(message, CASE WHEN o = 0 THEN 99 ELSE o END) AS latest FROM fl GROUP BY ALL", "jobs")
def job4_failure_summary(jobs: DataFrame) -> DataFrame:
    return cleanup.failure_summary(cleanup.task_failures(_tasks(jobs)))


@query(
    """, w AS (SELECT a.project_id, a.photo_id, p.taken_at, CAST(1 AS DOUBLE) AS score FROM analysis a JOIN photos p ON p.project_id = a.project_id AND p.id = a.photo_id WHERE p.deleted_at IS NULL AND list_has_any(object_tags, ['the', 'la', 'der']))
SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY taken_at DESC NULLS LAST, photo_id DESC) AS INT) AS rank, count(*) OVER (PARTITION BY project_id) AS total FROM w QUALIFY rank BETWEEN 4 AND 6""",
    "analysis", "photos",
)
def brw7_tag_page(analysis: DataFrame, photos: DataFrame) -> DataFrame:
    return browse.tag_page(analysis, photos, "object_tags", ["the", "la", "der"], 2, 3)


@query(
    _COUNTERS + """SELECT project_id, person_id, pending_count, CAST(row_number() OVER (PARTITION BY project_id ORDER BY is_named DESC, positive_count DESC, face_count DESC, person_id * 7 % 10 DESC, person_id DESC) AS INT) AS rank,
  count(*) OVER (PARTITION BY project_id) AS total FROM x WHERE pending_count > 0 AND contains('person ' || CAST(person_id % 100 AS STRING) || ' #p' , 'on 1') OR pending_count > 0 AND person_id % 100 = 1 QUALIFY rank <= 4""",
    "assignments", "persons",
)
def brw9_filtered_people(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    dated = persons.withColumn("updated_at", F.col("id") * 7 % 10)
    return browse.people_list(assignments, dated, 4, pending=True, name="ON 1").select("project_id", "person_id", "pending_count", "rank", "total")


@query(
    """, b AS (SELECT project_id, face_id, array_to_string(list_sort(list_distinct(list(person_id))), ',') AS barred FROM assignments WHERE assignment_status = 'rejected' GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY id * 13 % 101 DESC, id DESC) AS INT) AS rank FROM assignments WHERE assignment_status = 'review_pending' QUALIFY rank <= 25)
SELECT r.project_id, r.id, r.face_id, r.person_id, f.photo_id, coalesce(barred, '') AS barred, rank FROM r JOIN face_embeddings f ON f.project_id = r.project_id AND f.face_id = r.face_id LEFT JOIN b ON b.project_id = r.project_id AND b.face_id = r.face_id""",
    "assignments", "face_embeddings",
)
def brw10_review_page(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    barred = assignments.where("assignment_status = 'rejected'").select("project_id", "face_id", F.col("person_id").alias("not_person_id"))
    page = browse.review_page(assignments.withColumn("updated_at", F.col("id") * 13 % 101), faces, barred, 25)
    return page.select("project_id", "id", "face_id", "person_id", "photo_id", F.array_join("barred", ",").alias("barred"), "rank")


@query(
    """, d AS (SELECT project_id, person_id, id, CAST(row_number() OVER (PARTITION BY project_id, person_id ORDER BY is_positive DESC, id * 13 % 101 DESC, id DESC) AS INT) AS rank FROM assignments QUALIFY rank <= 5),
p AS (SELECT project_id, person_id, face_id FROM assignments WHERE assignment_status = 'review_pending' QUALIFY row_number() OVER (PARTITION BY project_id, person_id ORDER BY face_id) <= 500), l AS (SELECT project_id, person_id, string_agg(CAST(face_id AS STRING), ',' ORDER BY face_id) AS pending FROM p GROUP BY ALL)
SELECT d.*, coalesce(pending, '') AS pending FROM d LEFT JOIN l USING (project_id, person_id)""",
    "assignments",
)
def brw11_detail_with_pending(assignments: DataFrame) -> DataFrame:
    detail = browse.person_detail(assignments.withColumn("updated_at", F.col("id") * 13 % 101), 5).drop("total")
    waiting = browse.pending_faces(assignments).select("project_id", "person_id", F.array_join("face_ids", ",").alias("p"))
    return detail.join(waiting, ["project_id", "person_id"], "left").withColumn("pending", F.coalesce("p", F.lit(""))).drop("p")


@query(
    """, f AS (SELECT *, CASE WHEN face_id % 6 <> 0 THEN face_id * 11 % 500 END AS detected_at FROM face_embeddings WHERE status = 'embedded')
SELECT project_id, face_id, photo_id, status, CAST(row_number() OVER (PARTITION BY project_id ORDER BY detected_at DESC NULLS LAST, face_id DESC) AS INT) AS rank, count(*) OVER (PARTITION BY project_id) AS total FROM f QUALIFY rank BETWEEN 31 AND 60""",
    "face_embeddings",
)
def brw12_face_page(faces: DataFrame) -> DataFrame:
    return browse.face_page(faces.withColumn("detected_at", F.when(F.col("face_id") % 6 != 0, F.col("face_id") * 11 % 500)), 2, 30, "embedded")


@query(
    """, b AS (SELECT project_id, face_id, person_id, assignment_status FROM assignments WHERE assignment_status <> 'rejected' QUALIFY row_number() OVER (PARTITION BY project_id, face_id
  ORDER BY CASE WHEN assignment_status LIKE 'human%' THEN 0 WHEN assignment_status = 'auto_assigned' THEN 1 ELSE 2 END, id * 13 % 5 DESC, id DESC) = 1)
SELECT b.*, display_name, is_named FROM b JOIN persons p ON p.project_id = b.project_id AND p.id = b.person_id""",
    "assignments", "persons",
)
def brw13_best_people(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    return browse.best_people(assignments.withColumn("updated_at", F.col("id") * 13 % 5), persons)
