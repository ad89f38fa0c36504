"""Face identity queries over the derived tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.operators import people
from shoebox.plans.library import query
from shoebox.sources.files import written

_SAMPLES = """, s AS (SELECT a.project_id, a.person_id, a.id, CAST(embedding AS DOUBLE[]) AS e, quality FROM assignments a JOIN face_embeddings f ON f.project_id = a.project_id AND f.face_id = a.face_id
  WHERE assignment_status LIKE 'human%' AND is_positive QUALIFY {where} row_number() OVER (PARTITION BY a.project_id, a.person_id ORDER BY quality DESC, a.id DESC) <= {limit})"""
_GOOD = _SAMPLES.replace("QUALIFY {where}", "AND quality >= 0.7 QUALIFY")
_MEAN = """, m0 AS (SELECT project_id, person_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM s), m1 AS (SELECT project_id, person_id, i, avg(x) AS x, count(*) AS n FROM m0 GROUP BY ALL),
pr AS (SELECT project_id, person_id, list(x ORDER BY i) AS v, max(n) AS sample_count FROM m1 GROUP BY ALL)"""
_PROTOTYPES = _GOOD.replace("{limit}", "200") + _MEAN
_HEAD = "list_aggregate(list_transform(v, lambda x: round(x, 6)), 'sum')"


def _digest() -> Column:
    return F.round(F.aggregate(F.transform("vector", lambda x: F.round(x, 6)), F.lit(0.0), lambda a, b: a + b), 5).alias("element_sum")


@query(_PROTOTYPES + f" SELECT project_id, person_id, sample_count, round({_HEAD}, 5) AS element_sum FROM pr", "assignments", "face_embeddings")
def ppl1_centroid_prototype(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return people.prototypes(assignments, faces).select("project_id", "person_id", "sample_count", _digest())


@query(
    _PROTOTYPES.replace("quality >= 0.7", "quality >= 0.98") + ", p1 AS MATERIALIZED (SELECT * FROM pr) " + _SAMPLES.replace("{where}", "").replace("{limit}", "200").replace("s AS", "s2 AS", 1)
    + _MEAN.replace("m0", "n0").replace("m1", "n1").replace("pr AS", "p2 AS").replace("FROM s)", "FROM s2)")
    + """ SELECT project_id, person_id, sample_count, 'prototype' AS source FROM p1 UNION ALL SELECT project_id, person_id, sample_count, 'samples' FROM p2 WHERE NOT EXISTS (FROM p1 WHERE p1.project_id = p2.project_id AND p1.person_id = p2.person_id)""",
    "assignments", "face_embeddings",
)
def ppl2_search_profile(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    protos = people.prototypes(assignments, faces, 0.98)
    return people.search_profiles(assignments, faces, protos).select("project_id", "person_id", "sample_count", "source")


_PAIRS = _PROTOTYPES + """, fr AS (SELECT project_id, face_id, quality, CAST(embedding AS DOUBLE[]) AS e FROM face_embeddings f WHERE status = 'embedded' AND NOT EXISTS (FROM assignments a WHERE assignment_status LIKE 'human%' AND a.project_id = f.project_id AND a.face_id = f.face_id)),
pa AS (SELECT fr.project_id, face_id, person_id, e, round(list_cosine_similarity(e, v), 6) AS similarity FROM fr JOIN pr USING (project_id)),
br AS (SELECT project_id, face_id, person_id FROM assignments WHERE assignment_status = 'rejected')"""
_MATCH = _PAIRS + """, be AS (SELECT project_id, face_id, person_id, similarity, CASE WHEN similarity >= 0.3 THEN 'auto_assigned' ELSE 'review_pending' END AS decision FROM pa
  WHERE similarity >= 0.1 AND NOT EXISTS (FROM br WHERE br.project_id = pa.project_id AND br.face_id = pa.face_id AND br.person_id = pa.person_id)
  QUALIFY row_number() OVER (PARTITION BY project_id, face_id ORDER BY similarity DESC, person_id) = 1)"""


def _barred(assignments: DataFrame) -> DataFrame:
    return assignments.where("assignment_status = 'rejected'").select("project_id", "face_id", F.col("person_id").alias("not_person_id"))


def _decisions(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return people.match(people.prototypes(assignments, faces), faces, assignments, _barred(assignments), 0.3, 0.1)


@query(_MATCH + " SELECT * FROM be", "assignments", "face_embeddings")
def ppl3_face_match(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return _decisions(assignments, faces)


@query(
    _PROTOTYPES + """, al AS (SELECT project_id, face_id, status, quality, CAST(embedding AS DOUBLE[]) AS e FROM face_embeddings),
ng AS (SELECT a.project_id, a.person_id, a.face_id, e FROM assignments a JOIN al ON al.project_id = a.project_id AND al.face_id = a.face_id WHERE assignment_status = 'rejected' AND status = 'embedded' AND quality >= 0.7)
SELECT DISTINCT al.project_id, al.face_id, pr.person_id AS not_person_id FROM al JOIN pr ON pr.project_id = al.project_id JOIN ng ON ng.project_id = al.project_id AND ng.person_id = pr.person_id AND ng.face_id <> al.face_id
WHERE round(list_cosine_similarity(al.e, v), 6) >= 0.1 AND round(list_cosine_similarity(al.e, ng.e), 6) >= 0.2 AND round(list_cosine_similarity(al.e, ng.e), 6) >= round(list_cosine_similarity(al.e, v), 6)""",
    "assignments", "face_embeddings",
)
def ppl4_negative_generalisation(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    excluded = assignments.where("assignment_status = 'rejected'").select("project_id", "face_id", "person_id")
    return people.generalised_bars(people.prototypes(assignments, faces), faces, excluded, 0.2, 0.1)


@query(
    """SELECT project_id, face_id FROM face_embeddings f WHERE status = 'embedded'
  AND NOT EXISTS (FROM assignments a WHERE assignment_status LIKE 'human%' AND a.project_id = f.project_id AND a.face_id = f.face_id)
  AND (NOT EXISTS (FROM assignments a WHERE assignment_status <> 'rejected' AND a.project_id = f.project_id AND a.face_id = f.face_id) OR EXISTS (FROM assignments a WHERE assignment_status = 'review_pending' AND a.project_id = f.project_id AND a.face_id = f.face_id))""",
    "face_embeddings", "assignments",
)
def ppl5_rematch_candidates(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    return people.rematch_candidates(faces, assignments, None)


@query(
    _MATCH + """ SELECT a.project_id, a.face_id, a.person_id, a.id, CASE WHEN assignment_status LIKE 'human%' OR be.person_id IS NULL THEN assignment_status WHEN be.person_id = a.person_id THEN decision ELSE 'rejected' END AS assignment_status,
  CASE WHEN assignment_status LIKE 'human%' OR be.person_id IS NULL THEN NULL WHEN be.person_id = a.person_id THEN 'similarity_match' WHEN assignment_status <> 'rejected' THEN 'prototype_rematch' END AS assignment_source
FROM assignments a LEFT JOIN be ON be.project_id = a.project_id AND be.face_id = a.face_id UNION ALL
SELECT project_id, face_id, person_id, NULL, decision, 'similarity_match' FROM be WHERE NOT EXISTS (FROM assignments a WHERE a.project_id = be.project_id AND a.face_id = be.face_id AND a.person_id = be.person_id)""",
    "assignments", "face_embeddings",
)
def ppl6_rematch_apply(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return people.apply_rematch(assignments, _decisions(assignments, faces))


@query(None, "face_embeddings", "assignments")
def ppl7_unknown_face_clustering(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    return people.cluster_rounds(faces, assignments)


@query(None, "face_embeddings", "assignments")
def ppl7_clusters_in_rounds(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    made = people.cluster_tables(people.cluster_rounds(faces, assignments))
    return made["assignments"].join(made["persons"], ["project_id", "cluster"])


@query(None, "face_embeddings", "assignments")
def ppl7_photo_clusters(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    return people.cluster_rounds(faces, assignments, by=("project_id", "photo_id"))


@query(None, "lineitem")
def ppl9_detection_reconcile(lines: DataFrame) -> DataFrame:
    box = [(F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") % 300).alias("y"), (F.col("l_quantity") + 20).cast("bigint").alias("w"), (F.col("l_quantity") + 30).cast("bigint").alias("h")]
    rows = written(lines.select((F.col("l_orderkey") % 7).alias("project_id"), F.col("l_orderkey").alias("photo_id"), *box, (F.col("l_linenumber") + F.col("l_partkey") * 10).cast("bigint").alias("face_id"), "l_linenumber").distinct())
    new = rows.where("l_linenumber <> 3").withColumn("x", F.when(F.col("l_linenumber") == 2, F.col("x") + 3).when(F.col("l_linenumber") == 4, F.col("x") + 200).otherwise(F.col("x"))).withColumnRenamed("face_id", "place")
    return people.reconcile_boxes(rows.drop("l_linenumber"), new.drop("l_linenumber"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(0.65::DOUBLE * CASE WHEN l_tax = 0 THEN 0.5 ELSE 1 - l_discount END::DOUBLE + 0.35::DOUBLE * least(1.0::DOUBLE, 12 * (l_quantity * l_quantity) / (l_suppkey * 10 + 640)), 9) AS quality FROM lineitem")
def ppl10_face_quality(lineitem: DataFrame) -> DataFrame:
    confidence = F.when(F.col("l_tax") != 0, 1 - F.col("l_discount"))
    quality = people.face_quality(confidence, F.col("l_quantity") * F.col("l_quantity"), (F.col("l_suppkey") * 10 + 640).cast("double"), 9)
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", quality.alias("quality"))


_EVENTS = """, ev AS (SELECT project_id, face_id, CASE WHEN id % 4 = 1 THEN person_id + 1 ELSE person_id END AS person_id, CASE WHEN id % 3 = 0 THEN 'exclude' ELSE 'confirm' END AS action, id AS seq FROM assignments WHERE id % 2 = 1 OR id % 3 = 0),
la AS (SELECT project_id, face_id, person_id, max_by(action, seq) AS action, max(seq) AS seq FROM ev GROUP BY ALL), wi AS (SELECT project_id, face_id, max_by(person_id, seq) AS w FROM la WHERE action = 'confirm' GROUP BY ALL)"""


def _events(assignments: DataFrame) -> DataFrame:
    person = F.when(F.col("id") % 4 == 1, F.col("person_id") + 1).otherwise(F.col("person_id"))
    return assignments.where("id % 2 = 1 OR id % 3 = 0").select("project_id", "face_id", person.alias("person_id"), F.when(F.col("id") % 3 == 0, "exclude").otherwise("confirm").alias("action"), F.col("id").alias("seq"))


@query(
    _EVENTS + """ SELECT project_id, face_id, person_id, id, assignment_status, (p OR coalesce(person_id = w, false)) AND assignment_status <> 'rejected' AS is_positive FROM (
  SELECT a.project_id, a.face_id, a.person_id, a.id, a.is_positive AS p, w, CASE WHEN a.person_id = w THEN 'human_confirmed' WHEN action = 'exclude' OR w IS NOT NULL THEN 'rejected' ELSE a.assignment_status END AS assignment_status
  FROM assignments a LEFT JOIN la ON la.project_id = a.project_id AND la.face_id = a.face_id AND la.person_id = a.person_id LEFT JOIN wi ON wi.project_id = a.project_id AND wi.face_id = a.face_id)
UNION ALL SELECT project_id, face_id, w, NULL, 'human_confirmed', true FROM wi WHERE NOT EXISTS (FROM assignments a WHERE a.project_id = wi.project_id AND a.face_id = wi.face_id AND a.person_id = w)""",
    "assignments",
)
def ppl11_feedback(assignments: DataFrame) -> DataFrame:
    return people.apply_feedback(assignments, _events(assignments))


@query(
    """, pa AS (SELECT DISTINCT project_id, person_id AS source_id, person_id + 1 AS target_id FROM assignments), fc AS (SELECT pa.*, h.assignment_status AS held FROM pa JOIN assignments a ON a.project_id = pa.project_id AND a.person_id = source_id AND a.assignment_status <> 'rejected'
  LEFT JOIN assignments h ON h.project_id = pa.project_id AND h.person_id = target_id AND h.face_id = a.face_id WHERE source_id % 3 <> 0),
co AS (SELECT project_id, source_id, target_id, count(*) FILTER (held IS NULL) AS moved, count(*) FILTER (held = 'rejected') AS revived FROM fc GROUP BY ALL)
SELECT pa.*, source_id % 3 = 0 AS blocked, coalesce(moved, 0) AS moved, coalesce(revived, 0) AS revived FROM pa LEFT JOIN co USING (project_id, source_id, target_id)""",
    "assignments",
)
def ppl12_merge_people(assignments: DataFrame) -> DataFrame:
    pairs = assignments.select("project_id", F.col("person_id").alias("source_id"), (F.col("person_id") + 1).alias("target_id")).distinct()
    links = pairs.where("source_id % 3 = 0").select("project_id", F.col("source_id").alias("person_a"), F.col("target_id").alias("person_b"))
    return people.merge_people(assignments, pairs, links)


@query("SELECT project_id, face_id, person_id, 50 - person_id % 7 AS new_person_id, least(person_id, 50 - person_id % 7) AS a, greatest(person_id, 50 - person_id % 7) AS b FROM assignments WHERE assignment_status <> 'rejected' AND face_id % 3 = 0", "assignments")
def ppl13_split_person(assignments: DataFrame) -> DataFrame:
    chosen = assignments.where("face_id % 3 = 0").select("project_id", "face_id", "person_id", (50 - F.col("person_id") % 7).alias("new_person_id"))
    return people.split_people(assignments, chosen)


@query(
    """, every AS (SELECT project_id, id FROM persons UNION ALL SELECT project_id, id + 1000 FROM persons)
SELECT p.project_id, p.id AS person_id, NOT EXISTS (FROM assignments a WHERE a.assignment_status <> 'rejected' AND a.project_id = p.project_id AND a.person_id = p.id) AS deletable FROM every p""",
    "persons", "assignments",
)
def ppl14_delete_rules(persons: DataFrame, assignments: DataFrame) -> DataFrame:
    """All assignments; each person is joined by one without any, since every person of the derived table has some."""
    known = persons.select("project_id", "id")
    return people.deletable_people(assignments, known.union(known.withColumn("id", F.col("id") + 1000)))


@query(
    """SELECT project_id, id AS photo_id, CASE WHEN EXISTS (FROM jobs j WHERE status IN ('queued', 'running') AND j.project_id = p.project_id AND j.photo_id = p.id) THEN 'skipped' ELSE 'created' END AS outcome
FROM photos p WHERE deleted_at IS NULL AND NOT EXISTS (FROM face_embeddings f WHERE f.project_id = p.project_id AND f.photo_id = p.id)""",
    "photos", "face_embeddings", "jobs",
)
def ppl15_face_scan_plan(photos: DataFrame, faces: DataFrame, jobs: DataFrame) -> DataFrame:
    return people.scan_plan(photos, faces, jobs, "missing")


# Faces with a model, the time of their embedding and of their detection, as numbers that order them.
_MODELLED = """, fm AS (SELECT project_id, face_id, photo_id, quality, status, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN face_id % 4 = 0 THEN 'b' ELSE 'a' END AS model, CASE WHEN face_id % 9 <> 0 THEN face_id * 7 % 1000 END AS embedded_at, face_id * 11 % 500 AS detected_at FROM face_embeddings)"""
_MODEL_SAMPLES = _MODELLED + """, s0 AS (SELECT a.project_id, a.person_id, a.id, a.face_id, e, quality, model, embedded_at FROM assignments a JOIN fm ON fm.project_id = a.project_id AND fm.face_id = a.face_id WHERE assignment_status LIKE 'human%' AND is_positive AND quality >= 0.7),
s1 AS (SELECT *, first_value(model) OVER (PARTITION BY project_id, person_id ORDER BY embedded_at DESC NULLS LAST, face_id DESC) AS newest FROM s0), s AS (SELECT * FROM s1 WHERE model = newest QUALIFY row_number() OVER (PARTITION BY project_id, person_id ORDER BY quality DESC, id DESC) <= 200)"""
_MODEL_MEAN = _MODEL_SAMPLES + _MEAN.replace("pr AS", "p0 AS") + ", pr AS (SELECT DISTINCT p0.*, newest FROM p0 JOIN s ON s.project_id = p0.project_id AND s.person_id = p0.person_id)"


def _modelled(faces: DataFrame) -> DataFrame:
    n = F.col("face_id")
    return faces.withColumns({"model": F.when(n % 4 == 0, "b").otherwise("a"), "version": F.lit("1"), "embedded_at": F.when(n % 9 != 0, n * 7 % 1000), "detected_at": n * 11 % 500})


@query(_MODEL_MEAN + f" SELECT project_id, person_id, newest || '|1|64' AS space, sample_count, round({_HEAD}, 5) AS element_sum FROM pr", "assignments", "face_embeddings")
def ppl1_newest_model(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return people.prototypes(assignments, _modelled(faces)).select("project_id", "person_id", "space", "sample_count", _digest())


_STORED = """, st AS (SELECT project_id, person_id, id, list_slice(e, 1, CASE WHEN id % 3 = 0 THEN 32 ELSE 64 END) AS v, id * 13 % 101 AS updated_at FROM (SELECT a.project_id, a.person_id, a.id, CAST(embedding AS DOUBLE[]) AS e FROM assignments a JOIN face_embeddings f ON f.project_id = a.project_id AND f.face_id = a.face_id WHERE a.person_id % 3 <> 0)),
nw AS (SELECT project_id, person_id, v FROM st WHERE len(v) = 64 QUALIFY row_number() OVER (PARTITION BY project_id, person_id ORDER BY updated_at DESC, id DESC) = 1)"""


@query(
    _SAMPLES.replace("{where}", "").replace("{limit}", "200") + _MEAN + _STORED + f""", al AS (SELECT project_id, person_id, v, 'prototype' AS source FROM nw UNION ALL SELECT project_id, person_id, v, 'samples' FROM pr WHERE NOT EXISTS (FROM nw WHERE nw.project_id = pr.project_id AND nw.person_id = pr.person_id))
SELECT al.project_id, al.person_id, source, round(list_sum(v), 3) AS element_sum FROM al JOIN persons p ON p.project_id = al.project_id AND p.id = al.person_id WHERE is_named""",
    "assignments", "face_embeddings", "persons",
)
def ppl2_named_profiles(assignments: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    vector = F.slice(F.col("embedding").cast("array<double>"), 1, F.when(F.col("id") % 3 == 0, 32).otherwise(64))
    stored = assignments.where("person_id % 3 <> 0").join(faces.select("project_id", "face_id", "embedding"), ["project_id", "face_id"]).select("project_id", "person_id", "id", vector.alias("vector"), F.lit(1).alias("sample_count"), (F.col("id") * 13 % 101).alias("updated_at"))
    found = people.search_profiles(assignments, faces, people.newest_prototypes(stored, 64), persons)
    return found.select("project_id", "person_id", "source", F.round(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b), 3).alias("element_sum"))


@query(
    _MODEL_MEAN + """, fr AS (SELECT * FROM fm WHERE status = 'embedded' AND NOT EXISTS (FROM assignments a WHERE assignment_status LIKE 'human%' AND a.project_id = fm.project_id AND a.face_id = fm.face_id)),
pa AS (SELECT fr.project_id, fr.face_id, pr.person_id, round(list_cosine_similarity(e, v), 6) AS similarity FROM fr JOIN pr ON pr.project_id = fr.project_id AND newest = model JOIN persons p ON p.project_id = pr.project_id AND p.id = pr.person_id AND is_named)
SELECT *, 'review_pending' AS decision FROM pa WHERE similarity >= 0.1 AND NOT EXISTS (FROM assignments b WHERE assignment_status = 'rejected' AND b.project_id = pa.project_id AND b.face_id = pa.face_id AND b.person_id = pa.person_id) QUALIFY row_number() OVER (PARTITION BY project_id, face_id ORDER BY similarity DESC, person_id) = 1""",
    "assignments", "face_embeddings", "persons",
)
def ppl3_same_model_match(assignments: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    modelled = _modelled(faces)
    older = modelled.withColumns({"embedding": F.reverse("embedding"), "embedded_at": F.lit(-1).cast("bigint"), "embedding_id": F.lit(0)}).where("face_id % 9 <> 0")
    newest = people.newest_embeddings(modelled.withColumn("embedding_id", F.lit(1)).unionByName(older))
    return people.match(people.prototypes(assignments, modelled), newest, assignments, _barred(assignments), 0.3, 0.1, persons, auto=False)


_FREE = "status = 'embedded' AND NOT EXISTS (FROM assignments a WHERE assignment_status LIKE 'human%' AND a.project_id = fm.project_id AND a.face_id = fm.face_id)"


@query(
    _MODELLED + f""", f0 AS (SELECT 'project' AS scope, project_id, face_id, embedded_at, detected_at FROM fm WHERE {_FREE} UNION ALL SELECT 'time_range', project_id, face_id, embedded_at, detected_at FROM fm WHERE {_FREE} AND detected_at BETWEEN 100 AND 300
  UNION ALL SELECT 'person', project_id, face_id, embedded_at, detected_at FROM fm WHERE {_FREE} AND NOT EXISTS (FROM assignments a WHERE assignment_status <> 'rejected' AND person_id = 3 AND a.project_id = fm.project_id AND a.face_id = fm.face_id))
SELECT scope, project_id, face_id, CAST(row_number() OVER (PARTITION BY scope, project_id ORDER BY embedded_at DESC NULLS LAST, detected_at DESC, face_id DESC) AS INT) AS rank FROM f0 QUALIFY rank <= 5000""",
    "face_embeddings", "assignments",
)
def ppl5_rematch_scopes(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    own = {"project": {}, "time_range": {"start": 100, "end": 300}, "person": {"person_id": 3}}
    parts = [people.rematch_candidates(_modelled(faces), assignments, 5000, scope, **more).select(F.lit(scope).alias("scope"), "project_id", "face_id", "rank") for scope, more in own.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    _MATCH + """, fc AS (SELECT project_id, face_id FROM face_embeddings f WHERE status = 'embedded' AND NOT EXISTS (FROM assignments a WHERE assignment_status LIKE 'human%' AND a.project_id = f.project_id AND a.face_id = f.face_id))
SELECT fc.project_id, count(*) AS faces_considered, count(decision) AS matched_faces, count(*) FILTER (decision = 'auto_assigned') AS auto_assigned, count(*) FILTER (decision = 'review_pending') AS review_pending FROM fc LEFT JOIN be ON be.project_id = fc.project_id AND be.face_id = fc.face_id GROUP BY ALL""",
    "assignments", "face_embeddings",
)
def ppl6_rematch_summary(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return people.rematch_summary(people.rematch_candidates(faces, assignments, None, "project"), _decisions(assignments, faces))


@query(
    _MATCH + """, pe AS (SELECT * FROM be WHERE person_id IN (1, 101)) SELECT a.project_id, a.face_id, a.person_id, a.id, CASE WHEN assignment_status LIKE 'human%' OR pe.person_id IS NULL OR pe.person_id <> a.person_id THEN assignment_status ELSE 'review_pending' END AS assignment_status,
  CASE WHEN assignment_status NOT LIKE 'human%' AND pe.person_id = a.person_id THEN 'targeted_person_rematch' END AS assignment_source FROM assignments a LEFT JOIN pe ON pe.project_id = a.project_id AND pe.face_id = a.face_id UNION ALL
SELECT project_id, face_id, person_id, NULL, 'review_pending', 'targeted_person_rematch' FROM pe WHERE NOT EXISTS (FROM assignments a WHERE a.project_id = pe.project_id AND a.face_id = pe.face_id AND a.person_id = pe.person_id)""",
    "assignments", "face_embeddings",
)
def ppl6_person_rematch(assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return people.apply_rematch(assignments, _decisions(assignments, faces).where("person_id IN (1, 101)"), for_person=True)


_MOVES = """, e0 AS (SELECT project_id, face_id, person_id, CASE id % 5 WHEN 0 THEN 'move' WHEN 1 THEN 'exclude' ELSE 'confirm' END AS action, person_id + id % 3 + 1 AS target_id, id AS seq FROM assignments WHERE id % 4 <> 3),
e1 AS (SELECT project_id, face_id, person_id, CASE action WHEN 'move' THEN 'left' ELSE action END AS action, seq FROM e0 UNION ALL SELECT project_id, face_id, target_id, 'corrected', seq FROM e0 WHERE action = 'move'),
la AS (SELECT project_id, face_id, person_id, max_by(action, seq) AS action, max(seq) AS seq FROM e1 GROUP BY ALL), wi AS (SELECT project_id, face_id, max_by(person_id, seq) AS w FROM la WHERE action = 'confirm' GROUP BY ALL)"""


def _moves(assignments: DataFrame) -> DataFrame:
    n = F.col("id")
    action = F.when(n % 5 == 0, "move").when(n % 5 == 1, "exclude").otherwise("confirm")
    return assignments.where("id % 4 <> 3").select("project_id", "face_id", "person_id", action.alias("action"), (F.col("person_id") + n % 3 + 1).alias("target_id"), n.alias("seq"))


@query(
    _MOVES + """ SELECT project_id, face_id, person_id, id, assignment_status, (p OR own OR mv) AND assignment_status <> 'rejected' AS is_positive FROM (SELECT a.project_id, a.face_id, a.person_id, a.id, a.is_positive AS p, coalesce(a.person_id = w, false) AS own, coalesce(action = 'corrected', false) AS mv,
  CASE WHEN a.person_id = w THEN 'human_confirmed' WHEN action = 'corrected' THEN 'human_corrected' WHEN action = 'exclude' OR w IS NOT NULL THEN 'rejected' ELSE a.assignment_status END AS assignment_status
  FROM assignments a LEFT JOIN la ON la.project_id = a.project_id AND la.face_id = a.face_id AND la.person_id = a.person_id LEFT JOIN wi ON wi.project_id = a.project_id AND wi.face_id = a.face_id WHERE action IS NULL OR action <> 'left')
UNION ALL SELECT x.*, NULL, s, true FROM (SELECT project_id, face_id, w AS person_id FROM wi) x CROSS JOIN (SELECT 'human_confirmed' AS s) WHERE NOT EXISTS (FROM assignments a WHERE a.project_id = x.project_id AND a.face_id = x.face_id AND a.person_id = x.person_id)
UNION ALL SELECT la.project_id, la.face_id, la.person_id, NULL, 'human_corrected', true FROM la LEFT JOIN wi ON wi.project_id = la.project_id AND wi.face_id = la.face_id WHERE action = 'corrected' AND (w IS NULL OR w <> la.person_id) AND NOT EXISTS (FROM assignments a WHERE a.project_id = la.project_id AND a.face_id = la.face_id AND a.person_id = la.person_id)""",
    "assignments",
)
def ppl11_moves(assignments: DataFrame) -> DataFrame:
    return people.apply_feedback(assignments, _moves(assignments))


@query(
    _MOVES + """, bf AS (SELECT project_id, face_id, person_id FROM assignments WHERE assignment_status = 'rejected'), al AS (SELECT project_id, face_id, person_id FROM la WHERE action IN ('exclude', 'left') UNION SELECT project_id, face_id, person_id FROM bf
  UNION SELECT a.project_id, a.face_id, a.person_id FROM assignments a JOIN wi ON wi.project_id = a.project_id AND wi.face_id = a.face_id WHERE a.assignment_status <> 'rejected' AND a.person_id <> w)
SELECT project_id, face_id, person_id AS not_person_id FROM al WHERE NOT EXISTS (FROM la WHERE action IN ('confirm', 'corrected') AND la.project_id = al.project_id AND la.face_id = al.face_id AND la.person_id = al.person_id)""",
    "assignments",
)
def ppl11_constraints(assignments: DataFrame) -> DataFrame:
    return people.feedback_constraints(_moves(assignments), assignments, _barred(assignments))


_PAIRED = """, pa AS (SELECT DISTINCT project_id, person_id AS source_id, person_id + 1 AS target_id FROM assignments WHERE person_id % 2 = 0 AND person_id % 3 <> 0),
op AS (SELECT a.*, target_id FROM assignments a JOIN pa ON pa.project_id = a.project_id AND pa.source_id = a.person_id WHERE assignment_status <> 'rejected')"""


def _pairs(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    pairs = assignments.where("person_id % 2 = 0").select("project_id", F.col("person_id").alias("source_id"), (F.col("person_id") + 1).alias("target_id")).distinct()
    return pairs, pairs.where("source_id % 3 = 0").select("project_id", F.col("source_id").alias("person_a"), F.col("target_id").alias("person_b"))


@query(
    _PAIRED + """ SELECT a.project_id, a.face_id, a.person_id, a.id, CASE WHEN op.id IS NOT NULL AND a.assignment_status = 'rejected' THEN op.assignment_status ELSE a.assignment_status END AS assignment_status, CASE WHEN op.id IS NOT NULL AND a.assignment_status = 'rejected' THEN 'human_merge' END AS assignment_source
FROM assignments a LEFT JOIN op ON op.project_id = a.project_id AND op.face_id = a.face_id AND op.target_id = a.person_id WHERE NOT EXISTS (FROM op o WHERE o.project_id = a.project_id AND o.id = a.id)
UNION ALL SELECT project_id, face_id, target_id, id, assignment_status, 'human_merge' FROM op WHERE NOT EXISTS (FROM assignments a WHERE a.project_id = op.project_id AND a.face_id = op.face_id AND a.person_id = op.target_id)""",
    "assignments",
)
def ppl12_merged_tables(assignments: DataFrame) -> DataFrame:
    return people.merged_assignments(assignments, *_pairs(assignments))


#: Merges of persons by the last digit of their ids, in order: a chain, a cycle and a target met three times; (6, 8) is barred.
_CHAIN = ((0, 1), (4, 5), (6, 8), (1, 2), (5, 4), (2, 3), (7, 3), (9, 3), (3, 0))


def _merged_step(n: int, source: int, target: int) -> str:
    """SQL of the ``n``-th merge over the assignments a{n-1}."""
    return f"""o{n} AS (SELECT *, person_id + {target - source} AS target_id FROM a{n - 1} WHERE person_id % 10 = {source} AND assignment_status <> 'rejected'),
a{n} AS (SELECT a.project_id, a.face_id, a.person_id, a.id, CASE WHEN o.id IS NOT NULL AND a.assignment_status = 'rejected' THEN o.assignment_status ELSE a.assignment_status END AS assignment_status, CASE WHEN o.id IS NOT NULL AND a.assignment_status = 'rejected' THEN 'human_merge' ELSE a.assignment_source END AS assignment_source
  FROM a{n - 1} a LEFT JOIN o{n} o ON o.project_id = a.project_id AND o.face_id = a.face_id AND o.target_id = a.person_id WHERE NOT EXISTS (FROM o{n} x WHERE x.project_id = a.project_id AND x.id = a.id)
  UNION ALL SELECT project_id, face_id, target_id, id, assignment_status, 'human_merge' FROM o{n} o WHERE NOT EXISTS (FROM a{n - 1} a WHERE a.project_id = o.project_id AND a.face_id = o.face_id AND a.person_id = o.target_id))"""


_OPEN_CHAIN = [pair for pair in _CHAIN if pair != (6, 8)]


@query(
    ", a0 AS (SELECT project_id, face_id, person_id, id, assignment_status, CAST(NULL AS STRING) AS assignment_source FROM assignments), " + ", ".join(_merged_step(n, *pair) for n, pair in enumerate(_OPEN_CHAIN, 1)) + f" SELECT * FROM a{len(_OPEN_CHAIN)}",
    "assignments",
)
def ppl12_merge_chains(assignments: DataFrame) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(s).alias("s"), F.lit(t).alias("t")) for n, (s, t) in enumerate(_CHAIN)))
    base = F.col("person_id") - F.col("person_id") % 10
    merges = assignments.select("project_id", base.alias("base")).distinct().select("project_id", "base", F.inline(steps)).select("project_id", (F.col("base") + F.col("seq")).alias("seq"), (F.col("base") + F.col("s")).alias("source_id"), (F.col("base") + F.col("t")).alias("target_id"))
    barred = merges.where("source_id % 10 = 6").select("project_id", F.col("source_id").alias("person_a"), F.col("target_id").alias("person_b"))
    return people.merged_in_order(assignments, merges, barred)


@query(
    """, pa AS (SELECT DISTINCT project_id, person_id AS source_id, person_id + 1 AS target_id FROM assignments WHERE person_id % 2 = 0), r AS (SELECT project_id, id, CASE WHEN id % 4 <> 1 THEN id * 10 END AS rep FROM persons)
SELECT r.project_id, r.id, CASE WHEN EXISTS (FROM pa WHERE pa.project_id = r.project_id AND pa.source_id = r.id) THEN NULL ELSE coalesce(r.rep, g.rep) END AS representative FROM r LEFT JOIN pa ON pa.project_id = r.project_id AND pa.target_id = r.id LEFT JOIN r g ON g.project_id = pa.project_id AND g.id = pa.source_id""",
    "persons", "assignments",
)
def ppl12_representatives(persons: DataFrame, assignments: DataFrame) -> DataFrame:
    shown = persons.select("project_id", "id", F.when(F.col("id") % 4 != 1, F.col("id") * 10).alias("representative"))
    return people.merged_representatives(shown, _pairs(assignments)[0])


_CHOSEN = """, ch AS (SELECT DISTINCT project_id, face_id, person_id, 500 + person_id AS np FROM assignments WHERE face_id % 3 = 0), dn AS (SELECT ch.* FROM ch WHERE EXISTS (FROM assignments a WHERE assignment_status <> 'rejected' AND a.project_id = ch.project_id AND a.face_id = ch.face_id AND a.person_id = ch.person_id))"""


def _split(assignments: DataFrame) -> dict[str, DataFrame]:
    chosen = assignments.where("face_id % 3 = 0").select("project_id", "face_id", "person_id", (F.col("person_id") + 500).alias("new_person_id")).distinct()
    return people.split_tables(assignments, chosen)


@query(
    _CHOSEN + """ SELECT a.project_id, a.face_id, CASE WHEN np IS NOT NULL AND assignment_status <> 'rejected' THEN np ELSE a.person_id END AS person_id, a.id, CASE WHEN np IS NOT NULL AND assignment_status <> 'rejected' THEN 'human_corrected' ELSE assignment_status END AS assignment_status,
  is_positive OR np IS NOT NULL AND assignment_status <> 'rejected' AS is_positive, CASE WHEN np IS NOT NULL AND assignment_status <> 'rejected' THEN 'human_split' END AS assignment_source FROM assignments a LEFT JOIN dn ON dn.project_id = a.project_id AND dn.face_id = a.face_id AND dn.person_id = a.person_id""",
    "assignments",
)
def ppl13_split_assignments(assignments: DataFrame) -> DataFrame:
    return _split(assignments)["assignments"]


@query(
    _CHOSEN + " SELECT DISTINCT 'constraint' AS kind, project_id, face_id AS a, person_id AS b FROM dn UNION ALL SELECT DISTINCT 'link', project_id, least(person_id, np), greatest(person_id, np) FROM dn UNION ALL SELECT DISTINCT 'person', project_id, np, 1 FROM dn",
    "assignments",
)
def ppl13_split_edges(assignments: DataFrame) -> DataFrame:
    made = _split(assignments)
    rows = made["constraints"].select(F.lit("constraint").alias("kind"), "project_id", F.col("face_id").alias("a"), F.col("not_person_id").alias("b"))
    rows = rows.union(made["cannot_links"].select(F.lit("link"), "project_id", "person_a", "person_b"))
    return rows.union(made["persons"].select(F.lit("person"), "project_id", "id", F.col("is_named").cast("bigint")))


@query(
    """, ev AS (SELECT project_id, person_id, max_by(trim(n), id) AS display_name FROM (SELECT project_id, person_id, id, CASE WHEN id % 3 = 0 THEN '  ' ELSE ' Name ' || CAST(id % 7 AS STRING) || ' ' END AS n FROM assignments WHERE id % 5 = 0) WHERE trim(n) <> '' GROUP BY ALL),
nm AS (SELECT ev.*, NOT is_named AS first FROM ev JOIN persons p ON p.project_id = ev.project_id AND p.id = ev.person_id)
SELECT a.project_id, a.face_id, a.person_id, a.id, CASE WHEN nm.person_id IS NOT NULL AND assignment_status <> 'rejected' THEN 'human_confirmed' ELSE assignment_status END AS assignment_status, is_positive OR nm.person_id IS NOT NULL AND assignment_status <> 'rejected' AS is_positive
FROM assignments a LEFT JOIN nm ON first AND nm.project_id = a.project_id AND nm.person_id = a.person_id""",
    "persons", "assignments",
)
def ppl14_first_naming(persons: DataFrame, assignments: DataFrame) -> DataFrame:
    n = F.col("id")
    events = assignments.where("id % 5 = 0").select("project_id", "person_id", F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit(" Name "), (n % 7).cast("string"), F.lit(" "))).alias("name"), n.alias("seq"))
    return people.promoted(assignments, people.first_namings(persons, events))


@query(
    """, ex AS (SELECT project_id, id FROM persons UNION ALL SELECT project_id, id + 1000 FROM persons), rq AS (SELECT project_id, id AS person_id FROM persons UNION ALL SELECT project_id, id + 1000 FROM persons UNION ALL SELECT project_id, id + 2000 FROM persons),
oc AS (SELECT rq.*, CASE WHEN ex.id IS NULL THEN 'not_found' WHEN EXISTS (FROM assignments a WHERE assignment_status <> 'rejected' AND a.project_id = rq.project_id AND a.person_id = rq.person_id) THEN 'refused' ELSE 'deleted' END AS outcome FROM rq LEFT JOIN ex ON ex.project_id = rq.project_id AND ex.id = rq.person_id),
gn AS (SELECT project_id, person_id FROM oc WHERE outcome = 'deleted'), lk AS (SELECT project_id, id AS a, id + 1000 AS b FROM persons UNION ALL SELECT project_id, id, id + 1 FROM persons), ct AS (SELECT project_id, face_id, CASE WHEN id % 2 = 0 THEN person_id + 1000 ELSE person_id END AS p FROM assignments WHERE assignment_status = 'rejected')
SELECT 'outcome' AS kind, project_id, person_id AS a, NULL AS b, outcome FROM oc UNION ALL SELECT 'link', project_id, a, b, NULL FROM lk WHERE NOT EXISTS (FROM gn WHERE gn.project_id = lk.project_id AND gn.person_id IN (a, b)) UNION ALL SELECT 'constraint', project_id, face_id, p, NULL FROM ct WHERE NOT EXISTS (FROM gn WHERE gn.project_id = ct.project_id AND gn.person_id = p)""",
    "persons", "assignments",
)
def ppl14_delete_cascade(persons: DataFrame, assignments: DataFrame) -> DataFrame:
    known = persons.select("project_id", "id")
    plus = lambda n: known.select("project_id", (F.col("id") + n).alias("id"))
    requests = known.union(plus(1000)).union(plus(2000)).select("project_id", F.col("id").alias("person_id"))
    links = known.select("project_id", F.col("id").alias("person_a"), (F.col("id") + 1000).alias("person_b")).union(known.select("project_id", "id", F.col("id") + 1))
    barred = assignments.where("assignment_status = 'rejected'").select("project_id", "face_id", F.when(F.col("id") % 2 == 0, F.col("person_id") + 1000).otherwise(F.col("person_id")).alias("not_person_id"))
    made = people.delete_people(requests, known.union(plus(1000)), assignments, barred, links)
    none = F.lit(None)
    rows = made["outcome"].select(F.lit("outcome").alias("kind"), "project_id", F.col("person_id").alias("a"), none.cast("bigint").alias("b"), "outcome")
    rows = rows.union(made["cannot_links"].select(F.lit("link"), "project_id", "person_a", "person_b", none.cast("string")))
    return rows.union(made["constraints"].select(F.lit("constraint"), "project_id", "face_id", "not_person_id", none.cast("string")))


_SCANS = """, lv AS (SELECT project_id, id AS photo_id FROM photos WHERE deleted_at IS NULL), nf AS (SELECT project_id, photo_id, max(face_id % 50) AS newest FROM face_embeddings GROUP BY ALL), dv AS (SELECT project_id, photo_id FROM lv WHERE photo_id % 6 IN (1, 2, 3) AND CASE photo_id % 6 WHEN 1 THEN true WHEN 2 THEN photo_id % 5 = 0 ELSE photo_id % 7 <> 0 END),
sl AS (SELECT project_id, photo_id FROM nf WHERE newest < 45 + project_id UNION SELECT project_id, photo_id FROM dv), fl AS (SELECT project_id, photo_id FROM face_embeddings WHERE status = 'failed' UNION SELECT project_id, photo_id FROM jobs WHERE job_type = 'analyze' AND status = 'failed'), sd AS (SELECT project_id, photo_id FROM jobs WHERE id % 3 = 1),
bz AS (SELECT DISTINCT project_id, photo_id FROM jobs WHERE job_type = 'analyze' AND status IN ('queued', 'running')),
pl AS (SELECT 'stale' AS scope, lv.* FROM lv WHERE EXISTS (FROM sl WHERE sl.project_id = lv.project_id AND sl.photo_id = lv.photo_id) UNION ALL SELECT 'failed', lv.* FROM lv WHERE EXISTS (FROM fl WHERE fl.project_id = lv.project_id AND fl.photo_id = lv.photo_id) UNION ALL SELECT 'selected', lv.* FROM lv WHERE EXISTS (FROM sd WHERE sd.project_id = lv.project_id AND sd.photo_id = lv.photo_id)),
sp AS (SELECT pl.*, CASE WHEN bz.photo_id IS NOT NULL THEN 'skipped' ELSE 'created' END AS outcome FROM pl LEFT JOIN bz ON bz.project_id = pl.project_id AND bz.photo_id = pl.photo_id)"""


def _scans(photos: DataFrame, faces: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    n = F.col("photo_id")
    dated = faces.withColumn("updated_at", F.col("face_id") % 50)
    settings = faces.select("project_id").distinct().withColumn("updated_at", 45 + F.col("project_id"))
    images = photos.select("project_id", F.col("id").alias("photo_id")).where("photo_id % 6 IN (1, 2, 3, 4)").select(
        "project_id", "photo_id", F.when(n % 6 == 1, "failed").otherwise("ready").alias("status"), ((n % 6 != 2) | (n % 5 != 0)).alias("path_exists"), F.lit(True).alias("source_exists"), F.when(n % 6 == 3, n % 7).alias("source_mtime"), F.lit(0).cast("bigint").alias("file_mtime"),
    )
    stale = people.stale_scans(photos, dated, settings, images)
    plan = lambda scope, **more: people.scan_plan(photos, faces, jobs, scope, "analyze", **more)
    return {"stale": plan("stale", stale=stale), "failed": plan("failed"), "selected": plan("selected", selected=jobs.where("id % 3 = 1"))}


@query(_SCANS + " SELECT scope, project_id, photo_id, outcome FROM sp", "photos", "face_embeddings", "jobs")
def ppl15_scan_scopes(photos: DataFrame, faces: DataFrame, jobs: DataFrame) -> DataFrame:
    parts = [rows.select(F.lit(scope).alias("scope"), "project_id", "photo_id", "outcome") for scope, rows in _scans(photos, faces, jobs).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    _SCANS + """, tt AS (SELECT project_id, count(*) AS total_photos FROM lv GROUP BY ALL), cn AS (SELECT project_id, count(*) FILTER (outcome = 'created') AS c, count(*) FILTER (outcome = 'skipped') AS k FROM sp WHERE scope = 'failed' GROUP BY ALL)
SELECT project_id, total_photos, coalesce(c, 0) AS candidates, coalesce(k, 0) AS skipped_active, total_photos - coalesce(c, 0) - coalesce(k, 0) AS out_of_scope FROM tt LEFT JOIN cn USING (project_id)""",
    "photos", "face_embeddings", "jobs",
)
def ppl15_scan_counts(photos: DataFrame, faces: DataFrame, jobs: DataFrame) -> DataFrame:
    return people.scan_counts(photos, _scans(photos, faces, jobs)["failed"])
