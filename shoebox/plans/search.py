"""Search queries over the derived tables, each with SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators import ingest, search, vectors
from shoebox.sources.files import written
from shoebox.plans.library import query

_NEW = "taken_at DESC NULLS LAST, created_at DESC, photo_id DESC"


def _by_request(order: str, k: int) -> str:
    return f"CAST(row_number() OVER (PARTITION BY project_id, query_id ORDER BY {order}) AS INT) AS rank"


_LIVE = "l AS (SELECT * RENAME (id AS photo_id) FROM photos WHERE deleted_at IS NULL)"
_META = f""", {_LIVE}, m AS (SELECT s.project_id, query_id, photo_id, CAST(1 AS DOUBLE) AS score, {_by_request(_NEW, 0)} FROM l JOIN searches s USING (project_id)
  WHERE (s.year IS NULL OR year(taken_at) = s.year) AND (gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL) = needs_gps AND iso >= iso_min QUALIFY rank <= 5000)"""


@query(_META + " SELECT * FROM m", "photos", "searches")
def sch1_metadata_recall(photos: DataFrame, searches: DataFrame) -> DataFrame:
    return search.metadata_recall(searches, photos)


_CONTAINS_PLACE = " OR ".join(f"contains(lower({c}), term)" for c in search.PLACE_COLUMNS)


@query(
    f""", {_LIVE}, q AS (SELECT project_id, query_id, CASE WHEN query_id % 5 = 0 THEN TIMESTAMP '1994-03-01' END AS date_from, CASE WHEN query_id % 5 = 1 THEN TIMESTAMP '1996-01-01' END AS date_to, year, CASE WHEN query_id % 2 = 0 THEN query_id % 12 + 1 END AS month,
  CASE WHEN query_id % 3 = 1 THEN [1, 2, 3] WHEN query_id % 3 = 2 THEN CAST([] AS INT[]) END AS months, CASE WHEN query_id % 4 = 1 THEN 'low' END AS camera_make, CASE WHEN query_id % 2 = 1 THEN 'MODEL 3' END AS camera_model, ['area ' || CAST(query_id % 3 AS STRING), 'str'] AS place_terms FROM searches)
SELECT project_id, query_id, photo_id, CAST(1 AS DOUBLE) AS score, {_by_request(_NEW, 0)} FROM (SELECT l.project_id, query_id, photo_id, taken_at, created_at FROM l JOIN q USING (project_id)
  WHERE (date_from IS NULL OR taken_at >= date_from) AND (date_to IS NULL OR taken_at < date_to) AND CASE WHEN date_from IS NOT NULL OR date_to IS NOT NULL THEN true WHEN q.year IS NOT NULL THEN year(taken_at) = q.year AND (q.month IS NULL OR month(taken_at) = q.month)
    WHEN q.month IS NOT NULL THEN month(taken_at) = q.month WHEN len(months) > 0 THEN list_contains(months, month(taken_at)) ELSE true END
  AND CASE WHEN q.camera_make IS NOT NULL AND q.camera_model IS NOT NULL THEN contains(lower(l.camera_make), 'low') OR contains(lower(l.camera_model), 'model 3') WHEN q.camera_make IS NOT NULL THEN contains(lower(l.camera_make), 'low') WHEN q.camera_model IS NOT NULL THEN contains(lower(l.camera_model), 'model 3') ELSE true END
  AND list_bool_and(list_transform(place_terms, lambda term: coalesce({_CONTAINS_PLACE}, false)))) QUALIFY rank <= 5000""".replace("contains(lower(", "contains(lower("),
    "photos", "searches",
)
def sch1_metadata_filters(photos: DataFrame, searches: DataFrame) -> DataFrame:
    n = F.col("query_id")
    asked = searches.select(
        "project_id", "query_id", "year", F.when(n % 5 == 0, F.lit("1994-03-01").cast("timestamp")).alias("date_from"), F.when(n % 5 == 1, F.lit("1996-01-01").cast("timestamp")).alias("date_to"), F.when(n % 2 == 0, n % 12 + 1).alias("month"),
        F.when(n % 3 == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).when(n % 3 == 2, F.array().cast("array<int>")).alias("months"), F.when(n % 4 == 1, "low").alias("camera_make"), F.when(n % 2 == 1, "MODEL 3").alias("camera_model"),
        F.array(F.concat(F.lit("Area "), (n % 3).cast("string")), F.lit("str")).alias("place_terms"),
    )
    return search.metadata_recall(asked, photos)


_CLAUSES = f""", {_LIVE}, c AS (SELECT s.project_id, query_id, l.photo_id FROM l JOIN searches s USING (project_id) LEFT JOIN analysis a ON a.project_id = l.project_id AND a.photo_id = l.photo_id
  WHERE people_count >= query_id % 4 AND (query_id % 2 = 1 OR contains(lower(camera_make), 'low')) AND l.iso < 2000)"""


def _clauses(searches: DataFrame) -> DataFrame:
    row = lambda *x: F.struct(*(F.lit(v).cast("string").alias(n) if not hasattr(v, "cast") else v.cast("string").alias(n) for n, v in zip(("field", "op", "value"), x, strict=True)))
    rows = F.array_compact(F.array(row("people_count", "gte", F.col("query_id") % 4), row("iso", "lt", "2000"), row("unknown", "eq", "x"), F.when(F.col("query_id") % 2 == 0, row("camera_make", "contains", "LOW"))))
    return searches.select("project_id", "query_id", F.inline(rows))


@query(_CLAUSES + " SELECT * FROM c", "photos", "analysis", "searches")
def sch2_structured_clauses(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    return search.structured_filter(_clauses(searches), photos, analysis)


@query(
    f""", {_LIVE} SELECT s.project_id, query_id, l.photo_id FROM l JOIN searches s USING (project_id) WHERE coalesce(l.created_at >= TIMESTAMP '1994-01-01', false)
  AND coalesce(l.iso IN (400, 800, 2000, 3100), false) AND CASE WHEN query_id % 2 = 0 THEN coalesce(l.camera_make IN ('1-URGENT', '5-LOW'), false) ELSE true END AND (gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL) = (query_id % 3 <> 0)""",
    "photos", "analysis", "searches",
)
def sch2_structured_operators(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    row = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"))
    makers = F.when(F.col("query_id") % 2 == 0, row("camera_make", "in", F.lit("1-URGENT,5-LOW")))
    gps = F.when(F.col("query_id") % 3 == 0, row("has_gps", "ne", F.lit("true"))).otherwise(row("has_gps", "eq", F.lit("true")))
    rows = F.array_compact(F.array(row("created_at", "gte", F.lit("1994-01-01")), row("iso", "in", F.lit("400, 800,2000,3100")), row("iso", "near", F.lit("1")), makers, gps))
    return search.structured_filter(searches.select("project_id", "query_id", F.inline(rows)), photos, analysis)


@query(
    """, n AS (SELECT project_id, photo_id, count(*) AS n FROM face_embeddings WHERE status <> 'failed' GROUP BY ALL), h AS (SELECT a.*, f.photo_id FROM assignments a JOIN face_embeddings f ON f.project_id = a.project_id AND f.face_id = a.face_id),
r AS (SELECT DISTINCT project_id, photo_id FROM h WHERE assignment_status = 'review_pending'), u AS (SELECT DISTINCT h.project_id, photo_id FROM h JOIN persons p ON p.project_id = h.project_id AND p.id = h.person_id WHERE assignment_status <> 'rejected' AND NOT is_named)
SELECT q.project_id, query_id, n.photo_id FROM (SELECT query_id % 2 AS project_id, query_id FROM searches) q JOIN n USING (project_id) LEFT JOIN r ON r.project_id = n.project_id AND r.photo_id = n.photo_id LEFT JOIN u ON u.project_id = n.project_id AND u.photo_id = n.photo_id
WHERE CASE query_id % 3 WHEN 0 THEN r.photo_id IS NOT NULL WHEN 1 THEN r.photo_id IS NULL ELSE true END AND CASE query_id % 4 WHEN 0 THEN u.photo_id IS NOT NULL WHEN 1 THEN u.photo_id IS NULL ELSE true END""",
    "face_embeddings", "assignments", "persons", "searches",
)
def sch3_review_and_unnamed(faces: DataFrame, assignments: DataFrame, persons: DataFrame, searches: DataFrame) -> DataFrame:
    n = F.col("query_id")
    none = F.lit(None).cast("int")
    q = searches.select((n % 2).alias("project_id"), "query_id", none.alias("face_min"), none.alias("face_max"), F.when(n % 3 < 2, n % 3 == 0).alias("has_review_pending"), F.when(n % 4 < 2, n % 4 == 0).alias("has_unnamed_people"))
    return search.face_filter(q, faces, assignments, persons)


@query(
    """, n AS (SELECT project_id, photo_id, count(*) AS n FROM face_embeddings WHERE status <> 'failed' GROUP BY ALL)
SELECT q.project_id, query_id, photo_id FROM (SELECT query_id % 2 AS project_id, query_id FROM searches) q JOIN n USING (project_id) WHERE n BETWEEN query_id % 3 + 1 AND query_id % 3 + 2""",
    "face_embeddings", "searches",
)
def sch3_face_filters(faces: DataFrame, searches: DataFrame) -> DataFrame:
    q = searches.select((F.col("query_id") % 2).alias("project_id"), "query_id", (F.col("query_id") % 3 + 1).alias("face_min"), (F.col("query_id") % 3 + 2).alias("face_max"))
    return search.face_count_filter(q, faces)


@query(
    _META + _CLAUSES.replace(f", {_LIVE}", "") + " SELECT m.project_id, m.query_id, m.photo_id FROM m WHERE query_id % 2 = 1 OR EXISTS (FROM c WHERE c.project_id = m.project_id AND c.query_id = m.query_id AND c.photo_id = m.photo_id)",
    "photos", "analysis", "searches",
)
def sch4_constraint_intersection(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    first, second = search.metadata_recall(searches, photos), search.structured_filter(_clauses(searches), photos, analysis)
    return search.intersect([first, second], [searches, searches.where("query_id % 2 = 0")])


_TAGS = ("scene_tags", "object_tags", "activity_tags", "search_keywords", "quality_tags", "location_clues")
_IN_TAGS = lambda fields: " OR ".join(f"coalesce(list_bool_or(list_transform({c}, lambda x: contains(lower(x), t))), false)" for c in fields)
_HIT = "contains(lower(caption), t) OR contains(lower(ocr_text), t) OR contains(lower(file_name), t) OR " + " OR ".join(f"contains(lower(array_to_string({c}, ' ')), t)" for c in _TAGS)
_WORTH = "3 * CAST(contains(lower(caption), t) AS INT) + 5 * CAST(contains(lower(ocr_text), t) AS INT) + CAST(contains(lower(file_name), t) AS INT) + " + " + ".join(
    f"{2 if c in _TAGS[4:] else 4} * len(list_filter({c}, lambda x: contains(lower(x), t)))" for c in _TAGS
)
_TIERS = {"exact": 10, "strong": 7, "support": 5, "weak": 3}
_UNWANTED = "contains(lower(caption), t) OR contains(lower(ocr_text), t) OR " + _IN_TAGS([c for c in _TAGS if c != "quality_tags"])
_ENTITY = "contains(lower(caption), t) OR " + _IN_TAGS(["object_tags", "search_keywords"])
_HINT = _IN_TAGS(["search_keywords", "location_clues"])
_RAW = " + ".join(f"{w} * coalesce(list_sum(list_transform({t}, lambda t: {_WORTH})), 0)" for t, w in _TIERS.items())
_COUNTS = ", ".join(f"len(list_filter({t}, lambda t: {_WORTH} > 0)) AS n_{t}" for t in _TIERS)
_EVERY = " || ".join(_TIERS)
_KEYWORD = f""", {_LIVE}, t AS (SELECT project_id, query_id, intent, {", ".join(f"list_distinct(list_filter({c}, lambda x: x <> '')) AS {n}" for n, c in (("exact", "exact_terms"), ("strong", "expanded_terms"), ("support", "support_terms"), ("weak", "broad_terms"), ("unwanted", "negative_terms")))} FROM searches),
k0 AS (SELECT l.project_id, t.query_id, l.photo_id, l.taken_at, l.created_at, file_name, caption, ocr_text, {", ".join(_TAGS)}, intent, {", ".join(_TIERS)}, unwanted FROM l JOIN analysis a ON a.project_id = l.project_id AND a.photo_id = l.photo_id JOIN t ON t.project_id = l.project_id),
k1 AS (SELECT * FROM k0 WHERE list_bool_or(list_transform(exact || strong, lambda t: {_HIT}))),
k2 AS (SELECT project_id, query_id, photo_id, taken_at, created_at, intent, round(least(1.0, CAST({_RAW} AS DOUBLE) / (len(list_distinct({_EVERY})) * 290)), 4) AS base, {_COUNTS}, len(list_filter(unwanted, lambda t: {_UNWANTED})) AS n_negative,
  coalesce(list_bool_or(list_transform({_EVERY}, lambda t: {_ENTITY})), false) AS entity, coalesce(list_bool_or(list_transform({_EVERY}, lambda t: {_HINT})), false) AS weak_field FROM k1),
k3 AS (SELECT *, CASE WHEN intent = 'animal_search' AND n_strong > 0 AND entity THEN greatest(base, 0.65) ELSE base END AS score FROM k2),
kw AS (SELECT project_id, query_id, photo_id, score, n_exact > 0 AS exact, n_strong > 0 AS strong, n_support > 0 AS support, n_weak > 0 AS weak, n_negative, weak_field, n_exact + n_strong + n_support + n_weak + n_negative AS n_hits, {_by_request("score DESC, " + _NEW, 0)} FROM k3 WHERE score > 0 QUALIFY rank <= 2000)"""
_TIER_LIST = "array_to_string(list_filter([CASE WHEN exact THEN 'exact' END, CASE WHEN n_negative > 0 THEN 'negative' END, CASE WHEN strong THEN 'strong' END, CASE WHEN support THEN 'support' END, CASE WHEN weak THEN 'weak' END], lambda x: x IS NOT NULL), ',') AS tiers"


def _keyword_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*search.KEYS, "score", "rank", F.array_join("tiers", ",").alias("tiers"), F.col("negative_hits").alias("n_negative"), F.size("term_hits").cast("bigint").alias("n_hits"))


@query(_KEYWORD + f" SELECT project_id, query_id, photo_id, score, rank, {_TIER_LIST}, n_negative, n_hits FROM kw", "photos", "analysis", "searches")
def sch6_keyword_recall(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    return _keyword_columns(search.keyword_recall(searches, photos, analysis))


_CONCEPT = f""", c0 AS (SELECT project_id, query_id, intent, CASE WHEN query_id % 11 = 5 THEN [] ELSE list_distinct(list_filter([concept_term, expanded_terms[1]], lambda x: x <> '')) END AS cw, CASE WHEN query_id % 11 = 5 THEN [] ELSE list_distinct(list_filter(exact_terms, lambda x: x <> '')) END AS ew, ['group_photo'] AS fw FROM searches),
c1 AS (SELECT l.project_id, s.query_id, l.photo_id, intent, cw, ew, len(list_filter(cw, lambda x: list_contains(semantic_concepts, x))) AS ch, len(list_filter(ew, lambda x: list_contains(object_tags || search_keywords, x))) AS eh, len(list_filter(fw, lambda x: list_contains(coalesce(semantic_facets, []), x))) AS fh
  FROM l JOIN analysis a ON a.project_id = l.project_id AND a.photo_id = l.photo_id JOIN c0 s ON s.project_id = l.project_id),
c2 AS (SELECT *, round(CASE WHEN len(cw) > 0 AND len(ew) > 0 THEN (ch / len(cw) + eh / len(ew)) / 2 WHEN len(cw) > 0 THEN ch / len(cw) WHEN len(ew) > 0 THEN eh / len(ew) ELSE 0 END, 6) AS mean, intent = 'animal_search' AND len(ew) > 0 AND eh = 0 AND ch > 0 AS pale FROM c1 WHERE ch > 0 OR eh > 0 OR len(cw) = 0 AND len(ew) = 0 AND fh > 0),
c3 AS (SELECT *, CASE WHEN pale THEN round(mean * CAST(0.3 AS DOUBLE), 6) ELSE mean END AS score FROM c2),
cl AS (SELECT project_id, query_id, photo_id, score, pale, {_by_request("score DESC, photo_id", 0)} FROM c3 QUALIFY rank <= 200)"""


def _concepts(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    asked = lambda c: F.when(F.col("query_id") % 11 != 5, c)
    terms = F.array_compact(F.array("concept_term", F.get("expanded_terms", F.lit(0))))
    q = searches.select("project_id", "query_id", "intent", asked(terms).alias("concept_terms"), asked(F.col("exact_terms")).alias("entity_terms"), F.array(F.lit("group_photo")).alias("facet_terms"))
    return search.concept_recall(q, photos, analysis, 200)


@query(f", {_LIVE}" + _CONCEPT + " SELECT project_id, query_id, photo_id, score, rank, CASE WHEN pale THEN 'weak' ELSE 'strong' END AS tiers FROM cl", "photos", "analysis", "searches")
def sch7_concept_recall(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    return _concepts(photos, analysis, searches).select(*search.KEYS, "score", "rank", F.array_join("tiers", ",").alias("tiers"))


_PEOPLE = f""", p0 AS (SELECT project_id, query_id, query_id % 5 AS people_min, list_distinct(list_filter(expanded_terms, lambda x: x <> '')) AS pw, CASE WHEN query_id % 2 = 0 THEN ['group_photo'] ELSE [] END AS pf FROM searches),
p1 AS (SELECT l.project_id, s.query_id, l.photo_id, len(list_filter(pw, lambda x: list_contains(semantic_concepts || search_keywords || activity_tags, x))) + len(list_filter(pf, lambda x: list_contains(coalesce(semantic_facets, []), x))) + 1 AS h
  FROM l JOIN analysis a ON a.project_id = l.project_id AND a.photo_id = l.photo_id JOIN p0 s ON s.project_id = l.project_id WHERE people_count >= people_min),
p2 AS (SELECT *, round(least(1.0, 0.2 + CAST(0.2 AS DOUBLE) * h), 6) AS score FROM p1),
pl AS (SELECT project_id, query_id, photo_id, score, {_by_request("score DESC, photo_id", 0)} FROM p2 QUALIFY rank <= 300)"""


def _people(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    facets = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("group_photo")))
    q = searches.select("project_id", "query_id", (F.col("query_id") % 5).alias("people_min"), F.filter("expanded_terms", lambda t: t != "").alias("people_terms"), facets.alias("facet_terms"))
    return search.people_visual_recall(q, photos, analysis, 300)


@query(f", {_LIVE}" + _PEOPLE + " SELECT * FROM pl", "photos", "analysis", "searches")
def sch8_people_visual_recall(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    return _people(photos, analysis, searches).select(*search.KEYS, "score", "rank")


_NAMES = """, q AS (SELECT query_id % 2 AS project_id, query_id, 'find person ' || CAST(query_id % 10 AS STRING) || ' with p' || CAST(query_id % 4 AS STRING) AS text FROM searches),
t AS (SELECT project_id, id AS person_id, unnest(['person ' || CAST(id % 100 AS STRING), 'p' || CAST(id % 100 AS STRING), 'all']) AS term FROM persons),
w AS (SELECT q.project_id, query_id, person_id, term FROM q JOIN t USING (project_id) WHERE contains(text, term) QUALIFY row_number() OVER (PARTITION BY q.project_id, query_id, person_id ORDER BY length(term) DESC, term) = 1)"""


def _wanted(persons: DataFrame, searches: DataFrame) -> DataFrame:
    text = F.concat(F.lit("find Person "), (F.col("query_id") % 10).cast("string"), F.lit(" with p"), (F.col("query_id") % 4).cast("string"))
    q = searches.select((F.col("query_id") % 2).alias("project_id"), "query_id", text.alias("text"))
    return search.resolve_people(q, persons, ingest.name_terms(F.col("display_name"))["search_terms"])


@query(_NAMES + " SELECT * FROM w", "persons", "searches")
def sch9_person_name_resolve(persons: DataFrame, searches: DataFrame) -> DataFrame:
    return _wanted(persons, searches)


@query(
    """, q AS (SELECT query_id % 2 AS project_id, query_id, list_distinct(['Person ' || CAST(query_id % 12 AS STRING), ' p' || CAST(query_id % 7 AS STRING) || ' ', 'nobody']) AS names FROM searches WHERE query_id % 3 <> 0),
t AS (SELECT project_id, id AS person_id, unnest(['person ' || CAST(id % 100 AS STRING), 'p' || CAST(id % 100 AS STRING), 'all']) AS term FROM persons WHERE is_named), r AS (SELECT project_id, query_id, unnest(names) AS name FROM q)
SELECT r.project_id, query_id, name, min(person_id) AS person_id FROM r LEFT JOIN t ON t.project_id = r.project_id AND term = lower(trim(name)) GROUP BY ALL""",
    "persons", "searches",
)
def sch9_planned_names(persons: DataFrame, searches: DataFrame) -> DataFrame:
    return search.resolve_planned(_planned(searches), persons, ingest.name_terms(F.col("display_name"))["search_terms"])


def _planned(searches: DataFrame) -> DataFrame:
    n = F.col("query_id")
    names = F.array(F.concat(F.lit("Person "), (n % 12).cast("string")), F.concat(F.lit(" p"), (n % 7).cast("string"), F.lit(" ")), F.lit("nobody"))
    return searches.where("query_id % 3 <> 0").select((n % 2).alias("project_id"), "query_id", names.alias("planned_names"))


@query(
    _NAMES + """, n AS (SELECT project_id, query_id, count(DISTINCT person_id) AS n FROM w GROUP BY ALL) SELECT q.project_id, q.query_id, CASE WHEN n > 1 THEN 'all' WHEN n = 1 THEN 'any' ELSE 'none' END AS mode FROM q LEFT JOIN n ON n.project_id = q.project_id AND n.query_id = q.query_id""",
    "persons", "searches",
)
def sch9_people_modes(persons: DataFrame, searches: DataFrame) -> DataFrame:
    return search.people_modes(searches.select((F.col("query_id") % 2).alias("project_id"), "query_id"), _wanted(persons, searches))


@query(
    _NAMES + """, k AS (SELECT a.project_id, a.person_id, f.photo_id, CASE WHEN assignment_status = 'auto_assigned' THEN 0.82 ELSE 1.0 END::DOUBLE * greatest(0.7::DOUBLE * CASE WHEN a.id % 3 <> 0 THEN confidence ELSE 0 END + 0.3::DOUBLE * CASE WHEN a.id % 4 <> 0 THEN similarity ELSE 0 END, 0.2::DOUBLE) AS v
  FROM assignments a JOIN face_embeddings f ON f.project_id = a.project_id AND f.face_id = a.face_id WHERE assignment_status IN ('auto_assigned', 'human_confirmed', 'human_corrected')),
n AS (SELECT project_id, query_id, count(DISTINCT person_id) AS asked FROM w GROUP BY ALL)
SELECT w.project_id, w.query_id, photo_id, round(sum(v) + 0.2 * count(DISTINCT w.person_id) / any_value(asked), 6) AS score, CAST(row_number() OVER (PARTITION BY w.project_id, w.query_id ORDER BY round(sum(v) + 0.2 * count(DISTINCT w.person_id) / any_value(asked), 6) DESC, photo_id) AS INT) AS rank FROM k JOIN w ON w.project_id = k.project_id AND w.person_id = k.person_id
JOIN n ON n.project_id = w.project_id AND n.query_id = w.query_id GROUP BY w.project_id, w.query_id, photo_id HAVING count(DISTINCT w.person_id) = any_value(asked)""",
    "persons", "searches", "assignments", "face_embeddings",
)
def sch10_people_recall(persons: DataFrame, searches: DataFrame, assignments: DataFrame, faces: DataFrame) -> DataFrame:
    return search.people_recall(_wanted(persons, searches), _with_nulls(assignments), faces)


def _with_nulls(assignments: DataFrame) -> DataFrame:
    """Without some confidences and similarities, which count as 0."""
    return assignments.withColumns({"confidence": F.when(F.col("id") % 3 != 0, F.col("confidence")), "similarity": F.when(F.col("id") % 4 != 0, F.col("similarity"))})


_FIELDS = """WITH v AS (SELECT floor(vec_id / 20)::BIGINT % 2 AS project_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0),
d AS (SELECT 'content' AS field, * FROM v UNION ALL SELECT 'tag', * FROM v),
f AS (SELECT field, d.project_id, q.id AS query_id, d.id AS photo_id, round(list_cosine_similarity(q.e, d.e), 6) AS similarity, CAST(row_number() OVER (PARTITION BY field, q.id ORDER BY round(list_cosine_similarity(q.e, d.e), 6) DESC, d.id) AS INT) AS rank
  FROM d JOIN q USING (project_id) QUALIFY rank <= 200)"""


def _field_hits(embeddings: DataFrame) -> DataFrame:
    """Every 20th id asks both fields of its project, which is a run of 20 ids in turn, so that both projects have queries."""
    rows = embeddings.select((F.floor(F.col("vec_id") / 20) % 2).alias("project_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    content, tag = (vectors.top_k(asked, rows, 200).withColumn("field", F.lit(name)) for name in ("content", "tag"))
    return content.union(tag).withColumnRenamed("id", "photo_id")


@query(_FIELDS + " SELECT * FROM f")
def sch11_vector_top_k(embeddings: DataFrame) -> DataFrame:
    return _field_hits(embeddings)


@query(
    _FIELDS + """, m AS (SELECT project_id, query_id, photo_id, round(sum(CASE field WHEN 'content' THEN 0.5 ELSE 0.25 END::DOUBLE * greatest(similarity, 0)), 8) AS score FROM f GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY project_id, query_id ORDER BY score DESC, photo_id) AS INT) AS rank FROM m WHERE score >= 0.1 QUALIFY rank <= 200"""
)
def sch12_multi_field_score(embeddings: DataFrame) -> DataFrame:
    return search.multi_field_score(_field_hits(embeddings), 200, 0.1).drop("tag_score", "caption_score")


_MERGED = _KEYWORD + _CONCEPT + _PEOPLE + f""", u AS (SELECT 'keyword' AS source, project_id, query_id, photo_id, score, exact, strong, support, weak, n_negative, weak_field FROM kw UNION ALL SELECT 'concept', project_id, query_id, photo_id, score, false, NOT pale, false, pale, 0, false FROM cl UNION ALL SELECT 'people', project_id, query_id, photo_id, score, false, true, false, false, 0, false FROM pl),
mg AS (SELECT project_id, query_id, photo_id, max(score) AS score, bool_or(exact) AS exact, bool_or(strong) AS strong, bool_or(support) AS support, bool_or(weak) AS weak, max(n_negative) AS n_negative, bool_or(weak_field) AS weak_field, string_agg(source, ',' ORDER BY source) AS sources, {_by_request("max(score) DESC, photo_id", 0)} FROM u GROUP BY project_id, query_id, photo_id)"""
_SEARCH = ("photos", "analysis", "searches")


def _analysed(photos: DataFrame, analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos with an analysis and the analyses without their texts, written once for all recalls of a chain: a library has many more
    photos, and recalls need them for what is analysed only."""
    tags = written(analysis.drop("caption", "ocr_text"))
    own = photos.select("project_id", "id", "file_name", "taken_at", "created_at", "deleted_at")
    return written(own.join(tags.select("project_id", F.col("photo_id").alias("id")), ["project_id", "id"], "left_semi")), tags


def _merged(photos: DataFrame, tags: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    return search.merge_lists({"keyword": search.keyword_recall(searches, photos, analysis), "concept": _concepts(photos, tags, searches), "people": _people(photos, tags, searches)})


@query(_MERGED + f" SELECT project_id, query_id, photo_id, score, sources, {_TIER_LIST}, n_negative, rank FROM mg", *_SEARCH)
def sch13_merge_lists(photos: DataFrame, analysis: DataFrame, searches: DataFrame) -> DataFrame:
    rows = _merged(*_analysed(photos, analysis), analysis, searches)
    return rows.select(*search.KEYS, "score", F.array_join("sources", ",").alias("sources"), F.array_join("tiers", ",").alias("tiers"), F.col("negative_hits").alias("n_negative"), "rank")


# Vectors of photos and requests are the embeddings with their ids; tag and caption vectors are those of some photos. Requests for animals
# take few of each field.
_VECTOR = f""", v0 AS (SELECT 'content' AS field, a.project_id, a.photo_id, CAST(embedding AS DOUBLE[]) AS e FROM analysis a JOIN embeddings ON vec_id = a.photo_id),
v1 AS (FROM v0 UNION ALL SELECT 'tag', project_id, photo_id, e FROM v0 WHERE photo_id % 2 = 0 UNION ALL SELECT 'caption', project_id, photo_id, e FROM v0 WHERE photo_id % 3 = 0),
v2 AS (SELECT s.project_id, query_id, intent, CAST(embedding AS DOUBLE[]) AS q FROM searches s JOIN embeddings ON vec_id = query_id),
v3 AS (SELECT field, v1.project_id, query_id, photo_id, intent, round(list_cosine_similarity(q, e), 6) AS similarity, row_number() OVER (PARTITION BY field, v1.project_id, query_id ORDER BY round(list_cosine_similarity(q, e), 6) DESC, photo_id) AS rank FROM v1 JOIN v2 ON v2.project_id = v1.project_id QUALIFY rank <= 200),
v4 AS (SELECT * FROM v3 WHERE intent <> 'animal_search' OR rank <= CASE field WHEN 'content' THEN 15 WHEN 'tag' THEN 15 ELSE 12 END),
v5 AS (SELECT project_id, query_id, photo_id, round(sum(CASE field WHEN 'content' THEN 0.5 WHEN 'tag' THEN 0.25 ELSE 0.2 END::DOUBLE * greatest(similarity, 0)), 8) AS score, greatest(coalesce(max(similarity) FILTER (field = 'tag'), 0), 0) AS tag_score, greatest(coalesce(max(similarity) FILTER (field = 'caption'), 0), 0) AS caption_score FROM v4 GROUP BY ALL),
vl AS (SELECT *, {_by_request("score DESC, photo_id", 0)} FROM v5 WHERE score >= 0.05 QUALIFY rank <= 200)"""
_CHAIN = ("photos", "analysis", "searches", "embeddings", "assignments", "face_embeddings")


def _vector_list(analysis: DataFrame, searches: DataFrame, embeddings: DataFrame) -> DataFrame:
    content = written(analysis.select("project_id", F.col("photo_id").alias("id")).join(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id"))
    asked = searches.select("project_id", "query_id").join(embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    fields = {"content": content, "tag": content.where("id % 2 = 0"), "caption": content.where("id % 3 = 0")}
    hits = reduce(DataFrame.union, [vectors.top_k(asked, rows, 200).withColumn("field", F.lit(name)) for name, rows in fields.items()]).withColumnRenamed("id", "photo_id")
    cut = search.vector_hits(hits, searches.where("intent = 'animal_search'").select("project_id", "query_id", F.lit(60).alias("top_k")))
    return search.multi_field_score(cut, 200, 0.05)


@query(_VECTOR + " SELECT * FROM vl", "analysis", "searches", "embeddings")
def sch12_profiled_vectors(analysis: DataFrame, searches: DataFrame, embeddings: DataFrame) -> DataFrame:
    return _vector_list(analysis, searches, embeddings)


_SEARCHABLE = """, e AS (SELECT vec_id % 3 AS project_id, vec_id AS id, vec_id % 7 <> 0 AND vec_id % 5 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND vec_id % 17 <> 0 AS good FROM embeddings)"""


def _versions(embeddings: DataFrame) -> DataFrame:
    n, v = F.col("vec_id"), F.col("embedding")
    return embeddings.select(
        (n % 3).alias("project_id"), n.alias("id"), F.when(n % 7 == 0, "stale").otherwise("ready").alias("status"), F.when(n % 5 == 0, "old").otherwise("m").alias("model"), F.when(n % 11 == 0, "0").otherwise("1").alias("version"),
        F.when(n % 13 != 0, F.when(n % 17 == 0, F.slice(v, 1, 32)).otherwise(v)).alias("vector"),
    )


@query(_SEARCHABLE[1:].replace(" e AS", "WITH e AS", 1) + " SELECT project_id, id FROM e WHERE good")
def sch11_searchable(embeddings: DataFrame) -> DataFrame:
    return search.searchable(_versions(embeddings), "m", "1", 64).select("project_id", "id")


@query(_SEARCHABLE[1:].replace(" e AS", "WITH e AS", 1) + " SELECT project_id, count(*) FILTER (NOT good) AS stale FROM e GROUP BY ALL")
def sch11_stale_counts(embeddings: DataFrame) -> DataFrame:
    return search.stale_counts(_versions(embeddings), "m", "1", 64)


@query(
    _FIELDS + """, g AS (SELECT CASE field WHEN 'tag' THEN 'ocr' ELSE field END AS field, project_id, query_id, photo_id, similarity FROM f), m AS (SELECT project_id, query_id, photo_id, round(sum(CASE WHEN query_id % 40 = 0 THEN CASE field WHEN 'content' THEN 0.35 ELSE 0.4 END ELSE CASE field WHEN 'content' THEN 0.5 ELSE 0.05 END END::DOUBLE * greatest(similarity, 0)), 8) AS score FROM g GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY project_id, query_id ORDER BY score DESC, photo_id) AS INT) AS rank FROM m WHERE score >= 0.1 QUALIFY rank <= 200"""
)
def sch12_ocr_weights(embeddings: DataFrame) -> DataFrame:
    hits = _field_hits(embeddings).withColumn("field", F.when(F.col("field") == "tag", "ocr").otherwise(F.col("field")))
    ocr = embeddings.where("vec_id % 40 = 0").select((F.floor(F.col("vec_id") / 20) % 2).alias("project_id"), F.col("vec_id").alias("query_id"))
    return search.multi_field_score(hits, 200, 0.1, ocr=ocr).drop("tag_score", "caption_score")


# Requests of the first two projects look for one person each.
_WANTED = """, pk AS (SELECT a.project_id, a.person_id, f.photo_id, CASE WHEN assignment_status = 'auto_assigned' THEN 0.82 ELSE 1.0 END::DOUBLE * greatest(0.7::DOUBLE * confidence + 0.3::DOUBLE * similarity, 0.2::DOUBLE) AS v
  FROM assignments a JOIN face_embeddings f ON f.project_id = a.project_id AND f.face_id = a.face_id WHERE assignment_status IN ('auto_assigned', 'human_confirmed', 'human_corrected')),
ps AS (SELECT s.project_id, s.query_id, photo_id, round(sum(v) + 0.2, 6) AS score FROM pk JOIN searches s ON s.project_id = pk.project_id AND pk.person_id = s.project_id * 100 + s.query_id % 10 GROUP BY ALL),
pr AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, query_id ORDER BY score DESC, photo_id) AS INT) AS rank FROM ps)"""
_FUSED = _MERGED + _VECTOR + _WANTED + """, a0 AS (SELECT 'k' AS s, 0.4 AS w, project_id, query_id, photo_id, score, rank, exact, strong, support, weak, n_negative, weak_field, 0 AS tag_score, 0 AS caption_score FROM mg
  UNION ALL SELECT 'v', 0.6, project_id, query_id, photo_id, score, rank, false, false, false, false, 0, false, tag_score, caption_score FROM vl UNION ALL SELECT 'p', 1.2, project_id, query_id, photo_id, score, rank, false, false, false, false, 0, false, 0, 0 FROM pr),
fu AS (SELECT project_id, query_id, photo_id, round(sum(w::DOUBLE / (60 + rank)), 9) AS fused, max(score) FILTER (s = 'k') AS keyword_score, max(score) FILTER (s = 'v') AS vector_score, max(score) FILTER (s = 'p') AS people_score,
  bool_or(exact) AS exact, bool_or(strong) AS strong, bool_or(support) AS support, bool_or(weak) AS weak, max(n_negative) AS n_negative, bool_or(weak_field) AS weak_field, max(tag_score) AS tag_score, max(caption_score) AS caption_score FROM a0 GROUP BY ALL)"""
_LEVELS = _FUSED + """, le AS (SELECT *, CASE WHEN exact THEN 'A' WHEN strong THEN 'B' WHEN n_negative > 0 AND coalesce(vector_score, 0) < 0.32 THEN 'F' WHEN vector_score >= 0.42 THEN 'C' WHEN support AND vector_score >= 0.32 THEN 'C'
  WHEN support OR weak THEN 'D' WHEN vector_score >= 0.25 THEN 'D' ELSE 'E' END AS level FROM fu),
sc AS (SELECT *, round(greatest(0, fused + CASE level WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 WHEN 'C' THEN 0.45 WHEN 'D' THEN 0.15 WHEN 'E' THEN -0.5 ELSE -1 END::DOUBLE * 0.02::DOUBLE - n_negative * 0.01::DOUBLE), 9) AS final_score FROM le),
rq AS (SELECT project_id, query_id, intent, query_id % 5 = 0 AS allow_weak, query_id % 3 = 0 AS allow_vector, year IS NOT NULL AS filtered, query_id % 9 = 4 AS contract_two, CASE WHEN query_id % 6 = 1 THEN 'A' WHEN query_id % 6 = 2 THEN 'B' WHEN intent = 'animal_search' THEN 'B' ELSE 'C' END AS least FROM searches),
d0 AS (SELECT sc.*, rq.intent = 'animal_search' AND NOT contract_two AND coalesce(keyword_score, 0) <= 0 AND vector_score > 0 AS alone, NOT allow_weak AND level = 'C' AND coalesce(keyword_score, 0) <= 0 AS faint, (allow_vector OR filtered) AND vector_score >= 0.42 AS trusted, least FROM sc JOIN rq ON rq.project_id = sc.project_id AND rq.query_id = sc.query_id),
di AS (SELECT *, CASE WHEN alone AND vector_score < 0.62 THEN 'vector_only_below_entity_total_min' WHEN alone AND tag_score < 0.62 AND caption_score < 0.58 THEN 'vector_only_missing_tag_or_caption_evidence' WHEN faint AND trusted THEN NULL
  WHEN faint THEN 'query_constraints:no_vector_only_weak_match' WHEN level > least THEN 'evidence_level:' || level || ' below min:' || least END AS reason FROM d0)"""


def _requests(searches: DataFrame) -> DataFrame:
    n = F.col("query_id")
    return searches.select(
        "project_id", "query_id", "intent", (n % 5 == 0).alias("allow_weak_only"), (n % 3 == 0).alias("allow_vector_only"), F.col("year").isNotNull().alias("metadata_active"), F.when(n % 9 == 4, "2").alias("contract"),
        F.when(n % 6 == 1, "HIGH").when(n % 6 == 2, "medium").alias("min_level"),
    )


def _lists(photos: DataFrame, analysis: DataFrame, searches: DataFrame, embeddings: DataFrame, assignments: DataFrame, faces: DataFrame) -> dict[str, DataFrame]:
    """The lists that are fused; they are written, as they are read more than once by what follows."""
    wanted = searches.where("project_id < 2").select("project_id", "query_id", (F.col("project_id") * 100 + F.col("query_id") % 10).alias("person_id"))
    known, tags = _analysed(photos, analysis)
    lists = {"keyword": _merged(known, tags, analysis, searches), "vector": _vector_list(tags, searches, embeddings), "people": search.people_recall(wanted, assignments, faces)}
    return {name: written(rows) for name, rows in lists.items()}


def _fused(lists: dict[str, DataFrame]) -> DataFrame:
    return written(search.fuse(lists, {"keyword": 0.4, "vector": 0.6, "people": 1.2}))


@query(_FUSED + f" SELECT project_id, query_id, photo_id, fused, keyword_score, vector_score, people_score, {_TIER_LIST} FROM fu", *_CHAIN)
def sch14_rank_fusion(*tables: DataFrame) -> DataFrame:
    return _fused(_lists(*tables)).select(*search.KEYS, "fused", "keyword_score", "vector_score", "people_score", F.array_join("tiers", ",").alias("tiers"))


@query(_LEVELS + " SELECT project_id, query_id, photo_id, level, final_score FROM sc", *_CHAIN)
def sch16_evidence_score(*tables: DataFrame) -> DataFrame:
    return search.evidence(_fused(_lists(*tables))).select(*search.KEYS, "level", "final_score")


def _judged(*tables: DataFrame) -> DataFrame:
    return search.display_filter(search.evidence(_fused(_lists(*tables))), _requests(tables[2]))


@query(_LEVELS + " SELECT project_id, query_id, coalesce(reason, 'shown') AS reason, count(*) AS n FROM di GROUP BY ALL", *_CHAIN)
def sch17_display_filter(*tables: DataFrame) -> DataFrame:
    return search.reason_counts(_judged(*tables))


_PAGE = _LEVELS + """, pg AS (SELECT project_id, query_id, photo_id, CAST(row_number() OVER (PARTITION BY project_id, query_id ORDER BY final_score DESC, photo_id) AS INT) AS position, count(*) OVER (PARTITION BY project_id, query_id) AS total
  FROM di WHERE reason IS NULL)"""


def _page(page: int, size: int, *tables: DataFrame) -> DataFrame:
    return search.result_page(_judged(*tables).where("reason IS NULL"), tables[0], page, size)


@query(_PAGE + " SELECT pg.*, p.file_name FROM pg JOIN photos p ON p.project_id = pg.project_id AND p.id = pg.photo_id WHERE position BETWEEN 11 AND 20 AND deleted_at IS NULL", *_CHAIN)
def sch20_result_page(*tables: DataFrame) -> DataFrame:
    return _page(2, 10, *tables).select("project_id", "query_id", "photo_id", "position", "total", "file_name")


@query(
    _LEVELS + """, lp AS (SELECT * FROM photos WHERE deleted_at IS NULL), fc AS (SELECT project_id, photo_id, count(*) AS n FROM face_embeddings WHERE status <> 'failed' GROUP BY ALL),
pg AS (SELECT di.project_id, di.query_id, di.photo_id, CAST(row_number() OVER (PARTITION BY di.project_id, di.query_id ORDER BY taken_at ASC NULLS LAST, created_at DESC NULLS LAST, final_score DESC, di.photo_id) AS INT) AS position, count(*) OVER (PARTITION BY di.project_id, di.query_id) AS total
  FROM di LEFT JOIN lp ON lp.project_id = di.project_id AND lp.id = di.photo_id WHERE reason IS NULL QUALIFY position <= 15)
SELECT pg.*, p.file_name, a.people_count, coalesce(fc.n, 0) AS face_count FROM pg JOIN lp p ON p.project_id = pg.project_id AND p.id = pg.photo_id LEFT JOIN analysis a ON a.project_id = pg.project_id AND a.photo_id = pg.photo_id LEFT JOIN fc ON fc.project_id = pg.project_id AND fc.photo_id = pg.photo_id""",
    *_CHAIN,
)
def sch20_sorted_page(*tables: DataFrame) -> DataFrame:
    shown = _judged(*tables).where("reason IS NULL")
    page = search.result_page(shown, tables[0], 1, 15, [("taken_at", "asc"), ("size", "asc"), ("created_at", "desc")], tables[1], tables[5])
    return page.select("project_id", "query_id", "photo_id", "position", "total", "file_name", "people_count", "face_count")


_PLACE_NAMES = f"n AS (SELECT DISTINCT project_id, unnest([{', '.join(f'lower({c})' for c in search.PLACE_COLUMNS)}]) AS name FROM photos WHERE deleted_at IS NULL)"


@query(
    f""", {_PLACE_NAMES}
SELECT project_id, query_id, EXISTS (FROM n WHERE n.project_id = s.project_id AND contains(name, CASE WHEN query_id % 2 = 0 THEN 'nation_' || CAST(query_id % 30 AS STRING) ELSE exact_terms[1] END)) AS is_place FROM searches s""",
    "photos", "searches",
)
def sch22_place_existence(photos: DataFrame, searches: DataFrame) -> DataFrame:
    place = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("Nation_"), (F.col("query_id") % 30).cast("string"))).otherwise(F.get("exact_terms", F.lit(0)))
    return search.known_places(searches.withColumn("place", place), photos)


@query(
    f""", {_PLACE_NAMES}, q AS (SELECT project_id, query_id, CASE query_id % 4 WHEN 0 THEN ' Stree ' WHEN 1 THEN 'ci ty' WHEN 2 THEN 'x' ELSE 'street 1' END AS place FROM searches)
SELECT project_id, query_id, length(trim(place)) BETWEEN 2 AND 12 AND NOT regexp_matches(trim(place), '[0-9\\s]') AND EXISTS (FROM n WHERE n.project_id = q.project_id AND contains(name, lower(trim(place)))) AS is_place FROM q""",
    "photos", "searches",
)
def sch22_checked_places(photos: DataFrame, searches: DataFrame) -> DataFrame:
    n = F.col("query_id") % 4
    place = F.when(n == 0, " Stree ").when(n == 1, "ci ty").when(n == 2, "x").otherwise("street 1")
    return search.known_places(searches.withColumn("place", place), photos, True)


_CASES = _PAGE + """, g AS (SELECT project_id, query_id, list(photo_id) AS found, max(total) AS total FROM pg WHERE position <= 50 GROUP BY ALL),
x AS (SELECT s.project_id, s.query_id, list_sort(list_filter([s.query_id, s.query_id + 7], lambda i: NOT list_contains(coalesce(found, []), i))) AS missing, coalesce(total, 0) AS total FROM searches s LEFT JOIN g ON g.project_id = s.project_id AND g.query_id = s.query_id)"""


def _results(*tables: DataFrame) -> DataFrame:
    cases = tables[2].select("project_id", "query_id", F.array(F.col("query_id"), F.col("query_id") + 7).alias("expected"), F.lit(3).alias("min_total"))
    return search.evaluate(cases, _page(1, 50, *tables))


@query(_CASES + " SELECT project_id, query_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AND total >= 3 AS passed FROM x", *_CHAIN)
def sch23_evaluation(*tables: DataFrame) -> DataFrame:
    return _results(*tables)


@query(_CASES + " SELECT project_id, count(*) AS cases, count(*) FILTER (len(missing) = 0 AND total >= 3) AS passed, count(*) FILTER (NOT (len(missing) = 0 AND total >= 3)) AS failed FROM x GROUP BY ALL", *_CHAIN)
def sch23_summary(*tables: DataFrame) -> DataFrame:
    return search.evaluation_summary(_results(*tables))


@query(
    _LEVELS + """, tg AS (SELECT project_id, photo_id, list_distinct(scene_tags || object_tags || activity_tags) AS tags FROM analysis)
SELECT sc.project_id, sc.query_id, sc.photo_id, round(final_score + CAST(coalesce(list_sum(list_transform(tags, lambda t: CASE WHEN list_contains(expanded_terms, t) THEN 4 WHEN list_contains(exact_terms, t) THEN 2 WHEN t = concept_term THEN 1 ELSE 0 END - CASE WHEN t = 'the' THEN 3 ELSE 0 END)), 0) AS DOUBLE) / 100, 9) AS final_score
FROM sc LEFT JOIN tg ON tg.project_id = sc.project_id AND tg.photo_id = sc.photo_id JOIN searches s ON s.project_id = sc.project_id AND s.query_id = sc.query_id""",
    *_CHAIN,
)
def sch19_tag_boost(*tables: DataFrame) -> DataFrame:
    q = tables[2].select("project_id", "query_id", "expanded_terms", F.col("exact_terms").alias("support_terms"), F.array("concept_term").alias("broad_terms"), F.array(F.lit("the")).alias("penalised_terms"))
    return search.tag_boost(search.evidence(_fused(_lists(*tables))), tables[1], q)


_LOW = lambda *columns: "lower(" + " || ' ' || ".join(c if c in ("caption", "ocr_text") else f"array_to_string({c}, ' ')" for c in columns) + ")"


@query(
    _LEVELS + f""", tx AS (SELECT project_id, photo_id, {_LOW("caption", "ocr_text", "scene_tags", "object_tags", "activity_tags", "search_keywords", "location_clues")} AS night, {_LOW("caption", "scene_tags", "object_tags", "activity_tags")} AS rich, {_LOW("search_keywords", "location_clues")} AS hint,
  list_transform(object_tags || search_keywords, lambda x: lower(x)) AS entities, lower(caption) AS cap, {_LOW("semantic_concepts")} AS con, {_LOW("scene_tags", "location_clues")} AS scene FROM analysis),
f0 AS (SELECT sc.*, tx.photo_id IS NULL AS unknown, coalesce(vector_score, 0) >= 0.42 AS sure, level IN ('A', 'B') AS good_level, CASE WHEN s.query_id % 9 <> 4 THEN s.query_id % 4 ELSE 0 END AS facet, exact_terms[1] AS pos, tx.* EXCLUDE (project_id, photo_id)
  FROM sc LEFT JOIN tx ON tx.project_id = sc.project_id AND tx.photo_id = sc.photo_id JOIN searches s ON s.project_id = sc.project_id AND s.query_id = sc.query_id),
f1 AS (SELECT *, coalesce(contains(night, pos), false) AS n_good, coalesce(contains(night, 'src1'), false) AS n_bad, coalesce(contains(rich, pos), false) AS i_good, coalesce(contains(rich, 'src1') OR contains(hint, 'src1'), false) AS i_bad,
  coalesce(list_contains(entities, pos) OR length(pos) >= 2 AND (contains(cap, pos) OR contains(con, pos)), false) AS a_good, coalesce(contains(scene, 'src1'), false) AS a_scene FROM f0),
f2 AS (SELECT project_id, query_id, photo_id, CASE facet
  WHEN 1 THEN CASE WHEN unknown AND sure THEN '+vector_only_high_confidence' WHEN unknown THEN '+no_ai_analysis' WHEN sure AND n_bad AND NOT n_good THEN '-night_negative_evidence' WHEN sure THEN '+vector_high_confidence' WHEN n_good AND NOT n_bad THEN '+night_positive_evidence'
    WHEN n_good AND good_level THEN '+night_conflicting_but_strong_keyword' WHEN n_good THEN '-night_conflicting_evidence' WHEN good_level THEN '+night_no_evidence_but_strong_keyword' ELSE '-night_no_core_facet_evidence' END
  WHEN 2 THEN CASE WHEN unknown AND sure THEN '+indoor_vector_only_high_confidence' WHEN unknown THEN '-indoor_no_ai_analysis' WHEN sure AND i_bad AND NOT i_good THEN '-indoor_negative_evidence' WHEN sure THEN '+indoor_vector_high_confidence' WHEN i_good AND NOT i_bad THEN '+indoor_positive_visual_evidence'
    WHEN i_good AND good_level THEN '+indoor_conflicting_but_strong_keyword' WHEN i_good THEN '-indoor_conflicting_evidence' WHEN weak_field THEN '-indoor_weak_tag_only' ELSE '-indoor_no_positive_visual_evidence' END
  WHEN 3 THEN CASE WHEN unknown AND sure THEN '+animal_vector_only_high_confidence' WHEN unknown THEN '-animal_no_ai_analysis' WHEN sure THEN '+animal_vector_high_confidence' WHEN a_good THEN '+animal_entity_evidence' WHEN a_scene THEN '-animal_scene_without_entity' ELSE '-animal_no_entity_evidence' END
  ELSE '+' END AS v FROM f1)
SELECT project_id, query_id, photo_id, v[1] = '+' AS passes, substring(v, 2) AS reason FROM f2""",
    *_CHAIN,
)
def sch18_core_facet_filter(*tables: DataFrame) -> DataFrame:
    n = F.col("query_id") % 4
    facet = F.when(n == 1, "night").when(n == 2, "indoor").when(n == 3, "animal")
    q = tables[2].select("project_id", "query_id", facet.alias("facet"), F.slice("exact_terms", 1, 1).alias("positive_terms"), F.array(F.lit("SRC1")).alias("negative_terms"), F.when(F.col("query_id") % 9 == 4, "2").alias("contract"))
    return search.facet_filter(search.evidence(_fused(_lists(*tables))), tables[1], q)


_MODE = "CASE query_id % 5 WHEN 0 THEN 'metadata' WHEN 1 THEN 'people' WHEN 2 THEN 'keyword' WHEN 3 THEN 'vector' ELSE CASE WHEN query_id % 2 = 0 THEN 'keyword' ELSE 'hybrid' END END"


@query(
    _META + _LEVELS.replace(f", {_LIVE}", "", 1) + f""", r0 AS (SELECT project_id, query_id, {_MODE} AS wanted FROM searches), r1 AS (SELECT project_id, query_id, CASE WHEN query_id % 7 = 0 AND wanted = 'hybrid' THEN 'keyword' WHEN query_id % 7 = 0 AND wanted = 'vector' THEN 'nothing' ELSE wanted END AS mode FROM r0),
r2 AS (SELECT project_id, query_id, photo_id, score, 'metadata' AS mode FROM m UNION ALL SELECT project_id, query_id, photo_id, score, 'people' FROM pr UNION ALL SELECT project_id, query_id, photo_id, score, 'keyword' FROM mg UNION ALL SELECT project_id, query_id, photo_id, score, 'vector' FROM vl UNION ALL SELECT project_id, query_id, photo_id, final_score, 'hybrid' FROM sc)
SELECT r2.* FROM r2 JOIN r1 ON r1.project_id = r2.project_id AND r1.query_id = r2.query_id AND r1.mode = r2.mode""",
    *_CHAIN,
)
def sch21_mode_routing(*tables: DataFrame) -> DataFrame:
    photos, searches = tables[0], tables[2]
    n = F.col("query_id")
    modes = F.when(n % 5 == 0, "metadata").when(n % 5 == 1, "people").when(n % 5 == 2, "keyword").when(n % 5 == 3, "vector").otherwise("auto")
    asked = searches.select("project_id", "query_id", modes.alias("mode"), (n % 2 == 0).alias("is_ocr"), (n % 7 == 0).alias("vector_failed"))
    lists = _lists(*tables)
    hybrid = search.evidence(_fused(lists)).withColumn("score", F.col("final_score"))
    metadata = search.metadata_recall(searches.select("project_id", "query_id", "year", "needs_gps", "iso_min"), photos)
    return search.routed(asked, {"metadata": metadata, "people": lists["people"], "keyword": lists["keyword"], "vector": lists["vector"], "hybrid": hybrid})
