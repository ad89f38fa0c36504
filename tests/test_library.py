"""Small cases of the library operators whose results are known."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import terms
from shoebox.operators import browse, cleanup, ingest, people, search, vectors

PHOTO = "id bigint, project_id bigint, taken_at timestamp, created_at timestamp, folder_path string, status string, deleted_at timestamp, file_hash string, file_name string"


def photos(spark, rows):
    """Rows (id, taken day of January 2026 or None, folder, status)."""
    day = lambda d: datetime(2026, 1, d, 12) if d else None
    return spark.createDataFrame([(i, 1, day(d), datetime(2026, 1, 2, 8, 30), f, s, None, f"h{i % 3}", f"{i}.jpg") for i, d, f, s in rows], PHOTO)


def test_pages_put_undated_photos_last(spark):
    table = photos(spark, [(i, 1 if i > 2 else None, "a", "indexed") for i in range(1, 7)])
    assert [[r["id"] for r in browse.photo_page(table, p, 3).orderBy("position").collect()] for p in (1, 2)] == [[6, 5, 4], [3, 2, 1]]
    cursor = table.where("id = 4").select("project_id", F.col("taken_at").alias("c_taken"), F.col("created_at").alias("c_created"), F.col("id").alias("c_id"))
    page = browse.keyset_page(table, cursor, 2).orderBy("position").collect()
    assert [(r["id"], r["has_more"]) for r in page] == [(3, True), (2, True)]


def test_position_in_folder(spark):
    found = browse.locate(photos(spark, [(i, i, "ten" if i < 7 else "twenty", "indexed") for i in range(1, 8)]), 2).where("id = 2").first()
    assert (found["total"], found["position"], found["page"], found["is_browsable"]) == (6, 5, 3, True)
    found = browse.locate(photos(spark, [(i, i, "ten", "quarantined" if i == 2 else "indexed") for i in range(1, 7)]), 2).where("id = 2").first()
    assert (found["total"], found["position"], found["page"], found["is_browsable"]) == (5, 5, 3, False)


def test_folder_counts(spark):
    rows, n = [], 0
    for folder, count in (("", 1), ("a", 2), ("a/b", 3), ("ab", 1), ("a_b", 1)):
        for _ in range(count):
            n += 1
            rows.append((n, 1, folder, "indexed"))
    got = {r["relative_path"]: (r["photos_direct"], r["photos_recursive"]) for r in ingest.folder_counts(photos(spark, rows)).collect()}
    assert got == {"": (1, 8), "a": (2, 5), "a/b": (3, 3), "ab": (1, 1), "a_b": (1, 1)}


def test_duplicates_point_to_the_first(spark):
    got = sorted((r["id"], r["source_id"]) for r in cleanup.exact_duplicates(photos(spark, [(i, 1, "", "quarantined" if i == 1 else "indexed") for i in range(1, 8)])).collect())
    assert got == [(5, 2), (6, 3), (7, 4)]


def test_calibration_of_verified_candidates(spark):
    good = '{{"decision": "quarantine", "classification": "{}", "confidence": {}, "preservation_flags": [], "has_record_value": false}}'
    rows = [
        ("a", good.format("severe_blur", 0.99), good.format("severe_blur", 0.98), "KEEP"), ("a", good.format("severe_blur", 0.99), good.format("blank_image", 0.99), "TRASH"), ("b", good.format("severe_blur", 0.97), good.format("severe_blur", 0.99), "TRASH"),
        ("b", good.format("severe_blur", 0.99), None, "KEEP"), ("b", good.format("landscape", 0.99), good.format("landscape", 0.99), "KEEP"),
    ]
    items = spark.createDataFrame([(1, *r) for r in rows], "project_id bigint, classification string, first string, second string, human_label string")
    items = items.withColumns({c: cleanup.read_pass(F.col(c)) for c in ("first", "second")})
    row = cleanup.calibration(items).where("classification IS NULL").first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"], row["precision"], row["recall"], row["ready"]) == (0, 1, 2, 2, 0.0, 0.0, False)
    assert cleanup.calibration(items).where("classification = 'a'").first()["fp"] == 1


def test_answers_of_a_pass(spark):
    texts = ["```json\n{\"decision\": \"keep\", \"confidence\": 3}\n```", "{\"decision\": \"maybe\"}", "no json", None, "x {\"decision\": \"REVIEW\", \"sensitive_content_flags\": [\" gore \", \"gore\"]} y", "{\"decision\": \"REVIEW\", \"sensitive_content_flags\": [\"weapon\"]}"]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(cleanup.read_pass(F.col("t")).alias("p")).collect()]
    assert (got[0]["decision"], got[0]["confidence"], got[0]["classification"], got[0]["has_record_value"], got[0]["content_rating"]) == ("KEEP", 1.0, "uncertain", True, "SAFE")
    assert got[1:4] == [None] * 3 and (got[4]["content_rating"], got[4]["sensitive_content_flags"]) == ("ADULT", ["gore"]) and got[5]["content_rating"] == "SENSITIVE"


FACE = "project_id bigint, face_id bigint, embedding array<float>, quality double, status string"
ASSIGNED = "project_id bigint, id bigint, face_id bigint, person_id bigint, assignment_status string, is_positive boolean"


def test_prototype_and_match(spark):
    faces = spark.createDataFrame([(1, 201, [1.0, 0.0, 0.0], 0.9, "embedded"), (1, 202, [0.95, 0.05, 0.0], 0.9, "embedded"), (1, 203, [0.2, 0.2, 0.0], 0.9, "embedded"), (2, 204, [1.0, 0.0, 0.0], 0.9, "embedded")], FACE)
    assigned = spark.createDataFrame([(1, 401, 201, 101, "human_confirmed", True)], ASSIGNED)
    protos = people.prototypes(assigned, faces)
    assert protos.first()["vector"] == [1.0, 0.0, 0.0]
    none = spark.createDataFrame([], "project_id bigint, face_id bigint, not_person_id bigint")
    got = {r["face_id"]: (r["person_id"], r["decision"], r["similarity"]) for r in people.match(protos, faces, assigned, none, 0.75, 0.45).collect()}
    assert got == {202: (101, "auto_assigned", 0.998618), 203: (101, "review_pending", 0.707107)}
    barred = spark.createDataFrame([(1, 202, 101)], none.schema)
    assert {r["face_id"] for r in people.match(protos, faces, assigned, barred, 0.75, 0.45).collect()} == {203}


def test_best_samples_make_the_prototype(spark):
    faces = spark.createDataFrame([(1, 201, [1.0, 0.0], 0.9, "embedded"), (1, 204, [0.0, 1.0], 0.95, "embedded"), (1, 205, [-1.0, 0.0], 0.8, "embedded")], FACE)
    assigned = spark.createDataFrame([(1, 401, 201, 7, "human_confirmed", True), (1, 404, 204, 7, "human_corrected", True), (1, 405, 205, 7, "human_confirmed", True)], ASSIGNED)
    row = people.prototypes(assigned, faces, limit=2).first()
    assert (row["vector"], row["sample_count"]) == ([0.5, 0.5], 2)


def test_clusters_follow_the_order(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, (np.eye(3)[i % 3] + 0.1 * rng.standard_normal(3)).tolist(), 0.9, "embedded") for i in range(30)]
    none = spark.createDataFrame([], ASSIGNED)
    got = {r["face_id"]: r["cluster"] for r in people.cluster_unknown(spark.createDataFrame(rows, FACE), none, limit=20).collect()}
    assert got == {i: i % 3 for i in range(20)}


def test_boxes(spark):
    box = "project_id bigint, photo_id bigint, x bigint, y bigint, w bigint, h bigint, {} bigint"
    old = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 5), (1, 1, 50, 50, 10, 10, 6), (1, 2, 0, 0, 5, 5, 7)], box.format("face_id"))
    new = spark.createDataFrame([(1, 1, 1, 0, 10, 10, 0), (1, 1, 50, 50, 10, 10, 1), (1, 1, 200, 0, 10, 10, 2), (1, 3, 0, 0, 1, 1, 0)], box.format("place"))
    got = {(r["photo_id"], r["place"], r["face_id"], r["action"]) for r in people.reconcile_boxes(old, new).collect()}
    assert got == {(1, 0, 5, "move"), (1, 1, 6, "keep"), (1, 2, None, "insert"), (2, None, 7, "disappeared"), (3, 0, None, "insert")}


def test_old_faces_with_one_box_are_matched_one_by_one(spark):
    box = "project_id bigint, photo_id bigint, x bigint, y bigint, w bigint, h bigint, {} bigint"
    old = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 5), (1, 1, 0, 0, 10, 10, 6), (1, 1, 1, 0, 10, 10, 7)], box.format("face_id"))
    new = lambda n: spark.createDataFrame([(1, 1, 0, 0, 10, 10, i) for i in range(n)], box.format("place"))
    acts = lambda n: sorted((r["face_id"], r["place"], r["action"]) for r in people.reconcile_boxes(old, new(n)).collect() if r["face_id"])
    assert acts(1) == [(5, 0, "keep"), (6, None, "disappeared"), (7, None, "disappeared")]
    assert acts(3) == [(5, 0, "keep"), (6, 1, "keep"), (7, 2, "move")]


def test_odd_vectors_take_no_part(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, None), (1, 3, [1.0]), (1, 4, []), (1, 5, [0.0, 1.0]), (1, 6, [None, 1.0])]
    table = spark.createDataFrame(rows, "project_id bigint, id bigint, vector array<double>")
    got = [(r["query_id"], r["id"]) for r in vectors.top_k(table.withColumnRenamed("id", "query_id"), table, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 5), (3, 3), (5, 5), (5, 1)]
    faces = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.9, "embedded"), (1, 2, None, 0.9, "embedded"), (1, 3, [1.0], 0.9, "embedded")], FACE)
    protos = spark.createDataFrame([(1, 9, [1.0, 0.0]), (1, 8, None)], "project_id bigint, person_id bigint, vector array<double>")
    assert [(r["face_id"], r["person_id"]) for r in people.pairs_above(protos, faces, 0.5).collect()] == [(1, 9)]


def test_top_k_matches_the_sql_form(spark):
    rng = random.Random(2)
    rows = [(i % 2, i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(0, 60, [0.0] * 5)]
    table = spark.createDataFrame(rows, "project_id bigint, id bigint, vector array<double>")
    asked = table.where("id < 4").withColumnRenamed("id", "query_id")
    got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in vectors.top_k(asked, table, 6).collect())
    pairs = asked.withColumnRenamed("vector", "q").join(table, "project_id").select("project_id", "query_id", F.col("id").alias("photo_id"), F.round(vectors.cosine(F.col("q"), F.col("vector")), 6).alias("s"))
    assert got == sorted((r["query_id"], r["rank"], r["photo_id"], r["s"]) for r in search.ranked(pairs, 6, F.desc("s"), "photo_id").collect())


def test_rank_fusion(spark):
    lists = {n: spark.createDataFrame([(1, 1, p, s, r) for p, s, r in rows], "project_id bigint, query_id bigint, photo_id bigint, score double, rank int") for n, rows in {"keyword": [(1, 0.9, 1), (2, 0.8, 2)], "vector": [(2, 0.95, 1), (3, 0.75, 2)]}.items()}
    got = {r["photo_id"]: r["fused"] for r in search.fuse(lists, {"keyword": 0.4, "vector": 0.6}).collect()}
    assert got == {1: round(0.4 / 61, 9), 2: round(0.4 / 62 + 0.6 / 61, 9), 3: round(0.6 / 62, 9)}


LEVELS = [
    (1, ["exact", "negative"], 0.1, "A"), (2, ["strong"], 0.9, "B"), (3, ["negative", "support"], 0.31, "F"), (4, ["negative", "support"], 0.32, "C"), (5, ["support"], 0.1, "D"), (6, ["weak"], 0.3, "D"), (7, [], 0.42, "C"), (8, [], 0.25, "D"), (9, [], 0.2, "E"), (10, [], None, "E"),
]


def scored(spark, rows):
    names = "project_id bigint, query_id bigint, photo_id bigint, fused double, keyword_score double, vector_score double, tiers array<string>, negative_hits bigint, tag_score double, caption_score double, weak_field boolean"
    return search.evidence(spark.createDataFrame(rows, names))


def test_evidence_follows_the_tiers_of_hits(spark):
    got = {r["photo_id"]: (r["level"], r["final_score"]) for r in scored(spark, [(1, 1, p, 0.05, 0.1, v, t, 2, 0.0, 0.0, False) for p, t, v, _ in LEVELS]).collect()}
    assert {p: g[0] for p, g in got.items()} == {p: level for p, _, _, level in LEVELS}
    assert got[1][1] == 0.05 and got[2][1] == round(0.05 + 0.014, 9) and got[3][1] == round(0.05 - 0.02 - 0.02, 9) and got[9][1] == round(0.05 - 0.01, 9)


def test_display_gates_in_order(spark):
    rows = [
        (1, 1, 1, 0.1, None, 0.5, [], 0, 0.9, 0.0, False), (1, 1, 2, 0.1, None, 0.7, [], 0, 0.1, 0.1, False), (1, 1, 3, 0.1, 0.4, 0.1, ["strong"], 0, 0.0, 0.0, False),
        (1, 2, 1, 0.1, None, 0.5, [], 0, 0.0, 0.0, False), (1, 3, 1, 0.1, None, 0.5, [], 0, 0.0, 0.0, False), (1, 3, 2, 0.1, 0.2, 0.3, ["weak"], 0, 0.0, 0.0, False), (1, 4, 1, 0.1, 0.2, 0.5, ["support"], 0, 0.0, 0.0, False), (1, 5, 1, 0.1, None, 0.5, [], 0, 0.0, 0.0, False),
    ]
    asked = [(1, 1, "animal_search", None, False, False, None), (1, 2, None, None, False, False, None), (1, 3, None, "A", True, False, None), (1, 4, None, "medium", False, False, None), (1, 5, "animal_search", "LOW", False, True, "2")]
    queries = spark.createDataFrame(asked, "project_id bigint, query_id bigint, intent string, min_level string, metadata_active boolean, allow_weak_only boolean, contract string")
    got = {(r["query_id"], r["photo_id"]): r["reason"] for r in search.display_filter(scored(spark, rows), queries).collect()}
    assert got == {
        (1, 1): "vector_only_below_entity_total_min", (1, 2): "vector_only_missing_tag_or_caption_evidence", (1, 3): None, (2, 1): "query_constraints:no_vector_only_weak_match", (3, 1): None,
        (3, 2): "evidence_level:D below min:A", (4, 1): "evidence_level:C below min:B", (5, 1): None,
    }
    counts = {(r["query_id"], r["reason"]): r["n"] for r in search.reason_counts(search.display_filter(scored(spark, rows), queries)).collect()}
    assert counts[1, "shown"] == 1 and counts[3, "shown"] == 1


def media(spark, texts):
    tags = ("scene_tags", "object_tags", "activity_tags", "search_keywords", "quality_tags", "location_clues")
    rows = [(1, i, caption, None, *(t.get(c, []) for c in tags), None) for i, (caption, t) in enumerate(texts)]
    analysis = spark.createDataFrame(rows, f"project_id bigint, photo_id bigint, caption string, ocr_text string, {', '.join(f'{c} array<string>' for c in tags)}, created_at timestamp")
    return photos(spark, [(i, i + 1, "", "indexed") for i in range(len(texts))]), analysis


def test_terms_count_by_tier_and_alias(spark):
    table, analysis = media(spark, [("A kitten here", {"object_tags": ["Cat", "cat toy"]}), ("dog", {"search_keywords": ["zoo", None]}), ("nothing", {"quality_tags": ["big", "cat food"]}), ("horse riding", {"object_tags": ["horse"]})])
    columns = "project_id bigint, query_id bigint, intent string, exact_terms array<string>, expanded_terms array<string>, support_terms array<string>, broad_terms array<string>, negative_terms array<string>"
    asked = spark.createDataFrame([(1, 1, "animal_search", ["pet"], ["CAT"], ["toy"], ["zoo"], ["here"]), (1, 2, "animal_search", ["\u9a91\u9a6c"], ["horse"], None, None, None), (1, 3, None, ["g cat f"], [], [], [], []), (1, 4, None, [], [], ["dog"], [], [])], columns)
    aliases = spark.createDataFrame([("pet", "kitten"), ("pet", "puppy"), ("cat", "kitten")], "term string, alias string")
    got = {(r["query_id"], r["photo_id"]): r for r in search.keyword_recall(asked, table, analysis, aliases=aliases).collect()}
    first = got[1, 0]
    assert first["tiers"] == ["exact", "negative", "strong", "support"] and first["term_hits"] == ["exact:pet", "negative:here", "strong:cat", "support:toy"] and first["negative_hits"] == 1
    raw = 3 + (3 + 4 + 4) * 0.7 + 4 * 0.5
    assert first["score"] == max(0.65, round(raw / (4 * 29), 4))
    assert (1, 1) not in got and got[1, 2]["score"] == round(2 * 0.7 / (4 * 29), 4) and got[1, 2]["tiers"] == ["strong"]
    assert got[2, 3]["score"] == round((3 + 4) * 0.7 / (2 * 29), 4)
    assert not [k for k in got if k[0] in (3, 4)]


def test_facets_alone_and_pale_concepts(spark):
    table, analysis = media(spark, [("a", {"object_tags": ["cat"]}), ("b", {})])
    analysis = analysis.withColumns({"semantic_concepts": F.array(F.lit("animal")), "semantic_facets": F.when(F.col("photo_id") == 1, F.array(F.lit("group_photo")))})
    asked = spark.createDataFrame([(1, 1, ["animal"], ["cat"], None, "animal_search"), (1, 2, None, None, ["group_photo"], None)], "project_id bigint, query_id bigint, concept_terms array<string>, entity_terms array<string>, facet_terms array<string>, intent string")
    got = {(r["query_id"], r["photo_id"]): (r["score"], r["tiers"]) for r in search.concept_recall(asked, table, analysis, 10).collect()}
    assert got == {(1, 0): (1.0, ["strong"]), (1, 1): (0.15, ["weak"]), (2, 1): (0.0, ["strong"])}


def test_people_modes(spark):
    asked = spark.createDataFrame([(1, 1, "mum"), (1, 2, "mum and bob"), (1, 3, "nobody"), (1, 4, "bob")], "project_id bigint, query_id bigint, text string")
    found = spark.createDataFrame([(1, 1, 7, "mum"), (1, 2, 7, "mum"), (1, 2, 8, "bob"), (1, 4, 8, "bob")], "project_id bigint, query_id bigint, person_id bigint, term string")
    assert {r["query_id"]: r["mode"] for r in search.people_modes(asked, found, ["mum", "dad"]).collect()} == {1: "boost", 2: "all", 3: "none", 4: "any"}


def test_ocr_weights(spark):
    hits = spark.createDataFrame([(1, q, 5, f, s) for q in (1, 2) for f, s in (("content", 0.5), ("ocr", 1.0), ("tag", -1.0))], "project_id bigint, query_id bigint, photo_id bigint, field string, similarity double")
    got = {r["query_id"]: r["score"] for r in search.multi_field_score(hits, ocr=spark.createDataFrame([(1, 2)], "project_id bigint, query_id bigint")).collect()}
    assert got == {1: 0.3, 2: 0.575}
    assert search.normalised_weights({"content": 2.0, "tag": -1.0, "ocr": 2.0}) == {"content": 0.5, "tag": 0.0, "ocr": 0.5}


def test_exif_reading(spark):
    tags = spark.createDataFrame([({"EXIF DateTimeOriginal": "bad", "Image DateTime": " 2024:03:01 10:20:30 ", "GPS GPSLatitude": "[30, 16, 267/10]", "GPS GPSLatitudeRef": "s", "GPS GPSLongitude": "[1, 2]", "GPS GPSAltitude": "100/0", "EXIF ISOSpeedRatings": "auto"},)], "tags map<string,string>")
    row = tags.select(*ingest.exif_columns("tags")).first()
    assert row["taken_at"] == datetime(2024, 3, 1, 10, 20, 30) and abs(row["gps_latitude"] + 30.2740833) < 1e-6
    assert (row["gps_longitude"], row["gps_altitude"], row["iso"]) == (None, 0.0, None)


def test_nested_roots(spark):
    roots = spark.createDataFrame([(1, "/a"), (1, "/a/b/"), (1, "/ab"), (1, "/a"), (2, "/a/b")], "project_id bigint, path string")
    assert sorted(map(tuple, ingest.outer_roots(roots).collect())) == [(1, "/a"), (1, "/ab"), (2, "/a/b")]


def test_entry_without_the_training_data_operators(tmp_path):
    """The library imports and lists its queries when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "shoebox", tmp_path / "shoebox", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'brw6_tag_counts' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_a_file_above_two_gigabytes_is_hashed_in_chunks(spark, tmp_path):
    from shoebox.sources import files

    size = (1 << 31) + 5
    with open(tmp_path / "long.mov", "wb") as out:
        out.truncate(size)
    digest, rest = hashlib.sha256(), size
    while rest:
        digest.update(bytes(min(rest, 1 << 24)))
        rest -= min(rest, 1 << 24)
    found = files.inventory(spark.createDataFrame([(1, str(tmp_path))], "project_id bigint, path string")).collect()
    assert [(r["file_size"], r["file_hash"]) for r in found] == [(size, digest.hexdigest())]


def test_manifest_lines_keep_their_numbers(spark, tmp_path):
    from shoebox.sources import files

    rows = ["first", "", "third", "  ", "ünïcode " * 9, "x" * 300, "", "", "cut"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, end in ((64, "\n"), (100, "\r\n"), (1 << 20, "\n")):
            (tmp_path / "m.jsonl").write_bytes(end.join(rows).encode())
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            found = files.manifest_lines(spark, f"{tmp_path}/m.jsonl").orderBy("n").collect()
            assert [(r["n"], r["value"]) for r in found] == list(enumerate(rows, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_batch_is_appended_once(spark, tmp_path):
    from shoebox.sources import files

    lines = spark.createDataFrame([(1, "a"), (2, "b")], "photo_id bigint, action string")
    path = f"{tmp_path}/manifest"
    broken = lines.select(F.when(F.col("photo_id") == 2, F.raise_error(F.lit("stop"))).otherwise("x").alias("action"), "photo_id")
    with pytest.raises(Exception, match="stop"):
        files.append_manifest(broken, path, "one")
    assert files.append_manifest(lines, path, "one") and not files.append_manifest(lines, path, "one")
    assert files.append_manifest(lines.where("photo_id = 1"), path, "two")
    # Two writers of one batch that both found no marker.
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: files.append_manifest(lines, path, "three"), range(2)))
    read = [r["value"] for r in files.read_appended(spark, path).collect()]
    assert sorted(read) == sorted(['{"action":"a","photo_id":1}', '{"action":"b","photo_id":2}'] * 2 + ['{"action":"a","photo_id":1}'])


def test_files_and_exports(spark, tmp_path):
    from shoebox.sources import files

    for name, text in (("a/x.JPG", "one"), ("a/b/y.png", "two"), ("a/z.txt", "no"), ("trash/t.jpg", "gone")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    roots = spark.createDataFrame([(1, str(tmp_path)), (1, f"{tmp_path}/a/"), (2, f"{tmp_path}/a"), (3, f"{tmp_path}/none")], "project_id bigint, path string")
    found = files.inventory(roots, (f"{tmp_path}/trash",))
    digest = {"x.JPG": hashlib.sha256(b"one").hexdigest(), "y.png": hashlib.sha256(b"two").hexdigest()}
    want = sorted((p, n, 3, digest[n]) for p in (1, 2) for n in digest)
    told = lambda rows: sorted((r["project_id"], r["file_path"].rsplit("/", 1)[1], r["file_size"], r["file_hash"]) for r in rows.collect())
    assert told(found) == want
    # Files of the same size and time keep the hash they had; others are read.
    known = found.withColumn("file_hash", F.lit("old"))
    (tmp_path / "a/b/y.png").write_text("other")
    again = files.inventory(roots, (f"{tmp_path}/trash",), known)
    assert [r[3] for r in told(again)] == ["old", hashlib.sha256(b"other").hexdigest()] * 2
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "photo_id bigint, action string")
    files.write_manifest(lines, f"{tmp_path}/m")
    files.write_manifest(lines, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 4
    items = spark.createDataFrame([(1, 7, "KEEP", datetime(2026, 1, 1)), (2, 7, "TRASH", datetime(2026, 1, 2)), (3, 7, None, None)], "id bigint, project_id bigint, human_label string, human_labeled_at timestamp")
    files.export_calibration(items, f"{tmp_path}/c")
    assert [r["item_id"] for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == ["2", "1"]
    files.write_table(items, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").where("project_id = 7").count() == 3


def test_model_answers(spark):
    from shoebox.functions.text import model_answer, nfkc

    rows = ['{"caption": "c", "people_count": 2}', 'x {"objects": ["a", "a", " b "], "score": "85%", "people": "3 persons"} y', "just words", "", None, '{"caption": "cut', "```json\n{\"caption\": \"f\"}\n```"]
    got = [r["a"] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(model_answer(F.col("t")).alias("a")).collect()]
    assert (got[0]["caption"], got[0]["people_count"]) == ("c", 2)
    assert (got[1]["object_tags"], got[1]["confidence"], got[1]["people_count"]) == (["a", "b"], 0.85, 3)
    assert got[2]["caption"] == "just words" and got[6]["caption"] == "f" and got[5]["caption"]
    assert spark.createDataFrame([("ｆ①",), (None,)], "t string").select(nfkc("t")).first()[0] == "f1"


SMALLEST, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def rows_of(spark, name, folder=SMALLEST):
    from shoebox.plans import ingest, library, people, search  # noqa: F401

    return library.QUERIES[name](spark, folder).collect()


def test_people_queries_read_all_assignments(spark):
    from shoebox.sources.tables import load

    held = {(r["project_id"], r["person_id"]) for r in load(spark, SMALLEST, "assignments").where("assignment_status <> 'rejected'").select("project_id", "person_id").distinct().collect()}
    got = {(r["project_id"], r["person_id"]): r["deletable"] for r in rows_of(spark, "ppl14_delete_rules")}
    assert got == {key: key not in held for key in got} and set(got.values()) == {True, False}
    counts = {(r["project_id"], r["person_id"]): r["sample_count"] for r in rows_of(spark, "ppl1_centroid_prototype", LARGER)}
    good = people.samples(load(spark, LARGER, "assignments"), load(spark, LARGER, "face_embeddings"), limit=10**9).groupBy("project_id", "person_id").count()
    assert counts == {(r["project_id"], r["person_id"]): min(r["count"], 200) for r in good.collect()} and max(counts.values()) > 5


def test_more_samples_than_the_limit(spark):
    rows = [(1, i, [float(i), 1.0], 0.8, "embedded") for i in range(1, 204)]
    assigned = [(1, 1000 + i, i, 7, "human_confirmed", True) for i in range(1, 204)]
    row = people.prototypes(spark.createDataFrame(assigned, ASSIGNED), spark.createDataFrame(rows, FACE)).first()
    assert (row["vector"], row["sample_count"]) == ([sum(range(4, 204)) / 200, 1.0], 200)


def test_every_project_has_a_manifest(spark):
    assert {r["project_id"] for r in rows_of(spark, "src2_manifest_validate")} == set(range(7))
    text = '{{"version": 1, "action": "trash", "project_id": {}, "photo_id": {}, "file_name": "x", "relative_path": "{}/x", "file_hash": "' + "a" * 64 + '", "file_size": 1}}'
    lines = [(1, 1, text.format(1, 5, "a")), (2, 2, text.format(2, 5, "a")), (2, 3, text.format(2, 5, "b")), (2, 4, text.format(1, 6, "c")), (2, 5, " ")]
    found = ingest.read_manifest(spark.createDataFrame(lines, "manifest_project bigint, n bigint, value string"), "trash").collect()
    assert {r["n"]: r["error"] for r in found} == {1: None, 2: "duplicate photo", 3: "duplicate photo", 4: "project"}


def one_by_one(rows, threshold=people.CLUSTER):
    """Clusters of (face_id, vector) by the rule itself."""
    groups, out = [], {}
    for face, vector in sorted(rows, key=lambda r: r[0]):
        vector = np.asarray(vector, float)
        means = [np.mean(g, axis=0) for g in groups]
        scores = [float(m @ vector / (np.linalg.norm(m) * np.linalg.norm(vector))) for m in means]
        best = int(np.argmax(scores)) if scores else -1
        if best < 0 or scores[best] < threshold:
            best = len(groups)
            groups.append([])
        groups[best].append(vector)
        out[face] = best
    return out


def test_every_unknown_face_has_a_cluster(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, rng.standard_normal(6).tolist(), 0.9, "embedded") for i in range(1400)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = people.cluster_unknown(spark.createDataFrame(rows, FACE), spark.createDataFrame([], ASSIGNED)).collect()
    stored = lambda v: np.asarray(v, np.float32)
    for project in (0, 1):
        assert {r["face_id"]: r["cluster"] for r in got if r["project_id"] == project} == one_by_one([(f, stored(v)) for p, f, v, _, _ in rows if p == project])
    assert len(got) == 1400


def test_rounds_of_clusters(spark):
    rng = np.random.default_rng(6)
    kinds = np.eye(8)[rng.integers(0, 8, 700)] + 0.05 * rng.standard_normal((700, 8))
    rows = [(i % 2, i, kinds[i].tolist(), 0.9, "embedded") for i in range(700)] + [(0, 9999, None, 0.9, "embedded")]
    faces, none = spark.createDataFrame(rows, FACE), spark.createDataFrame([], ASSIGNED)
    label = lambda got: {r["face_id"]: r["cluster"] for r in got.collect()}
    one, many = label(people.cluster_rounds(faces, none)), label(people.cluster_rounds(faces, none, 40))
    assert len(one) == 700 and one == many
    for project in (0, 1):
        plain = one_by_one([(i, np.asarray(v, np.float32)) for p, i, v, *_ in rows if p == project and v])
        first = {c: min(i for i in plain if plain[i] == c) for c in plain.values()}
        assert {i: one[i] for i in plain} == {i: first[c] for i, c in plain.items()}
    made = people.cluster_tables(people.cluster_rounds(faces, none, 40))
    assert made["persons"].agg(F.sum("face_count")).first()[0] == 700 and made["persons"].count() == 16
    assert people.cluster_rounds(faces.where("false"), none).count() == 0


def test_similar_clusters_become_one_wherever_they_stand(spark):
    rng = np.random.default_rng(11)
    kinds = np.eye(12)[[*range(12), *range(12)]] + 0.02 * rng.standard_normal((24, 12))
    faces = spark.createDataFrame([(1, i, kinds[i].tolist(), 0.9, "embedded") for i in range(24)], FACE)
    got = people.cluster_rounds(faces, spark.createDataFrame([], ASSIGNED), 4).collect()
    assert {r["face_id"]: r["cluster"] for r in got} == {i: i % 12 for i in range(24)}


def test_clusters_end_without_similar_means(spark):
    rng = np.random.default_rng(12)
    rows = [(i % 2, i, rng.standard_normal(5).tolist(), 0.9, "embedded") for i in range(120)]
    got = people.cluster_rounds(spark.createDataFrame(rows, FACE), spark.createDataFrame([], ASSIGNED), 7).collect()
    assert len(got) == 120
    same = {}
    for r in got:
        same.setdefault((r["project_id"], r["cluster"]), []).append(r["face_id"])
    for project in (0, 1):
        means = np.array([np.mean([rows[f][2] for f in own], axis=0) for (p, _), own in same.items() if p == project])
        unit = means / np.linalg.norm(means, axis=1)[:, None]
        assert (unit @ unit.T - 2 * np.eye(len(unit)) < people.CLUSTER + 1e-6).all()
    assert all(c == min(own) for (_, c), own in same.items())


def test_leaders_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(people, "PAIR_BLOCK", 8)
    rng = np.random.default_rng(13)
    vectors_ = np.eye(4)[rng.integers(0, 4, 30)] + 0.3 * rng.standard_normal((30, 4))
    points = spark.createDataFrame([(1, i, v.tolist(), 1 + i % 3) for i, v in enumerate(vectors_)], "project_id bigint, id bigint, vector array<double>, weight bigint")
    unit = vectors_ / np.linalg.norm(vectors_, axis=1)[:, None]
    got = {r["id"]: r for r in people._leaders(points, ["project_id"], 0.8).collect()}
    want = {i: r["leader"] for i, r in got.items()}
    leaders = [i for i in range(30) if want[i] == i]
    assert len(want) == 30 and len(leaders) > 4 and set(want.values()) == set(leaders)
    assert all(unit[i] @ unit[j] < 0.8 for i in leaders for j in leaders if i != j)
    assert all(want[i] < i and unit[i] @ unit[want[i]] >= 0.8 for i in want if want[i] != i)
    for i, r in got.items():
        own = [j for j in want if want[j] == r["leader"]]
        assert np.allclose(r["mean"], np.average(vectors_[own], axis=0, weights=[1 + j % 3 for j in own])) and r["total"] == sum(1 + j % 3 for j in own)


def test_clusters_of_photos(spark):
    rows = [(1, i, i % 3, [1.0, 0.0] if i < 6 else [0.0, 1.0], 0.9, "embedded") for i in range(9)]
    faces = spark.createDataFrame(rows, "project_id bigint, face_id bigint, photo_id bigint, embedding array<double>, quality double, status string")
    got = {(r["photo_id"], r["face_id"]): r["cluster"] for r in people.cluster_rounds(faces, spark.createDataFrame([], ASSIGNED), by=("project_id", "photo_id")).collect()}
    assert got == {(i % 3, i): i % 3 if i < 6 else i for i in range(9)}


def one_box_after_another(old, new, threshold=people.SAME_BOX):
    """The rule of ``reconcile_boxes``, box by box."""

    def overlap(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        shared = max(0, w) * max(0, h)
        every = a[2] * a[3] + b[2] * b[3] - shared
        return shared / every if every else 0.0

    left, rows = {}, []
    for photo, *box, face in sorted(old, key=lambda r: r[-1]):
        left.setdefault(photo, {})[face] = tuple(box)
    for photo, *box, place in sorted(new, key=lambda r: r[-1]):
        own, box = left.get(photo, {}), tuple(box)
        same = next((face for face, b in own.items() if b == box), None)
        best = same if same is not None else max(own, key=lambda face: (overlap(own[face], box), -face), default=None)
        if same is None and (best is None or overlap(own[best], box) < threshold):
            rows.append((photo, place, None, "insert"))
        else:
            del own[best]
            rows.append((photo, place, best, "keep" if best == same else "move"))
    return rows + [(photo, None, face, "disappeared") for photo, own in left.items() for face in own]


@pytest.mark.parametrize("spread", [3, 12, 60])
def test_boxes_equal_brute_force(spark, spread):
    rng = random.Random(spread)
    box = lambda: (rng.randrange(spread), rng.randrange(-2, spread), rng.choice([0, 7, 8, 20, 21, 23]), rng.choice([7, 8, 20, 22]))
    old = [(photo, *box(), i) for i, photo in enumerate(p for p in range(60) for _ in range(rng.randrange(9)))]
    new = [(photo, *(box() if rng.random() < 0.4 or not old else rng.choice(old)[1:5]), i) for i, photo in enumerate(p for p in range(62) for _ in range(rng.randrange(9)))]
    table = lambda rows, last: spark.createDataFrame([(1, *r) for r in rows], f"project_id bigint, photo_id bigint, x bigint, y bigint, w bigint, h bigint, {last} bigint")
    got = [tuple(r)[1:] for r in people.reconcile_boxes(table(old, "face_id"), table(new, "place")).collect()]
    assert sorted(got, key=repr) == sorted(one_box_after_another(old, new), key=repr)


def test_embedded_texts(spark):
    analysis = spark.createDataFrame(
        [(1, 1, " A dog\n", ["park", " park ", None], ["dog"], [], ["sharp"], ["Berlin"], ["dog", "pet"], ["animal"], " STOP ", 2), (1, 2, None, None, None, None, None, None, None, None, "  ", 0)],
        "project_id bigint, photo_id bigint, caption string, scene_tags array<string>, object_tags array<string>, activity_tags array<string>, quality_tags array<string>, location_clues array<string>, search_keywords array<string>, semantic_concepts array<string>, ocr_text string, people_count int",
    )
    photos = spark.createDataFrame(
        [(1, 1, "d.jpg", "a/d.jpg", datetime(2024, 5, 6, 7, 8, 59), "Canon", None, 52.5, 13.4041234), (1, 2, None, None, None, None, None, 1.0, None)],
        "project_id bigint, id bigint, file_name string, relative_path string, taken_at timestamp, camera_make string, camera_model string, gps_latitude double, gps_longitude double",
    )
    one, two = (r.asDict() for r in ingest.embedding_texts(analysis, photos, " Doc ", True).orderBy("photo_id").collect())
    assert one["caption_text"] == "Doc\nA dog" and one["tag_text"] == "Doc\npark;dog;sharp;Berlin;pet;animal" and one["ocr_text"] == "Doc\nSTOP"
    assert one["content_text"] == "Doc\n" + "\n\n".join(
        ["照片描述：A dog", "场景标签：park、park", "对象标签：dog", "质量标签：sharp", "地点线索：Berlin", "搜索关键词：dog、pet", "语义概念：animal", "OCR文本：STOP", "人物数量：2", "文件名：d.jpg", "相对路径：a/d.jpg", "拍摄时间：2024-05-06 07:08", "相机信息：Canon", "GPS：52.500000, 13.404123"]
    )
    assert {k: v for k, v in two.items() if k.endswith("text")} == {"caption_text": "", "tag_text": "", "ocr_text": "", "content_text": ""} and two["content_hash"] is None


def test_people_scores_count_nulls_as_zero(spark):
    wanted = spark.createDataFrame([(1, 7, 5), (1, 7, 6)], "project_id bigint, query_id bigint, person_id bigint")
    held = spark.createDataFrame([(1, 1, 5, "human_confirmed", 0.9, None), (1, 2, 6, "auto_assigned", None, 0.5), (1, 3, 5, "human_confirmed", None, None)], "project_id bigint, face_id bigint, person_id bigint, assignment_status string, confidence double, similarity double")
    faces = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 11)], "project_id bigint, face_id bigint, photo_id bigint")
    got = {r["photo_id"]: (r["score"], r["rank"]) for r in search.people_recall(wanted, held, faces, "any").collect()}
    assert got == {10: (round(0.63 + 0.82 * 0.2 + 0.2, 6), 1), 11: (0.3, 2)}


def test_actions_on_an_item_are_taken_in_order(spark, monkeypatch):
    items = spark.createDataFrame([(1, 1, "review", "QUARANTINE", None), (1, 2, "analysis_failed", None, None), (1, 3, "quarantined", None, None), (1, 4, "review", None, None)], "project_id bigint, photo_id bigint, status string, decision string, human_label string")
    photo_rows = spark.createDataFrame([(1, 1, "ai_indexed", None), (1, 2, "indexed", None), (1, 3, "quarantined", datetime(2026, 1, 1)), (1, 4, "quarantined", None)], "project_id bigint, id bigint, status string, deleted_at timestamp")
    steps = [(1, "keep"), (1, "delete"), (1, "delete"), (1, "keep"), (1, "undo"), (1, "undo"), (1, "delete"), (2, "retry"), (2, "retry"), (2, "keep"), (3, "keep"), (3, "restore"), (3, "keep"), (4, "keep"), (9, "keep"), (4, "jump")]
    actions = spark.createDataFrame([(1, p, n, a, a != "restore") for n, (p, a) in enumerate(steps)], "project_id bigint, photo_id bigint, seq bigint, action string, file_present boolean")
    want = ["done", "done", "unchanged", "conflict", "done", "conflict", "done", "done", "unchanged", "conflict", "conflict", "done", "done", "conflict", "not_found", "invalid"]
    for run in (256, 2):  # in one run, and in a tree of functions
        monkeypatch.setattr(cleanup, "ACTION_RUN", run)
        made = cleanup.review_actions(items, actions, photo_rows)
        assert [r["outcome"] for r in made["results"].orderBy("seq").collect()] == want
        got = {r["photo_id"]: (r["status"], r["decision"], r["human_label"], r["previous_photo_status"], r["answer_reset"]) for r in made["items"].collect()}
        assert got == {1: ("delete_queued", "QUARANTINE", "TRASH", "ai_indexed", False), 2: ("analysis_retry_queued", "REVIEW", None, None, True), 3: ("kept", "KEEP", "KEEP", None, False), 4: ("review", None, None, None, False)}
        assert {r["id"]: (r["status"], r["deleted"]) for r in made["photos"].collect()} == {1: ("quarantined", True), 2: ("indexed", False), 3: ("indexed", False), 4: ("quarantined", False)}


def test_an_item_without_a_photo_keeps_the_status_it_was_restored_to(spark, monkeypatch):
    items = spark.createDataFrame([(1, p, "review", None) for p in (1, 2, 3)] + [(1, 4, "review", "ai_indexed")], "project_id bigint, photo_id bigint, status string, previous_photo_status string")
    photo_rows = spark.createDataFrame([(1, 3, None, None)], "project_id bigint, id bigint, status string, deleted_at timestamp")
    steps = [(1, "delete"), (2, "delete"), (2, "undo"), (2, "delete"), (3, "delete"), (3, "undo"), (3, "delete"), (4, "delete"), (4, "undo"), (4, "delete")]
    actions = spark.createDataFrame([(1, p, n, a) for n, (p, a) in enumerate(steps)], "project_id bigint, photo_id bigint, seq bigint, action string")
    for run in (256, 2):
        monkeypatch.setattr(cleanup, "ACTION_RUN", run)
        made = cleanup.review_actions(items, actions, photo_rows)
        assert {r["photo_id"]: (r["status"], r["previous_photo_status"]) for r in made["items"].collect()} == {1: ("delete_queued", None), 2: ("delete_queued", "indexed"), 3: ("delete_queued", "indexed"), 4: ("delete_queued", "ai_indexed")}
        assert [tuple(r) for r in made["photos"].collect()] == [(1, 3, "quarantined", True)]


def one_action_after_another(items, photo_rows, actions):
    """The rules of ``review_actions``, action by action: outcomes by seq, items and photos."""
    state = {p: dict(status=s, prev=prev, label=None, decision=None, reset=False) for p, s, prev in items}
    shown, given, outcomes = {p: list(photo_rows.get(p, (None, False))) for p in state}, set(photo_rows), {}
    for p, seq, action, present, matches, writable, claimed, stored, same in actions:
        if p not in state:
            outcomes[seq] = "not_found"
            continue
        x, photo = state[p], shown[p]
        s, out = x["status"], "invalid"
        gone = photo[1] or photo[0] == "quarantined"
        if action == "keep":
            out = "unchanged" if s == "kept" else "conflict" if s not in cleanup.KEEPABLE or gone else "done"
        elif action == "delete":
            if s in ("delete_queued", "quarantined"):
                out = "unchanged"
            elif s not in cleanup.DELETABLE or present and not matches:
                out = "conflict"
            elif present and not writable:
                x["status"] = "queue_failed"
            elif present:
                out, x["prev"], shown[p] = "done", x["prev"] or photo[0], ["quarantined", True]
        elif action == "undo":
            out = "conflict" if s != "delete_queued" or not present or claimed else "done"
        elif action == "restore":
            if s == "restored":
                out = "unchanged"
            elif s not in cleanup.RESTORABLE or present and not stored and not matches or not present and stored and not same:
                out = "conflict"
            elif present and stored:
                out, x["status"] = "conflict", "restore_conflict"
            elif not present and not stored:
                x["status"] = "restore_failed"
            else:
                out = "done"
        elif action == "retry":
            out = "unchanged" if s == "analysis_retry_queued" else "conflict" if s != "analysis_failed" or gone else "done"
        elif action in ("label_keep", "label_trash"):
            out, x["label"] = "done", action[6:].upper()
        if out == "done" and action in ("undo", "restore"):
            shown[p] = [x["prev"] or "indexed", False]
        if out == "done":
            x["status"] = {"keep": "kept", "delete": "delete_queued", "undo": "restored", "restore": "restored", "retry": "analysis_retry_queued"}.get(action, s)
            x["decision"] = {"keep": "KEEP", "undo": "KEEP", "delete": "QUARANTINE", "retry": "REVIEW"}.get(action, x["decision"])
            x["reset"] |= action == "retry"
        if out == "done" and action in ("keep", "restore", "undo", "delete") or out == "unchanged" and action in ("keep", "restore", "delete"):
            x["label"] = "TRASH" if action == "delete" else "KEEP"
        outcomes[seq] = out
    return outcomes, {p: tuple(x.values()) for p, x in state.items()}, {p: tuple(shown[p]) for p in given}


@pytest.mark.parametrize("run", [256, 3])
def test_actions_equal_those_taken_one_by_one(spark, monkeypatch, run):
    monkeypatch.setattr(cleanup, "ACTION_RUN", run)
    rng = random.Random(run)
    starts = (None, "indexed", "ai_indexed", "quarantined")
    items = [(p, rng.choice((*cleanup.STATES[:-1], "elsewhere")), rng.choice((None, *starts))) for p in range(80)]
    photo_rows = {p: (rng.choice(starts), rng.random() < 0.2) for p in range(80) if p % 3}
    facts = lambda: (rng.random() < 0.7, rng.random() < 0.8, rng.random() < 0.8, rng.random() < 0.2, rng.random() < 0.5, rng.random() < 0.7)
    names = ("delete", "undo", "delete", "undo", "restore", "keep", "retry", "label_keep", "label_trash", "dance")
    actions = [(rng.randrange(82), n, rng.choice(names), *facts()) for n in range(1500)]
    made = cleanup.review_actions(
        spark.createDataFrame([(1, *r) for r in items], "project_id bigint, photo_id bigint, status string, previous_photo_status string"),
        spark.createDataFrame([(1, *r) for r in actions], "project_id bigint, photo_id bigint, seq bigint, action string, file_present boolean, hash_matches boolean, queue_writable boolean, claimed boolean, stored_present boolean, stored_matches boolean"),
        spark.createDataFrame([(1, p, s, datetime(2026, 1, 1) if gone else None) for p, (s, gone) in photo_rows.items()], "project_id bigint, id bigint, status string, deleted_at timestamp"),
    )
    outcomes, ends, shown = one_action_after_another(items, photo_rows, actions)
    assert {r["seq"]: r["outcome"] for r in made["results"].collect()} == outcomes
    assert {r["photo_id"]: (r["status"], r["previous_photo_status"], r["human_label"], r["decision"], r["answer_reset"]) for r in made["items"].collect()} == ends
    assert {r["id"]: (r["status"], r["deleted"]) for r in made["photos"].collect()} == shown


def test_clustered_faces_are_those_without_an_open_assignment(spark):
    from shoebox.sources.tables import load

    taken = load(spark, SMALLEST, "assignments").where("assignment_status <> 'rejected'")
    free = load(spark, SMALLEST, "face_embeddings").where("status = 'embedded'").join(taken, ["project_id", "face_id"], "left_anti")
    assert {r["face_id"] for r in rows_of(spark, "ppl7_unknown_face_clustering")} == {r["face_id"] for r in free.select("face_id").collect()}


def test_rematch_candidates_without_a_limit(spark):
    faces = spark.createDataFrame([(1, i, [1.0], 0.9, "embedded") for i in range(1200)], FACE)
    assert people.rematch_candidates(faces, spark.createDataFrame([], ASSIGNED), None).count() == 1200


def test_old_matches_are_scored_too(spark):
    table = photos(spark, [(i, i, "", "indexed") for i in range(1, 6)])
    tags = ", ".join(f"{c} array<string>" for c in ("scene_tags", "object_tags", "activity_tags", "search_keywords", "quality_tags", "location_clues"))
    texts = spark.createDataFrame([(1, i, "dog" if i > 1 else "dog cat", "", *[[]] * 6, None) for i in range(1, 6)], f"project_id bigint, photo_id bigint, caption string, ocr_text string, {tags}, created_at timestamp")
    asked = spark.createDataFrame([(1, 9, ["dog", "cat"])], "project_id bigint, query_id bigint, exact_terms array<string>")
    assert [r["photo_id"] for r in search.keyword_recall(asked, table, texts, k=1, scan=2).collect()] == [5]
    assert [r["photo_id"] for r in search.keyword_recall(asked, table, texts, k=1, scan=None).collect()] == [1]


def test_every_20th_vector_asks_both_fields(spark):
    found = rows_of(spark, "sch11_vector_top_k")
    assert {r["query_id"] for r in found} == set(range(0, 500, 20)) and {r["project_id"] for r in found} == {0, 1}
    assert {f: max(r["rank"] for r in found if r["field"] == f) for f in ("content", "tag")} == {"content": 200, "tag": 200}


def test_aliases_are_found_in_captions(spark):
    texts = spark.createDataFrame([(1, 1, "a long way to the Tiger", "", [], [], [], [], [], 0), (1, 2, "none", "", [], [], ["Tiger walk"], [], [], 0), (1, 3, None, None, None, [], [], [], [], 1)], "project_id bigint, photo_id bigint, caption string, ocr_text string, object_tags array<string>, scene_tags array<string>, activity_tags array<string>, search_keywords array<string>, location_clues array<string>, people_count int")
    aliases = spark.createDataFrame([("tiger", "cat")], "alias string, entity string")
    related = spark.createDataFrame([("cat", "animal")], "entity string, concept string")
    found = {r["photo_id"]: (r["entities"], r["concepts"]) for r in ingest.concepts(texts, aliases, related).collect()}
    assert found == {1: (["cat"], ["animal"]), 2: (["cat"], ["animal"]), 3: ([], ["people", "portrait"])}


def test_parts_within_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda low, high: "".join(rng.choice("abé ") for _ in range(rng.randint(low, high)))
    texts = [(i, g, None if i % 11 == 0 else word(0, 12)) for i in range(60) for g in (1, 2)] + [(900, 1, "ab " * 5000), (901, 1, "ab"), (901, 1, "ab")]
    parts = [(rng.choice((1, 2)), word(0, 5)) for _ in range(40)] + [(1, None), (1, ""), (1, "ab"), (1, "ab")]
    found = terms.parts_within(spark.createDataFrame(texts, "id int, g int, t string"), "t", spark.createDataFrame(parts, "g int, part string"), ("g",))
    want = [(i, g, t, p) for i, g, t in texts for h, p in set(parts) if g == h and p and t and p in t]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.columns == ["id", "g", "t", "part"]
    assert terms.parts_within(spark.createDataFrame([], "t string"), "t", spark.createDataFrame([("a",)], "part string")).isEmpty()


def asked_photos(spark, rng, n=150):
    """Photos with nulls in every column that requests ask for, most of them in one month."""
    some = lambda *x: rng.choice((None, *x))
    day = lambda: None if rng.random() < 0.1 else datetime(2026, 3, rng.randint(1, 31), 5) if rng.random() < 0.6 else datetime(rng.randint(2023, 2026), rng.randint(1, 12), rng.choice((1, 28)))
    places = ", ".join(f"{c} string" for c in search.PLACE_COLUMNS)
    rows = [(i, rng.randint(1, 2), day(), day(), datetime(2026, 1, 1) if i % 9 == 0 else None, some(0, 50, 100, 400, 6400), some("Canon", "NIKON", ""), some("EOS", "canon Z"), some(1.0), some(2.0), *(some("Rome", "Old Rome", "Oslo") for _ in search.PLACE_COLUMNS)) for i in range(n)]
    return spark.createDataFrame(rows, f"id bigint, project_id bigint, taken_at timestamp, created_at timestamp, deleted_at timestamp, iso int, camera_make string, camera_model string, gps_latitude double, gps_longitude double, {places}"), rows


def test_metadata_requests_equal_brute_force(spark):
    rng = random.Random(8)
    table, rows = asked_photos(spark, rng)
    some = lambda *x: rng.choice((None, None, *x))
    asked = [(1 + i % 2, i, some(2024, 2026), some(3, 12), some([], [1, 3]), some(datetime(2026, 3, 9), datetime(2024, 1, 1)), some(datetime(2026, 3, 20), datetime(2024, 12, 28)), some(True, False), some(60, 400), some(100, 9000), some("can", "nikon", ""), some("EOS", "can"), some(["rome"], ["old", "oslo"], [], [""], ["none"])) for i in range(120)]
    queries = spark.createDataFrame(asked, "project_id bigint, query_id int, year int, month int, months array<int>, date_from timestamp, date_to timestamp, needs_gps boolean, iso_min int, iso_max int, camera_make string, camera_model string, place_terms array<string>")
    found = {(r["query_id"], r["photo_id"]) for r in search.metadata_recall(queries, table).collect()}
    holds = lambda text, part: text is not None and part.lower() in text.lower()

    def wants(q, r):
        project, _, year, month, months, first, end, gps, low, high, make, model, words = q
        own, taken, deleted, iso, by, of, places = r[1], r[2], r[4], r[5], r[6], r[7], r[10:]
        if own != project or deleted:
            return False
        if first or end:
            timely = taken and (not first or taken >= first) and (not end or taken < end)
        elif year or month:
            timely = taken and year in (None, taken.year) and month in (None, taken.month)
        else:
            timely = not months or taken and taken.month in months
        cameras = [holds(x, y) for x, y in ((by, make), (of, model)) if y is not None]
        fits = timely and gps in (None, r[8] is not None and r[9] is not None) and (low is None or iso is not None and iso >= low) and (high is None or iso is not None and iso <= high)
        return fits and (not cameras or any(cameras)) and all(any(holds(p, w) for p in places) for w in words or [])

    want = {(q[1], r[0]) for q in asked for r in rows if wants(q, r)}
    assert found == want and len(want) > 300


def test_structured_requests_equal_brute_force(spark):
    rng = random.Random(9)
    table, rows = asked_photos(spark, rng)
    counts = {(r[1], r[0]): rng.choice((None, 0, 1, 5)) for r in rows if r[0] % 4}
    analysis = spark.createDataFrame([(p, i, n) for (p, i), n in counts.items()], "project_id bigint, photo_id bigint, people_count int")
    values = {"people_count": ("1", "5", "x"), "iso": ("100", "400", "50,400"), "taken_at": ("2026-03-09", "2025-01-01"), "created_at": ("2026-03-20",), "camera_make": ("canon", "Canon", "NIKON, Canon"), "camera_model": ("z", "EOS"), "has_gps": ("true", "false", "?"), "other": ("1",)}
    clauses = [(1 + i % 2, i, f := rng.choice(list(values)), rng.choice(("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "near")), rng.choice(values[f])) for i in range(100) for _ in range(rng.randint(1, 3))]
    found = search.structured_filter(spark.createDataFrame(clauses, "project_id bigint, query_id int, field string, op string, value string"), table, analysis)
    kinds = {"people_count": float, "iso": float, "taken_at": datetime.fromisoformat, "created_at": datetime.fromisoformat, "camera_make": str, "camera_model": str}

    def cast(kind, text):
        try:
            return kind(text)
        except ValueError:
            return None

    def holds(r, field, op, value):
        if field == "has_gps":
            want = {"true": True, "false": False}.get(value)
            return op not in ("eq", "ne") or want is None or ((r[8] is not None and r[9] is not None) == want) == (op == "eq")
        if field not in kinds or op == "near":
            return True
        own = {"people_count": counts.get((r[1], r[0])), "iso": r[5], "taken_at": r[2], "created_at": r[3], "camera_make": r[6], "camera_model": r[7]}[field]
        if own is None:
            return False
        if op == "contains":
            return value.lower() in (str(float(own)) if kinds[field] is float else str(own)).lower()
        if op == "in":
            return any(cast(kinds[field], v.strip()) == own for v in value.split(","))
        v = cast(kinds[field], value)
        return v is not None and {"eq": own == v, "ne": own != v, "gt": own > v, "gte": own >= v, "lt": own < v, "lte": own <= v}[op]

    asked = {}
    for project, query, *clause in clauses:
        asked.setdefault((project, query), []).append(clause)
    want = {(p, q, r[0]) for (p, q), own in asked.items() for r in rows if r[1] == p and not r[4] and all(holds(r, *c) for c in own)}
    assert {tuple(r) for r in found.select("project_id", "query_id", "photo_id").collect()} == want and len(want) > 300


def test_merges_in_order_equal_one_after_the_other(spark):
    rng = random.Random(12)
    rows, merges, links = [], [], set()
    for project in (1, 2):
        pairs = sorted({(f, p) for f in range(30) for p in rng.sample(range(8), rng.randint(1, 4))})
        rows += [(project, f, p, 1000 * project + n, rng.choice(("rejected", "auto_assigned", "human_confirmed")), None) for n, (f, p) in enumerate(pairs)]
        merges += [(project, n, rng.randrange(9), rng.randrange(9)) for n in range(14)] + [(project, 100 + n, 20 + n, 21 + n) for n in range(40)]
        rows += [(project, 99, 20, 1000 * project + 999, "auto_assigned", None)]
        links |= {(project, 0, 1), (project, 2, 5)}
    held = {r[:3]: list(r[3:]) for r in rows}
    for project, _, s, t in sorted(merges):
        if s == t or (project, min(s, t), max(s, t)) in links:
            continue
        for face in {f for p, f, who in held if (p, who) == (project, s) and held[p, f, who][1] != "rejected"}:
            own, other = held.pop((project, face, s)), held.get((project, face, t))
            if other is None:
                held[project, face, t] = [*own[:2], "human_merge"]
            elif other[1] == "rejected":
                other[1:] = [own[1], "human_merge"]
    table = spark.createDataFrame(rows, "project_id bigint, face_id int, person_id int, id bigint, assignment_status string, assignment_source string")
    asked = spark.createDataFrame(merges, "project_id bigint, seq int, source_id int, target_id int")
    found = people.merged_in_order(table, asked, spark.createDataFrame(sorted(links), "project_id bigint, person_a int, person_b int"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((*k, *v) for k, v in held.items()), key=repr)
    assert (1, 99, 60) in held
    none = people.merged_in_order(table, asked.limit(0), spark.createDataFrame([], "project_id bigint, person_a int, person_b int"))
    assert sorted(map(tuple, none.collect()), key=repr) == sorted(rows, key=repr)


def test_raw_concepts_add_to_hits_and_contracts_switch(spark):
    table, analysis = media(spark, [("a", {"object_tags": ["cat"]}), ("b", {})])
    analysis = analysis.withColumns({"semantic_concepts": F.array(F.lit("animal")), "raw_concepts": F.array(F.lit(" home ")), "raw_entities": F.array(F.lit("dog"))})
    asked = spark.createDataFrame([(1, 1, ["home", "animal"], ["cat", "dog"], "1"), (1, 2, ["home"], ["dog"], None), (1, 3, ["animal"], None, "2")], "project_id bigint, query_id bigint, concept_terms array<string>, entity_terms array<string>, contract string")
    got = lambda **how: {(r["query_id"], r["photo_id"]): r["score"] for r in search.concept_recall(asked, table, analysis, 10, **how).collect()}
    assert got() == {(1, 0): 1.0, (1, 1): 0.75}
    assert got(legacy=True) == {(1, 0): 1.0, (1, 1): 0.75, (3, 0): 1.0, (3, 1): 1.0}
    assert {p for q, p in got(scan=1) if q == 1} == {1}


def test_facets_from_file_names_raw_animals_and_default_terms(spark):
    _, analysis = media(spark, [("a wall", {}), ("Indoor", {"scene_tags": ["outside"]}), ("grass", {"scene_tags": ["动物园"]}), ("x", {})])
    analysis = analysis.withColumns({"semantic_concepts": F.array(F.lit("thing")), "raw_animals": F.when(F.col("photo_id") == 3, F.array(F.lit(" Cat ")))})
    rows = spark.createDataFrame([(1, q, p, 0.0, "C", False, ["INDOOR"] if p == 0 else None) for q in (1, 2) for p in range(4)], "project_id bigint, query_id bigint, photo_id bigint, vector_score double, level string, weak_field boolean, file_name_hits array<string>")
    asked = spark.createDataFrame([(1, 1, "indoor", None, None), (1, 2, "animal", ["cat"], [])], "project_id bigint, query_id bigint, facet string, positive_terms array<string>, negative_terms array<string>")
    got = {(r["query_id"], r["photo_id"]): r["reason"] for r in search.facet_filter(rows, analysis, asked).collect()}
    assert [got[1, p] for p in range(3)] == ["indoor_positive_visual_evidence", "indoor_conflicting_evidence", "indoor_no_positive_visual_evidence"]
    assert [got[2, p] for p in (0, 2, 3)] == ["animal_no_entity_evidence", "animal_scene_without_entity", "animal_entity_evidence"]
