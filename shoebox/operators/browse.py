"""Browsing a library: pages, cursors, positions, timelines, tag counts and lists, for all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators.order import running_counts

TAG_CATEGORIES = ("scene_tags", "object_tags", "activity_tags", "quality_tags", "location_clues", "search_keywords")
HUMAN = ("human_confirmed", "human_corrected")


def active() -> Column:
    """Photos of the active library: neither deleted nor quarantined."""
    return F.col("deleted_at").isNull() & (F.col("status") != "quarantined")


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("taken_at"), F.desc("created_at"), F.desc("id")]


def photo_page(photos: DataFrame, page: int, size: int, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """A page (from 1) of each project's active photos, newest first, with the project's total."""
    found = photos.where(active())
    if date_from:
        found = found.where(F.col("taken_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        found = found.where(F.col("taken_at") < F.lit(date_to).cast("timestamp"))
    totals = found.groupBy("project_id").agg(F.count("*").alias("total"))
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(*newest_first()))).where(F.col("position") <= page * size)
    return ranked.where(F.col("position") > (page - 1) * size).join(totals, "project_id").select("project_id", "position", "id", "taken_at", "total")


def keyset_page(photos: DataFrame, cursors: DataFrame, size: int) -> DataFrame:
    """For each project's cursor (project_id, c_taken, c_created, c_id), the next ``size`` photos and whether more follow."""
    after = (
        F.when(F.col("c_taken").isNull(), F.col("taken_at").isNull() & _before())
        .otherwise(F.col("taken_at").isNull() | (F.col("taken_at") < F.col("c_taken")) | ((F.col("taken_at") == F.col("c_taken")) & _before()))
    )
    found = photos.where(active()).join(cursors, "project_id").where(after)
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(*newest_first()))).where(F.col("position") <= size + 1)
    more = F.max("position").over(Window.partitionBy("project_id")) > size
    return ranked.withColumn("has_more", more).where(F.col("position") <= size).select("project_id", "position", "id", "has_more")


def _before() -> Column:
    return (F.col("created_at") < F.col("c_created")) | ((F.col("created_at") == F.col("c_created")) & (F.col("id") < F.col("c_id")))


def locate(photos: DataFrame, size: int) -> DataFrame:
    """Of every photo that isn't deleted: its position among the active photos of its folder, page, total and whether it can be browsed."""
    key = ["project_id", "folder_path"]
    rows = photos.where("deleted_at IS NULL").select(*key, "id", "taken_at", "created_at", (F.col("status") != "quarantined").alias("is_browsable"))
    totals = rows.groupBy(*key).agg(F.count_if("is_browsable").alias("total"))
    counted = running_counts(rows, key, newest_first(), F.col("is_browsable")).join(totals, key)
    counted = counted.select("project_id", "id", "is_browsable", "total", (1 + F.col("before")).alias("position"))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    return counted.withColumn("page", F.least(F.ceil(F.col("position") / size), last))


def timeline(photos: DataFrame) -> DataFrame:
    """Active photos by month: year, month, key "Y-MM", count."""
    dated = photos.where(active() & F.col("taken_at").isNotNull())
    months = dated.groupBy("project_id", F.year("taken_at").alias("year"), F.month("taken_at").alias("month")).agg(F.count("*").alias("count"))
    return months.withColumn("key", F.concat(F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0")))


def in_folder(photos: DataFrame, folder: str, scope: str = "subtree") -> DataFrame:
    """Active photos of a folder path: ``direct`` or with its subtree; the root's subtree is everything."""
    found = photos.where(active())
    if scope == "direct":
        return found.where(F.col("folder_path") == folder)
    return found.where((F.col("folder_path") == folder) | F.col("folder_path").startswith(f"{folder}/")) if folder else found


def tag_counts(analysis: DataFrame, photos: DataFrame, top: int = 100) -> DataFrame:
    """For each project and tag category, how many photos that aren't deleted carry a tag; the ``top`` most frequent, ties by tag.

    A photo has one analysis, so its tags are made distinct on the spot and then only counted.
    """
    kept = analysis.join(photos.where("deleted_at IS NULL").select("project_id", F.col("id").alias("photo_id")), ["project_id", "photo_id"])
    tags = F.array(*(F.struct(F.lit(c).alias("category"), F.array_distinct(F.array_compact(c)).alias("tags")) for c in TAG_CATEGORIES))
    pairs = kept.select("project_id", F.explode(tags).alias("x")).select("project_id", "x.category", F.explode("x.tags").alias("tag"))
    counts = pairs.groupBy("project_id", "category", "tag").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("project_id", "category").orderBy(F.desc("cnt"), "tag"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def with_tag(analysis: DataFrame, photos: DataFrame, field: str, values: list[str]) -> DataFrame:
    """Photos that aren't deleted whose tag array has one of ``values`` (a tag and its aliases), with score 1."""
    found = analysis.where(F.arrays_overlap(field, F.array(*map(F.lit, values)))).select("project_id", "photo_id")
    live = photos.where("deleted_at IS NULL").select("project_id", F.col("id").alias("photo_id"), "taken_at")
    return found.join(live, ["project_id", "photo_id"]).withColumn("score", F.lit(1.0))


def tag_page(analysis: DataFrame, photos: DataFrame, field: str, values: list[str], page: int, size: int) -> DataFrame:
    """A page of each project's ``with_tag`` photos, newest first, with the project's total."""
    found = with_tag(analysis, photos, field, values)
    totals = found.groupBy("project_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("taken_at"), F.desc("photo_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= page * size)
    return ranked.where(F.col("rank") > (page - 1) * size).join(totals, "project_id")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def person_counters(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    """Per person, over assignments that aren't rejected: all, positive, automatic and pending ones; zeros for persons without."""
    kept = assignments.where("assignment_status <> 'rejected'")
    counts = kept.groupBy("project_id", "person_id").agg(
        F.count("*").alias("face_count"), F.count_if("is_positive").alias("positive_count"),
        F.count_if(F.col("assignment_status") == "auto_assigned").alias("auto_count"), F.count_if(F.col("assignment_status") == "review_pending").alias("pending_count"),
    )
    return persons.withColumnRenamed("id", "person_id").join(counts, ["project_id", "person_id"], "left").na.fill(0)


def people_list(assignments: DataFrame, persons: DataFrame, limit: int, min_faces: int = 0, named: bool | None = None, pending: bool | None = None, name: str | None = None, min_positive: int = 0) -> DataFrame:
    """Persons of a project: named ones first, then by positive samples, faces, updated_at (if there is such a column) and id, all
    descending; the first ``limit`` with the total. Filters: least numbers of faces and positive samples, named or not, with or
    without pending faces, a part of the name in any case."""
    found = person_counters(assignments, persons).where((F.col("face_count") >= min_faces) & (F.col("positive_count") >= min_positive))
    if named is not None:
        found = found.where(F.col("is_named") == named)
    if pending is not None:
        found = found.where((F.col("pending_count") > 0) == pending)
    if name is not None:
        found = found.where(F.lower("display_name").contains(name.lower()))
    newest = [F.desc_nulls_last("updated_at")] if "updated_at" in persons.columns else []
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("is_named"), F.desc("positive_count"), F.desc("face_count"), *newest, F.desc("person_id")))
    totals = found.groupBy("project_id").agg(F.count("*").alias("total"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).join(totals, "project_id")


def review_list(assignments: DataFrame, faces: DataFrame, constraints: DataFrame) -> DataFrame:
    """Pending assignments with their face's photo and the persons it is known not to be."""
    pending = assignments.where("assignment_status = 'review_pending'")
    barred = constraints.groupBy("project_id", "face_id").agg(F.sort_array(F.collect_set("not_person_id")).alias("barred"))
    found = pending.select("project_id", "id", "face_id", "person_id").join(faces.select("project_id", "face_id", "photo_id"), ["project_id", "face_id"]).join(barred, ["project_id", "face_id"], "left")
    return found.withColumns({"n_barred": F.coalesce(F.size("barred"), F.lit(0)), "barred": F.coalesce("barred", F.array().cast("array<bigint>"))})


def review_page(assignments: DataFrame, faces: DataFrame, constraints: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each project's review list, newest assignments (updated_at, then id) first."""
    order = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("id"))
    pending = assignments.where("assignment_status = 'review_pending'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return review_list(pending, faces, constraints).join(pending.select("project_id", "id", "rank"), ["project_id", "id"])


def person_detail(assignments: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` assignments of each person, positive ones first, then newest (updated_at if there is such a column, and id),
    with the person's total."""
    newest = [F.desc_nulls_last("updated_at")] if "updated_at" in assignments.columns else []
    rank = F.row_number().over(Window.partitionBy("project_id", "person_id").orderBy(F.desc("is_positive"), *newest, F.desc("id")))
    totals = assignments.groupBy("project_id", "person_id").agg(F.count("*").alias("total"))
    first = assignments.select("project_id", "person_id", "id", rank.alias("rank")).where(F.col("rank") <= limit)
    return first.join(totals, ["project_id", "person_id"]).select("project_id", "person_id", "id", "rank", "total")


def pending_faces(assignments: DataFrame, limit: int = 500) -> DataFrame:
    """(project_id, person_id, face_ids): the first ``limit`` faces of each person that wait for review, by id."""
    rank = F.row_number().over(Window.partitionBy("project_id", "person_id").orderBy("face_id"))
    first = assignments.where("assignment_status = 'review_pending'").select("project_id", "person_id", "face_id", rank.alias("n")).where(F.col("n") <= limit)
    return first.groupBy("project_id", "person_id").agg(F.sort_array(F.collect_list("face_id")).alias("face_ids"))


def face_list(faces: DataFrame, page: int, size: int, status: str | None = None, photo_id: int | None = None) -> DataFrame:
    """A page of each project's faces, last detected first (detected_at if there is such a column, null last), then highest ids."""
    found = _faces(faces, status, photo_id)
    newest = [F.desc_nulls_last("detected_at")] if "detected_at" in faces.columns else []
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(*newest, F.desc("face_id")))
    return found.select("project_id", "face_id", "photo_id", "status", rank.alias("rank")).where((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))


def _faces(faces: DataFrame, status: str | None, photo_id: int | None) -> DataFrame:
    found = faces if status is None else faces.where(F.col("status") == status)
    return found if photo_id is None else found.where(F.col("photo_id") == photo_id)


def face_page(faces: DataFrame, page: int, size: int, status: str | None = None, photo_id: int | None = None) -> DataFrame:
    """``face_list`` with each project's total."""
    totals = _faces(faces, status, photo_id).groupBy("project_id").agg(F.count("*").alias("total"))
    return face_list(faces, page, size, status, photo_id).join(totals, "project_id")


def best_assignment(assignments: DataFrame) -> DataFrame:
    """One assignment that isn't rejected for each face: human before automatic before pending, then the latest updated_at (if there is
    such a column), then the highest id. A grouped maximum, combined before the shuffle."""
    worth = F.when(F.col("assignment_status").isin(*HUMAN), 2).when(F.col("assignment_status") == "auto_assigned", 1).otherwise(0)
    newest = [F.col("updated_at").isNotNull(), F.col("updated_at")] if "updated_at" in assignments.columns else []
    best = assignments.where("assignment_status <> 'rejected'").groupBy("project_id", "face_id").agg(F.max_by(F.struct("person_id", "assignment_status"), F.struct(worth, *newest, "id")).alias("b"))
    return best.select("project_id", "face_id", "b.person_id", "b.assignment_status")


def best_people(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    """``best_assignment`` with the person's name."""
    names = persons.select("project_id", F.col("id").alias("person_id"), "display_name", "is_named")
    return best_assignment(assignments).join(names, ["project_id", "person_id"])
