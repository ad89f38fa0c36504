"""Scan reconciliation, folders, places, tags and the state of derived texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.terms import parts_within
from shoebox.functions.text import nfkc_all, stripped
from shoebox.operators.browse import active

MEDIA = ("jpg", "jpeg", "png", "webp", "heic", "heif", "mp4", "mov", "m4v", "avi", "mkv", "webm")
EXIF_TIMES = ("EXIF DateTimeOriginal", "Image DateTime", "EXIF DateTimeDigitized")
PLACES = ("city", "district", "admin2", "admin1", "country_name")


# Metadata


def ratio(text: Column) -> Column:
    """A number written as ``a`` or ``a/b``; 0 for a zero denominator, null for anything else."""
    parts = F.split(F.trim(text), "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def degrees(value: Column, reference: Column, negative: str) -> Column:
    """Decimal degrees of ``[d, m, s]``, which must have three numbers; negative for the references in ``negative``."""
    parts = F.transform(F.split(F.regexp_replace(value, r"[\[\]]", ""), ","), ratio)
    size = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60 + F.get(parts, F.lit(2)) / 3600
    sign = F.when(F.upper(F.trim(reference)).isin(*negative), -1.0).otherwise(1.0)
    return F.when(F.size(parts) == 3, size * sign)


def exif_columns(tags: str) -> list[Column]:
    """Typed columns of a map of camera tags; what cannot be read is null."""
    tag = lambda name: F.element_at(F.col(tags), name)
    taken = F.coalesce(*(F.try_to_timestamp(F.trim(tag(t)), F.lit("yyyy:MM:dd HH:mm:ss")) for t in EXIF_TIMES))
    height = ratio(tag("GPS GPSAltitude")) * F.when(F.trim(tag("GPS GPSAltitudeRef")) == "1", -1.0).otherwise(1.0)
    return [
        taken.alias("taken_at"), degrees(tag("GPS GPSLatitude"), tag("GPS GPSLatitudeRef"), "S").alias("gps_latitude"), degrees(tag("GPS GPSLongitude"), tag("GPS GPSLongitudeRef"), "W").alias("gps_longitude"),
        height.alias("gps_altitude"), F.trim(tag("EXIF ISOSpeedRatings")).try_cast("int").alias("iso"), F.trim(tag("Image Make")).alias("camera_make"),
        F.trim(tag("Image Model")).alias("camera_model"), F.trim(tag("EXIF LensModel")).alias("lens"), F.trim(tag("Image Orientation")).try_cast("int").alias("orientation"),
    ]


def relative_path(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def folder_path(relative: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_extract(relative, r"^(.*)/[^/]*$", 1)


# Scans


def outer_roots(roots: DataFrame) -> DataFrame:
    """(project_id, path): each project's distinct roots without those inside another root."""
    roots = roots.select("project_id", F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    inner = roots.alias("a").join(roots.alias("b"), (F.col("a.project_id") == F.col("b.project_id")) & F.col("a.path").startswith(F.concat(F.col("b.path"), F.lit("/"))), "left_anti")
    return inner


def media_files(files: DataFrame) -> DataFrame:
    """Rows whose ``file_path`` has a media suffix, in any case."""
    return files.where(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).isin(*MEDIA))


def reconcile(inventory: DataFrame, photos: DataFrame) -> DataFrame:
    """(project_id, file_path, id, action) of every file found: insert, skip (deleted or quarantined), refresh (same content) or update."""
    known = photos.select("project_id", "file_path", "id", F.col("file_hash").alias("old_hash"), (~active()).alias("buried"))
    action = F.when(F.col("id").isNull(), "insert").when(F.col("buried"), "skip").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "refresh").otherwise("update")
    found = inventory.select("project_id", "file_path", F.col("file_hash").alias("new_hash")).join(known, ["project_id", "file_path"], "left")
    return found.select("project_id", "file_path", "id", action.alias("action"))


def merged_photos(inventory: DataFrame, photos: DataFrame, columns: list[str]) -> DataFrame:
    """The photos of ``reconcile``: all known ones and inserted ones (id null, status pending), with the inventory's ``columns`` where the
    file is new or has other content; with the folder of the path where it is the same (refresh). Skipped ones stay as they are."""
    key = ["project_id", "file_path"]
    acts = reconcile(inventory, photos).select(*key, "action")
    fresh = inventory.select(*key, F.col("file_hash").alias("new_file_hash"), F.col("folder_path").alias("new_folder_path"), *(F.col(c).alias(f"new_{c}") for c in columns)).join(acts, key)
    rows = photos.select(*key, "id", "status", "file_hash", "folder_path", *columns).join(fresh, key, "full")
    taken, moved = F.col("action").isin("insert", "update"), F.col("action").isin("insert", "update", "refresh")
    pick = lambda c, when: F.when(F.coalesce(when, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*key, "id", F.when(F.col("action") == "insert", "pending").otherwise(F.col("status")).alias("status"), pick("file_hash", taken), pick("folder_path", moved), *(pick(c, taken) for c in columns), F.coalesce("action", F.lit("keep")).alias("action"))


def missing_files(photos: DataFrame, inventory: DataFrame, projects: DataFrame) -> DataFrame:
    """Active photos without a file, but none of a project whose root cannot be reached."""
    away = projects.where(~F.col("available")).select(F.col("id").alias("project_id"))
    gone = photos.where(active()).select("project_id", "file_path", "id").join(inventory.select("project_id", "file_path"), ["project_id", "file_path"], "left_anti")
    return gone.join(away, "project_id", "left_anti").select("project_id", "id")


def reindex(photos: DataFrame, fresh: DataFrame, columns: list[str], scope: str = "all") -> DataFrame:
    """Photos in scope with new values where there are any, and whether one changed."""
    scopes = {"all": F.lit(True), "missing_metadata": F.col("taken_at").isNull(), "missing_location": F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull() & F.col("location_resolved_at").isNull()}
    new = fresh.select("project_id", "id", *(F.col(c).alias(f"new_{c}") for c in columns))
    found = photos.where(scopes[scope]).join(new, ["project_id", "id"], "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
    return found.select("project_id", "id", *(F.coalesce(f"new_{c}", c).alias(c) for c in columns), changed.alias("changed"))


# Folders


def ancestors(path: Column) -> Column:
    """All folders above and including a folder path, from the root (the empty path) down."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folders(photos: DataFrame) -> DataFrame:
    """(project_id, relative_path, parent_path, name, depth) of every folder with photos, and of those above."""
    paths = photos.select("project_id", "folder_path").distinct().select("project_id", F.explode(ancestors(F.col("folder_path"))).alias("relative_path")).distinct()
    top = F.col("relative_path") == ""
    depth = F.when(top, 0).otherwise(F.size(F.split("relative_path", "/")))
    return paths.select("project_id", "relative_path", F.when(~top, folder_path(F.col("relative_path"))).alias("parent_path"), F.element_at(F.split("relative_path", "/"), -1).alias("name"), depth.alias("depth"))


def folder_counts(photos: DataFrame) -> DataFrame:
    """Photos that aren't deleted, directly in each folder and in its whole subtree. Counted by folder first, then passed up."""
    direct = photos.where("deleted_at IS NULL").groupBy("project_id", "folder_path").agg(F.count("*").alias("n"))
    up = direct.select("project_id", "n", F.explode(ancestors(F.col("folder_path"))).alias("relative_path")).groupBy("project_id", "relative_path").agg(F.sum("n").alias("photos_recursive"))
    own = direct.select("project_id", F.col("folder_path").alias("relative_path"), F.col("n").alias("photos_direct"))
    return folders(photos).select("project_id", "relative_path").join(own, ["project_id", "relative_path"], "left").join(up, ["project_id", "relative_path"], "left").na.fill(0)


def breadcrumbs(folder_table: DataFrame) -> DataFrame:
    """For each folder the names from the root down to it, joined by `` > ``."""
    above = folder_table.select("project_id", "relative_path", F.explode(ancestors(F.col("relative_path"))).alias("a"))
    names = folder_table.select("project_id", F.col("relative_path").alias("a"), "name", "depth")
    lists = above.join(names, ["project_id", "a"]).groupBy("project_id", "relative_path").agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("c"))
    return lists.select("project_id", "relative_path", F.array_join(F.transform("c", lambda x: F.when(x["name"] == "", "/").otherwise(x["name"])), " > ").alias("crumbs"))


def breadcrumb_rows(folder_table: DataFrame) -> DataFrame:
    """(project_id, relative_path, crumbs array<struct<depth, id, name, relative_path>>): each folder of a table with ids and the folders
    above it, from the root down."""
    above = folder_table.select("project_id", "relative_path", F.explode(ancestors(F.col("relative_path"))).alias("a"))
    names = folder_table.select("project_id", F.col("relative_path").alias("a"), "id", "name", "depth")
    crumb = F.struct("depth", "id", "name", F.col("a").alias("relative_path"))
    return above.join(names, ["project_id", "a"]).groupBy("project_id", "relative_path").agg(F.sort_array(F.collect_list(crumb)).alias("crumbs"))


# Places


def location_key(latitude: Column, longitude: Column) -> Column:
    """Both coordinates with four decimals; equal for places some ten metres apart."""
    return F.concat(F.format_string("%.4f", F.round(latitude, 4)), F.lit(","), F.format_string("%.4f", F.round(longitude, 4)))


def enrich_places(photos: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Photos with coordinates that need a place: the cached one, or ``place`` null with the key to resolve."""
    wanted = F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull() & (F.lit(force) | F.col("location_resolved_at").isNull() | F.col("country_name").isNull())
    keyed = photos.where(wanted).select("project_id", "id", location_key(F.col("gps_latitude"), F.col("gps_longitude")).alias("location_key"))
    return keyed.join(cache.select("location_key", "place"), "location_key", "left")


def upsert_cache(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with geocoder results (location_key, place, seq); the last result of a key wins over all others."""
    rows = cache.select("location_key", "place", F.lit(-1).cast("bigint").alias("seq")).union(results.select("location_key", "place", F.col("seq").cast("bigint")))
    return rows.groupBy("location_key").agg(F.max_by("place", "seq").alias("place"))


def merge_place_tokens(analysis: DataFrame, photos: DataFrame) -> DataFrame:
    """Place names of photos with a latitude (city, district, admin2, admin1, country_name, in this order), behind the location clues they
    aren't among, and all clues behind the keywords; names are trimmed, and clues compared without white space around. ``added`` are the
    new clues and ``added_keywords`` the new keywords."""
    names = F.array_distinct(F.filter(F.array(*(F.trim(c) for c in PLACES)), lambda x: x.isNotNull() & (x != "")))
    here = photos.where("gps_latitude IS NOT NULL").select("project_id", F.col("id").alias("photo_id"), names.alias("names"))
    none = F.array().cast("array<string>")
    trimmed = lambda c: F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: t != "")
    rows = analysis.withColumns({"location_clues": F.coalesce("location_clues", none), "search_keywords": F.coalesce("search_keywords", none)}).join(here, ["project_id", "photo_id"])
    added = rows.withColumn("added", F.array_except("names", trimmed(F.col("location_clues"))))
    clues = F.concat("location_clues", "added")
    words = F.array_except(trimmed(clues), trimmed(F.col("search_keywords")))
    return added.select("project_id", "photo_id", clues.alias("location_clues"), F.concat("search_keywords", words).alias("search_keywords"), "added", words.alias("added_keywords"))


# Tags and texts


TAG_FIELDS = ("scene_tags", "object_tags", "activity_tags", "quality_tags", "location_clues")


def clean_tag(tag: Column) -> Column:
    """A tag with separators and white space folded."""
    return F.regexp_replace(F.trim(F.regexp_replace(tag, r"[_-]+", " ")), r"\s+", " ")


def canonical_tag(tag: Column, aliases: dict[str, str]) -> Column:
    """A tag with separators and white space folded, as the canonical tag that its lower-cased form is an alias of."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    clean = clean_tag(tag)
    return F.coalesce(F.try_element_at(table, F.lower(clean)), clean)


def canonical_tags(tags: Column, aliases: dict[str, str]) -> Column:
    """Canonical tags in order, without empty and repeated ones; characters are composed by NFKC first."""
    return F.array_distinct(F.filter(F.transform(nfkc_all(tags), lambda t: canonical_tag(t, aliases)), lambda t: t.isNotNull() & (t != "")))


def canonical_analysis(analysis: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Analyses with canonical tags in every tag field; keywords are followed by the scenes, objects, activities, qualities and clues that
    they lack. Null lists are empty."""
    none = F.array().cast("array<string>")
    fields = [*TAG_FIELDS, "search_keywords", *(["semantic_concepts"] if "semantic_concepts" in analysis.columns else [])]
    rows = analysis.withColumns({c: canonical_tags(F.coalesce(c, none), aliases) for c in fields})
    return rows.withColumn("search_keywords", F.array_distinct(F.concat("search_keywords", *TAG_FIELDS)))


def expand_terms(terms: DataFrame, aliases: DataFrame, separators: bool = True) -> DataFrame:
    """(term, expanded): the term with separators and white space folded, its canonical tag and, sorted, all aliases of that tag (alias,
    canonical); aliases are found in any case. Without ``separators`` only white space is folded, and a term keeps its ``_`` and ``-``."""
    clean = clean_tag(F.col("term")) if separators else F.regexp_replace("term", r"[\t\n\f\r ]+", " ")
    groups = aliases.groupBy("canonical").agg(F.sort_array(F.collect_set("alias")).alias("all"))
    known = aliases.groupBy(F.lower("alias").alias("key")).agg(F.min("canonical").alias("canonical"))
    found = terms.select("term").distinct().withColumn("clean", clean).withColumn("key", F.lower("clean")).join(known, "key", "left").join(groups, "canonical", "left")
    return found.select("term", F.array_distinct(F.array_compact(F.concat(F.array("clean", "canonical"), F.coalesce("all", F.array().cast("array<string>"))))).alias("expanded"))


#: Labels of the sections of an embedded text, in their order.
SECTIONS = ("照片描述", "场景标签", "对象标签", "活动标签", "质量标签", "地点线索", "搜索关键词", "语义概念", "OCR文本", "人物数量", "文件名", "相对路径", "拍摄时间", "相机信息", "GPS")
#: Tag fields in the order in which they are embedded.
EMBEDDED_TAGS = ("scene_tags", "object_tags", "activity_tags", "quality_tags", "location_clues", "search_keywords", "semantic_concepts")


def embedding_texts(analysis: DataFrame, photos: DataFrame, prefix: str = "", with_texts: bool = False) -> DataFrame:
    """SHA-256 of the four texts that are embedded for each photo, null for empty ones: its caption, its tags, the text read from it, and the
    sections of all that is known of it. ``with_texts`` adds the texts.

    Texts and tags are stripped of white space, and empty ones are left out. Tags of all fields are joined by ``;``, each once, where it
    comes first; in a section they keep repeats and are joined by ``、``. Sections (``SECTIONS``) stand in order with an empty line
    between; a people count of 0 is none, times are to the minute, coordinates have six places. A ``prefix`` stands on a line before each
    text that is not empty. Columns that a table does not have count as null.
    """
    own = {c: F.col(f"a.{c}") for c in analysis.columns} | {c: F.col(f"p.{c}") for c in photos.columns if c not in ("project_id", "id") and c not in analysis.columns}
    none = F.lit(None)
    text = lambda c: F.when(stripped(c) != "", stripped(c))
    known = lambda c, kind="string": own.get(c, none).cast(kind)
    tags = {c: F.filter(F.transform(F.coalesce(known(c, "array<string>"), F.array().cast("array<string>")), stripped), lambda t: t != "") for c in EMBEDDED_TAGS}
    listed = [F.when(F.size(t) > 0, F.array_join(t, "、")) for t in tags.values()]
    people = F.when(known("people_count", "bigint") > 0, known("people_count"))
    path = F.coalesce(*(F.when(known(c) != "", known(c)) for c in ("relative_path", "file_path")))
    camera = F.array_join(F.filter(F.array(known("camera_make"), known("camera_model")), lambda x: x != ""), " ")
    gps = F.format_string("%.6f, %.6f", known("gps_latitude", "double"), known("gps_longitude", "double"))
    values = [text(known("caption")), *listed, text(known("ocr_text")), people, known("file_name"), path, F.date_format(known("taken_at", "timestamp"), "yyyy-MM-dd HH:mm"), camera, F.when(known("gps_latitude").isNotNull() & known("gps_longitude").isNotNull(), gps)]
    content = F.concat_ws("\n\n", *(F.when(v != "", F.concat(F.lit(f"{name}："), v)) for name, v in zip(SECTIONS, values, strict=True)))
    every = F.array_join(F.array_distinct(F.flatten(F.array(*tags.values()))), ";")
    head = prefix.strip()
    parts = {"caption": text(known("caption")), "tag": text(every), "ocr": text(known("ocr_text")), "content": text(content)}
    if head:
        parts = {name: F.concat(F.lit(f"{head}\n"), c) for name, c in parts.items()}
    joined = analysis.alias("a").join(photos.alias("p"), (F.col("a.project_id") == F.col("p.project_id")) & (F.col("a.photo_id") == F.col("p.id")))
    shown = [F.coalesce(c, F.lit("")).alias(f"{name}_text") for name, c in parts.items()] if with_texts else []
    return joined.select("a.project_id", "a.photo_id", *(F.sha2(c, 256).alias(f"{name}_hash") for name, c in parts.items()), *shown)


def embedding_state(texts: DataFrame, embeddings: DataFrame, model: str, version: str, dimension: int | None = None) -> DataFrame:
    """missing, failed, stale or ready for each photo with a text. Stale: not ready, of another model, version, dimension (if one is
    asked for) or text."""
    hashes = [c for c in texts.columns if c.endswith("_hash")]
    sizes = ["dimension"] if dimension is not None else []
    old = embeddings.select("project_id", "photo_id", "status", "model", "version", *sizes, *(F.col(c).alias(f"old_{c}") for c in hashes))
    same = (F.col("status") == "ready") & (F.col("model") == model) & (F.col("version") == version)
    if dimension is not None:
        same = same & F.coalesce(F.col("dimension") == dimension, F.lit(False))
    for c in hashes:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "failed", "failed").when(same, "ready").otherwise("stale")
    return texts.join(old, ["project_id", "photo_id"], "left").select("project_id", "photo_id", state.alias("state"))


def embedding_counts(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for each project: photos with a text, by state, and queued and running embedding jobs."""
    counts = state.groupBy("project_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("ready", "missing", "stale", "failed")))
    waiting = jobs.where(F.col("job_type") == "embed").groupBy("project_id").agg(*(F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in ("queued", "running")))
    return counts.join(waiting, "project_id", "left").na.fill(0)


def rebuild_list(state: DataFrame, jobs: DataFrame, scope: str = "stale", selected: DataFrame | None = None) -> DataFrame:
    """Photos to embed again by scope (a state, ``selected``, ``all`` for what isn't ready, or ``force``), and which are skipped: those with an
    active job, and selected ones that are ready (up_to_date)."""
    wanted = {"all": F.col("state") != "ready", "force": F.lit(True), "selected": F.lit(True)}.get(scope, F.col("state") == scope)
    busy = jobs.where(F.col("status").isin("queued", "running") & (F.col("job_type") == "embed")).select("project_id", "photo_id", F.lit(True).alias("busy")).distinct()
    chosen = state.where(wanted)
    if scope == "selected":
        chosen = chosen.join(selected.select("project_id", "photo_id"), ["project_id", "photo_id"], "left_semi")
    found = chosen.join(busy, ["project_id", "photo_id"], "left")
    fresh = F.lit(scope == "selected") & (F.col("state") == "ready")
    return found.select("project_id", "photo_id", F.when(fresh, "up_to_date").when(F.col("busy"), "skipped_existing").otherwise("created").alias("outcome"))


def rebuild_summary(state: DataFrame, listed: DataFrame) -> DataFrame:
    """(project_id, created, skipped_existing, up_to_date): of ``rebuild_list``; up to date are all ready photos that it does not create."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    rows = state.join(listed, ["project_id", "photo_id"], "left")
    return rows.groupBy("project_id").agg(count("created"), count("skipped_existing"), F.count_if((F.col("state") == "ready") & ~F.coalesce(F.col("outcome") == "created", F.lit(False))).alias("up_to_date"))


def name_terms(name: Column) -> dict[str, Column]:
    """Of a display name: its ``#tags`` (distinct in any case, in order), the name without them, and all search terms."""
    raw = F.regexp_extract_all(name, F.lit(r"#([^\s#]+)"), 1)
    keep = F.filter(raw, lambda t, i: F.array_position(F.transform(raw, F.lower), F.lower(t)) == i + 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, r"#[^\s#]+", " "), r"\s+", " "))
    terms = F.array_distinct(F.filter(F.concat(F.array(F.lower(plain)), F.transform(keep, F.lower)), lambda t: t != ""))
    return {"name_tags": keep, "plain_name": plain, "search_terms": terms}


def rewrite_roots(projects: DataFrame, old: str, new: str) -> DataFrame:
    """Roots at or below ``old``, moved to ``new``."""
    under = (F.col("root") == old) | F.col("root").startswith(f"{old}/")
    return projects.withColumn("root", F.when(under, F.concat(F.lit(new), F.substring(F.col("root"), F.lit(len(old) + 1), F.length("root")))).otherwise(F.col("root")))


def rewrite_library_paths(paths: DataFrame, old: str, new: str) -> DataFrame:
    """Child rows (project_id, path, position) below ``old``, moved to ``new``; of paths that become equal, the first position stays."""
    under = (F.col("path") == old) | F.col("path").startswith(f"{old}/")
    moved = F.when(under, F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path")))).otherwise(F.col("path"))
    return paths.withColumn("path", moved).groupBy("project_id", "path").agg(F.min("position").alias("position"))


def backfill_scope(rows: DataFrame, photos: DataFrame, default_project: int) -> DataFrame:
    """Rows (id, photo_id, project_id) without a project get that of their photo, else the default."""
    of = photos.select(F.col("id").alias("photo_id"), F.col("project_id").alias("p"))
    return rows.join(of, "photo_id", "left").select("id", "photo_id", F.coalesce("project_id", "p", F.lit(default_project)).alias("project_id"))


# Trash manifests


MANIFEST = "version int, action string, project_id bigint, project_name string, photo_id bigint, file_name string, relative_path string, file_hash string, file_size bigint"


def read_manifest(lines: DataFrame, action: str, project_id: int | None = None) -> DataFrame:
    """Lines (n, value) of a manifest with the fields read and ``error`` for lines that make the batch invalid; blank ones are skipped.

    Without ``project_id``, lines (manifest_project, n, value) of one manifest for each project, which are told apart by that column.
    """
    own = F.col("manifest_project") if project_id is None else F.lit(project_id)
    parsed = lines.where(F.trim("value") != "").select(own.alias("manifest_project"), "n", F.from_json("value", MANIFEST).alias("m")).select("manifest_project", "n", "m.*")
    photo, path = Window.partitionBy("manifest_project", "photo_id"), Window.partitionBy("manifest_project", "relative_path")
    parts = F.split("relative_path", "/")
    unsafe = F.col("relative_path").startswith("/") | F.exists(parts, lambda p: p.isin("", ".", "..")) | (F.element_at(parts, -1) != F.col("file_name"))
    bad = lambda c: F.coalesce(c, F.lit(True))
    error = (
        F.when(bad(F.col("version") != 1), "version").when(bad(F.col("action") != action), "action").when(bad(F.col("project_id") != F.col("manifest_project")), "project")
        .when(bad(F.col("photo_id") <= 0), "photo").when(bad(unsafe), "path").when(bad(~F.col("file_hash").rlike("^[0-9a-fA-F]{64}$")), "hash").when(F.col("file_size") < 0, "size")
        .when(F.count("*").over(photo) > 1, "duplicate photo").when(F.count("*").over(path) > 1, "duplicate path")
    )
    found = parsed.withColumn("error", error)
    return found if project_id is None else found.drop("manifest_project")


def manifest_verdicts(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(manifest_project, lines, errors, valid) of each manifest of ``read_manifest``: any bad line fails it. With ``names`` (project_id,
    name) a line whose project_name is another's is bad too."""
    bad = F.col("error").isNotNull()
    if names is not None:
        lines = lines.join(names.select(F.col("project_id").alias("manifest_project"), F.col("name").alias("own_name")), "manifest_project", "left")
        bad = bad | ~F.col("project_name").eqNullSafe(F.col("own_name"))
    counts = lines.groupBy("manifest_project").agg(F.count("*").alias("lines"), F.count_if(bad).alias("errors"))
    return counts.withColumn("valid", F.col("errors") == 0)


def new_manifest_lines(deleted: DataFrame, manifest: DataFrame, action: str) -> DataFrame:
    """Entries (project_id, photo_id, …) that the manifest does not have for this action, each once."""
    key = ["action", "project_id", "photo_id"]
    return deleted.withColumn("action", F.lit(action)).dropDuplicates(key).join(manifest.select(*key), key, "left_anti")


def cancel_lines(manifest: DataFrame, claimed: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Manifest entries with what becomes of them: kept, removed, or a conflict because a running batch has claimed them."""
    key = ["project_id", "photo_id"]
    marked = manifest.join(cancelled.select(*key, F.lit(True).alias("cancel")).distinct(), key, "left").join(claimed.select(*key, F.lit(True).alias("claim")).distinct(), key, "left")
    return marked.select(*key, F.when(F.col("cancel") & F.col("claim"), "conflict").when(F.col("cancel"), "removed").otherwise("kept").alias("outcome"))


TAGS = ("object_tags", "scene_tags", "activity_tags", "search_keywords", "location_clues")


def concepts(analysis: DataFrame, aliases: DataFrame, related: DataFrame, tags: tuple[str, ...] = TAGS, caption: bool = True) -> DataFrame:
    """(project_id, photo_id, entities, concepts): entities whose alias (alias, entity) is contained in a tag or the caption, and the
    concepts related to them (entity, concept), with those that the number of people implies; all sorted.

    Different texts meet the aliases by grams (``parts_within``), so neither table is read once for each row of the other. Without ``caption``
    captions are left out. Empty aliases are in no text.
    """
    fields = [F.coalesce(c, F.array().cast("array<string>")) for c in tags]
    terms = analysis.select("project_id", "photo_id", F.explode(F.array_distinct(F.transform(F.concat(*fields, F.array("ocr_text")), F.lower))).alias("term"))
    if caption:
        terms = terms.union(analysis.select("project_id", "photo_id", F.lower("caption")))
    known = aliases.select(F.lower("alias").alias("part"), "entity").distinct()
    found = parts_within(terms, "term", known.select("part")).join(known, "part").select("project_id", "photo_id", "entity").distinct()
    entities = found.groupBy("project_id", "photo_id").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    wider = found.join(related, "entity").groupBy("project_id", "photo_id").agg(F.collect_set("concept").alias("wider"))
    n = F.col("people_count")
    people = F.array_compact(F.array(F.when(n >= 1, "people"), F.when(n == 1, "portrait"), F.when(n >= 2, "group photo"), F.when(n >= 3, "gathering")))
    none = F.array().cast("array<string>")
    joined = analysis.select("project_id", "photo_id", "people_count").join(entities, ["project_id", "photo_id"], "left").join(wider, ["project_id", "photo_id"], "left")
    return joined.select("project_id", "photo_id", F.coalesce("entities", none).alias("entities"), F.sort_array(F.array_distinct(F.concat(F.coalesce("wider", none), people))).alias("concepts"))


# Scenes that do not make an animal, and words for groups of people in captions.
WEAK_SCENES = ("动物园", "宠物店", "野外")
GROUP_WORDS = ("多人", "合照", "合影", "集体照", "全家福", "多人合照", "多人合影", "group photo")
SOURCES = ("object_tags", "search_keywords", "caption", "scene_tags", "activity_tags", "location_clues")
WEAK_SOURCES = ("scene_tags", "location_clues", "activity_tags")
PEOPLE = ("人物", "单人照", "人像", "多人", "合照", "合影", "集体照", "自拍", "全家福")
GROUPS = ("多人", "合照", "合影", "集体照", "全家福")
ANIMALS = ("动物", "宠物", "小动物", "野生动物", "水生动物", "昆虫")


def _placed(source: int):
    return lambda term, place: F.struct(F.lit(source).alias("s"), place.alias("i"), F.lower(F.trim(term)).alias("term"))


def ordered_concepts(analysis: DataFrame, aliases: DataFrame, related: DataFrame, concept_aliases: DataFrame, people_aliases: DataFrame) -> DataFrame:
    """(project_id, photo_id, entities, concepts, facets): as ``concepts``, in the order in which they are met.

    First what people_count implies; then, source by source and term by term, for each term: entities (alias, entity; a part of the
    term), each with its concepts (entity, concept, place), then the concept whose alias the whole term is (alias, concept), then
    concepts of people whose alias is a part of it; last, a group word in the caption. Weak scenes in weak sources do not count, and
    weak sources do not give the concept of animals as such. Facets: object and animal, people, group_photo.

    Different terms meet the aliases by grams (``parts_within``); only what is found is gathered for a photo.
    """
    key = ["project_id", "photo_id"]
    fields = [F.transform(F.array("caption") if c == "caption" else F.coalesce(c, F.array().cast("array<string>")), _placed(SOURCES.index(c))) for c in SOURCES]
    terms = analysis.select(*key, F.inline(F.concat(*fields))).where("term <> ''")
    weak = F.col("s").isin(*(SOURCES.index(c) for c in WEAK_SOURCES))
    terms = terms.where(~(weak & F.col("term").isin(*WEAK_SCENES)))
    numbered = lambda rows, n: rows.withColumn("k", F.lit(n))
    known = numbered(aliases.select(F.lower("alias").alias("alias"), F.col("entity").alias("name")), 0).union(numbered(people_aliases.select(F.lower("alias"), "concept"), 2)).distinct()
    whole = concept_aliases.select(F.lower("alias").alias("term"), F.col("concept").alias("name"), F.lit(1).alias("k"))
    columns = [*key, "s", "i", "name", "k"]
    hits = parts_within(terms, "term", known.select(F.col("alias").alias("part"))).withColumnRenamed("part", "alias").join(known, "alias").select(*columns).union(terms.join(whole, "term").where(~((F.col("name") == "动物") & weak)).select(*columns))
    order = F.struct("s", "i", "k", "name").alias("o")
    entities = hits.where("k = 0").groupBy(*key, F.col("name").alias("entity")).agg(F.min(order).alias("o"))
    own = hits.where("k > 0").select(*key, F.col("name").alias("concept"), F.col("s").alias("a"), F.col("i").alias("b"), F.col("k").alias("c"), F.lit(0).alias("d"), "name")
    wider = hits.where("k = 0").withColumnRenamed("name", "entity").join(related, "entity").select(*key, "concept", "s", "i", "k", "place", "entity")
    n = F.col("people_count")
    implied = F.array_compact(F.array(F.when(n >= 1, "人物"), F.when(n == 1, "单人照"), F.when(n == 1, "人像"), F.when(n >= 2, "多人"), F.when(n >= 2, "合照"), F.when(n >= 2, "合影"), F.when(n >= 3, "集体照")))
    grouped = F.when(F.coalesce(F.lower("caption").rlike("|".join(GROUP_WORDS)), F.lit(False)), F.array(*(F.lit(x) for x in ("多人", "合照", "合影")))).otherwise(F.array().cast("array<string>"))
    counted = analysis.select(*key, F.posexplode(implied).alias("b", "concept")).select(*key, "concept", F.lit(-1), "b", F.lit(0), F.lit(0), F.lit(""))
    last = analysis.select(*key, F.posexplode(grouped).alias("b", "concept")).select(*key, "concept", F.lit(len(SOURCES)), "b", F.lit(0), F.lit(0), F.lit(""))
    concepts_ = own.union(wider).union(counted).union(last).groupBy(*key, "concept").agg(F.min(F.struct("a", "b", "c", "name", "d")).alias("o"))
    listed = lambda rows, name: rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", name))), lambda x: x[name]).alias(f"{name}_list"))
    none = F.array().cast("array<string>")
    rows = analysis.select(*key).join(listed(entities, "entity"), key, "left").join(listed(concepts_, "concept"), key, "left").select(*key, F.coalesce("entity_list", none).alias("entities"), F.coalesce("concept_list", none).alias("concepts"))
    some = lambda names: F.arrays_overlap("concepts", F.array(*map(F.lit, names)))
    animal = (F.size("entities") > 0) | some(ANIMALS)
    facets = F.array_compact(F.array(F.when(animal, "object"), F.when(animal, "animal"), F.when(some(PEOPLE), "people"), F.when(some(GROUPS), "group_photo")))
    return rows.withColumn("facets", facets)
