"""Duplicates, review items, calibration, deletion and the job log."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.columns import let
from shoebox.operators.browse import active
from shoebox.operators.order import running_counts
from shoebox.sources.files import written

ACTIVE_JOBS = ("queued", "running", "paused")
#: Older names of item classes.
ALIASES = {"meaningless_test": "meaningless_test_image"}
AUTO_CONFIDENCE = 0.98


def exact_duplicates(photos: DataFrame) -> DataFrame:
    """Active photos whose content an active photo with a smaller id has, with that photo.

    The smallest id of a hash is a grouped minimum, combined before the shuffle; hashes with one photo never reach the join,
    so a hash with very many copies costs one row.
    """
    live = photos.where(active() & F.col("file_hash").isNotNull()).select("project_id", "file_hash", "id", "file_name")
    sources = live.groupBy("project_id", "file_hash").agg(F.min(F.struct("id", "file_name")).alias("s"), F.count("*").alias("n")).where("n > 1")
    found = live.join(sources, ["project_id", "file_hash"]).where("id <> s.id")
    return found.select("project_id", "id", F.col("s.id").alias("source_id"), F.col("s.file_name").alias("source_name"), F.lit("REVIEW").alias("decision"), F.lit("suspected_duplicate").alias("classification"), F.lit(1.0).alias("confidence"))


# Classes that may be moved without a human, and flags of sensitive content that make a rating ADULT.
AUTO_CLASSES = ("accidental_capture", "severe_blur", "obscured_lens", "blank_image", "meaningless_test_image")
ADULT_FLAGS = ("explicit_sexual_content", "nudity", "graphic_violence", "gore", "other_adult_content")
#: What a model says of a photo in one pass.
PASS = "decision string, classification string, confidence double, reason string, preservation_flags array<string>, has_record_value boolean, content_rating string, sensitive_content_flags array<string>"


def read_pass(raw: Column) -> Column:
    """A struct of ``PASS`` from a model's raw text, which may stand in a code fence or among words; null if it is not a decision.

    Decisions are KEEP, REVIEW or QUARANTINE in any case; a missing class is uncertain, a missing confidence 0 and a missing record value
    true; confidences are cut to 0 to 1; flags make the rating ADULT, or SENSITIVE if it was SAFE.
    """
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = F.from_json(inner, PASS)
    none = F.array().cast("array<string>")
    flags = F.coalesce(F.array_distinct(F.transform(got["sensitive_content_flags"], lambda f: F.trim(f))), none)
    rating = F.upper(F.trim(F.coalesce(got["content_rating"], F.lit("SAFE"))))
    rating = F.when(F.arrays_overlap(flags, F.array(*map(F.lit, ADULT_FLAGS))), "ADULT").when((F.size(flags) > 0) & (rating == "SAFE"), "SENSITIVE").otherwise(rating)
    decision = F.upper(F.trim(got["decision"]))
    found = F.struct(
        decision.alias("decision"), F.lower(F.trim(F.coalesce(got["classification"], F.lit("uncertain")))).alias("classification"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got["confidence"], F.lit(0.0)))).alias("confidence"),
        F.substring(F.trim(F.coalesce(got["reason"], F.lit(""))), 1, 1000).alias("reason"), F.coalesce(got["preservation_flags"], none).alias("preservation_flags"), F.coalesce(got["has_record_value"], F.lit(True)).alias("has_record_value"),
        rating.alias("content_rating"), flags.alias("sensitive_content_flags"),
    )
    return F.when(decision.isin("KEEP", "REVIEW", "QUARANTINE"), found)


def is_auto_candidate(found: Column) -> Column:
    """Whether a pass alone would move a photo without a human."""
    sure = (found["decision"] == "QUARANTINE") & found["classification"].isin(*AUTO_CLASSES) & (found["confidence"] >= AUTO_CONFIDENCE)
    return F.coalesce(sure & (F.size(found["preservation_flags"]) == 0) & ~found["has_record_value"], F.lit(False))


def is_verified(first: Column, second: Column) -> Column:
    """Whether both passes would, for the same class."""
    return is_auto_candidate(first) & is_auto_candidate(second) & F.coalesce(first["classification"] == second["classification"], F.lit(False))


def decide_passes(photos: DataFrame, answers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(project_id, photo_id, status, decision, classification, confidence, content_rating) of photos by their answers (project_id,
    photo_id, first, second: raw texts).

    Duplicates go to review and videos stay, whatever the answers; an unreadable first answer is analysis_failed; sensitive content
    goes to review; a first pass that would move the photo needs a second one that agrees, else it goes to review; otherwise the
    first decision counts. Only KEEP is kept.
    """
    key = ["project_id", "photo_id"]
    rows = photos.select("project_id", F.col("id").alias("photo_id"), F.lower("mime_type").startswith("video/").alias("is_video"))
    rows = rows.join(duplicates.select("project_id", F.col("id").alias("photo_id"), F.lit(True).alias("is_duplicate")), key, "left").join(answers, key)
    rows = rows.select(*key, F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"), F.coalesce("is_video", F.lit(False)).alias("is_video"), read_pass(F.col("first")).alias("a"), read_pass(F.col("second")).alias("b"))
    a, b = F.col("a"), F.col("b")
    judged = F.when(F.size(a["sensitive_content_flags"]) > 0, "REVIEW").when(is_auto_candidate(a) & ~is_verified(a, b), "REVIEW").otherwise(a["decision"])
    bad = a.isNull()
    pick = lambda duplicate, video, failed, judged: F.when(F.col("is_duplicate"), duplicate).when(F.col("is_video"), video).when(bad, failed).otherwise(judged)
    decision = pick(F.lit("REVIEW"), F.lit("KEEP"), F.lit("REVIEW"), judged)
    status = pick(F.lit("review"), F.lit("kept"), F.lit("analysis_failed"), F.when(judged == "KEEP", "kept").otherwise("review"))
    return rows.select(
        *key, status.alias("status"), decision.alias("decision"), pick(F.lit("suspected_duplicate"), F.lit("video_out_of_scope"), F.lit("uncertain"), a["classification"]).alias("classification"),
        pick(F.lit(1.0), F.lit(1.0), F.lit(0.0), a["confidence"]).alias("confidence"), pick(F.lit("SAFE"), F.lit("SAFE"), F.lit("SAFE"), a["content_rating"]).alias("content_rating"),
    )


def review_candidates(photos: DataFrame, items: DataFrame) -> DataFrame:
    """Active photos without an item, in order of their ids within the project."""
    left = photos.where(active()).select("project_id", "id").join(items.select("project_id", F.col("photo_id").alias("id")), ["project_id", "id"], "left_anti")
    return running_counts(left, ["project_id"], [F.col("id")], F.lit(True)).select("project_id", "id", (F.col("before") + 1).cast("int").alias("place"))


def next_candidates(photos: DataFrame, items: DataFrame, model: str, prompt: str, limit: int) -> DataFrame:
    """The next ``limit`` active photos of each project to judge: without an item, or with one of another model or prompt version
    (model_name, prompt_version); those queued again first, then by id."""
    known = items.select("project_id", F.col("photo_id").alias("id"), F.col("status").alias("item_status"), "model_name", "prompt_version")
    rows = photos.where(active()).select("project_id", "id").join(known, ["project_id", "id"], "left")
    old = F.col("item_status").isNull() | (F.col("model_name") != model) | (F.col("prompt_version") != prompt)
    order = Window.partitionBy("project_id").orderBy(F.when(F.col("item_status") == "analysis_retry_queued", 0).otherwise(1), "id")
    return rows.where(old).select("project_id", "id", F.row_number().over(order).alias("place")).where(F.col("place") <= limit)


def current_class() -> Column:
    name = F.col("classification")
    for old, new in ALIASES.items():
        name = F.when(F.col("classification") == old, new).otherwise(name)
    return name


def class_counts(items: DataFrame, statuses: list[str], labelled: bool | None = None) -> DataFrame:
    """Items that aren't videos by class, old names folded into the new; optionally only labelled or unlabelled ones."""
    found = items.where(F.col("status").isin(statuses) & ~F.col("is_video"))
    if labelled is not None:
        found = found.where(F.col("human_label").isNotNull() == labelled)
    return found.groupBy("project_id", current_class().alias("classification")).agg(F.count("*").alias("count"))


def item_page(items: DataFrame, classes: list[str], page: int, size: int) -> DataFrame:
    """A page of each project's items of some classes (aliases count both ways), newest first, with the total."""
    names = {ALIASES.get(c, c) for c in classes}
    found = items.where(current_class().isin(sorted(names)))
    totals = found.groupBy("project_id").agg(F.count("*").alias("total"))
    ranked = found.select("project_id", "id", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))).alias("rank")).where(F.col("rank") <= page * size)
    return ranked.where(F.col("rank") > (page - 1) * size).join(totals, "project_id")


def calibration(items: DataFrame) -> DataFrame:
    """Predicted against human labels for each project and for each of its classes (class null: the whole project).

    Predicted trash is what both passes (structs of ``PASS``: first, second; second null: none) would move without a human, for the
    same class. Precision, recall and false-positive rate are null where nothing is to be divided; a project is ready with 300
    labelled items, 100 of each label and no false positive.
    """
    human = F.col("human_label") == "TRASH"
    labelled = items.where("human_label IS NOT NULL").select("project_id", "classification", is_verified(F.col("first"), F.col("second")).alias("p"), human.alias("h"))
    sums = labelled.groupingSets([["project_id"], ["project_id", "classification"]], "project_id", "classification").agg(
        F.count_if(F.col("p") & F.col("h")).alias("tp"), F.count_if(F.col("p") & ~F.col("h")).alias("fp"), F.count_if(~F.col("p") & ~F.col("h")).alias("tn"), F.count_if(~F.col("p") & F.col("h")).alias("fn")
    )
    share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    ready = (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") >= 300) & (F.col("tp") + F.col("fn") >= 100) & (F.col("tn") + F.col("fp") >= 100) & (F.col("fp") == 0)
    return sums.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("fp", "tn").alias("fpr"), ready.alias("ready"))


def deletion_reconcile(items: DataFrame, inventory: DataFrame, projects: DataFrame) -> DataFrame:
    """Items that wait for deletion: confirmed if their file is gone, remaining if not, failed if the project's root is away."""
    waiting = items.where(F.col("status").isin("delete_queued", "quarantined")).select("project_id", "photo_id")
    there = inventory.select("project_id", F.col("id").alias("photo_id"), F.lit(True).alias("there"))
    roots = projects.select(F.col("id").alias("project_id"), "available")
    found = waiting.join(there, ["project_id", "photo_id"], "left").join(roots, "project_id", "left")
    state = F.when(~F.coalesce("available", F.lit(False)), "failed").when(F.col("there"), "remaining").otherwise("confirmed")
    return found.select("project_id", "photo_id", state.alias("state"))


#: States of an item, and those from which an action may start.
STATES = (
    "review", "analysis_failed", "analysis_retry_queued", "moving", "move_failed", "queue_failed", "kept", "delete_queued", "quarantined", "restoring", "restore_conflict", "restore_failed", "restored", "deleted_confirmed", "other",
)
KEEPABLE = ("review", "analysis_failed", "move_failed", "queue_failed", "restored")
RESTORABLE = ("quarantined", "restoring", "restore_conflict", "restore_failed")
#: What was seen of the files when an action ran, and what holds if a table of actions doesn't say.
FACTS = {"file_present": True, "hash_matches": True, "queue_writable": True, "claimed": False, "stored_present": True, "stored_matches": True}
#: The facts that an action looks at; an action with these values is a kind, and other actions are of the kinds without facts.
LOOKS_AT = {"delete": ("file_present", "hash_matches", "queue_writable"), "undo": ("file_present", "claimed"), "restore": ("file_present", "hash_matches", "stored_present", "stored_matches"), "keep": (), "retry": (), "label_keep": (), "label_trash": (), "": ()}
KINDS = tuple((action, dict(zip(names, values, strict=True))) for action, names in LOOKS_AT.items() for values in product((False, True), repeat=len(names)))
#: Actions of an item that are folded at once.
ACTION_RUN = 256
_DONE, _UNCHANGED, _CONFLICT, _INVALID, _NOT_QUEUED, _OCCUPIED, _MISSING = range(7)
_OUTCOMES = ("done", "unchanged", "conflict", "invalid", "invalid", "conflict", "invalid")
_ITEM = ["project_id", "photo_id"]


def review_actions(items: DataFrame, actions: DataFrame, photos: DataFrame) -> dict[str, DataFrame]:
    """What actions (project_id, photo_id, seq, action; ``FACTS`` if known) make of review items and their photos, in the order of seq.

    ``keep`` an item (from ``KEEPABLE``, if its photo isn't quarantined or deleted), ``delete`` (from ``DELETABLE``: the item is
    delete_queued and the photo quarantined, its status before kept in previous_photo_status unless there is one), ``undo`` (from
    delete_queued) and ``restore`` (from ``RESTORABLE``; both make the item restored and the photo what it was, or indexed, also for the
    next deletion if the photo has no row or status), ``retry`` (from analysis_failed, with the answer reset), ``label_keep`` and
    ``label_trash``. A changed or missing file, a queue that can't be written, an entry already
    claimed and an occupied path are conflicts or invalid, and the last three states are kept as queue_failed, restore_conflict or
    restore_failed. An item that already is where an action leads stays unchanged.

    ``results``: (…, seq, action, outcome: done, unchanged, conflict, invalid or not_found) of every action. ``items``: (…, status, decision,
    human_label, previous_photo_status, answer_reset). ``photos``: (project_id, id, status, deleted). Unknown actions are invalid. Items
    are unique by project and photo, and seq within an item.

    Actions are functions of a finite state. Up to ``ACTION_RUN`` on one item are folded in order; of an item with more, runs of actions
    become functions from state to state, which are composed run by run, level by level, so no task ever gets all actions of an item.
    What each of the ``KINDS`` of actions makes of each state is worked out once for items with equal flags, not for every action.
    """
    known = items.columns
    own = items.select(
        *_ITEM, "status", *(F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in ("decision", "human_label", "previous_photo_status")),
        (F.col("quarantine_path").isNotNull() if "quarantine_path" in known else F.lit(True)).alias("has_path"),
    ).join(photos.select("project_id", F.col("id").alias("photo_id"), F.col("status").alias("photo_status"), F.col("deleted_at").isNotNull().alias("was_deleted")), _ITEM, "left")
    is_gone = lambda c: F.coalesce(F.col(c) == "quarantined", F.lit(False))
    flags = F.struct((is_gone("photo_status") | F.coalesce("was_deleted", F.lit(False))).alias("gone"), is_gone("photo_status").alias("first"), is_gone("previous_photo_status").alias("prev"), F.col("previous_photo_status").isNull().alias("no_prev"), F.col("photo_status").isNull().alias("no_first"), "has_path")
    own = written(own.withColumn("flags", flags).withColumn("state", 9 * _code(F.col("status"))))
    facts = F.struct(*((F.coalesce(F.col(c).cast("boolean"), F.lit(default)) if c in actions.columns else F.lit(default)).alias(c) for c, default in FACTS.items()))
    asked = actions.select(*_ITEM, "seq", F.coalesce("action", F.lit("")).alias("action"), facts.alias("facts")).join(own.select(*_ITEM, "flags"), _ITEM, "left")
    placed = running_counts(asked.where("flags IS NOT NULL"), _ITEM, [F.col("seq")], F.lit(True)).withColumn("run", F.floor(F.col("before") / ACTION_RUN).cast("bigint"))
    runs = written(placed.groupBy(*_ITEM, "run").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "facts", "flags"))).alias("acts")))

    long = runs.join(runs.where("run > 0").select(*_ITEM).distinct(), _ITEM, "left_semi").select(*_ITEM, F.col("run").alias("n"), F.transform("acts", lambda a: _kind(a["action"], a["facts"])).alias("kinds"), F.get("acts", F.lit(0))["flags"].alias("flags"))
    moves = own.select("flags").distinct().select("flags", _moves(F.col("flags")).alias("moves"))
    begun = _starts(long.join(F.broadcast(moves), "flags").select(*_ITEM, "n", _function(F.col("kinds"), F.col("moves")).alias("f")), own)
    starts = runs.join(begun, (runs["project_id"] == begun["b_project"]) & (runs["photo_id"] == begun["b_photo"]) & (runs["run"] == begun["n"]), "left").select(*_ITEM, "run", "acts", "start")
    step = lambda acc, a: let(_step(acc["state"], a), lambda r: F.struct(r["next"].alias("state"), F.concat(acc["found"], F.array(F.struct(a["seq"].alias("seq"), a["action"].alias("action"), r["outcome"].alias("code"), r["next"].alias("after")))).alias("found")))
    folded = starts.join(own.select(*_ITEM, "state"), _ITEM).withColumn("start", F.coalesce("start", "state"))
    none = F.array().cast("array<struct<seq:bigint,action:string,code:int,after:int>>")
    told = written(folded.select(*_ITEM, F.inline(F.aggregate("acts", F.struct(F.col("start").alias("state"), none.alias("found")), step)["found"])))

    names = F.array(*map(F.lit, _OUTCOMES))
    results = told.select(*_ITEM, "seq", "action", F.get(names, "code").alias("outcome"))
    results = results.union(asked.where("flags IS NULL").select(*_ITEM, F.col("seq").cast("bigint"), "action", F.lit("not_found")))
    good = F.col("code").isin(_DONE, _UNCHANGED)
    label = F.when(good & F.col("action").isin("keep", "restore") | (F.col("code") == _DONE) & F.col("action").isin("undo", "label_keep"), "KEEP").when(good & (F.col("action") == "delete") | (F.col("code") == _DONE) & (F.col("action") == "label_trash"), "TRASH")
    decision = F.when(F.col("code") == _DONE, F.when(F.col("action").isin("keep", "undo"), "KEEP").when(F.col("action") == "delete", "QUARANTINE").when(F.col("action") == "retry", "REVIEW"))
    ends = told.groupBy(*_ITEM).agg(
        F.max_by("after", "seq").alias("end"), F.max_by(label, F.when(label.isNotNull(), F.col("seq"))).alias("new_label"), F.max_by(decision, F.when(decision.isNotNull(), F.col("seq"))).alias("new_decision"),
        F.bool_or((F.col("code") == _DONE) & (F.col("action") == "retry")).alias("reset"),
    )
    after = own.join(ends, _ITEM, "left").withColumn("end", F.coalesce("end", "state"))
    status, photo, prev = _parts(F.col("end"))
    shown = F.when(status == len(STATES) - 1, F.col("status")).otherwise(F.get(F.array(*map(F.lit, STATES)), status))
    previous = F.when(prev == 1, F.col("photo_status")).when(prev == 2, "indexed").otherwise(F.col("previous_photo_status"))
    after_photo = F.when(photo == 0, F.col("photo_status")).when(photo == 1, "quarantined").otherwise(F.coalesce(previous, F.lit("indexed")))
    made = after.select(
        *_ITEM, shown.alias("status"), F.coalesce("new_decision", "decision").alias("decision"), F.coalesce("new_label", "human_label").alias("human_label"), previous.alias("previous_photo_status"), F.coalesce("reset", F.lit(False)).alias("answer_reset"),
        F.when(photo != 0, after_photo).alias("moved"), F.when(photo != 0, photo == 1).alias("moved_gone"),
    )
    moved = made.where("moved IS NOT NULL").select("project_id", F.col("photo_id").alias("id"), "moved", "moved_gone")
    kept = photos.join(moved, ["project_id", "id"], "left").select("project_id", "id", F.coalesce("moved", "status").alias("status"), F.coalesce("moved_gone", F.col("deleted_at").isNotNull()).alias("deleted"))
    return {"results": results, "items": made.drop("moved", "moved_gone"), "photos": kept}


def _code(status: Column) -> Column:
    found = F.array_position(F.array(*map(F.lit, STATES)), F.coalesce(status, F.lit("other"))).cast("int") - 1
    return F.when(found < 0, len(STATES) - 1).otherwise(found)


def _parts(state: Column) -> tuple[Column, Column, Column]:
    """Status; photo: 0 as it was, 1 gone, 2 back; status before the deletion: 0 as given, 1 the photo's first, 2 indexed."""
    return F.floor(state / 9).cast("int"), (F.floor(state / 3) % 3).cast("int"), (state % 3).cast("int")


def _step(state: Column, a: Column) -> Column:
    """struct(next, outcome) of one action on one state."""
    status, photo, prev = _parts(state)
    facts, flags, action = a["facts"], a["flags"], a["action"]
    at = lambda *names: status.isin(*(STATES.index(n) for n in names))
    back = F.when(prev == 0, flags["prev"]).when(prev == 1, flags["first"]).otherwise(F.lit(False))
    gone = F.when(photo == 1, F.lit(True)).when(photo == 0, flags["gone"]).otherwise(back)
    rules = {
        "keep": F.when(at("kept"), _UNCHANGED).when(~at(*KEEPABLE) | gone, _CONFLICT),
        "delete": F.when(at("delete_queued", "quarantined"), _UNCHANGED).when(~at(*DELETABLE), _CONFLICT).when(~facts["file_present"], _INVALID).when(~facts["hash_matches"], _CONFLICT).when(~facts["queue_writable"], _NOT_QUEUED),
        "undo": F.when(~at("delete_queued") | ~facts["file_present"] | facts["claimed"], _CONFLICT),
        "restore": F.when(at("restored"), _UNCHANGED).when(~at(*RESTORABLE), _CONFLICT).when(~flags["has_path"], _INVALID).when(facts["file_present"] & ~facts["stored_present"], F.when(facts["hash_matches"], _DONE).otherwise(_CONFLICT))
        .when(facts["file_present"], _OCCUPIED).when(~facts["stored_present"], _MISSING).when(~facts["stored_matches"], _CONFLICT),
        "retry": F.when(at("analysis_retry_queued"), _UNCHANGED).when(~at("analysis_failed") | gone, _CONFLICT),
        "label_keep": F.lit(None).cast("int"),
        "label_trash": F.lit(None).cast("int"),
    }
    outcome = reduce(lambda rest, x: F.when(action == x[0], F.coalesce(x[1], F.lit(_DONE))).otherwise(rest), rules.items(), F.lit(_INVALID))

    def after(code: Column) -> Column:
        target = {"keep": "kept", "delete": "delete_queued", "undo": "restored", "restore": "restored", "retry": "analysis_retry_queued"}
        done = reduce(lambda rest, x: F.when(action == x[0], STATES.index(x[1])).otherwise(rest), target.items(), status)
        new = F.when(code == _DONE, done).when(code == _NOT_QUEUED, STATES.index("queue_failed")).when(code == _OCCUPIED, STATES.index("restore_conflict")).when(code == _MISSING, STATES.index("restore_failed")).otherwise(status)
        deleted, returned = (code == _DONE) & (action == "delete"), (code == _DONE) & action.isin("undo", "restore")
        new_photo = F.when(deleted, 1).when(returned, 2).otherwise(photo)
        # Without a first status nothing is kept yet, so that a later deletion can keep the one that a restored photo has.
        new_prev = F.when(deleted & (prev == 0) & flags["no_prev"], F.when(photo == 2, 2).when(flags["no_first"], 0).otherwise(1)).otherwise(prev)
        return F.struct((9 * new + 3 * new_photo + new_prev).cast("int").alias("next"), code.cast("int").alias("outcome"))

    return let(outcome, after)


def _kind(action: Column, facts: Column) -> Column:
    """The place of an action in ``KINDS``."""
    first = {name: next(i for i, k in enumerate(KINDS) if k[0] == name) for name in LOOKS_AT}
    place = lambda name: reduce(lambda n, fact: 2 * n + facts[fact].cast("int"), LOOKS_AT[name], F.lit(0)) + first[name]
    return reduce(lambda rest, name: F.when(action == name, place(name)).otherwise(rest), LOOKS_AT, F.lit(first[""]))


def _moves(flags: Column) -> Column:
    """For each of ``KINDS`` the state that each state becomes."""
    every = F.sequence(F.lit(0), F.lit(9 * len(STATES) - 1))
    kinds = F.array(*(F.struct(F.lit(action).alias("action"), F.struct(*(F.lit(seen.get(c, default)).alias(c) for c, default in FACTS.items())).alias("facts")) for action, seen in KINDS))
    return F.transform(kinds, lambda k: F.transform(every, lambda s: _step(s, {"action": k["action"], "facts": k["facts"], "flags": flags})["next"]))


def _function(kinds: Column, moves: Column) -> Column:
    """The state that each state becomes by a run of actions."""
    every = F.sequence(F.lit(0), F.lit(9 * len(STATES) - 1))
    return F.aggregate(kinds, every, lambda f, k: let(F.get(moves, k), lambda move: F.transform(f, lambda s: F.get(move, s))))


def _starts(functions: DataFrame, own: DataFrame) -> DataFrame:
    """(b_project, b_photo, n, start): the state before the n-th run of each item, from the functions (project_id, photo_id, n, f) of its runs."""
    functions = written(functions)
    if functions.where("n > 0").isEmpty():
        first = functions.join(own.select(*_ITEM, "state"), _ITEM)
        return first.select(F.col("project_id").alias("b_project"), F.col("photo_id").alias("b_photo"), "n", F.col("state").alias("start"))
    groups = written(functions.groupBy(*_ITEM, F.floor(F.col("n") / ACTION_RUN).cast("bigint").alias("group")).agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("parts")))
    every = F.sequence(F.lit(0), F.lit(9 * len(STATES) - 1))
    whole = F.aggregate("parts", every, lambda f, p: F.transform(f, lambda s: F.get(p["f"], s)))
    above = _starts(groups.select(*_ITEM, F.col("group").alias("n"), whole.alias("f")), own).withColumnRenamed("n", "group")
    met = groups.join(above, (groups["project_id"] == above["b_project"]) & (groups["photo_id"] == above["b_photo"]) & (groups["group"] == above["group"]))
    none = F.array().cast("array<struct<n:bigint,start:int>>")
    step = lambda acc, p: F.struct(F.get(p["f"], acc["state"]).alias("state"), F.concat(acc["found"], F.array(F.struct(p["n"].alias("n"), acc["state"].alias("start")))).alias("found"))
    return met.select("b_project", "b_photo", F.inline(F.aggregate("parts", F.struct(F.col("start").alias("state"), none.alias("found")), step)["found"]))


#: States from which deletion can be asked for; items that wait for it or are moved stay as they are.
DELETABLE = ("review", "moving", "move_failed", "queue_failed", "analysis_failed", "kept", "restored")


def apply_labels(items: DataFrame, actions: DataFrame, photos: DataFrame) -> dict[str, DataFrame]:
    """Items and photos after label and delete actions (project_id, photo_id, action, label, file_hash, seq); the last of a photo counts.

    ``label`` sets human_label. ``delete`` of an item in ``DELETABLE`` whose file still has the item's content makes it delete_queued and
    its photo quarantined, and labels it TRASH; a changed file (hash) is a conflict, as is any other state but delete_queued and
    quarantined. ``outcome``: done, unchanged, conflict or not_found for each photo.
    """
    key = ["project_id", "photo_id"]
    last = actions.groupBy(*key).agg(F.max_by(F.struct("action", "label", "file_hash"), "seq").alias("x")).select(*key, "x.action", "x.label", F.col("x.file_hash").alias("now_hash"))
    rows = items.select(*key, "status", "human_label", "content_hash").join(last, key, "full")
    changed = F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("now_hash"))
    delete = F.col("action") == "delete"
    outcome = (
        F.when(F.col("action").isNull(), None).when(F.col("status").isNull(), "not_found").when(F.col("action") == "label", "done").when(F.col("status").isin("delete_queued", "quarantined"), "unchanged")
        .when(~F.col("status").isin(*DELETABLE) | changed, "conflict").otherwise("done")
    )
    rows = rows.withColumn("outcome", outcome)
    queued = F.coalesce(delete & (F.col("outcome") == "done"), F.lit(False))
    trash = F.coalesce(delete & F.col("outcome").isin("done", "unchanged"), F.lit(False))
    label = F.when(F.col("action") == "label", F.col("label")).when(trash, "TRASH").otherwise(F.col("human_label"))
    after = rows.where("status IS NOT NULL").select(*key, F.when(queued, "delete_queued").otherwise(F.col("status")).alias("status"), label.alias("human_label"))
    gone = rows.where(queued).select("project_id", F.col("photo_id").alias("id"), F.lit(True).alias("gone"))
    photos = photos.select("project_id", "id", "status").join(gone, ["project_id", "id"], "left").select("project_id", "id", F.when(F.col("gone"), "quarantined").otherwise(F.col("status")).alias("status"))
    return {"items": after, "photos": photos, "outcome": rows.where("outcome IS NOT NULL").select(*key, "action", "outcome")}


def batch_delete(requests: DataFrame, photos: DataFrame) -> DataFrame:
    """Distinct requested photos and whether they can be deleted (known and not deleted yet)."""
    live = photos.where("deleted_at IS NULL").select("project_id", "id", F.lit(True).alias("found"))
    return requests.select("project_id", "id").distinct().join(live, ["project_id", "id"], "left").select("project_id", "id", F.coalesce("found", F.lit(False)).alias("found"))


def job_rollup(jobs: DataFrame, photos: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row for each project: jobs by status, distinct photos analysed and active photos."""
    statuses = ["failed", "paused", "queued", "running", "success"]
    by = jobs.groupBy("project_id").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)
    done = analysis.select("project_id", "photo_id").distinct().groupBy("project_id").agg(F.count("*").alias("analysed"))
    total = photos.where(active()).groupBy("project_id").agg(F.count("*").alias("photos"))
    return total.join(by, "project_id", "left").join(done, "project_id", "left").na.fill(0)


def embedding_rollup(states: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row for each project with analyses: ready, failed and stale embeddings by (project_id, photo_id, state), and missing ones: the
    photos analysed without those three."""
    counts = states.groupBy("project_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("ready", "failed", "stale")))
    done = analysis.select("project_id", "photo_id").distinct().groupBy("project_id").agg(F.count("*").alias("analysed"))
    rows = done.join(counts, "project_id", "left").na.fill(0)
    return rows.withColumn("missing", F.greatest(F.lit(0), F.col("analysed") - F.col("ready") - F.col("failed") - F.col("stale")))


def analysis_candidates(photos: DataFrame, jobs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Active photos with neither an active job nor an analysis."""
    busy = jobs.where(F.col("status").isin(*ACTIVE_JOBS)).select("project_id", F.col("photo_id").alias("id"))
    done = analysis.select("project_id", F.col("photo_id").alias("id"))
    return photos.where(active()).select("project_id", "id").join(busy, ["project_id", "id"], "left_anti").join(done, ["project_id", "id"], "left_anti")


def reanalysis_candidates(photos: DataFrame, jobs: DataFrame, analysis: DataFrame, scope: str, selected: DataFrame | None = None) -> DataFrame:
    """Active photos without an active job to analyse again: ``completed`` (analysed), ``failed`` (a failed job), ``selected`` (project_id, id)
    or ``all``."""
    key = ["project_id", "id"]
    as_photo = lambda rows: rows.select("project_id", F.col("photo_id").alias("id"))
    free = photos.where(active()).select(*key).join(as_photo(jobs.where(F.col("status").isin(*ACTIVE_JOBS))), key, "left_anti")
    limits = {"completed": lambda: as_photo(analysis), "failed": lambda: as_photo(jobs.where("status = 'failed'")), "selected": lambda: selected.select(*key)}
    return free if scope == "all" else free.join(limits[scope](), key, "left_semi")


def enqueue(requests: DataFrame, jobs: DataFrame, job_type: str) -> DataFrame:
    """Distinct requested photos: created, or skipped if an active job of that type has them."""
    busy = jobs.where(F.col("status").isin(*ACTIVE_JOBS) & (F.col("job_type") == job_type)).select("project_id", "photo_id", F.lit(True).alias("busy")).distinct()
    found = requests.select("project_id", "photo_id").distinct().join(busy, ["project_id", "photo_id"], "left")
    return found.select("project_id", "photo_id", F.when(F.col("busy"), "skipped").otherwise("created").alias("outcome"))


def failures(jobs: DataFrame) -> DataFrame:
    """Distinct error messages of a project's failed jobs, with how often and when last."""
    failed = jobs.where("status = 'failed' AND error_message IS NOT NULL")
    return failed.groupBy("project_id", "job_type", "error_message").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


#: What a task's payloads say of its files and errors, oldest first.
PAYLOAD = "recent_files array<struct<path: string, status: string, message: string, timestamp: string>>, recent_errors array<string>"


def task_failures(tasks: DataFrame) -> DataFrame:
    """(project_id, task_id, place, source, message, path, status, timestamp): the failures of each task (project_id, id, error_message,
    finished_at, result_payload, progress_payload: JSON), in order and each once.

    First the task's own error; then, of the result's payload and then of the progress', the files, newest first, that failed or have
    a message, and the errors, newest first. Blank messages do not count. Equal source, message, path, status and time are one.
    """
    none = F.array().cast("array<struct<source:string,message:string,path:string,status:string,timestamp:string>>")
    row = lambda source, message, path, status, timestamp: F.struct(F.lit(source).alias("source"), message.alias("message"), path.alias("path"), status.alias("status"), timestamp.cast("string").alias("timestamp"))
    null = F.lit(None).cast("string")

    def of_file(entry: Column) -> Column:
        status, message = F.lower(F.trim(F.coalesce(entry["status"], F.lit("")))), F.trim(F.coalesce(entry["message"], F.lit("")))
        return F.when(status.isin("failed", "error") | (message != ""), row("file_progress", F.when(message != "", message).otherwise(status), F.nullif(entry["path"], F.lit("")), F.nullif(status, F.lit("")), entry["timestamp"]))

    parts = [F.when(F.trim("error_message") != "", F.array(row("task_error", F.trim("error_message"), null, F.lit("failed"), F.col("finished_at")))).otherwise(none)]
    for name in ("result_payload", "progress_payload"):
        got = F.from_json(name, PAYLOAD)
        parts.append(F.coalesce(F.array_compact(F.transform(F.reverse(got["recent_files"]), of_file)), none))
        errors = F.filter(F.transform(F.reverse(got["recent_errors"]), lambda e: F.trim(e)), lambda e: e != "")
        parts.append(F.coalesce(F.transform(errors, lambda e: row("recent_error", e, null, F.lit("failed"), null)), none))
    every = F.array_distinct(F.concat(*parts))
    return tasks.select("project_id", F.col("id").alias("task_id"), F.posexplode(every).alias("place", "f")).select("project_id", "task_id", "place", "f.*")


def failure_summary(found: DataFrame) -> DataFrame:
    """(project_id, task_id, failures, latest): how many failures a task has, and the first message that is not its own error, else that."""
    order = F.struct((F.col("source") == "task_error").cast("int"), "place")
    return found.groupBy("project_id", "task_id").agg(F.count("*").alias("failures"), F.min_by("message", order).alias("latest"))


def job_page(jobs: DataFrame, photos: DataFrame, statuses: list[str], page: int, size: int, types: list[str] | None = None) -> DataFrame:
    """A page of each project's jobs of some statuses (and types), newest first, with the total; file names are joined to the page only."""
    found = jobs.where(F.col("status").isin(statuses))
    if types is not None:
        found = found.where(F.col("job_type").isin(types))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id")))
    cut = found.select("project_id", "id", "photo_id", "status", rank.alias("rank")).where((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))
    totals = found.groupBy("project_id").agg(F.count("*").alias("total"))
    return cut.join(totals, "project_id").join(photos.select("project_id", F.col("id").alias("photo_id"), "file_name"), ["project_id", "photo_id"], "left")
