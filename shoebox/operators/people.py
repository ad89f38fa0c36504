"""Prototypes, matching, clustering and corrections of face identities, for all projects at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators.browse import HUMAN, person_counters
from shoebox.operators.order import running_counts
from shoebox.operators.vectors import BLOCK, _unit, element_mean
from shoebox.sources.files import written

ACCEPT, REVIEW, CLUSTER, MIN_QUALITY, MAX_SAMPLES, SAME_BOX = 0.62, 0.48, 0.50, 0.70, 200, 0.70
#: Different old boxes of a photo from which on boxes meet in cells.
CROWD = 32
#: Vectors of a block of which all pairs with another block are compared in one task.
PAIR_BLOCK = 512


def is_human() -> Column:
    return F.col("assignment_status").isin(*HUMAN)


def model_space() -> Column:
    """What vectors must share to be compared: model, version and dimension."""
    return F.concat_ws("|", F.col("model"), F.col("version"), F.size("embedding").cast("string"))


def newest_embeddings(faces: DataFrame) -> DataFrame:
    """The newest usable row of each face: embedded, with a vector; by embedded_at, then embedding_id."""
    usable = faces.where((F.col("status") == "embedded") & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return usable.groupBy("project_id", "face_id").agg(F.max_by(F.struct(*(c for c in faces.columns if c not in ("project_id", "face_id"))), F.struct(F.col("embedded_at").isNotNull(), "embedded_at", "embedding_id")).alias("r")).select("project_id", "face_id", "r.*")


def samples(assignments: DataFrame, faces: DataFrame, min_quality: float | None = MIN_QUALITY, limit: int = MAX_SAMPLES, cut_first: bool = False) -> DataFrame:
    """The best ``limit`` positive human samples of each person: quality (null last), then the latest assignment (updated_at if
    there is such a column, then id). Faces without a vector are left out.

    If faces have a model, only samples of the model, version and dimension of the person's newest one (embedded_at, null last, then
    face_id) count; with ``cut_first`` the limit is applied before that.
    """
    modelled = "model" in faces.columns
    more = [model_space().alias("space"), "embedded_at"] if modelled else []
    good = assignments.where(is_human() & F.col("is_positive")).join(faces.where("embedding IS NOT NULL").select("project_id", "face_id", "quality", F.col("embedding").alias("vector"), *more), ["project_id", "face_id"])
    if min_quality is not None:
        good = good.where(F.col("quality").isNull() | (F.col("quality") >= min_quality))
    latest = [F.desc_nulls_last("updated_at")] if "updated_at" in assignments.columns else []
    rank = F.row_number().over(Window.partitionBy("project_id", "person_id").orderBy(F.desc(F.coalesce("quality", F.lit(-1.0))), *latest, F.desc("id")))
    best = lambda rows: rows.withColumn("rank", rank).where(F.col("rank") <= limit)
    if not modelled:
        return best(good)
    rows = best(good).drop("rank") if cut_first else good
    newest = rows.groupBy("project_id", "person_id").agg(F.max_by("space", F.struct(F.col("embedded_at").isNotNull(), "embedded_at", "face_id")).alias("space"))
    return best(rows.join(newest, ["project_id", "person_id", "space"]))


def prototypes(assignments: DataFrame, faces: DataFrame, min_quality: float = MIN_QUALITY, limit: int = MAX_SAMPLES) -> DataFrame:
    """(project_id, person_id, vector, sample_count): the element-wise mean of each person's samples; and their space, if faces have a
    model. A person without samples has no row, and so loses an older prototype."""
    keys = ["project_id", "person_id", *(["space"] if "model" in faces.columns else [])]
    return element_mean(samples(assignments, faces, min_quality, limit), keys)


def newest_prototypes(stored: DataFrame, dimension: int) -> DataFrame:
    """The newest stored prototype (updated_at, then id) of each person whose vector has ``dimension`` places."""
    rows = stored.where(F.size("vector") == dimension)
    return rows.groupBy("project_id", "person_id").agg(F.max_by(F.struct("vector", "sample_count"), F.struct(F.col("updated_at").isNotNull(), "updated_at", "id")).alias("r")).select("project_id", "person_id", "r.*")


def search_profiles(assignments: DataFrame, faces: DataFrame, protos: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """A person's prototype, or without one the mean of confirmed samples of any quality; ``source`` says which. With ``persons`` only
    named ones have a profile."""
    rest = element_mean(samples(assignments, faces, None, cut_first=True), ["project_id", "person_id"]).join(protos, ["project_id", "person_id"], "left_anti")
    found = protos.select("project_id", "person_id", "vector", "sample_count", F.lit("prototype").alias("source")).union(rest.select("project_id", "person_id", "vector", "sample_count", F.lit("samples").alias("source")))
    return found if persons is None else found.join(_named(persons), ["project_id", "person_id"], "left_semi")


def _named(persons: DataFrame) -> DataFrame:
    return persons.where("is_named").select("project_id", F.col("id").alias("person_id"))


def pairs_above(protos: DataFrame, faces: DataFrame, least: float) -> DataFrame:
    """(project_id, face_id, person_id, similarity): faces and prototypes of a project at least ``least`` similar, rounded to 6 places.

    Only vectors of equal length meet, and of equal ``space`` if prototypes have one; null vectors are left out. If prototypes
    have a face_id, a face does not meet its own, and the most similar one of a person counts. Prototypes pass in blocks that are
    broadcast, so faces are never shuffled and only similar pairs leave a task.
    """
    protos = protos.where("vector IS NOT NULL")
    blocks = max(1, -(-protos.count() // BLOCK))
    found = None
    for b in range(blocks):
        part = _similar(protos.where(F.pmod(F.xxhash64("project_id", "person_id"), F.lit(blocks)) == b), faces, least)
        found = part if found is None else found.union(part)
    return found.groupBy("project_id", "face_id", "person_id").agg(F.max("similarity").alias("similarity")) if "face_id" in protos.columns else found


def _similar(protos: DataFrame, faces: DataFrame, least: float) -> DataFrame:
    spaced = "space" in protos.columns
    own_face = F.col("face_id") if "face_id" in protos.columns else F.lit(None).cast("bigint")
    space = F.col("space") if spaced else F.size("vector").cast("string")
    rows = protos.select("project_id", space.alias("space"), "person_id", own_face.alias("own"), "vector").orderBy("project_id", "person_id", "own").collect()
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault((r["project_id"], r["space"]), []).append(r)
    known = {key: (np.array([r["person_id"] for r in g]), np.array([-1 if r["own"] is None else r["own"] for r in g]), _unit(np.array([r["vector"] for r in g], float))) for key, g in groups.items()}
    sent = faces.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            project, face, spaces = whole.column(0).to_pylist(), whole.column(1).to_numpy(), whole.column(2).to_pylist()
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(project, spaces, strict=True)):
                if key in sent.value:
                    places.setdefault(key, []).append(i)
            for key, at in places.items():
                people, owners, vectors = sent.value[key]
                scores = np.round(_unit(whole.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)) @ vectors.T, 6)
                here = face[np.array(at)]
                i, j = np.nonzero((scores >= least) & (here[:, None] != owners))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key[0])), pa.array(here[i]), pa.array(people[j]), pa.array(scores[i, j])], ["project_id", "face_id", "person_id", "similarity"])

    good = faces.where("embedding IS NOT NULL AND size(embedding) > 0")
    face_space = model_space() if spaced else F.size("embedding").cast("string")
    source = good.select(F.col("project_id").cast("bigint"), F.col("face_id").cast("bigint"), face_space.alias("space"), F.col("embedding").cast("array<double>"))
    return source.mapInArrow(run, "project_id bigint, face_id bigint, person_id bigint, similarity double")


def match(protos: DataFrame, faces: DataFrame, assignments: DataFrame, barred: DataFrame, accept: float = ACCEPT, review: float = REVIEW, persons: DataFrame | None = None, auto: bool = True) -> DataFrame:
    """(project_id, face_id, person_id, similarity, decision): the best person of each face that no human has assigned, unless
    barred (project_id, face_id, not_person_id); auto_assigned from ``accept`` on if ``auto``, review_pending from ``review`` on.

    With ``persons`` only named ones are candidates. Faces with several embeddings are to be cut to the newest (``newest_embeddings``);
    a prototype's space, if it has one, must be the face's.
    """
    if persons is not None:
        protos = protos.join(_named(persons), ["project_id", "person_id"], "left_semi")
    locked = assignments.where(is_human()).select("project_id", "face_id").distinct()
    free = faces.where("status = 'embedded'").join(locked, ["project_id", "face_id"], "left_anti")
    pairs = pairs_above(protos, free, review)
    allowed = pairs.join(barred.select("project_id", "face_id", F.col("not_person_id").alias("person_id")), ["project_id", "face_id", "person_id"], "left_anti")
    best = allowed.groupBy("project_id", "face_id").agg(F.max(F.struct("similarity", (-F.col("person_id")).alias("p"))).alias("b"))
    return best.select("project_id", "face_id", (-F.col("b.p")).alias("person_id"), "b.similarity", F.when(F.lit(auto) & (F.col("b.similarity") >= accept), "auto_assigned").otherwise("review_pending").alias("decision"))


def generalised_bars(protos: DataFrame, faces: DataFrame, excluded: DataFrame, accept: float = ACCEPT, review: float = REVIEW) -> DataFrame:
    """(project_id, face_id, not_person_id): pairs barred because a face excluded for the person (project_id, face_id, person_id)
    is at least ``accept`` similar to the face, and at least as similar as the person is.

    Only pairs that could become a decision are looked at: a person below ``review`` is never chosen anyway. Excluded faces pass
    like prototypes, so a face meets those of a person inside a task and only its most similar one leaves it.
    """
    space = [model_space().alias("space")] if "model" in faces.columns else []
    good = faces.where((F.col("status") == "embedded") & (F.col("quality") >= MIN_QUALITY)).select("project_id", "face_id", F.col("embedding").cast("array<double>").alias("vector"), *space)
    negatives = excluded.select("project_id", "face_id", "person_id").distinct().join(good, ["project_id", "face_id"])
    alike = pairs_above(negatives, faces, accept).withColumnRenamed("similarity", "alike")
    pairs = pairs_above(protos, faces, review).join(alike, ["project_id", "face_id", "person_id"])
    return pairs.where("alike >= similarity").select("project_id", "face_id", F.col("person_id").alias("not_person_id")).distinct()


def rematch_candidates(faces: DataFrame, assignments: DataFrame, limit: int | None = 1000, scope: str = "unknown", person_id: int | None = None, start=None, end=None) -> DataFrame:
    """Embedded faces that no human has assigned, newest first (embedded_at and detected_at if there are such columns, then id), at most
    ``limit`` for each project; without ``limit`` all of them, and no rank, which only a window over a whole project could number.

    Scopes: ``unknown``, faces without an open assignment or with one that waits for review or comes from a cluster; ``project``, all;
    ``person``, those without an open assignment to ``person_id``; ``time_range``, detected from ``start`` to ``end``.
    """
    key = ["project_id", "face_id"]
    open_ = assignments.where("assignment_status <> 'rejected'")
    free = faces.where("status = 'embedded'").join(assignments.where(is_human()).select(*key).distinct(), key, "left_anti")
    if scope == "unknown":
        source = F.col("assignment_source") == "unknown_cluster" if "assignment_source" in assignments.columns else F.lit(False)
        loose = F.coalesce((F.col("assignment_status") == "review_pending") | source, F.lit(False))
        held = open_.groupBy(*key).agg(F.bool_or(loose).alias("loose")).where("NOT loose")
        free = free.join(held, key, "left_anti")
    elif scope == "person":
        free = free.join(open_.where(F.col("person_id") == person_id).select(*key).distinct(), key, "left_anti")
    elif scope == "time_range":
        free = free.where(F.col("detected_at").between(F.lit(start), F.lit(end)))
    elif scope != "project":
        raise ValueError(f"unknown scope {scope}")
    if limit is None:
        return free.select(*key)
    newest = [F.desc_nulls_last(c) for c in ("embedded_at", "detected_at") if c in faces.columns]
    return free.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(*newest, F.desc("face_id")))).where(F.col("rank") <= limit).select(*key, "rank")


def apply_rematch(assignments: DataFrame, decisions: DataFrame, for_person: bool = False) -> DataFrame:
    """Assignments after decisions: a decided pair takes the decision's status, other open ones of the face are rejected (source
    prototype_rematch), new pairs appear without an id; human ones stay.

    ``for_person``: a rematch for one person leaves other assignments and only puts pairs up for review.
    """
    new = decisions.select("project_id", "face_id", F.col("person_id").alias("d_person"), "decision")
    if for_person:
        new = new.withColumn("decision", F.lit("review_pending"))
    old = assignments.join(new, ["project_id", "face_id"], "left")
    own, others = F.col("person_id") == F.col("d_person"), F.lit(not for_person)
    free = ~is_human() & F.col("d_person").isNotNull()
    status = F.when(free & own, F.col("decision")).when(free & others, "rejected").otherwise(F.col("assignment_status"))
    found = F.lit("targeted_person_rematch" if for_person else "similarity_match")
    before = F.col("assignment_source") if "assignment_source" in assignments.columns else F.lit(None).cast("string")
    source = F.when(free & own, found).when(free & others & (F.col("assignment_status") != "rejected"), "prototype_rematch").otherwise(before)
    kept = old.select("project_id", "face_id", "person_id", "id", status.alias("assignment_status"), source.alias("assignment_source"))
    added = new.withColumnRenamed("d_person", "person_id").join(assignments, ["project_id", "face_id", "person_id"], "left_anti")
    return kept.union(added.select("project_id", "face_id", "person_id", F.lit(None).cast("bigint"), "decision", found))


def rematch_summary(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, faces_considered, matched_faces, auto_assigned, review_pending) of a rematch of the candidates."""
    key = ["project_id", "face_id"]
    made = candidates.select(*key).join(decisions.select(*key, "decision"), key, "left")
    count = lambda name: F.count_if(F.col("decision") == name).alias(name)
    return made.groupBy("project_id").agg(F.count("*").alias("faces_considered"), F.count("decision").alias("matched_faces"), count("auto_assigned"), count("review_pending"))


def cluster_unknown(faces: DataFrame, assignments: DataFrame, limit: int | None = None, threshold: float = CLUSTER) -> DataFrame:
    """(project_id, face_id, cluster): faces without an open assignment (with ``limit``, the first ids of each project), each joined in
    id order to the cluster whose running mean is most similar (from ``threshold`` on; the earliest of equals), else a new one.

    The result depends on the order, so a project is one sorted run of a task. Faces pass in batches, and only the sums and counts of
    clusters are kept between them, so a project may have any number of faces.
    """
    taken = assignments.where("assignment_status <> 'rejected'").select("project_id", "face_id").distinct()
    free = faces.where("status = 'embedded'").select(F.col("project_id").cast("bigint"), F.col("face_id").cast("bigint"), F.col("embedding").cast("array<double>")).join(taken, ["project_id", "face_id"], "left_anti")
    if limit is not None:
        free = free.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("face_id"))).where(F.col("rank") <= limit).drop("rank")

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, n = None, 0
        sums = means = counts = np.zeros(0)
        for whole in batches:
            out = []
            for own, vector in zip(whole.column(0).to_pylist(), whole.column(2).to_pylist(), strict=True):
                vector = np.array(vector)
                if own != project:
                    project, n = own, 0
                    sums, means, counts = np.zeros((64, len(vector))), np.zeros((64, len(vector))), np.zeros(64)
                scores = means[:n] @ _unit(vector[None])[0]
                best = int(scores.argmax()) if n else -1
                if best < 0 or scores[best] < threshold:
                    best, n = n, n + 1
                    if n > len(sums):
                        sums, means, counts = (np.concatenate([x, np.zeros_like(x)]) for x in (sums, means, counts))
                    sums[best], counts[best] = 0, 0
                sums[best] += vector
                counts[best] += 1
                means[best] = _unit((sums[best] / counts[best])[None])[0]
                out.append(best)
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(out, pa.int64())], ["project_id", "face_id", "cluster"])

    run = free.select("project_id", "face_id", "embedding").repartition("project_id").sortWithinPartitions("project_id", "face_id")
    return run.mapInArrow(leaders, "project_id bigint, face_id bigint, cluster bigint")


def cluster_rounds(faces: DataFrame, assignments: DataFrame, size: int = 500, threshold: float = CLUSTER, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """(``by``…, face_id, cluster): faces without an open assignment in rounds of ``size`` by id, each round clustered by itself as
    ``cluster_unknown`` does; ``cluster`` is the smallest face_id in it.

    The means of all rounds, weighted by their faces, then go through further rounds in the same way while these still join enough of
    them. At last every mean is compared with every other of its project: in one more round if they are ``PAIR_BLOCK`` or fewer, else block by
    block: in the order of ids, a mean joins the most similar of the leaders before it (``_leaders``). This is repeated with the new means until none joins, so in the end
    no two clusters of a project are similar, wherever their faces stand in the order. A task holds ``size`` vectors, or two blocks of
    ``PAIR_BLOCK``. With ``by`` = project_id and photo_id each photo is clustered by itself, as after its scan. Faces of null vectors are
    left out.
    """
    taken = assignments.where("assignment_status <> 'rejected'").select("project_id", "face_id").distinct()
    free = faces.where("status = 'embedded' AND embedding IS NOT NULL AND size(embedding) > 0").join(taken, ["project_id", "face_id"], "left_anti")
    keys = list(by)
    points = free.select(*(F.col(c).cast("bigint") for c in keys), F.col("face_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(1).cast("bigint").alias("weight"))
    members = None
    exact = False
    while True:
        if exact:
            most = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
            # What fits in a block is one round.
            found = written(_leaders(points, keys, threshold) if most > PAIR_BLOCK else _round(points, keys, PAIR_BLOCK, threshold))
        else:
            found = written(_round(points, keys, size, threshold))
        step = found.select(*keys, F.col("id").alias("cluster"), F.col("leader").alias("next"))
        members = found.select(*keys, F.col("id").alias("face_id"), F.col("leader").alias("cluster")) if members is None else members.join(step, [*keys, "cluster"]).select(*keys, "face_id", F.col("next").alias("cluster"))
        members = written(members)
        sizes = found.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("leader")).alias("left"))
        n, left, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        # A round that holds all points of every key compares them all.
        if n == left and (exact or most <= size):
            return members
        # Once rounds join fewer than a tenth, the rest is similar across rounds only.
        exact = exact or 10 * left > 9 * n
        points = found.where("id = leader").select(*keys, "id", F.col("mean").alias("vector"), F.col("total").alias("weight"))


def _leaders(points: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys…, id, leader, mean, total) like ``_round``, of all points of a key: no two leaders are similar (from ``threshold`` on), and every
    other point has joined a similar leader of a smaller id.

    Points are decided in passes: those without a similar undecided one before them are leaders, and those similar to new leaders join the
    most similar of these (the smaller id of equals).
    """
    # Blocks are numbered once; later passes have fewer points in them.
    placed = running_counts(points, keys, [F.col("id")], F.lit(True)).withColumn("block", F.floor(F.col("before") / PAIR_BLOCK))
    undecided, done = written(placed.select(*keys, "id", "vector", "block")), []
    while not undecided.isEmpty():
        earlier = _nearest_before(undecided, undecided, keys, threshold).select(*keys, "id").distinct()
        new = written(undecided.join(earlier, [*keys, "id"], "left_anti"))
        joined = written(_nearest_before(undecided.join(earlier, [*keys, "id"]), new, keys, threshold))
        done += [new.select(*keys, "id", F.col("id").alias("leader")), joined.select(*keys, "id", "leader")]
        undecided = written(undecided.join(new.select(*keys, "id"), [*keys, "id"], "left_anti").join(joined.select(*keys, "id"), [*keys, "id"], "left_anti"))
    if not done:
        return points.select(*keys, "id", F.col("id").alias("leader"), F.col("vector").alias("mean"), F.col("weight").alias("total"))
    found = reduce(DataFrame.union, done)
    own = points.join(found, [*keys, "id"])
    parts = own.select(*keys, "leader", "weight", F.posexplode("vector").alias("i", "x"))
    sums = parts.groupBy(*keys, "leader", "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"), F.sum("weight").alias("total"))
    means = sums.groupBy(*keys, "leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("mean"), F.max("total").alias("total"))
    return own.select(*keys, "id", "leader").join(means, [*keys, "leader"]).select(*keys, "id", "leader", "mean", "total")


def _nearest_before(asked: DataFrame, others: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys…, id, leader): for each asked point the most similar of ``others`` with a smaller id, if any is similar enough.

    Points are packed by their ``block``, ``PAIR_BLOCK`` of a key at most; pairs of blocks of a key meet in tasks of their own, and each gives one row a point.
    """

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        packed = rows.groupBy(*keys, "block").agg(F.collect_list(F.struct("id", "vector")).alias(side), F.min("id").alias(f"{side}_low"), F.max("id").alias(f"{side}_high"))
        return packed.withColumnRenamed("block", f"{side}_block")

    pairs = blocks(asked, "a").join(blocks(others, "b"), keys).where("b_low < a_high").repartition(*keys, "a_block", "b_block").select(*keys, "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                (a_ids, a), (b_ids, b) = (_by_length(row[side]) for side in ("a", "b"))
                out: list[tuple] = []
                for n in a_ids.keys() & b_ids.keys():
                    scores = _unit(a[n]) @ _unit(b[n]).T
                    scores = np.where(b_ids[n][None, :] < a_ids[n][:, None], scores, -2)
                    best = scores.max(1)
                    # Ids are sorted, so the first of equals is the smallest.
                    out += [(int(a_ids[n][i]), int(b_ids[n][int(scores[i].argmax())]), float(best[i])) for i in np.flatnonzero(best >= threshold)]
                if out:
                    ids, leaders, found = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[k]] * len(out), pa.int64()) for k in keys), pa.array(ids, pa.int64()), pa.array(leaders, pa.int64()), pa.array(found, pa.float64())], [*keys, "id", "leader", "similarity"])

    found = pairs.mapInArrow(compare, ", ".join(f"{k} bigint" for k in keys) + ", id bigint, leader bigint, similarity double")
    return found.groupBy(*keys, "id").agg(F.max_by("leader", F.struct("similarity", -F.col("leader"))).alias("leader"))


def _by_length(points: list[dict]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Ids and vectors of a block, for each length of vectors, by id."""
    found: dict[int, list] = {}
    for point in sorted(points, key=lambda x: x["id"]):
        found.setdefault(len(point["vector"]), []).append(point)
    return {n: np.array([p["id"] for p in rows]) for n, rows in found.items()}, {n: np.array([p["vector"] for p in rows], float) for n, rows in found.items()}


def _round(points: DataFrame, keys: list[str], size: int, threshold: float) -> DataFrame:
    """(keys…, id, leader, mean, total): points (keys…, id, vector, weight) clustered in runs of ``size``; a leader's row has the
    mean and weight of its cluster."""
    placed = running_counts(points, keys, [F.col("id")], F.lit(True)).withColumn("round", F.floor(F.col("before") / size))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        vectors, weights, ids = np.stack(rows["vector"].to_list()), rows["weight"].to_numpy(), rows["id"].to_numpy()
        sums, means, counts, leaders, of = np.zeros_like(vectors), np.zeros_like(vectors), np.zeros(len(ids)), [], np.zeros(len(ids), int)
        for i, vector in enumerate(vectors):
            n = len(leaders)
            scores = means[:n] @ _unit(vector[None])[0]
            best = int(scores.argmax()) if n else -1
            if best < 0 or scores[best] < threshold:
                best = n
                leaders.append(i)
            sums[best] += vector * weights[i]
            counts[best] += weights[i]
            means[best] = _unit((sums[best] / counts[best])[None])[0]
            of[i] = best
        mean = sums[: len(leaders)] / counts[: len(leaders), None]
        first = np.array(leaders)
        return pd.DataFrame({**{k: rows[k].to_numpy() for k in keys}, "id": ids, "leader": ids[first[of]], "mean": [m.tolist() for m in mean[of]], "total": counts[of].astype("int64")})

    return placed.select(*keys, "round", "id", "vector", "weight").groupBy(*keys, "round").applyInPandas(greedy, ", ".join(f"{k} bigint" for k in keys) + ", id bigint, leader bigint, mean array<double>, total bigint")


def cluster_tables(clusters: DataFrame) -> dict[str, DataFrame]:
    """What clusters become: ``persons`` (project_id, cluster, is_named, face_count, representative: the smallest face), none of them named,
    and ``assignments`` of their faces that wait for review (source unknown_cluster)."""
    persons = clusters.groupBy("project_id", "cluster").agg(F.count("*").alias("face_count"), F.min("face_id").alias("representative"))
    rows = clusters.select("project_id", "face_id", "cluster", F.lit("review_pending").alias("assignment_status"), F.lit("unknown_cluster").alias("assignment_source"), F.lit(False).alias("is_positive"))
    return {"persons": persons.select("project_id", "cluster", F.lit(False).alias("is_named"), "face_count", "representative"), "assignments": rows}


def reconcile_boxes(old: DataFrame, new: DataFrame, threshold: float = SAME_BOX, crowd: int = CROWD) -> DataFrame:
    """(project_id, photo_id, place, face_id, action) of new boxes (x, y, w, h, place: order of detection) against a photo's old ones (face_id).

    In the order of detection, a new box takes an old one that is equal, else the one with the best overlap (the smallest face_id of
    equals) from ``threshold`` (0.5 or more) on, among those not taken before: keep or move. The rest is inserted (face_id null), and old
    ones not taken have disappeared (place null). Repeated boxes are taken one by one, smaller ids first. Boxes with a null take no part.

    In a photo of more than ``crowd`` different old boxes, boxes meet in cells of a grid as wide as they are, so only boxes that can overlap
    are compared; in others, which are most, a new box meets every old one and no cells are shuffled. Then, in rounds, a new box is settled
    with its best remaining old box if fewer undecided ones before it can want that box than it has copies left.
    """
    photo, box = ["project_id", "photo_id"], ["x", "y", "w", "h"]
    sound = " AND ".join(f"{c} IS NOT NULL" for c in (*photo, *box))
    new = written(new.where(sound).select(*photo, *box, "place"))
    old = written(old.where(sound).select(*photo, *box, "face_id"))
    # Copies of an old box are one box, taken as often as it has faces.
    boxes = written(old.groupBy(*photo, *box).agg(F.min("face_id").alias("box_id"), F.count("*").alias("copies")))
    crowded = written(boxes.groupBy(*photo).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*photo, F.lit(True).alias("crowded")))
    marked = boxes.select(*photo, "box_id", "copies", *(F.col(c).alias(f"o_{c}") for c in box))
    equal = new.join(boxes.select(*photo, *box, "box_id", "copies"), [*photo, *box]).select(*photo, "place", "box_id", "copies", F.lit(2.0).alias("worth"))
    met = new.join(crowded, photo, "left").select(*photo, *box, "place", F.explode(_cells("x", "y", "w", "h", (-1, 0, 1), F.col("crowded"))).alias("cell"))
    near = marked.join(crowded, photo, "left").select(*marked.columns, F.explode(_cells("o_x", "o_y", "o_w", "o_h", (0,), F.col("crowded"))).alias("cell"))
    pairs = met.join(near, [*photo, "cell"]).drop("cell").where("NOT (x = o_x AND y = o_y AND w = o_w AND h = o_h)")
    pairs = pairs.withColumn("worth", _overlap()).where(F.col("worth") >= threshold).select(*photo, "place", "box_id", "copies", "worth").distinct()
    left = written(equal.union(pairs))
    matched = None
    while not left.isEmpty():
        own, wanted = Window.partitionBy(*photo, "place"), Window.partitionBy(*photo, "box_id").orderBy("place")
        ranked_pairs = left.withColumn("best", F.row_number().over(own.orderBy(F.desc("worth"), "box_id")) == 1).withColumn("before", F.row_number().over(wanted) - 1)
        settled = written(ranked_pairs.where("best AND before < copies").select(*photo, "place", "box_id", "worth"))
        matched = settled if matched is None else matched.union(settled)
        taken = settled.groupBy(*photo, "box_id").agg(F.count("*").alias("taken"))
        rest = left.join(settled.select(*photo, "place"), [*photo, "place"], "left_anti").join(taken, [*photo, "box_id"], "left")
        left = written(rest.select(*photo, "place", "box_id", (F.col("copies") - F.coalesce("taken", F.lit(0))).alias("copies"), "worth").where("copies > 0"))
    kind = F.when(F.col("worth") > 1, "keep").otherwise("move").alias("action")
    if matched is None:
        matched = left.select(*photo, "place", "box_id", "worth")
    # The k-th to take a box gets the k-th smallest face.
    turn = matched.withColumn("turn", F.row_number().over(Window.partitionBy(*photo, "box_id").orderBy("place")))
    faces = old.select(*photo, "face_id", F.min("face_id").over(Window.partitionBy(*photo, *box)).alias("box_id"), F.row_number().over(Window.partitionBy(*photo, *box).orderBy("face_id")).alias("turn"))
    kept = written(turn.join(faces, [*photo, "box_id", "turn"]).select(*photo, F.col("place").cast("bigint"), F.col("face_id").cast("bigint"), kind))
    missing = F.lit(None).cast("bigint")
    inserted = new.join(kept.select(*photo, "place"), [*photo, "place"], "left_anti").select(*photo, F.col("place").cast("bigint"), missing, F.lit("insert"))
    gone = old.join(kept.select(*photo, "face_id"), [*photo, "face_id"], "left_anti").select(*photo, missing, F.col("face_id").cast("bigint"), F.lit("disappeared"))
    return kept.union(inserted).union(gone)


def _cells(x: str, y: str, w: str, h: str, classes: tuple[int, ...], crowded: Column) -> Column:
    """Cells (size class, column, row) that a box touches in the grids of its size class and those beside it; a cell is wider than the boxes
    of its class. Overlaps of half and more are of equal or neighbouring classes. A box without an area has none; a photo that is not
    ``crowded`` is one cell."""
    size = F.floor(F.log2(F.greatest(w, h).cast("double")))

    def grid(step: int) -> Column:
        side = F.pow(F.lit(2.0), size + step + 1)
        at = lambda c: F.floor(c / side).cast("bigint")
        columns, lines = F.sequence(at(F.col(x)), at(F.col(x) + F.col(w))), F.sequence(at(F.col(y)), at(F.col(y) + F.col(h)))
        return F.flatten(F.transform(columns, lambda i: F.transform(lines, lambda j: F.struct((size + step).cast("bigint").alias("class"), i.alias("i"), j.alias("j")))))

    zero = F.lit(0).cast("bigint")
    cells = F.when(crowded, F.flatten(F.array(*map(grid, classes)))).otherwise(F.array(F.struct(zero.alias("class"), zero.alias("i"), zero.alias("j"))))
    return F.when((F.col(w) > 0) & (F.col(h) > 0), cells).otherwise(F.array().cast("array<struct<class:bigint,i:bigint,j:bigint>>"))


def _overlap() -> Column:
    """Shared area of boxes (x, y, w, h) and (o_x, o_y, o_w, o_h) as a share of both."""
    side = lambda at, n: F.greatest(F.lit(0), F.least(F.col(at) + F.col(n), F.col(f"o_{at}") + F.col(f"o_{n}")) - F.greatest(at, f"o_{at}"))
    shared = side("x", "w") * side("y", "h")
    return F.coalesce(shared.cast("double") / (F.col("w") * F.col("h") + F.col("o_w") * F.col("o_h") - shared), F.lit(0.0))


def face_quality(confidence: Column, box_area: Column, image_area: Column, digits: int = 4) -> Column:
    """0.65 of the detection's confidence (null: 0.5) and 0.35 of twelve times the share of the image, at most 1."""
    share = F.when(image_area > 0, F.least(F.lit(1.0), 12 * box_area / image_area)).otherwise(0.0)
    return F.round(0.65 * F.coalesce(confidence, F.lit(0.5)) + 0.35 * share, digits)


def _last_events(events: DataFrame) -> DataFrame:
    """The last action of each (project_id, face_id, person_id): confirm, exclude, left or corrected; a move is the last two."""
    key = ["project_id", "face_id", "person_id"]
    if "target_id" in events.columns:
        parts = F.when(F.col("action") == "move", F.array(F.struct("person_id", F.lit("left").alias("action")), F.struct(F.col("target_id").alias("person_id"), F.lit("corrected").alias("action")))).otherwise(F.array(F.struct("person_id", "action")))
        events = events.select("project_id", "face_id", "seq", F.inline(parts))
    return events.groupBy(*key).agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def apply_feedback(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """Assignments after confirm, exclude and move events (project_id, face_id, person_id, action, seq, and target_id of moves); the last
    one of a pair counts.

    A confirmed pair is human_confirmed and positive, and other open assignments of its face are rejected; an excluded pair is
    rejected. A move deletes the assignment to the person, and makes that to target_id human_corrected and positive. Confirmed
    and corrected pairs without an assignment appear without an id.
    """
    key = ["project_id", "face_id", "person_id"]
    last = _last_events(events)
    winner = last.where("action = 'confirm'").groupBy("project_id", "face_id").agg(F.max_by("person_id", "seq").alias("winner"))
    old = assignments.join(last.drop("seq"), key, "left").join(winner, ["project_id", "face_id"], "left").where("action IS NULL OR action <> 'left'")
    own, moved = F.coalesce(F.col("person_id") == F.col("winner"), F.lit(False)), F.coalesce(F.col("action") == "corrected", F.lit(False))
    status = F.when(own, "human_confirmed").when(moved, "human_corrected").when((F.col("action") == "exclude") | F.col("winner").isNotNull(), "rejected").otherwise(F.col("assignment_status"))
    kept = old.select(*key, "id", status.alias("assignment_status"), (F.col("is_positive") | own | moved) & (status != "rejected"))
    fresh = winner.select("project_id", "face_id", F.col("winner").alias("person_id"), F.lit("human_confirmed").alias("status"))
    fresh = fresh.union(last.where("action = 'corrected'").join(winner, ["project_id", "face_id"], "left").where("winner IS NULL OR winner <> person_id").select(*key, F.lit("human_corrected")))
    added = fresh.join(assignments, key, "left_anti").select(*key, F.lit(None).cast("bigint"), "status", F.lit(True))
    return kept.union(added).toDF(*key, "id", "assignment_status", "is_positive")


def feedback_constraints(events: DataFrame, assignments: DataFrame | None = None, before: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """(project_id, face_id, not_person_id) after events: those of ``before``, excluded pairs, persons that a face was moved from and, with
    ``assignments``, other persons with an open assignment to a confirmed face; without confirmed and corrected pairs. With
    ``enabled`` false no new ones are made."""
    key = ["project_id", "face_id", "person_id"]
    last = _last_events(events)
    bars = last.where("action IN ('exclude', 'left')").select(*key)
    if assignments is not None:
        winner = last.where("action = 'confirm'").groupBy("project_id", "face_id").agg(F.max_by("person_id", "seq").alias("winner"))
        lost = assignments.where("assignment_status <> 'rejected'").join(winner, ["project_id", "face_id"]).where("person_id <> winner")
        bars = bars.union(lost.select(*key))
    if not enabled:
        bars = bars.where("false")
    if before is not None:
        bars = bars.union(before.select("project_id", "face_id", F.col("not_person_id").alias("person_id")))
    kept = bars.distinct().join(last.where("action IN ('confirm', 'corrected')"), key, "left_anti")
    return kept.select("project_id", "face_id", F.col("person_id").alias("not_person_id"))


def merge_people(assignments: DataFrame, pairs: DataFrame, cannot_links: DataFrame) -> DataFrame:
    """(project_id, source_id, target_id, blocked, moved, revived): what merging each pair does. A cannot-link (a < b) blocks it;
    open faces of the source move, unless the target has them; a rejected one of the target is revived, which is no move."""
    links = cannot_links.select("project_id", F.col("person_a").alias("a"), F.col("person_b").alias("b"), F.lit(True).alias("linked"))
    marked = pairs.withColumn("a", F.least("source_id", "target_id")).withColumn("b", F.greatest("source_id", "target_id")).join(links, ["project_id", "a", "b"], "left")
    open_ = assignments.where("assignment_status <> 'rejected'").select("project_id", F.col("person_id").alias("source_id"), "face_id")
    has = assignments.select("project_id", F.col("person_id").alias("target_id"), "face_id", F.col("assignment_status").alias("held"))
    faces = marked.where("linked IS NULL").join(open_, ["project_id", "source_id"]).join(has, ["project_id", "target_id", "face_id"], "left")
    counts = faces.groupBy("project_id", "source_id", "target_id").agg(F.count_if(F.col("held").isNull()).alias("moved"), F.count_if(F.col("held") == "rejected").alias("revived"))
    out = marked.join(counts, ["project_id", "source_id", "target_id"], "left")
    return out.select("project_id", "source_id", "target_id", F.coalesce("linked", F.lit(False)).alias("blocked"), F.coalesce("moved", F.lit(0)).alias("moved"), F.coalesce("revived", F.lit(0)).alias("revived"))


def merged_assignments(assignments: DataFrame, pairs: DataFrame, cannot_links: DataFrame) -> DataFrame:
    """Assignments after merging pairs (source_id, target_id) that no cannot-link blocks; a person is in one pair at most.

    An open face of the source goes to the target (source human_merge); if the target has it, its own row stays, taking the source's
    status if it was rejected, and the source's goes. Rejected rows of the source stay.
    """
    links = cannot_links.select("project_id", F.col("person_a").alias("a"), F.col("person_b").alias("b"))
    open_pairs = pairs.select("project_id", "source_id", "target_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).join(links, ["project_id", "a", "b"], "left_anti").select("project_id", "source_id", "target_id")
    columns = ["project_id", "face_id", "person_id", "id", "assignment_status", "assignment_source"]
    rows = assignments.withColumn("assignment_source", F.col("assignment_source") if "assignment_source" in assignments.columns else F.lit(None).cast("string")).select(*columns)
    own = rows.where("assignment_status <> 'rejected'").select("project_id", "face_id", F.col("person_id").alias("source_id"), F.col("id").alias("s_id"), F.col("assignment_status").alias("s_status"))
    open_ = own.join(open_pairs, ["project_id", "source_id"])
    held = rows.join(open_.select("project_id", "face_id", F.col("target_id").alias("person_id"), "s_id", "s_status"), ["project_id", "face_id", "person_id"], "left")
    revived = F.col("s_id").isNotNull() & (F.col("assignment_status") == "rejected")
    held = held.select("project_id", "face_id", "person_id", "id", F.when(revived, F.col("s_status")).otherwise(F.col("assignment_status")).alias("assignment_status"), F.when(revived, "human_merge").otherwise(F.col("assignment_source")).alias("assignment_source"))
    stay = held.join(open_.select("project_id", F.col("s_id").alias("id")), ["project_id", "id"], "left_anti").select(*columns)
    moved = open_.select("project_id", "face_id", F.col("target_id").alias("person_id"), "s_id", "s_status").join(rows.select("project_id", "face_id", "person_id"), ["project_id", "face_id", "person_id"], "left_anti")
    return stay.union(moved.select("project_id", "face_id", "person_id", "s_id", "s_status", F.lit("human_merge")))


def merge_paths(merges: DataFrame) -> DataFrame:
    """(project_id, person_id, steps): the merges (project_id, seq, source_id, target_id) that open faces of a source pass through, in
    order: the first merge of the person, then the first later one of its target, and so on; cycles end with the batch.

    Pointers to the next merge are doubled, so a chain of n merges takes log2(n) rounds. A path is as long as its chain.
    """
    key = ["project_id", "seq"]
    event = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("person_id"))
    seen = merges.select(*key, "source_id", "target_id", F.inline(F.array(event("source"), event("target"))))
    later = Window.partitionBy("project_id", "person_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    following = seen.withColumn("next", F.first(F.when(F.col("kind") == "source", F.col("seq")), ignorenulls=True).over(later)).where("kind = 'target'")
    nodes = written(following.select(*key, "next", F.array(F.struct("seq", "source_id", "target_id")).alias("steps")))
    while not nodes.where("next IS NOT NULL").isEmpty():
        ahead = nodes.select("project_id", F.col("seq").alias("next"), F.col("next").alias("further"), F.col("steps").alias("rest"))
        joined = nodes.join(ahead, ["project_id", "next"], "left")
        nodes = written(joined.select(*key, F.col("further").alias("next"), F.concat("steps", F.coalesce("rest", F.expr("slice(steps, 1, 0)"))).alias("steps")))
    first = merges.groupBy("project_id", F.col("source_id").alias("person_id")).agg(F.min("seq").alias("seq"))
    return first.join(nodes, key).select("project_id", "person_id", "steps")


def merged_in_order(assignments: DataFrame, merges: DataFrame, cannot_links: DataFrame) -> DataFrame:
    """Assignments after a batch of merges (project_id, seq, source_id, target_id), one after the other by ``seq``, which is unique in a
    project: persons may be in any number of them, also in chains and cycles.

    Each merge does what ``merged_assignments`` says with the faces that its source has by then. A merge of persons with a cannot-link, or of
    a person with itself, is left out. A face's few assignments are folded over the merges that they pass; others are only passed on.
    """
    links = cannot_links.select("project_id", F.col("person_a").alias("a"), F.col("person_b").alias("b")).distinct()
    marked = merges.where("source_id <> target_id").select("project_id", "seq", "source_id", "target_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    paths = merge_paths(written(marked.join(links, ["project_id", "a", "b"], "left_anti").select("project_id", "seq", "source_id", "target_id")))
    columns = ["project_id", "face_id", "person_id", "id", "assignment_status", "assignment_source"]
    source = F.col("assignment_source") if "assignment_source" in assignments.columns else F.lit(None).cast("string")
    rows = assignments.withColumn("assignment_source", source).select(*columns)
    open_ = rows.where("assignment_status <> 'rejected'").select("project_id", "face_id", "person_id")
    passed = open_.join(paths, ["project_id", "person_id"]).groupBy("project_id", "face_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("steps")))).alias("steps"))
    held = rows.groupBy("project_id", "face_id").agg(F.collect_list(F.struct("person_id", "id", "assignment_status", "assignment_source")).alias("held"))
    folded = held.join(passed, ["project_id", "face_id"], "left")

    def merged(held: Column, step: Column) -> Column:
        moves = lambda x: (x["person_id"] == step["source_id"]) & (x["assignment_status"] != "rejected")
        given = F.element_at(F.filter(held, moves), 1)["assignment_status"]
        moved = lambda x: F.when(moves(x), x.withField("person_id", step["target_id"]).withField("assignment_source", F.lit("human_merge"))).otherwise(x)
        revived = lambda x: F.when((x["person_id"] == step["target_id"]) & (x["assignment_status"] == "rejected"), x.withField("assignment_status", given).withField("assignment_source", F.lit("human_merge"))).otherwise(x)
        taken = F.exists(held, lambda x: x["person_id"] == step["target_id"])
        return F.when(~F.exists(held, moves), held).when(taken, F.transform(F.filter(held, lambda x: ~moves(x)), revived)).otherwise(F.transform(held, moved))

    after = F.when(F.col("steps").isNull(), F.col("held")).otherwise(F.aggregate("steps", F.col("held"), merged))
    return folded.select("project_id", "face_id", F.inline(after)).select(*columns)


def merged_representatives(persons: DataFrame, pairs: DataFrame) -> DataFrame:
    """(project_id, id, representative) after merges: the target's own, else the source's, which has none any more."""
    source = pairs.select("project_id", F.col("source_id").alias("id"), F.lit(True).alias("gone"))
    given = pairs.join(persons.select("project_id", F.col("id").alias("source_id"), F.col("representative").alias("given")), ["project_id", "source_id"]).select("project_id", F.col("target_id").alias("id"), "given")
    rows = persons.join(source, ["project_id", "id"], "left").join(given, ["project_id", "id"], "left")
    return rows.select("project_id", "id", F.when(F.col("gone").isNull(), F.coalesce("representative", "given")).alias("representative"))


def split_people(assignments: DataFrame, chosen: DataFrame) -> DataFrame:
    """(project_id, face_id, person_id, new_person_id, a, b): chosen open faces (project_id, face_id, person_id, new_person_id) as they
    go to the new person; (a, b) is the cannot-link that the split leaves."""
    held = assignments.where("assignment_status <> 'rejected'").select("project_id", "face_id", "person_id")
    return chosen.join(held, ["project_id", "face_id", "person_id"]).withColumn("a", F.least("person_id", "new_person_id")).withColumn("b", F.greatest("person_id", "new_person_id"))


def split_tables(assignments: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """What a split leaves: ``assignments``, in which chosen faces are human_corrected, positive ones of the new person (source
    human_split); ``persons``, the new named ones; ``constraints`` against the old person; ``cannot_links``."""
    done = split_people(assignments, chosen)
    to = done.select("project_id", "face_id", "person_id", "new_person_id")
    rows = assignments.join(to, ["project_id", "face_id", "person_id"], "left")
    split = F.col("new_person_id").isNotNull() & (F.col("assignment_status") != "rejected")
    after = rows.select("project_id", "face_id", F.when(split, F.col("new_person_id")).otherwise(F.col("person_id")).alias("person_id"), "id", F.when(split, "human_corrected").otherwise(F.col("assignment_status")).alias("assignment_status"), (F.col("is_positive") | split).alias("is_positive"), F.when(split, "human_split").alias("assignment_source"))
    return {
        "assignments": after, "persons": done.select("project_id", F.col("new_person_id").alias("id"), F.lit(True).alias("is_named")).distinct(),
        "constraints": done.select("project_id", "face_id", F.col("person_id").alias("not_person_id")).distinct(), "cannot_links": done.select("project_id", F.col("a").alias("person_a"), F.col("b").alias("person_b")).distinct(),
    }


def first_namings(persons: DataFrame, events: DataFrame) -> DataFrame:
    """(project_id, person_id, display_name, first): the last not blank name of each renamed person; ``first`` if it had none before."""
    names = events.where("trim(name) <> ''").groupBy("project_id", "person_id").agg(F.max_by(F.trim("name"), "seq").alias("display_name"))
    return names.join(persons.select("project_id", F.col("id").alias("person_id"), (~F.col("is_named")).alias("first")), ["project_id", "person_id"])


def promoted(assignments: DataFrame, named: DataFrame) -> DataFrame:
    """Assignments after first namings: open ones of the person are human_confirmed, positive ones."""
    rows = assignments.join(named.where("first").select("project_id", "person_id", F.lit(True).alias("now")), ["project_id", "person_id"], "left")
    hit = F.col("now").isNotNull() & (F.col("assignment_status") != "rejected")
    return rows.select("project_id", "face_id", "person_id", "id", F.when(hit, "human_confirmed").otherwise(F.col("assignment_status")).alias("assignment_status"), (F.col("is_positive") | hit).alias("is_positive"))


def delete_people(requests: DataFrame, persons: DataFrame, assignments: DataFrame, constraints: DataFrame, cannot_links: DataFrame) -> dict[str, DataFrame]:
    """``outcome`` of each requested deletion (project_id, person_id): deleted, refused (open assignments) or not_found; and the
    ``constraints`` and ``cannot_links`` that are left."""
    known = deletable_people(assignments, persons).select("project_id", "person_id", "deletable")
    outcome = requests.select("project_id", "person_id").distinct().join(known, ["project_id", "person_id"], "left")
    outcome = outcome.select("project_id", "person_id", F.when(F.col("deletable").isNull(), "not_found").when(F.col("deletable"), "deleted").otherwise("refused").alias("outcome"))
    gone = outcome.where("outcome = 'deleted'").select("project_id", "person_id")
    left = constraints.join(gone.withColumnRenamed("person_id", "not_person_id"), ["project_id", "not_person_id"], "left_anti")
    links = cannot_links.join(gone.withColumnRenamed("person_id", "person_a"), ["project_id", "person_a"], "left_anti").join(gone.withColumnRenamed("person_id", "person_b"), ["project_id", "person_b"], "left_anti")
    return {"outcome": outcome, "constraints": left, "cannot_links": links}


def deletable_people(assignments: DataFrame, persons: DataFrame) -> DataFrame:
    """Whether each person may be deleted: only without an open assignment."""
    return person_counters(assignments, persons).select("project_id", "person_id", (F.col("face_count") == 0).alias("deletable"))


def stale_scans(photos: DataFrame, faces: DataFrame, settings: DataFrame, derivatives: DataFrame) -> DataFrame:
    """(project_id, photo_id) of photos to scan again: their newest face (updated_at) is older than the project's settings, or their work
    image (status, path_exists, source_exists, source_mtime, file_mtime) is not ready, gone, or of another source."""
    key = ["project_id", "photo_id"]
    newest = faces.groupBy(*key).agg(F.max("updated_at").alias("newest")).join(settings.select("project_id", F.col("updated_at").alias("changed")), "project_id")
    other = F.col("source_exists") & F.col("source_mtime").isNotNull() & ~F.col("source_mtime").eqNullSafe(F.col("file_mtime"))
    broken = derivatives.where((F.col("status") != "ready") | ~F.col("path_exists") | ~F.col("source_exists") | other).select(*key)
    live = photos.where("deleted_at IS NULL").select("project_id", F.col("id").alias("photo_id"))
    return newest.where("newest < changed").select(*key).union(broken.join(live, key, "left_semi")).distinct()


def scan_plan(photos: DataFrame, faces: DataFrame, jobs: DataFrame, scope: str, job_type: str | None = None, stale: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Photos to scan for faces: ``missing`` (no face), ``failed`` (a failed face, or a failed job of ``job_type``), ``stale``
    (``stale_scans``), ``selected`` or ``all``; those with an active job (of ``job_type``, if given) are skipped."""
    live = photos.where("deleted_at IS NULL").select("project_id", F.col("id").alias("photo_id"))
    key = ["project_id", "photo_id"]
    own = jobs if job_type is None else jobs.where(F.col("job_type") == job_type)
    failed = faces.where("status = 'failed'").select(*key)
    if job_type is not None:
        failed = failed.union(own.where("status = 'failed'").select(*key))
    limits = {"missing": (faces, "left_anti"), "failed": (failed, "left_semi"), "stale": (stale, "left_semi"), "selected": (selected, "left_semi")}
    wanted = live if scope == "all" else live.join(limits[scope][0].select(*key), key, limits[scope][1])
    busy = own.where(F.col("status").isin("queued", "running")).select(*key, F.lit(True).alias("busy")).distinct()
    return wanted.join(busy, key, "left").select(*key, F.when(F.col("busy"), "skipped").otherwise("created").alias("outcome"))


def scan_counts(photos: DataFrame, plan: DataFrame) -> DataFrame:
    """(project_id, total_photos, candidates, skipped_active, out_of_scope) of a plan."""
    total = photos.where("deleted_at IS NULL").groupBy("project_id").agg(F.count("*").alias("total_photos"))
    made = plan.groupBy("project_id").agg(F.count_if(F.col("outcome") == "created").alias("candidates"), F.count_if(F.col("outcome") == "skipped").alias("skipped_active"))
    rows = total.join(made, "project_id", "left").na.fill(0)
    return rows.withColumn("out_of_scope", F.col("total_photos") - F.col("candidates") - F.col("skipped_active"))
