"""Centroid clustering with exact integer sums, centroids filtered by bounds from an n-simplex projection.

Every vector's distances to a few pivots are computed once. With the pivots' distances to each other they are the edges of a simplex,
whose apex has coordinates that stand for the vector: all but the last in the space of the pivots, the last the height above it. The
Euclidean distance of two apexes is a lower bound of the distance of their vectors, and with the heights added instead of
subtracted an upper bound. A round compares apexes, and only centroids whose lower bound reaches the smallest distance still
possible are compared exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import materialize

#: Pivots at most. A pivot must stand this high above those before it, as a share of the first edge.
PIVOTS, LEAST_HEIGHT = 16, 0.05
#: Share of the squared lengths that bounds give away to rounding.
SLACK = 1e-6
#: Integer components are smaller than this, so that a squared distance of up to 64 of them fits 63 bits.
LARGEST = 1 << 27
#: Bytes of all centroids, which the driver and every task hold.
CENTROID_BYTES = 64 << 20


class Simplex(NamedTuple):
    """Pivots (rows of integers) and the inverse that turns differences of squared distances into coordinates."""

    pivots: np.ndarray
    inverse: np.ndarray
    lengths: np.ndarray


def simplex(candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
    """Of ``candidates``, the first, and then always the one that stands highest above those chosen."""
    gaps = candidates[:, None, :] - candidates[None, :, :]
    square = (gaps * gaps).sum(2).astype(float)
    chosen, base = [0], np.zeros((0, 0))
    shown = np.zeros((len(candidates), 0))
    while len(chosen) < min(most, len(candidates)):
        height = square[:, 0] - (shown * shown).sum(1)
        best = int(np.argmax(height))
        edge = square[0].max()
        if height[best] <= LEAST_HEIGHT * edge or best in chosen:
            break
        chosen.append(best)
        gram = (square[0, chosen[1:]][:, None] + square[0, chosen[1:]][None, :] - square[np.ix_(chosen[1:], chosen[1:])]) / 2
        base = np.linalg.cholesky(gram)
        shown = _solve(square[:, chosen], np.linalg.inv(2 * base), (base * base).sum(1))
    return Simplex(candidates[chosen], np.linalg.inv(2 * base) if len(base) else base, (base * base).sum(1))


def _solve(square: np.ndarray, inverse: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Coordinates in the pivots' space from squared distances to the pivots: 2 b_j x = |b_j|^2 + d_0^2 - d_j^2."""
    return (lengths + square[:, :1] - square[:, 1:]) @ inverse.T


def apexes(vectors: np.ndarray, base: Simplex) -> np.ndarray:
    """Apex coordinates of integer vectors, from their distances to the pivots."""
    square = np.stack([((vectors - p) ** 2).sum(1) for p in base.pivots], axis=1).astype(float)
    inside = _solve(square, base.inverse, base.lengths) if len(base.pivots) > 1 else np.zeros((len(vectors), 0))
    height = np.sqrt(np.maximum(square[:, 0] - (inside * inside).sum(1), 0))
    return np.concatenate([inside, height[:, None]], axis=1)


def nearest(vectors: np.ndarray, shown: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact comparisons) of every vector, ties to the smaller number.

    ``shown`` and ``tops`` are the apexes of vectors and centroids.
    """
    size = (shown * shown).sum(1)[:, None] + (tops * tops).sum(1)[None, :]
    low = size - 2 * shown @ tops.T
    spare = SLACK * size
    reach = (low + 4 * shown[:, -1:] * tops[None, :, -1] + spare).min(1)
    first = np.argmin(low, axis=1)
    at_first = ((vectors - centroids[first]) ** 2).sum(1)
    open_pairs = low - spare <= np.minimum(reach, at_first.astype(float) * (1 + 1e-12))[:, None]
    best, found = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_pairs[:, c])
        exact = ((vectors[rows] - centroids[c]) ** 2).sum(1)
        nearer = exact < best[rows]
        best[rows[nearer]], found[rows[nearer]] = exact[nearer], c
    return found, best, int(open_pairs.sum())


def _rows(column: pa.Array, dims: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims).astype(dtype)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) of every component, exactly."""
    scaled = np.floor(values * scale)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is not below {LARGEST}, so squared distances would not fit a long")
    return scaled.astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, vector array<double>): rows with exactly ``dims`` components, none null or not finite."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.size("vector") == dims)
    return rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid array<bigint>) of every usable vector.

    Vectors become integers floor(``scale`` * x). Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:id`` (all, if
    there are fewer). Each of ``rounds`` rounds takes every vector to its nearest centroid (ties: the smaller number) and moves every
    centroid that has vectors to the floor of their mean; then vectors are taken to centroids once more. ``distance`` is squared.

    Null vectors and those of another length or with a null or non-finite component give no row. Rows with equal ids are vectors of
    their own; as starting centroids they are ordered by their components. A null id takes part but starts no centroid. A component that
    doesn't fit raises an error. An empty table gives an empty one. Other columns are not carried.

    The driver and each task hold the centroids (``CENTROID_BYTES`` at most); tasks return one sum for each centroid and component.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector_col, dims)
    kind = kept.schema["id"].dataType.simpleString()
    if k * dims * 8 > CENTROID_BYTES:
        raise ValueError(f"{k} centroids of {dims} components are more than {CENTROID_BYTES} bytes")
    drawn = kept.where("id IS NOT NULL").withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    starts = drawn.orderBy("draw", "vector").limit(k).select("vector").collect()
    if not starts:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    centroids = whole_numbers(np.array([r["vector"] for r in starts], float), scale)
    base = simplex(centroids)
    width = len(base.pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = whole_numbers(_rows(b.column(1), dims, float), scale)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(whole.astype(np.int32)), _lists(apexes(whole, base))], ["id", "whole", "apex"])

    cached = materialize(kept.mapInArrow(project, f"id {kind}, whole array<int>, apex array<double>"), "apexes")

    for _ in range(rounds):
        centroids = _moved(cached.mapInArrow(_sums(centroids, base, dims, width), "cluster int, n bigint, total array<bigint>"), centroids)

    assigned = materialize(cached.mapInArrow(_places(centroids, base, dims, width), f"id {kind}, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(c, d, sum(inertia.values()), centroids[c].tolist()) for c, d in inertia.items()]
    ends = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(ends), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _places(centroids: np.ndarray, base: Simplex, dims: int, width: int) -> Callable:
    """A function of batches of the cached table that gives every vector its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = apexes(centroids, base)
        for b in batches:
            found, best, _ = nearest(_rows(b.column(1), dims, np.int64), _rows(b.column(2), width, float), centroids, tops)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    return run


def _sums(centroids: np.ndarray, base: Simplex, dims: int, width: int) -> Callable:
    """A function of batches of the cached table that gives, for each centroid of a task, the number and the sums of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = apexes(centroids, base)
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for b in batches:
            vectors = _rows(b.column(1), dims, np.int64)
            found, _, _ = nearest(vectors, _rows(b.column(2), width, float), centroids, tops)
            n += np.bincount(found, minlength=len(centroids))
            np.add.at(total, found, vectors)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), _lists(total[used])], ["cluster", "n", "total"])

    return run


def _moved(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means; a centroid without vectors stays. Sums are added as decimals, so they don't overflow."""
    long = sums.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    added = long.groupBy("cluster", "place").agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    moved = centroids.copy()
    for r in added.collect():
        moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return moved
