"""Approximate nearest neighbours from randomly rotated one-bit codes.

A vector minus the common centre is turned into a space of at least ``CODE_BITS`` dimensions by a random rotation and cut to the
signs of its coordinates. The packed code, the distance to the centre and the inner product of the code with the vector it
stands for (the correction) give an unbiased estimate of the inner product with any query, and a bound of its error. The
query is rounded to ``QUERY_BITS`` bits a coordinate, so that the estimate is a weighted sum of counts of common bits. A vector is reranked
with its exact distance only if its lower bound can still reach a query's nearest found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import materialize

#: Standard deviations of the estimate that the bounds allow for.
ERROR = 3.5
#: Bits of a code at least, and bits of a query's coordinate.
CODE_BITS, QUERY_BITS = 512, 5
#: Queries that a pass over the index answers; they are broadcast, one block at a time.
QUERY_BLOCK = 4096
#: Vectors that a task scores at once, and exact distances that it computes at once.
SLAB, PAIRS = 4096, 1 << 16
SEED = 20240607


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>): rows with an id and a vector of finite components that aren't all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _rotation(dimensions: int, bits: int, seed: int) -> np.ndarray:
    """Random orthonormal columns: turns ``dimensions`` coordinates into ``bits``, the next multiple of 64 at least."""
    wide = -(-max(bits, dimensions) // 64) * 64
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, dimensions)))[0]


def _centre(rows: DataFrame) -> np.ndarray:
    """Mean of all vectors; one number for each dimension comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for whole in batches:
            if whole.num_rows:
                total, n = total + _matrix(whole.column(0), whole.num_rows).sum(axis=0), n + whole.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["place", "total", "n"])

    parts = rows.select("vector").mapInArrow(sums, "place bigint, total double, n bigint")
    found = parts.groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("place").collect()
    return np.array([r["mean"] for r in found])


class Index:
    """One row for each vector of one length: id, packed code, distance to the centre, correction and the vector itself."""

    def __init__(self, rows: DataFrame, centre: np.ndarray, rotation: np.ndarray):
        self.rows, self.centre, self.rotation = rows, centre, rotation


def build_index(rows: DataFrame, bits: int = CODE_BITS, seed: int = SEED) -> Index:
    """Codes of all rows (id, vector) of one length, written to the shared scratch folder."""
    centre = _centre(rows)
    rotation = _rotation(len(centre), bits, seed)
    sent = rows.sparkSession.sparkContext.broadcast((centre, rotation))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, turn = sent.value
        for whole in batches:
            if not whole.num_rows:
                continue
            turned = (_matrix(whole.column(1), whole.num_rows) - middle) @ turn.T
            far = np.sqrt((turned**2).sum(axis=1))
            signs = turned > 0
            match = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / np.where(far > 0, far, 1)
            codes = np.packbits(signs, axis=1)
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(np.where(far > 0, match, 1.0)), whole.column(1)], ["id", "code", "far", "match", "vector"])

    coded = rows.mapInArrow(encode, "id bigint, code binary, far double, match double, vector array<double>")
    return Index(materialize(coded, "codes"), centre, rotation)


def search(index: Index, queries: DataFrame, k: int = 10, error: float = ERROR, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each distinct query (id, vector), nearest first.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id, a query
    never finds its own id, and all candidates come if there are fewer than ``k``. Queries go through the index in blocks of
    about ``block``. The driver holds one block at a time and writes its results before the next; each task keeps ``k`` rows
    for each query of its block.
    """
    queries = queries.distinct()
    blocks = max(1, -(-queries.count() // block))
    parts = [_search_block(index, queries.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == b), k, error) for b in range(blocks)]
    return reduce(DataFrame.union, parts)


def _search_block(index: Index, queries: DataFrame, k: int, error: float) -> DataFrame:
    asked = queries.select("id", "vector").orderBy("id", "vector").collect()
    ids = np.array([r["id"] for r in asked], np.int64)
    original = np.array([r["vector"] for r in asked], np.float64).reshape(len(asked), len(index.centre))
    sent = index.rows.sparkSession.sparkContext.broadcast((ids, original, index.centre, index.rotation))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, centre, rotation = sent.value
        if not len(q_ids):
            return
        nearest = _Nearest(q_ids, q, (q - centre) @ rotation.T, k, error)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLAB):
                part = whole.slice(lo, SLAB)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                nearest.add(part.column(0).to_numpy(), codes, part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), part.num_rows))
        at, place = np.nonzero(np.isfinite(nearest.squares))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(q_ids[at], pa.int64()), pa.array(nearest.found[at, place], pa.int64()), pa.array(np.sqrt(nearest.squares[at, place]))], ["query", "query_id", "vec_id", "score"])

    found = index.rows.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    ranked = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
    sent.unpersist()
    return ranked


class _Nearest:
    """The nearest vectors of each query among those seen so far in a task."""

    def __init__(self, ids: np.ndarray, original: np.ndarray, turned: np.ndarray, k: int, error: float):
        self.q_ids, self.original, self.k, self.error = ids, original, k, error
        self.wide = turned.shape[1]
        self.away = np.sqrt((turned**2).sum(axis=1))
        self.squares = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        # Coordinates rounded to steps from the smallest one; bit b of all steps is one packed plane.
        self.least = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.least) / (2**QUERY_BITS - 1), 1e-300)
        steps = np.rint((turned - self.least[:, None]) / self.step[:, None]).astype(np.uint8)
        self.sums = steps.sum(axis=1, dtype=np.int64)
        self.planes = np.stack([np.packbits((steps >> b) & 1, axis=1).view(np.uint64) for b in range(QUERY_BITS)], axis=1)

    def _inner(self, i: int, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of a rounded query with the signs of all codes."""
        common = sum(np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << b for b, plane in enumerate(self.planes[i]))
        return self.step[i] * (2 * common - self.sums[i]) + self.least[i] * (2 * ones - self.wide)

    def add(self, ids: np.ndarray, codes: np.ndarray, far: np.ndarray, match: np.ndarray, vectors: np.ndarray) -> None:
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        scale = far / match / np.sqrt(self.wide)
        spread = far * np.sqrt(np.maximum(0, 1 - match**2)) / match / np.sqrt(max(1, self.wide - 1))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, own in enumerate(self.q_ids):
            # Deviations of the code's estimate and of the query's rounding, which is uniform within a step.
            slack = 2 * self.error * np.hypot(self.away[i] * spread, scale * self.step[i] * np.sqrt(self.wide / 12))
            middle = far**2 + self.away[i] ** 2 - 2 * scale * self._inner(i, codes, ones)
            other = ids != own
            limit = self.squares[i, -1]
            if other.sum() > self.k:
                limit = min(limit, np.partition(np.where(other, middle + slack, np.inf), self.k - 1)[self.k - 1])
            place = np.flatnonzero((middle - slack <= limit * (1 + 1e-6) + 1e-9) & other)
            held.append((np.full(len(place), i), place))
            if sum(len(p) for _, p in held) >= PAIRS or i == len(self.q_ids) - 1:
                at, place = (np.concatenate(x) for x in zip(*held, strict=True))
                for x in range(0, len(at), PAIRS):
                    self._rerank(at[x : x + PAIRS], ids, place[x : x + PAIRS], vectors)
                held = []

    def _rerank(self, at: np.ndarray, ids: np.ndarray, place: np.ndarray, vectors: np.ndarray) -> None:
        square = np.zeros(len(at))
        for j in range(vectors.shape[1]):  # in order of the components, so that the sum is the same everywhere
            apart = vectors[place, j] - self.original[at, j]
            square += apart * apart
        touched = np.unique(at)
        at = np.concatenate([at, np.repeat(touched, self.k)])
        square = np.concatenate([square, self.squares[touched].ravel()])
        found = np.concatenate([ids[place], self.found[touched].ravel()])
        order = np.lexsort((found, square, at))
        at, square, found = at[order], square[order], found[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        top = rank < self.k
        self.squares[at[top], rank[top]], self.found[at[top], rank[top]] = square[top], found[top]


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, error: float = ERROR, bits: int = CODE_BITS) -> DataFrame:
    """``search`` of the index of ``vectors`` by those of its usable rows whose ``id`` meets the condition ``is_query``.

    Vectors that are null, zero, or have a null or non-finite component take no part. A query's candidates are the vectors of its own
    length; each length has an index. Rows that share an id are candidates each, and queries each unless they are equal. Ids are
    integers. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = [r[0] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = []
    for n in lengths:
        index = build_index(rows.where(F.size("vector") == n), bits)
        found.append(search(index, index.rows.where(is_query).select("id", "vector"), k, error))
    none = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    return reduce(DataFrame.union, found) if found else none
