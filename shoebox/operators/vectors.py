"""Cosine similarity of a batch of query vectors with many rows: local top-k in each task, then one window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one pass; they are broadcast.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if one has no length or their sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def top_k(queries: DataFrame, rows: DataFrame, k: int, key: str = "project_id") -> DataFrame:
    """(key, query_id, id, similarity, rank): the ``k`` rows (key, id, vector) most similar to each query (key, query_id,
    vector) with the same key and the same length; ties to the smaller id. Similarities are rounded to 6 places before they are
    compared. Null and empty vectors, and vectors with a null component, take no part.

    Queries pass in blocks of ``BLOCK``; each task sends at most ``k`` rows for each query of a block to the window.
    """
    whole = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
    queries, rows = queries.where(whole), rows.where(whole)
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        part = _scored(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), rows, k, key)
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _scored(queries: DataFrame, rows: DataFrame, k: int, key: str) -> DataFrame:
    asked = queries.select(F.col(key).cast("bigint"), F.col("query_id").cast("bigint"), F.col("vector").cast("array<double>")).orderBy("query_id").collect()
    groups: dict[tuple[int, int], list] = {}
    for r in asked:
        groups.setdefault((r[0], len(r[2])), []).append(r)
    by_key = {own: (np.array([r[1] for r in mine]), _unit(np.array([r[2] for r in mine]))) for own, mine in groups.items()}
    sent = rows.sparkSession.sparkContext.broadcast(by_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {own: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for own in sent.value}
        for whole in batches:
            keys, ids = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            lengths = np.diff(whole.column(2).offsets.to_numpy())
            for own in sorted(set(zip(keys.tolist(), lengths.tolist(), strict=True)) & sent.value.keys()):
                at = np.flatnonzero((keys == own[0]) & (lengths == own[1]))
                vectors = _unit(whole.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1))
                scores = np.round(sent.value[own][1] @ vectors.T, 6) + 0.0
                # What is worse than the k-th of this batch cannot be among the k; ties stay and are ordered by id below.
                least = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(scores), -2.0)
                q, row = np.nonzero(scores >= least[:, None])
                old = best[own]
                best[own] = _first(np.concatenate([old[0], q]), np.concatenate([old[1], ids[at[row]]]), np.concatenate([old[2], scores[q, row]]), k)
        for own, (q, ids, scores) in best.items():
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), own[0])), pa.array(sent.value[own][0][q]), pa.array(ids), pa.array(scores)], [key, "query_id", "id", "similarity"])

    source = rows.select(F.col(key).cast("bigint"), F.col("id").cast("bigint"), F.col("vector").cast("array<double>"))
    return source.mapInArrow(run, f"{key} bigint, query_id bigint, id bigint, similarity double")


def _first(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], ids[top], scores[top]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x, dtype=float), where=norm > 0)


def element_mean(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each key, with the number of them."""
    parts = rows.select(*keys, F.posexplode(vector).alias("place", "x")).groupBy(*keys, "place").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    sums = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("m"), F.max("n").alias("sample_count"))
    return sums.select(*keys, F.transform("m", lambda s: s["x"]).alias("vector"), "sample_count")
