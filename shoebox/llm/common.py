"""Scratch tables and small helpers for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's setting that removes shuffle files when an execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of packed rows that one group of a Python function gets, about.
BIN_BYTES = 32 << 20
#: A key is hot if more than one in so many of the counted rows has it.
HOT_SHARE = 1000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may fall back to a machine-local folder; on a cluster a missing setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shoebox-")
    return f"{base.rstrip('/')}/shoebox-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back, which cuts its lineage.

    The shuffle files of the write go as soon as it is done: what was written is whole, and the next step starts with free disks.
    """
    spark = df.sparkSession
    path, schema = f"{scratch_dir(spark)}/{name}", df.schema
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bins_for(spark: SparkSession, n_bytes: int, times: int = 4) -> int:
    """Number of hash bins for packed rows of about ``n_bytes`` together: at most ``BIN_BYTES`` each, and some for each shuffle
    partition, so that bins stay small and even at every size."""
    return max(times * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BIN_BYTES))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0


def join_back(left: DataFrame, right: DataFrame, key: str, rows: str = "n", total: int | None = None, counts: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` by the equal column ``key``, a left join in which no key makes a task large.

    ``key`` is unique and not null in ``right``. Rows of ``left`` with a null key are not shuffled. Nor are those with a key that more
    than a ``HOT_SHARE``-th of the rows have, whether ``right`` has it or not: there are fewer than ``HOT_SHARE`` such keys whatever the
    size of the tables, so these keys and their rows of ``right`` are broadcast.

    ``counts`` (``key``, ``rows``) tells how many rows of ``left`` have each key. Without it, ``right`` has the column ``rows`` (which is
    dropped) and must have all frequent keys. ``total`` is the number of rows of ``left``, if it is known. ``prepare`` is applied to the
    two parts of ``left`` before they are joined, so that what it computes is computed once for each row.
    """
    if counts is None:
        if total is None:
            right = materialize(right, "right")
            total = right.agg(F.sum(rows)).first()[0] or 0
        is_hot = F.col(rows) * HOT_SHARE > total
        held, right = right.where(is_hot).drop(rows), right.where(~is_hot).drop(rows)
        hot = held.select(key)
    else:
        total = left.count() if total is None else total
        hot = materialize(counts.where(F.col(rows) * HOT_SHARE > total).select(key), "hot")
        held = hot.join(right, key, "left")
    flag = "hot"
    while flag in left.columns or flag in right.columns:
        flag += "_"
    cold = left.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti")
    if prepare is None:
        near = left.join(F.broadcast(held.withColumn(flag, F.lit(True))), key, "left").where(F.col(key).isNull() | F.col(flag)).drop(flag)
        return near.unionByName(cold.join(right, key, "left"))
    near = left.join(F.broadcast(hot.withColumn(flag, F.lit(True))), key, "left").where(F.col(key).isNull() | F.col(flag)).drop(flag)
    return prepare(near).join(F.broadcast(held), key, "left").unionByName(prepare(cold).join(right, key, "left"))


def ordered_ids(rows: DataFrame, by: list[str]) -> DataFrame:
    """(``by``…, row_id): a bigint for each distinct tuple of ``by``, in their order, from a range sort; written, so that it stays."""
    spark = rows.sparkSession
    distinct = rows.select(*by).distinct()
    dealt = distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    return materialize(dealt.withColumn("row_id", F.monotonically_increasing_id()), "ids")


def packed(bins: np.ndarray, n_bins: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """For each non-empty bin, the bytes of its rows of every column."""
    order = np.argsort(bins, kind="stable")
    edges = np.searchsorted(bins[order], np.arange(n_bins + 1))
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), [c[edges[b] : edges[b + 1]].tobytes() for c in columns]


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """All values packed in a binary column, in row order."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def lower_ascii(column):
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value, body):
    """``body`` of a column that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def carried(docs: DataFrame, carry: bool) -> list:
    """The column that takes whole input rows through an operator, if asked for; inside it no name can clash."""
    return [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if carry else []


def with_row(schema: str, source: DataFrame) -> T.StructType:
    """A schema, and the column ``row`` of ``source`` behind it if there is one."""
    found = T.StructType.fromDDL(schema)
    return T.StructType([*found.fields, *(f for f in source.schema.fields if f.name == "row")])
