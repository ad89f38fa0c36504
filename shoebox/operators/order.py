"""Running counts over long ordered runs of rows, without a window that holds a whole run in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.sources.files import scratch


def running_counts(rows: DataFrame, keys: list[str], order: list[Column], counted: Column, name: str = "before") -> DataFrame:
    """``rows`` and, of every row, how many ``counted`` ones with equal ``keys`` stand before it in ``order``, which must be total.

    Rows are sorted into ranges of (keys, order) and written, so that the ranges stay. A key's rows then lie in consecutive ranges:
    each range is counted by itself, and gets the sum of those before it from one row for each range and key.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{scratch(spark)}/ranges"
    dealt = rows.withColumn("_on", F.coalesce(counted, F.lit(False)).cast("bigint")).repartitionByRange(ranges, *keys, *order)
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_on").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.withColumn("_inside", F.coalesce(F.sum("_on").over(inside), F.lit(0)))
    return counts.join(offsets, [*keys, "_range"]).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_on", "_range", "_offset", "_inside")
