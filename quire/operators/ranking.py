"""Row numbers within groups of any size, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import stored


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... within each group by ``order``.

    Rows are dealt by ranges of (group, order), so a crowded group lies in several ranges. A row's
    number is its place in its range plus the rows of its group in the ranges before; only the
    counts by group and range meet, at most one for each group and range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)).cast("long")
    return dealt.withColumn("_place", place).join(counts, [*group, "_range"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_place", "_before", "_range")
