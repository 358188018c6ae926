"""Sums over ordered blocks without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_GROUP = 4096


def sums_before(blocks: DataFrame, at: str, n: str, name: str) -> DataFrame:
    """blocks, a row for each number `at`, with the sum of n over all smaller numbers. Only a row for each _GROUP numbers meets in
    one task."""
    earlier = lambda by, value: F.coalesce(F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = blocks.withColumn("_g", F.floor(F.col(at) / _GROUP))
    top = grouped.groupBy("_g").agg(F.sum(n).alias("_s"))
    top = top.select("_g", earlier(Window.partitionBy().orderBy("_g"), "_s").alias("_earlier"))
    inside = earlier(Window.partitionBy("_g").orderBy(at), n)
    return grouped.join(top, "_g").withColumn(name, F.col("_earlier") + inside).drop("_g", "_earlier")
