"""Distributed connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on vertices, and is written to the shared folder, so lineage stays short and an
executor that goes takes nothing with it. Vertices with a great part of the edges (hubs) do not meet in one task: see skew_join.
Nothing about vertices or components reaches the driver, only counts, one checksum and the hubs, which are fewer than HUBS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, table


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns v, root for each vertex other than its component's smallest; root is that smallest vertex.

    Loops, repeated edges and either direction are allowed; null ends are left out; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("root")).distinct()
    e = table(e, "edges")
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)")).alias("s"), F.count_distinct("v").alias("d"))
    last = e.agg(sign.alias("x")).first().x
    # an edge set in which each vertex has one edge, to a vertex without one, is a forest of stars: the answer
    while last.n:
        both = e.union(e.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.least(F.min("root"), F.col("v")).alias("m"), F.count("*").alias("n"))
        large = skew_join(both, least, ["v"], "n", 2 * last.n).where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct()
        down = large.where("v > root")
        low = down.groupBy("v").agg(F.min("root").alias("m"), F.count("*").alias("n"))
        small = skew_join(down, low, ["v"], "n", last.n).select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("root")), F.struct(F.col("root").alias("v"), F.col("m").alias("root")))).alias("x")).select("x.*").where("v > root").distinct()
        e = table(small, "edges")
        now = e.agg(sign.alias("x")).first().x
        if now == last:
            break
        last = now
    return e
