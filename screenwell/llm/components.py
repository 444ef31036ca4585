"""Connected components of a link table, by alternating star steps.

A large step links every larger neighbour of a node to the least node around it, a small step every smaller one;
repeated, both leave each node linked to the least of its component.  Each step is a pre-aggregated minimum and a join
back, so a node with many links is met in parts, and its result is written to the shared folder.  Only two sums
of a round come to the driver, to see that nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwell.llm.common import written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: (a, b) with a > b.  Larger: around every node; smaller: around the upper end of its links only."""
    around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        around = around.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if larger:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, root): every linked node with the least node of its component.

    Order and direction of links, repeats and links of a node to itself do not matter; nulls must not occur.
    """
    now = written(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = written(_star(_star(now, True), False), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
