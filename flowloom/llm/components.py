"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates two star steps until only stars are left: every node hands its larger neighbours,
    then its smaller ones, to the smallest node it knows.  Each step is a grouped minimum
    (combined map side) and a join, so a node with very many neighbours is no single group.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = stored(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        # Done when every node hangs on one node that hangs on none.
        ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(links.select("v", F.lit(None).cast("int")).distinct())
        if ends.groupBy("n").agg(F.count("*").alias("times")).where("times > 1").isEmpty():
            break
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
