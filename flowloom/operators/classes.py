"""Classes of linked rows: connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import materialise


def _minimal(links: DataFrame) -> DataFrame:
    """Every node with the smallest of itself and its neighbours; one row per node and task is shuffled."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    return least.select("node", F.least("node", "least").alias("least"))


def linked_classes(links: DataFrame) -> DataFrame:
    """(node, class) for every node of ``links(a, b)``: the smallest node that links lead to.

    Each turn points every node's larger neighbours, and then its smaller ones, to the smallest node that it
    sees.  Paths at least halve, so the number of turns follows the logarithm of the longest
    one.  Turns are stored in the shared folder.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges.distinct())
    while True:
        least = _minimal(edges)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours (and the node itself) point to the smallest.
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("node")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.where("node <> least").select("node", "least"))
            .distinct()
        )
        large = materialise(large)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node"))
            .where("b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b")))
            .distinct()
        )
        small = materialise(small)
        # Settled when every node has one link and no target has a link of its own.
        targets = small.select(F.col("b").alias("a")).distinct()
        several = small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        if several.isEmpty() and targets.join(small, "a", "left_semi").isEmpty():
            break
        edges = small
    return small.select(F.col("a").alias("node"), F.col("b").alias("class")).union(
        small.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct()
    )
