"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.sources.storage import settled


def _checksum(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(mixed)).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour instead."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
    return (
        both.join(least, "a")
        .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("least")))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    others = (
        links.join(least, "a")
        .where(F.col("b") != F.col("least"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
    )
    return others.union(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes but the roots; a root is the smallest of its component.

    ``links`` has the columns ``a`` and ``b``; order, repetition and links of a
    node to itself do not matter. Stars alternate until nothing changes, which
    takes about as many rounds as the logarithm of the largest component. Each
    round is written to shared storage, so a lost executor costs one round, and
    is never larger than the links of the round before.
    """
    spark = links.sparkSession
    links = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = settled(spark, links.distinct(), "links")
    known = _checksum(links)
    while known[0]:
        links = settled(spark, _small_star(_large_star(links)), "links")
        found = _checksum(links)
        if found == known:
            break
        known = found
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
