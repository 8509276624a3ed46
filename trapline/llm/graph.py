"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.withColumnRenamed("m", "b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest reachable node) of every node of ``edges(a, b)``.

    Alternates large and small stars until nothing changes, which takes a number of rounds that grows
    with the logarithm of the longest path. Each round is a few shuffles of edges, and is stored in the
    shared folder; only a count and a checksum reach the driver. The mins combine on the map side
    and the joins can be split where a node has many neighbours. Links of a node to itself and repeated links do no
    harm; a missing end drops the link. No edges: no rows.
    """
    current = settle(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        mark = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            break
        seen = mark
        current = settle(_small_star(_large_star(current).distinct()).distinct())
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
