"""Connected components by alternating large and small stars.

Each round replaces every node's links by links to its smallest neighbour; the number of
rounds grows with the logarithm of the component's diameter. A node's neighbours are never
collected: only their minimum is, with partial aggregation, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.base import discard, staged


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links ``(high, low)``, low < high, moved to the smallest neighbour."""
    seen = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    if both_ways:
        seen = seen.unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    moved = seen.join(least.withColumn("m", F.least("m", "u")), "u")
    if both_ways:
        links = moved.where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:
        links = moved.select(F.col("v").alias("high"), F.col("m").alias("low")).unionByName(
            least.select(F.col("u").alias("high"), F.col("m").alias("low"))
        )
    return links.where("high <> low").distinct()


def _print(edges: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    total = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every linked node; the component is its smallest node."""
    pairs = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct()
    edges = staged(pairs, "links")
    before = _print(edges)
    while True:
        last = edges
        edges = staged(_star(_star(edges, True), False), "stars")
        discard(last)
        after = _print(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
