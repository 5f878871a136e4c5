"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)`` for every id with an edge; ``component``
    is the smallest id that can be reached.

    Alternates large-star and small-star steps until the edges no longer change:
    O(log n) rounds on any shape, each an aggregation by node whose hot keys
    are pre-aggregated, each written to the shared folder. Nothing but a row
    count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    now, path = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = _print(now)
    while seen[0]:
        new, new_path = materialize(_small_star(_large_star(now)), "edges")
        discard(spark, path)
        now, path, before, seen = new, new_path, seen, _print(new)
        if seen == before:
            break
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).head()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node links to the node's least neighbour (or the node)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )
