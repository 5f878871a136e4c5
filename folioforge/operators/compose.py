"""Composition of ranked lists: fusion, reranking, parent hydration."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of ranked lists that a task fuses, where their number is known.
TASK_ROWS = 1 << 18


def rrf(lists: list[DataFrame], weights: list[float] | None = None, c: int = 60, key: str = "content", most: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ``(query_id, <key>, rank)`` lists. A key that a
    list has twice counts at its first rank. ``most``: a bound of the rows of a list, if one is at hand; queries are then
    spread over so many tasks that each fuses about ``TASK_ROWS`` of them, however small the rows are when shuffled."""
    if not lists:
        raise ValueError("nothing to fuse")
    weights = weights or [1 / len(lists)] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight a list")
    parts = None
    for i, one in enumerate(lists):
        part = one.select("query_id", key, "rank", F.lit(i).alias("_list"))
        parts = part if parts is None else parts.unionByName(part)
    if most is not None:
        parts = parts.repartition(max(1, -(-most * len(lists) // TASK_ROWS)), "query_id")
    first = [F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(lists))]
    terms = [F.coalesce(F.lit(float(w)) / (F.col(f"_r{i}") + c), F.lit(0.0)) for i, w in enumerate(weights)]
    fused = parts.groupBy("query_id", key).agg(*first).select("query_id", key, reduce(add, terms).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)))


def vector_graph_hybrid(vector: DataFrame, graph: DataFrame, weights: tuple[float, float] = (0.7, 0.3), key: str = "content", most: int | None = None) -> DataFrame:
    return rrf([vector, graph], list(weights), key=key, most=most)


def rerank(hits: DataFrame, score: Column, n: int = 5, min_ratio: float = 0.0, tie: str = "rank") -> DataFrame:
    """Score every hit, keep those of ``min_ratio`` times the query's best or more, best n
    first. With a negative best and a positive ratio nothing is kept."""
    w = W.partitionBy("query_id")
    scored = hits.withColumn("rerank_score", score)
    kept = scored.withColumn("_max", F.max("rerank_score").over(w)).where(F.col("rerank_score") >= min_ratio * F.col("_max"))
    return kept.withColumn("rerank", F.row_number().over(w.orderBy(F.desc("rerank_score"), tie))).where(F.col("rerank") <= n).drop("_max")


def tournament_rerank(hits: DataFrame, score: Column, size: int = 20, n: int = 5, min_ratio: float = 0.0, most: int | None = None) -> DataFrame:
    """Rounds over consecutive groups of ``size``: the better half (rounded up) of each goes
    on until at most ``size`` are left, which are reranked. Scores are of a single hit,
    so they are computed once. ``most``: the longest list, counted if not given; it sets
    the number of rounds. ``size`` 1 would never end and is refused."""
    if size < 2:
        raise ValueError("a tournament needs groups of two or more")
    left = hits.withColumn("rerank_score", score).withColumn("seat", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    if most is None:
        most = hits.groupBy("query_id").count().agg(F.max("count")).head()[0] or 0
    while most > size:
        group = W.partitionBy("query_id", "group")
        left = left.withColumn("all", F.count(F.lit(1)).over(W.partitionBy("query_id"))).withColumn("group", F.floor((F.col("seat") - 1) / size))
        left = left.withColumn("place", F.row_number().over(group.orderBy(F.desc("rerank_score"), "seat"))).withColumn("n", F.count(F.lit(1)).over(group))
        left = left.where((F.col("all") <= size) | (F.col("place") <= F.ceil(F.col("n") / 2)))
        left = left.withColumn("seat", F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("all") <= size, 0).otherwise(F.col("group")), F.when(F.col("all") <= size, F.col("seat")).otherwise(F.col("place")))))
        left = left.drop("all", "group", "place", "n")
        full, rest = divmod(most, size)
        most = full * math.ceil(size / 2) + math.ceil(rest / 2)
    return rerank(left, F.col("rerank_score"), n, min_ratio, "seat").drop("seat")


def annotate(hits: DataFrame, parent: str = "parent_id", score: str = "score") -> DataFrame:
    """``similarity_score`` of a hit, ``max_similarity_score`` of its parent's hits (its own without a parent)."""
    best = F.max(score).over(W.partitionBy("query_id", parent))
    return hits.withColumn("similarity_score", F.col(score)).withColumn("max_similarity_score", F.when(F.col(parent).isNull(), F.col(score)).otherwise(best))


def ordered_parents(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Distinct parents of each query by their first hit."""
    return hits.where(F.col(parent).isNotNull()).groupBy("query_id", parent).agg(F.min("rank").alias("first_rank"))


HYDRATION = ("parents_replace", "children_enriched", "children_plus_parents")


def hydrate(hits: DataFrame, parents: DataFrame, mode: str = "parents_replace", separator: str = "\n\n") -> DataFrame:
    """Join hits ``(query_id, rank, id, parent_id, content, score)`` with
    ``parents(parent_id, parent_content)``.

    ``parents_replace``: each found parent once, at its first hit; hits without one stay.
    ``children_enriched``: the parent's text before the hit's own.
    ``children_plus_parents``: all hits, then each found parent once.
    Missing parents are tolerated. Returns ``query_id, position, id, content, score``.
    """
    if mode not in HYDRATION:
        raise ValueError(f"unknown mode {mode!r}")
    scored = annotate(hits)
    joined = scored.join(parents.select("parent_id", "parent_content"), "parent_id", "left")
    found = F.col("parent_content").isNotNull()
    if mode == "children_enriched":
        rows = joined.select("query_id", F.lit(0).alias("section"), "rank", F.col("id").cast("string").alias("id"), F.when(found, F.concat("parent_content", F.lit(separator), "content")).otherwise(F.col("content")).alias("content"), F.col("similarity_score").alias("score"))
    else:
        per = W.partitionBy("query_id", "parent_id").orderBy("rank")
        first = joined.where(found).withColumn("_n", F.row_number().over(per)).where("_n = 1")
        up = first.select("query_id", F.lit(0 if mode == "parents_replace" else 1).alias("section"), "rank", F.col("parent_id").cast("string").alias("id"), F.col("parent_content").alias("content"), F.col("max_similarity_score").alias("score"))
        keep = joined.where(~found) if mode == "parents_replace" else joined
        down = keep.select("query_id", F.lit(0).alias("section"), "rank", F.coalesce(F.col("parent_id").cast("string") if mode == "parents_replace" else F.lit(None).cast("string"), F.col("id").cast("string")).alias("id"), "content", F.col("similarity_score").alias("score"))
        rows = up.unionByName(down)
    position = F.row_number().over(W.partitionBy("query_id").orderBy("section", "rank", "id"))
    return rows.select("query_id", position.alias("position"), "id", "content", "score")


def dual_storage(hits: DataFrame, store: DataFrame, key: str = "parent_id") -> DataFrame:
    """Distinct keys of the hits in order of first sight, looked up in a document store."""
    ids = ordered_parents(hits, key)
    return ids.join(store, key).withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("first_rank")))


def auto_ensemble_rerank(lists: list[DataFrame], scorer: Callable[[DataFrame], Column], n: int = 5, min_ratio: float = 0.0, key: str = "content") -> DataFrame:
    """Fuse several lists (or take the one), then a tournament of ten."""
    base = rrf(lists, key=key) if len(lists) > 1 else lists[0]
    return tournament_rerank(base, scorer(base), 10, n, min_ratio)
