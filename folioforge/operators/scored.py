"""Score-aware retrieval over two stores: hits among child vectors, composed with their parents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import relevance
from folioforge.operators import compose
from folioforge.operators.retrieve import mmr, vector_search

SEARCHES = ("similarity", "similarity_score_threshold", "mmr")
SEPARATOR = "\n\n--- MATCHED CHILD CHUNK ---\n\n"


@dataclass(frozen=True)
class Search:
    """``similarity``: the k nearest, without scores. ``similarity_score_threshold``: those of them
    with a relevance of ``threshold`` or more, with it as their score. ``mmr``: k diverse ones of the
    ``fetch`` nearest, ``weight`` being that of nearness against diversity."""

    kind: str = "similarity"
    threshold: float | None = None
    fetch: int = 20
    weight: float = 0.5

    def __post_init__(self) -> None:
        if self.kind not in SEARCHES:
            raise ValueError(f"unknown search {self.kind!r}")


def search_children(queries: DataFrame, vectors: DataFrame, search: Search, k: int, key: str) -> DataFrame:
    """``query_id, rank, <key>, score`` of each query's hits."""
    if search.kind == "mmr":
        return mmr(queries, vectors, k, search.fetch, search.weight, key=key).select("query_id", "rank", key, F.lit(None).cast("double").alias("score"))
    hits = vector_search(queries, vectors, k, key=key)
    if search.kind == "similarity":
        return hits.withColumn("score", F.lit(None).cast("double"))
    scored = hits.withColumn("score", relevance(F.col("score")))
    return scored if search.threshold is None else scored.where(F.col("score") >= search.threshold)


def retrieve_scored(
    queries: DataFrame, vectors: DataFrame, children: DataFrame, parents: DataFrame, search: Search = Search(), hydration: str = "parents_replace", *, k: int = 4, key: str = "vec_id", separator: str = SEPARATOR
) -> DataFrame:
    """From ``queries(query_id, embedding)`` to composed results in one plan: hits among
    ``vectors(<key>, embedding)``, their ``children(id, parent_id, content)``, the scores of hits and (the greatest of the
    query's own hits) of parents, and ``parents(parent_id, parent_content)`` by the mode of hydration.
    Parents that the store lacks are tolerated. Returns ``query_id, position, id, content, score``."""
    hits = search_children(queries, vectors.select(key, "embedding"), search, k, key)
    found = hits.join(children, hits[key] == children["id"]).select("query_id", "rank", "id", "parent_id", "content", "score")
    return compose.hydrate(found, parents, hydration, separator)
