"""Knowledge-graph retrieval as one plan for many queries: local, global, hybrid and mix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import TOKEN, STOPWORDS, clamp, content_hash, overlap, py_strip, token_estimate
from folioforge.operators import graph
from folioforge.operators.models import complete
from folioforge.schema import KIND_RANK
from folioforge.session import cut

MODES = ("local", "global", "hybrid", "mix")


class GraphConfigurationError(ValueError):
    """A knob out of range or a table that isn't given."""


class GraphDataError(ValueError):
    """Data against a stated contract."""


@dataclass(frozen=True)
class GraphQuery:
    mode: str = "hybrid"
    entities: int = 12
    relations: int = 24
    chunks: int = 10
    hops: int = 2
    min_score: float = 0.0
    rerank: bool = True
    budget_total: int = 3500
    budget_chunks: int = 1900
    budget_relations: int = 900
    budget_entities: int = 700

    def check(self) -> None:
        if self.mode not in MODES:
            raise GraphConfigurationError(f"unknown mode {self.mode!r}")
        if min(self.entities, self.relations, self.chunks) <= 0:
            raise GraphConfigurationError("the numbers of entities, relations and chunks must be positive")
        if self.hops < 0:
            raise GraphConfigurationError("hops must be 0 or more")


@dataclass(frozen=True)
class GraphTables:
    """``nodes``, ``edges`` (with edge_id), ``chunks(segment_id, content)`` and optionally
    ``communities(query_id, community_id, content, score, source_segment_id)`` and
    ``chunk_scores(query_id, segment_id, score)``, a vector search's hits."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    chunk_scores: DataFrame | None = None
    communities: DataFrame | None = None


def keywords(query: Column) -> tuple[Column, Column]:
    """High and low level keywords: tokens without stopwords (the lower query if none is
    left), in order; high: the two longest, ties by alphabet; low: the first twelve."""
    found = F.regexp_extract_all(F.lower(query), F.lit(TOKEN), F.lit(1))
    kept = F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOPWORDS)))
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(py_strip(F.lower(query))))
    longest = F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(longest, 1, 2), lambda s: s["t"]), F.slice(kept, 1, 12)


def model_keywords(queries: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """``queries`` with ``high`` and ``low`` keywords by a model that answers in JSON (``{"high": [...], "low": [...]}``).
    Where it fails, or leaves one of them empty, both are those of ``keywords``. ``retrieve`` uses such columns."""
    answer = F.from_json(complete(F.col("query"), model)["value"], "high array<string>, low array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(py_strip(t))), lambda t: t != ""))
    rows = queries.withColumn("_a", answer).withColumn("_high", clean(F.col("_a.high"))).withColumn("_low", clean(F.col("_a.low")))
    both = (F.size("_high") > 0) & (F.size("_low") > 0)
    high, low = keywords(F.col("query"))
    return rows.withColumn("high", F.when(both, F.col("_high")).otherwise(high)).withColumn("low", F.when(both, F.col("_low")).otherwise(low)).drop("_a", "_high", "_low")


def render_entity() -> Column:
    return F.concat(F.lit("Entity: "), "label", F.lit("\nType: "), "type", F.lit("\nDescription: "), F.coalesce(F.nullif("description", F.lit("")), F.lit("No description")))


def render_relation() -> Column:
    return F.concat("source_id", F.lit(" -["), "relation_type", F.lit("]-> "), "target_id", F.lit("\nWeight: "), F.col("weight").cast("string"))


def evidence_key() -> Column:
    """What evidence is one: its source segment, else its content, else its kind and id.
    An entity and the chunk that it came from are one."""
    hashed = F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0, F.concat(F.lit("h:"), content_hash(F.col("content"))))
    return F.coalesce(F.concat(F.lit("s:"), F.nullif("source_segment_id", F.lit(""))), hashed, F.concat_ws(":", F.lit("k"), "kind", "evidence_id"))


def stable_order() -> list[Column]:
    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    return [F.element_at(rank, F.col("kind")), F.col("evidence_id"), F.coalesce("source_segment_id", F.lit("")), content_hash(F.col("content"))]


def dedupe(items: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id", "_key").orderBy(F.desc("score"), *stable_order())
    return items.withColumn("_key", evidence_key()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of evidence: 0.55 of the best score + 0.45 of the fused one."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), *stable_order())
    ranked = None
    for i, one in enumerate(rankings):
        part = one.withColumn("_rank", F.row_number().over(w)).withColumn("_list", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    ranked = ranked.withColumn("_key", evidence_key())
    same = W.partitionBy("query_id", "_key")
    best = ranked.withColumn("_rrf", F.sum(1.0 / (k + F.col("_rank"))).over(same)).withColumn("_n", F.row_number().over(same.orderBy(F.desc("score"), "_list", "_rank"))).where("_n = 1")
    most = F.max("_rrf").over(W.partitionBy("query_id"))
    return best.withColumn("score", clamp(0.55 * F.col("score") + 0.45 * F.col("_rrf") / most)).drop("_rrf", "_n", "_key", "_rank", "_list")


def minmax(scores: DataFrame, strict: bool = False) -> DataFrame:
    """Scores outside [0, 1] are an error (``strict``) or stretched to it by query; where
    all are equal they become 0.5. Queries within [0, 1] stay as they are."""
    if strict:
        ok = F.when((F.col("score") >= 0) & (F.col("score") <= 1), F.col("score"))
        return scores.withColumn("score", F.coalesce(ok, F.raise_error(F.lit("a score outside [0, 1]")).cast("double")))
    ends = scores.groupBy("query_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))  # no query's rows in one task
    lo, hi = F.col("_lo"), F.col("_hi")
    stretched = F.when(hi - lo <= 1e-12, F.lit(0.5)).otherwise((F.col("score") - lo) / (hi - lo))
    joined = scores.join(ends, scores["query_id"].eqNullSafe(ends["query_id"])).drop(ends["query_id"])
    return joined.withColumn("score", F.when((lo < 0) | (hi > 1), stretched).otherwise(F.col("score"))).drop("_lo", "_hi")


def pick_budget(items: DataFrame, budget: int, order: list, partition: str = "query_id") -> DataFrame:
    """Greedy picks by budget: the first item always, a later one that would overflow is
    passed over, and a spent budget ends it. A fold over each query's short ordered list."""
    fields = [c for c in items.columns if c != partition]
    cost = items.withColumn("_cost", token_estimate(F.col("content"))).withColumn("_order", F.row_number().over(W.partitionBy(partition).orderBy(*order)))
    grouped = cost.groupBy(partition).agg(F.sort_array(F.collect_list(F.struct("_order", "_cost", F.struct(*fields).alias("item")))).alias("all"))
    return _fold(grouped, partition, F.lit(budget))


def finalize(queries: DataFrame, items: DataFrame, config: GraphQuery, k: int | None = None) -> DataFrame:
    """Dedup, rerank by overlap, least score, budgets by kind and in all, k best."""
    ranked = dedupe(items)
    if config.rerank:
        ranked = ranked.join(queries.select("query_id", "query"), "query_id").withColumn("score", clamp(0.75 * F.col("score") + 0.25 * overlap(F.col("query"), F.col("content")))).drop("query")
    ranked = cut(ranked.where(F.col("score") >= config.min_score))
    order = [F.desc("score"), *stable_order()]
    parts = []
    for i, (kind, budget) in enumerate((("chunk", config.budget_chunks), ("relation", config.budget_relations), ("entity", config.budget_entities))):
        parts.append(pick_budget(ranked.where(F.col("kind") == kind), budget, order).withColumn("section", F.lit(i)))
    chosen = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    spent = chosen.groupBy("query_id").agg(F.sum(token_estimate(F.col("content"))).alias("spent"))
    community = ranked.where("kind = 'community'").join(spent, "query_id", "left")
    w = W.partitionBy("query_id").orderBy(*order)
    rest = community.withColumn("_room", F.greatest(F.lit(config.budget_total) - F.coalesce("spent", F.lit(0)), F.lit(0))).drop("spent")
    rest = _pick_with_room(rest, order).withColumn("section", F.lit(3))
    total = pick_budget(chosen.unionByName(rest).withColumnRenamed("picked", "_place"), config.budget_total, ["section", "_place"])
    if k is not None:
        total = total.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("picked"))).where(F.col("_n") <= k).drop("_n")
    return total.select("query_id", F.row_number().over(w).alias("rank"), "kind", "evidence_id", "content", "score", "source_segment_id")


def retrieve(queries: DataFrame, tables: GraphTables, config: GraphQuery = GraphQuery(), k: int | None = None) -> DataFrame:
    """``queries(query_id, query[, embedding])`` -> ranked evidence. Blank queries give none."""
    config.check()
    if config.mode == "mix" and tables.chunk_scores is None:
        raise GraphConfigurationError("mix needs the hits of a vector search")
    queries = queries.where(F.length(py_strip(F.coalesce("query", F.lit("")))) > 0).withColumn("query", py_strip(F.col("query")))
    priors = cut(graph.node_priors(tables.nodes, tables.edges))
    if config.mode == "local":
        items = local(queries, tables, priors, config)
    elif config.mode == "global":
        items = global_(queries, tables, priors, config)
    else:
        items = fuse([local(queries, tables, priors, config), global_(queries, tables, priors, config)])
        if config.mode == "mix":
            near = tables.chunk_scores.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "segment_id"))).where(F.col("_n") <= 2 * config.chunks).drop("_n")
            items = fuse([items, _chunk_items(queries, with_texts(near, tables.chunks))])
    return finalize(queries, items, config, k)


def _asked(queries: DataFrame, level: int) -> DataFrame:
    """The query and its keywords of a level, each a query of its own."""
    given = ("high", "low")[level]
    words = F.col(given) if given in queries.columns else keywords(F.col("query"))[level]
    vector = ["embedding"] if "embedding" in queries.columns else []
    each = queries.select(F.col("query_id").alias("_of"), F.col("query").alias("_whole"), *vector, F.explode(F.array_distinct(F.concat(F.array("query"), words))).alias("query"))
    # the vector is that of the whole query
    own = [F.when(F.col("query") == F.col("_whole"), F.col("embedding")).alias("embedding")] if vector else []
    return each.select(F.struct("_of", "query").alias("query_id"), "query", *own)


def _best_of(hits: DataFrame, key: str, n: int) -> DataFrame:
    best = hits.groupBy(F.col("query_id._of").alias("query_id"), key).agg(F.max(clamp(F.col("score"))).alias("seed_score"))
    w = W.partitionBy("query_id").orderBy(F.desc("seed_score"), key)
    return cut(best.withColumn("seat", F.row_number().over(w)).where(F.col("seat") <= n))


def local(queries: DataFrame, tables: GraphTables, priors: DataFrame, config: GraphQuery) -> DataFrame:
    """Entities near the query, the subgraph around them, and the chunks that it comes from."""
    seeds = _best_of(graph.search_nodes_hybrid(_asked(queries, 1), tables.nodes, priors, config.entities), "id", config.entities)
    most = max(config.entities, config.entities * (config.hops + 2))
    nodes, edges = graph.expand(tables.edges, seeds.select("query_id", "id", "seat"), config.hops, most)
    scored = seeds.select("query_id", "id", "seed_score")
    entity = nodes.join(tables.nodes.select("id", "type", "label", "description", "source_segment_id"), "id").join(priors.select("id", "prior"), "id", "left").join(scored, ["query_id", "id"], "left")
    decay = F.pow(F.lit(0.85), F.col("hop"))
    score = 0.45 * F.coalesce("seed_score", F.lit(0.0)) + 0.30 * decay + 0.15 * F.coalesce("prior", F.lit(0.0)) + 0.10 / (1.0 + F.col("hop"))
    entities = entity.select("query_id", F.col("id").alias("evidence_id"), F.lit("entity").alias("kind"), render_entity().alias("content"), clamp(score).alias("score"), "source_segment_id")
    hop = nodes.select("query_id", F.col("id").alias("_id"), "hop").join(scored.withColumnRenamed("id", "_id"), ["query_id", "_id"], "left")
    a = hop.select("query_id", F.col("_id").alias("source_id"), F.col("hop").alias("_ha"), F.col("seed_score").alias("_sa"))
    b = hop.select("query_id", F.col("_id").alias("target_id"), F.col("hop").alias("_hb"), F.col("seed_score").alias("_sb"))
    prior = graph.edge_priors(tables.edges).select("edge_id", F.col("prior").alias("_prior"))
    relation = edges.join(a, ["query_id", "source_id"]).join(b, ["query_id", "target_id"]).join(prior, "edge_id", "left")
    top = F.greatest(F.max(F.abs("weight")).over(W.partitionBy("query_id")), F.lit(1e-300))
    ends = F.greatest(F.coalesce("_sa", F.lit(0.0)), F.coalesce("_sb", F.lit(0.0)))
    rscore = 0.35 * ends + 0.30 * F.pow(F.lit(0.85), F.least("_ha", "_hb")) + 0.25 * F.abs("weight") / top + 0.10 * F.coalesce("_prior", F.lit(0.0))
    relations = relation.select("query_id", F.col("edge_id").alias("evidence_id"), F.lit("relation").alias("kind"), render_relation().alias("content"), clamp(rscore).alias("score"), "source_segment_id")
    items = cut(entities.unionByName(relations))
    return cut(items.unionByName(hydrate_chunks(queries, items, tables.chunks, config.chunks)))


def global_(queries: DataFrame, tables: GraphTables, priors: DataFrame, config: GraphQuery) -> DataFrame:
    """Communities, relations, the entities at their ends, and their chunks."""
    asked = _asked(queries, 0)
    found = graph.search_edges_hybrid(asked, tables.nodes, tables.edges, priors, config.relations)
    best = _best_of(found, "edge_id", config.relations)
    edge = best.join(graph.edge_priors(tables.edges), "edge_id")
    relations = edge.select("query_id", F.col("edge_id").alias("evidence_id"), F.lit("relation").alias("kind"), render_relation().alias("content"), clamp(0.8 * F.col("seed_score") + 0.2 * F.col("prior")).alias("score"), "source_segment_id")
    ends = edge.select("query_id", F.explode(F.array("source_id", "target_id")).alias("id"), "seed_score")
    near = _best_of(graph.search_nodes_hybrid(asked, tables.nodes, priors, config.entities), "id", config.entities).select("query_id", "id", "seed_score")
    scores = ends.unionByName(near).groupBy("query_id", "id").agg(F.max("seed_score").alias("seed_score"))
    w = W.partitionBy("query_id").orderBy(F.desc("seed_score"), "id")
    top = scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= config.entities).drop("_n")
    node = top.join(tables.nodes.select("id", "type", "label", "description", "source_segment_id"), "id").join(priors.select("id", "prior"), "id", "left")
    entities = node.select("query_id", F.col("id").alias("evidence_id"), F.lit("entity").alias("kind"), render_entity().alias("content"), clamp(0.8 * F.col("seed_score") + 0.2 * F.coalesce("prior", F.lit(0.0))).alias("score"), "source_segment_id")
    items = cut(relations.unionByName(entities))
    if tables.communities is not None:
        c = tables.communities.select("query_id", F.col("community_id").cast("string").alias("evidence_id"), F.lit("community").alias("kind"), "content", clamp(F.col("score")).alias("score"), "source_segment_id")
        items = items.unionByName(dedupe(c))
    return cut(items.unionByName(hydrate_chunks(queries, items, tables.chunks, config.chunks)))


def hydrate_chunks(queries: DataFrame, items: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Chunks that the items come from, the k of most overlap with the query."""
    ids = items.where("source_segment_id is not null").select("query_id", F.col("source_segment_id").alias("segment_id")).distinct()
    rows = ids.join(chunks.select("segment_id", "content"), "segment_id").join(queries.select("query_id", "query"), "query_id")
    scored = rows.withColumn("score", clamp(overlap(F.col("query"), F.col("content")))).drop("query")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "segment_id")
    return _chunk_items(queries, scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"))


#: Hits that are sent to all tasks, rather than all texts to the hits.
FEW_HITS = 100_000


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hits of a search with their chunks. They are found and counted first: up to ``FEW_HITS`` meet the
    texts where these are, so no text is shuffled that wasn't hit."""
    hits = cut(hits)
    return (F.broadcast(hits) if hits.count() <= FEW_HITS else hits).join(chunks, "segment_id")


def _chunk_items(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Chunk evidence: 0.75 of the score + 0.25 of the overlap."""
    asked = rows.join(queries.select("query_id", "query"), "query_id")
    score = clamp(0.75 * F.col("score") + 0.25 * overlap(F.col("query"), F.col("content")))
    return dedupe(asked.select("query_id", F.col("segment_id").cast("string").alias("evidence_id"), F.lit("chunk").alias("kind"), "content", score.alias("score"), F.col("segment_id").cast("string").alias("source_segment_id")))


def _pick_with_room(items: DataFrame, order: list) -> DataFrame:
    """``pick_budget`` where each query has its own budget, ``_room``."""
    room = items.groupBy("query_id").agg(F.first("_room").alias("_limit"))
    w = W.partitionBy("query_id").orderBy(*order)
    cost = items.drop("_room").withColumn("_cost", token_estimate(F.col("content"))).withColumn("_order", F.row_number().over(w))
    fields = [c for c in cost.columns if c not in ("query_id", "_cost", "_order")]
    grouped = cost.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_order", "_cost", F.struct(*fields).alias("item")))).alias("all")).join(room, "query_id")
    return _fold(grouped, "query_id", F.col("_limit"))


def _fold(grouped: DataFrame, partition: str, limit: Column) -> DataFrame:
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        passed = (acc["used"] >= limit) | ((acc["n"] > 0) & (acc["used"] + x["_cost"] > limit))
        return F.when(passed, acc).otherwise(F.struct((acc["used"] + x["_cost"]).cast("bigint").alias("used"), (acc["n"] + 1).alias("n"), F.concat(acc["taken"], F.array(x["_order"])).alias("taken")))

    picked = grouped.withColumn("_taken", F.when(limit > 0, F.aggregate("all", start, step)["taken"]).otherwise(F.array().cast("array<int>")))
    kept = picked.select(partition, F.explode(F.filter("all", lambda x: F.array_contains("_taken", x["_order"]))).alias("x"))
    return kept.select(partition, "x.item.*", F.col("x._order").alias("picked"))
