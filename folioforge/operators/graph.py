"""The knowledge graph as two tables: nodes and (parallel, directed) edges."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import cosine, lexical_score_tokens, py_strip, tokens
from folioforge.operators.retrieve import in_blocks
from folioforge.session import cut


def upsert_nodes(stored: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Union of both; of equal ids the row of the greatest ``seq`` stands, with all its attributes."""
    w = W.partitionBy("id").orderBy(F.desc(seq))
    return stored.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """``edge_key`` numbers parallel edges in order of ``seq``; ``edge_id`` is
    ``source|relation|target|key`` where the edge brings none."""
    key = F.row_number().over(W.partitionBy("source_id", "target_id").orderBy(seq)) - 1
    named = edges.withColumn("edge_key", key)
    given = F.col("edge_id") if "edge_id" in edges.columns else F.lit(None).cast("string")
    return named.withColumn("edge_id", F.coalesce(given, F.concat_ws("|", "source_id", "relation_type", "target_id", F.col("edge_key").cast("string"))))


def with_bare_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints that no node row describes become nodes of type ``unknown``, labelled by id."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct().join(nodes.select("id"), "id", "left_anti")
    bare = ends.select("id", F.lit("unknown").alias("type"), F.col("id").alias("label"))
    return nodes.unionByName(bare, allowMissingColumns=True)


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours, without self-loops."""
    a = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    return a.union(a.select("v", "u")).where("u <> v").distinct()


def neighbors(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """``starts(query_id, id)`` -> nodes within ``depth`` steps, undirected, starts excluded."""
    if depth < 1:
        return starts.limit(0).withColumn("hop", F.lit(0))
    steps = both_ways(edges)
    seen = starts.select("query_id", "id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, depth + 1):
        frontier = frontier.join(steps, frontier.id == steps.u).select("query_id", F.col("v").alias("id")).distinct().join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree together, parallel edges counted, a self-loop twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def node_priors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``degree`` and ``prior`` = degree / greatest degree, for every node."""
    d = degrees(edges)
    most = d.agg(F.max("degree").alias("most"))
    joined = nodes.select("id").join(d, "id", "left").crossJoin(F.broadcast(most))
    degree = F.coalesce("degree", F.lit(0))
    return joined.select("id", degree.alias("degree"), F.coalesce(degree / F.col("most"), F.lit(0.0)).alias("prior"))


def edge_priors(edges: DataFrame) -> DataFrame:
    """|weight| / greatest |weight|."""
    most = edges.agg(F.max(F.abs("weight")).alias("most"))
    return edges.crossJoin(F.broadcast(most)).withColumn("prior", F.when(F.col("most") > 0, F.abs("weight") / F.col("most")).otherwise(0.0)).drop("most")


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label or description contains the query, ignoring case; all for an empty one."""
    if not query:
        return nodes
    q = query.lower()
    return nodes.where(F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(q)))


def _blank(query: Column) -> Column:
    return F.length(F.trim(query)) == 0


def _best(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_nodes_hybrid(queries: DataFrame, nodes: DataFrame, priors: DataFrame, k: int = 10) -> DataFrame:
    """0.65 lexical + 0.20 cosine (where both sides have an ``embedding``) + 0.15 prior.

    A query that isn't blank drops nodes without lexical or vector evidence; a blank
    one ranks by the prior. Scores of 0 and less go, 1 is the most; ties by id.
    Queries are a stated set, sent in blocks of a counted size; each task keeps k nodes a query.
    """
    text = F.trim(F.concat_ws(" ", "label", F.coalesce("description", F.lit(""))))
    node = nodes.join(priors.select("id", "prior"), "id", "left").withColumn("_text", text).withColumn("_t", tokens(F.col("_text")))
    scored = _pairs(queries, node, "id").withColumn("_emb", _vector_score(nodes, queries))
    prior = F.coalesce("prior", F.lit(0.0))
    score = F.when(_blank(F.col("query")), 0.15 * prior).otherwise(0.65 * F.col("_lex") + 0.20 * F.col("_emb") + 0.15 * prior)
    kept = scored.where(_blank(F.col("query")) | (F.col("_lex") > 0) | (F.col("_emb") > 0)).withColumn("score", F.least(F.lit(1.0), score)).where("score > 0")
    return _best(kept.select("query_id", "id", "score"), k, F.desc("score"), "id")


FEW = 32
#: Distinct tokens of a few queries that a row is marked with; with more, the pairs are scored one by one.
FEW_WORDS = 64


def _grams(t: Column) -> Column:
    """What tokens are sought by: short ones as they are, long ones by their runs of four characters."""
    return F.array_distinct(F.flatten(F.transform(t, lambda x: F.when(F.length(x) < 4, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.length(x) - 3), lambda i: F.substring(x, i, 4))))))


def _pairs(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A stated set of queries with the rows that can have evidence for them, a block of queries a pass; ``_lex`` is
    the lexical score of a pair.

    Whatever a lexical score counts (a shared token, one token in another, equal beginnings, the query
    as a whole in the text) has a run of four characters in common, or a short token. So
    rows meet queries by an inverted index over these; only queries that are blank or of short tokens
    alone, and those with a vector that rows have as well, are held against all rows. The result is the same,
    so a set of a ``FEW`` queries (read first) is held against all rows, too: that is quicker than to cut all rows up."""
    vectors = "embedding" in rows.columns and "embedding" in queries.columns
    few = False
    if not vectors:
        asked = queries.withColumn("_q", tokens(F.col("query"))).withColumn("_blank", F.coalesce(_blank(F.col("query")), F.lit(False)))
        first = asked.limit(FEW + 1).collect()
        few = len(first) <= FEW
        if few and first and len({w for r in first for w in r["_q"]}) <= FEW_WORDS:
            return _with_few(first, asked.schema, rows).drop("_blank")

    def search(q: DataFrame) -> DataFrame:
        asked = q.withColumn("_q", tokens(F.col("query"))).withColumnsRenamed({"embedding": "_qv"})
        if vectors or few:
            return rows.join(asked, F.lit(True))
        sought = F.exists("_q", lambda x: F.length(x) >= 4)
        grams = asked.where(sought).select("*", F.explode(_grams(F.col("_q"))).alias("_k"))
        found = rows.withColumn("_k", F.explode(_grams(F.col("_t")))).join(F.broadcast(grams), "_k").drop("_k").dropDuplicates(["query_id", key])
        return found.unionByName(rows.join(F.broadcast(asked.where(~sought)), F.lit(True)))

    return in_blocks(queries, search).withColumn("_lex", lexical_score_tokens(F.col("query"), F.col("_q"), F.col("_text"), F.col("_t")))


def _within(t: str, word: str) -> Column:
    """Whether the word has one of the tokens of four and more in it."""
    return F.exists(t, lambda y: (F.length(y) >= 4) & F.contains(F.lit(word), y))


def _with_few(asked: list[Row], schema: T.StructType, rows: DataFrame) -> DataFrame:
    """``_pairs`` of queries that are at hand, without those of no lexical evidence (unless the query is blank).
    A row is marked once with each token of the queries that it has and that it is near to, by plain searches in its tokens
    joined by spaces, which are generated code; scores of all queries are sums of the marks."""
    words = sorted({w for r in asked for w in r["_q"]})
    line = F.col("_line")
    marks = {}
    for j, w in enumerate(words):
        marks[f"_has{j}"] = F.contains(line, F.lit(f" {w} ")).cast("int")
        if len(w) >= 4:
            near = F.contains(line, F.lit(w)) | F.contains(line, F.lit(" " + w[:4]))
            if inner := sorted({w[i : i + 4] for i in range(1, len(w) - 3)}):  # a token within this one begins with one of these
                begins = reduce(or_, [F.contains(line, F.lit(" " + g)) for g in inner]) if len(inner) <= 4 else line.rlike(f" (?:{'|'.join(inner)})")
                near = near | (begins & _within("_t", w))
            marks[f"_near{j}"] = near.cast("int")
    marked = rows.withColumn("_line", F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" "))).withColumn("_low", F.lower("_text")).withColumns(marks)
    scores = []
    for i, r in enumerate(asked):
        lex, n = F.lit(0.0), len(r["_q"])
        if n:
            at = [words.index(w) for w in r["_q"]]
            shared = reduce(add, [F.col(f"_has{j}") for j in at]) / n
            stem = reduce(add, [F.col(f"_near{j}") for j in at if f"_near{j}" in marks], F.lit(0)) / n
            exact = F.when(F.contains("_low", py_strip(F.lower(F.lit(r["query"])))), 1.0).otherwise(0.0)
            lex = F.least(F.lit(1.0), 0.55 * shared + 0.25 * exact + 0.20 * stem)
        scores.append(F.struct(F.lit(i).alias("_i"), lex.alias("_lex")))
    numbered = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(asked)], T.StructType([T.StructField("_i", T.IntegerType()), *schema.fields])).withColumnsRenamed({"embedding": "_qv"})
    blank = [i for i, r in enumerate(asked) if r["_blank"]]
    pairs = marked.select(*rows.columns, F.inline(F.array(*scores))).where((F.col("_lex") > 0) | F.col("_i").isin(blank) if blank else F.col("_lex") > 0)
    return pairs.join(F.broadcast(numbered), "_i").drop("_i")


def _vector_score(rows: DataFrame, queries: DataFrame) -> Column:
    """max(0, cosine) where both sides have an ``embedding`` column; a null one has 0."""
    if "embedding" not in rows.columns or "embedding" not in queries.columns:
        return F.lit(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), cosine(F.col("_qv"), F.col("embedding"))), F.lit(0.0))


def search_edges_hybrid(queries: DataFrame, nodes: DataFrame, edges: DataFrame, priors: DataFrame, k: int = 10) -> DataFrame:
    """Over ``source label, relation, target label``: 0.55 lexical + 0.20 cosine (where both
    sides have an ``embedding``) + 0.15 weight prior + 0.10 mean endpoint prior; a blank query:
    0.6 weight + 0.4 endpoints. A query that isn't blank drops edges without lexical or vector
    evidence. Ties by edge id."""
    label = nodes.select("id", "label").join(priors.select("id", "prior"), "id", "left")
    a = label.select(F.col("id").alias("source_id"), F.col("label").alias("_a"), F.col("prior").alias("_pa"))
    b = label.select(F.col("id").alias("target_id"), F.col("label").alias("_b"), F.col("prior").alias("_pb"))
    e = edge_priors(edges).join(a, "source_id", "left").join(b, "target_id", "left")
    e = e.withColumn("_text", F.concat_ws(" ", F.coalesce("_a", "source_id"), "relation_type", F.coalesce("_b", "target_id"))).withColumn("_t", tokens(F.col("_text")))
    ends = (F.coalesce("_pa", F.lit(0.0)) + F.coalesce("_pb", F.lit(0.0))) / 2
    scored = _pairs(queries, e, "edge_id").withColumn("_emb", _vector_score(edges, queries)).where(_blank(F.col("query")) | (F.col("_lex") > 0) | (F.col("_emb") > 0))
    score = F.when(_blank(F.col("query")), 0.6 * F.col("prior") + 0.4 * ends).otherwise(0.55 * F.col("_lex") + 0.20 * F.col("_emb") + 0.15 * F.col("prior") + 0.10 * ends)
    kept = scored.withColumn("score", F.least(F.lit(1.0), score)).where("score > 0")
    return _best(kept.select("query_id", "edge_id", "source_id", "target_id", "relation_type", "weight", "source_segment_id", "score"), k, F.desc("score"), "edge_id", "source_id", "target_id")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first subgraphs of several queries at once, undirected.

    ``seeds(query_id, id, seat)`` start in order of ``seat``. A node's neighbours queue in
    order of (queue place of the parent, neighbour id), the first parent counting; with
    ``most``, the queue ends at so many nodes. Returns nodes ``(query_id, id, hop, place)``
    and the edges between a node that was expanded (hop < hops) and one that is in.
    """
    if hops < 0:
        return seeds.select("query_id", "id", F.lit(0).alias("hop"), F.lit(0).alias("place")).limit(0), edges.limit(0).withColumn("query_id", F.lit(0))
    steps = cut(both_ways(edges))
    by_query = W.partitionBy("query_id")
    first = seeds.groupBy("query_id", "id").agg(F.min("seat").alias("seat"))
    nodes = first.select("query_id", "id", F.lit(0).alias("hop"), F.row_number().over(by_query.orderBy("seat", "id")).alias("place"))
    if most is not None:
        nodes = nodes.where(F.col("place") <= most)
    nodes = cut(nodes)
    frontier = nodes
    for hop in range(1, hops + 1):
        found = frontier.join(steps, frontier.id == steps.u).groupBy("query_id", F.col("v").alias("id")).agg(F.min("place").alias("parent"))
        new = found.join(nodes.select("query_id", "id"), ["query_id", "id"], "left_anti")
        size = nodes.groupBy("query_id").agg(F.max("place").alias("size"))
        placed = new.withColumn("_r", F.row_number().over(by_query.orderBy("parent", "id")))
        if most is not None:  # no more can have a place: each task keeps so many before the shuffle
            placed = placed.where(F.col("_r") <= most)
        placed = placed.join(size, "query_id").withColumn("place", F.col("size") + F.col("_r"))
        if most is not None:
            placed = placed.where(F.col("place") <= most)
        frontier = cut(placed.select("query_id", "id", F.lit(hop).alias("hop"), "place"))
        nodes = nodes.unionByName(frontier)
    a = nodes.select("query_id", F.col("id").alias("source_id"), F.col("hop").alias("_ha"))
    b = nodes.select("query_id", F.col("id").alias("target_id"), F.col("hop").alias("_hb"))
    inside = edges.join(a, "source_id").join(b, ["query_id", "target_id"]).where(F.least("_ha", "_hb") < hops)
    return nodes, inside.drop("_ha", "_hb")


def community_summaries(nodes: DataFrame, k: int, query: str | None = None) -> DataFrame:
    """Nodes of a community type whose text has the whole query, in order of their id as text."""
    rows = nodes.where(F.col("type").isin("community_summary", "community"))
    if query:
        q = F.lit(query.lower())
        rows = rows.where(F.contains(F.lower("label"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q))
    return rows.withColumn("score", F.lit(1.0)).orderBy(F.col("id").cast("string")).limit(k)


def source_segments(rows: DataFrame, order: str = "place") -> DataFrame:
    """Distinct source segments of each query's rows in order of first sight."""
    return rows.where("source_segment_id is not null").groupBy("query_id", "source_segment_id").agg(F.min(order).alias(order))


def relation_name(c: Column) -> Column:
    """A relation type as an identifier: upper case, anything else an underscore."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))


