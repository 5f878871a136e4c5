"""Registered graph queries and their SQL.

The graph: regions, nations, customers and suppliers with their foreign keys. An edge
from a customer or supplier to its nation weighs its balance in thousands. The source
segment of a node or edge is the document whose id is its key.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import graph, graph_retriever, models, retrieve
from folioforge.session import cut, scratch_root, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, n, c, s = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier"))

    def node(df: DataFrame, head: str, key: str, kind: str, label: str, text) -> DataFrame:
        return df.select(F.concat(F.lit(head), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), text.alias("description"), F.concat(F.lit("d"), F.col(key).cast("string")).alias("source_segment_id"))

    def edge(df: DataFrame, a: str, key: str, b: str, to: str, kind: str, weight) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(key).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(to).cast("string")).alias("target_id"), F.lit(kind).alias("relation_type"), weight.alias("weight"), F.concat(F.lit("d"), F.col(key).cast("string")).alias("source_segment_id"), F.col(key).cast("long").alias("seq"))

    nodes = [node(r, "r", "r_regionkey", "region", "r_name", F.lit(None).cast("string")), node(n, "n", "n_nationkey", "nation", "n_name", F.lit("a nation")), node(c, "c", "c_custkey", "customer", "c_name", F.col("c_mktsegment")), node(s, "s", "s_suppkey", "supplier", "s_name", F.lit(None).cast("string"))]
    edges = [edge(n, "n", "n_nationkey", "r", "n_regionkey", "part of", F.lit(1.0)), edge(c, "c", "c_custkey", "n", "c_nationkey", "lives in", F.col("c_acctbal") / 1000), edge(s, "s", "s_suppkey", "n", "s_nationkey", "sells from", F.col("s_acctbal") / 1000)]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(nodes), graph.append_edges(union(edges))


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label, NULL::VARCHAR AS description FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 'a nation' FROM nation
UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, c_mktsegment FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, NULL FROM supplier)"""
_EDGES = """edges AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b, 'part of' AS rel, 1.0::DOUBLE AS w FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives in', c_acctbal / 1000 FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'sells from', s_acctbal / 1000 FROM supplier)"""
_PRIOR = """deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY id),
prior AS (SELECT n.id, coalesce(degree, 0) AS degree, coalesce(degree / (SELECT max(degree) FROM deg), 0) AS prior FROM nodes n LEFT JOIN deg USING (id))"""
_G = f"WITH RECURSIVE {_NODES}, {_EDGES}, {_PRIOR}, both_ways AS (SELECT DISTINCT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges)"
_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[A-Za-z0-9\x{{400}}-\x{{4FF}}]+'))"


def _lexical(q: str, text: str) -> str:
    qt, tt = _TOK.format(q), _TOK.format(text)
    return f"""least(1.0, 0.55 * len(list_intersect({qt}, {tt})) / len({qt}) + 0.25 * (CASE WHEN contains(lower({text}), trim(lower({q}))) THEN 1 ELSE 0 END)
    + 0.20 * len(list_filter({qt}, lambda x: length(x) >= 4 AND len(list_filter({tt}, lambda y: length(y) >= 4 AND (contains(y, x) OR contains(x, y) OR left(x, 4) = left(y, 4)))) > 0)) / len({qt}))"""


@query(f"{_G} SELECT id, degree, round(prior, 9) AS prior FROM prior")
def graph_degree_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_priors(*tables(spark, sf_dir)).withColumn("prior", F.round("prior", 9))


@query(f"{_G} SELECT a AS source_id, b AS target_id, rel AS relation_type, a || '|' || rel || '|' || b || '|0' AS edge_id, round(w, 6) AS weight, round(abs(w) / (SELECT max(abs(w)) FROM edges), 9) AS prior FROM edges")
def graph_edge_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_priors(tables(spark, sf_dir)[1]).select("source_id", "target_id", "relation_type", "edge_id", F.round("weight", 6).alias("weight"), F.round("prior", 9).alias("prior"))


@query(f"{_G}, r AS (SELECT id AS query_id, id, 0 AS hop FROM nodes WHERE type = 'region' UNION SELECT query_id, v, hop + 1 FROM r JOIN both_ways ON u = r.id WHERE hop < 2), m AS (SELECT query_id, id, min(hop) AS hop FROM r GROUP BY ALL) SELECT * FROM m WHERE hop > 0")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tables(spark, sf_dir)
    return graph.neighbors(edges, nodes.where("type = 'region'").select(F.col("id").alias("query_id"), "id"), 2)


@query(f"{_G} SELECT id, label FROM nodes WHERE contains(lower(label), 'mer') OR contains(lower(coalesce(description, '')), 'mer')")
def graph_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_nodes(tables(spark, sf_dir)[0], "MER").select("id", "label")


_ASKED = [(1, "nation of asia"), (2, "Customer#000000012 building"), (3, "machinery"), (4, " ")]
_Q = "q AS (SELECT * FROM (VALUES (1, 'nation of asia'), (2, 'Customer#000000012 building'), (3, 'machinery'), (4, ' ')) q(query_id, query))"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ASKED, "query_id int, query string")


@query(f"""{_G}, {_Q}, l AS (SELECT query_id, id, query, prior, CASE WHEN trim(query) = '' THEN 0 ELSE {_lexical('query', "trim(label || ' ' || coalesce(description, ''))")} END AS lex FROM nodes JOIN prior USING (id), q),
s AS (SELECT query_id, id, least(1.0, CASE WHEN trim(query) = '' THEN 0.15 * prior ELSE 0.65 * lex + 0.15 * prior END) AS score FROM l WHERE trim(query) = '' OR lex > 0)
SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 12""")
def graph_node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tables(spark, sf_dir)
    return graph.search_nodes_hybrid(_asked(spark), nodes, graph.node_priors(nodes, edges), 12).withColumn("score", F.round("score", 6))


@query(f"""{_G}, {_Q}, e AS (SELECT a || '|' || rel || '|' || b || '|0' AS edge_id, na.label || ' ' || rel || ' ' || nb.label AS text, abs(w) / (SELECT max(abs(w)) FROM edges) AS wp, (pa.prior + pb.prior) / 2 AS ends
  FROM edges JOIN nodes na ON na.id = a JOIN nodes nb ON nb.id = b JOIN prior pa ON pa.id = a JOIN prior pb ON pb.id = b),
l AS (SELECT query_id, query, edge_id, wp, ends, CASE WHEN trim(query) = '' THEN 0 ELSE {_lexical('query', 'text')} END AS lex FROM e, q),
s AS (SELECT query_id, edge_id, least(1.0, CASE WHEN trim(query) = '' THEN 0.6 * wp + 0.4 * ends ELSE 0.55 * lex + 0.15 * wp + 0.10 * ends END) AS score FROM l WHERE trim(query) = '' OR lex > 0)
SELECT query_id, edge_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, edge_id) AS rank FROM s WHERE score > 0) WHERE rank <= 24""")
def graph_edge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tables(spark, sf_dir)
    return graph.search_edges_hybrid(_asked(spark), nodes, edges, graph.node_priors(nodes, edges), 24).select("query_id", "edge_id", "rank", F.round("score", 6).alias("score"))


@query(f"""{_G}, r AS (SELECT id AS query_id, id, 0 AS hop FROM nodes WHERE type = 'nation' UNION SELECT query_id, v, hop + 1 FROM r JOIN both_ways ON u = r.id WHERE hop < 1)
SELECT query_id, id, min(hop) AS hop FROM r GROUP BY ALL""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tables(spark, sf_dir)
    seeds = nodes.where("type = 'nation'").select(F.col("id").alias("query_id"), "id", F.lit(1).alias("seat"))
    return graph.expand(edges, seeds, 1)[0].select("query_id", "id", "hop")


@query(f"""{_G}, b AS (SELECT n.id AS query_id, v, row_number() OVER (PARTITION BY n.id ORDER BY v) AS p FROM nodes n JOIN both_ways ON u = n.id WHERE n.type = 'nation')
SELECT id AS query_id, id, 0 AS hop, 1 AS place FROM nodes WHERE type = 'nation' UNION ALL SELECT query_id, v, 1, p + 1 FROM b WHERE p < 20""")
def graph_expand_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tables(spark, sf_dir)
    seeds = nodes.where("type = 'nation'").select(F.col("id").alias("query_id"), "id", F.lit(1).alias("seat"))
    return graph.expand(edges, seeds, 1, 20)[0].select("query_id", "id", "hop", "place")


def _retriever(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    nodes, edges = map(cut, tables(spark, sf_dir))
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("segment_id"), F.col("text").alias("content"))
    asked, config, near = _asked(spark), graph_retriever.GraphQuery(mode=mode), None
    if mode == "mix":
        embedded = lambda c: models.embed(F.col(c), models.hashed_embedder(64)).alias("embedding")
        hits = retrieve.vector_search(asked.where("trim(query) <> ''").select("query_id", embedded("query")), chunks.select("segment_id", embedded("content")), 2 * config.chunks, key="segment_id")
        near = hits.select("query_id", "segment_id", F.greatest(F.col("score"), F.lit(0.0)).alias("score"))
    found = graph_retriever.retrieve(asked, graph_retriever.GraphTables(nodes, edges, chunks, near), config)
    return found.withColumn("score", F.round("score", 6))


@query()
def graph_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retriever(spark, sf_dir, "local")


@query()
def graph_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retriever(spark, sf_dir, "global")


@query()
def graph_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retriever(spark, sf_dir, "hybrid")


@query()
def graph_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retriever(spark, sf_dir, "mix")


@query("""SELECT l_suppkey AS query_id, l_orderkey, l_linenumber, round(CASE WHEN hi - lo <= 1e-12 THEN 0.5 ELSE (s - lo) / (hi - lo) END, 6) AS score
FROM (SELECT *, l_extendedprice AS s, min(l_extendedprice) OVER (PARTITION BY l_suppkey) AS lo, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS hi FROM lineitem)""")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))
    return graph_retriever.minmax(rows).withColumn("score", F.round("score", 6))


@query("""SELECT query_id, evidence_id, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seg ORDER BY score DESC, kind, evidence_id) AS n FROM (
SELECT o_custkey % 10 AS query_id, 'o' || o_orderkey AS evidence_id, 'chunk' AS kind, 'x' AS content, 'seg' || (o_orderkey % 97) AS seg, (o_orderkey * 7 % 100) / 100 AS score FROM orders
UNION ALL SELECT c_custkey % 10, 'c' || c_custkey, 'relation', 'y', 'seg' || (c_custkey % 97), (c_custkey * 11 % 100) / 100 FROM customer)) WHERE n = 1""")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 as query_id", "concat('o', o_orderkey) as evidence_id", "'chunk' as kind", "'x' as content", "concat('seg', o_orderkey % 97) as source_segment_id", "(o_orderkey * 7 % 100) / 100 as score")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey % 10 as query_id", "concat('c', c_custkey) as evidence_id", "'relation' as kind", "'y' as content", "concat('seg', c_custkey % 97) as source_segment_id", "(c_custkey * 11 % 100) / 100 as score")
    return graph_retriever.dedupe(o.unionByName(c)).select("query_id", "evidence_id", "kind", "score")


@query(r"""WITH q AS (SELECT item_id, lower(text) AS t, list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9\x{400}-\x{4FF}]+'), lambda x: NOT list_contains(['a','an','and','are','for','in','is','of','on','or','the','to','what','who','и','в','на','по','с','что','как'], x)) AS k FROM benchmark),
d AS (SELECT item_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS k FROM q)
SELECT item_id, array_to_string(k[1:12], ' ') AS low, array_to_string(list_transform(list_sort(list_transform(k, lambda x: {'n': -length(x), 't': x}))[1:2], lambda s: s.t), ' ') AS high FROM d""")
def graph_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = graph_retriever.keywords(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(low, " ").alias("low"), F.array_join(high, " ").alias("high"))


@query(f"{_G} SELECT id, type, label, (SELECT count(*) FROM edges WHERE a = id)::BIGINT AS out_edges FROM nodes")
def graph_gml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges written as GML lines and read back."""
    from folioforge.sources import graphs as files

    nodes, edges = tables(spark, sf_dir)
    path = f"{scratch_root(spark)}/gml-{uuid.uuid4().hex}"
    files.save_gml(nodes, edges, path)
    n, e = files.load_gml(spark, path)
    out = e.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("out_edges"))
    return n.join(out, "id", "left").select("id", "type", "label", F.coalesce("out_edges", F.lit(0)).cast("long").alias("out_edges"))
