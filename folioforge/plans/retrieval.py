"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import compose, retrieve, scored
from folioforge.functions import text as T
from folioforge.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rows(spark: SparkSession, pairs: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(pairs, ddl)


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(f"""SELECT vec_id, rank, round(score, 6) AS score FROM (SELECT c.vec_id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, c.vec_id) AS rank
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.vector_search(q, e, 10).select("vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.vector_search(_query_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0 AND c.label = 3) WHERE rank <= 5""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieve.vector_search(_query_vectors(spark, sf_dir), e, 5, where=F.col("label") == 3).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, vec_id, rank, round(score, 6) AS score, round(least(greatest((1 + score) / 2, 0), 1), 6) AS relevance FROM (SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 20 AND score >= 0.2""")
def vector_score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.vector_search(_query_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings"), 20, least=0.2)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), F.round(T.relevance(F.col("score")), 6).alias("relevance"))


@query()
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.mmr(_query_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings"), 4, 20, 0.5)


@query("""SELECT query_id, d.doc_id FROM documents d, (VALUES (1, 'the thon'), (2, 'c*** '), (3, 'PASSWORD=')) q(query_id, query)
WHERE contains(lower(d.text), lower(q.query)) OR contains(lower('{source: ' || d.source || ', lang: ' || d.lang || '}'), lower(q.query))""")
def regex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rows(spark, [(1, "the thon"), (2, "c*** "), (3, "PASSWORD=")], "query_id int, query string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("{source: "), "source", F.lit(", lang: "), "lang", F.lit("}")).alias("meta"))
    return retrieve.literal_scan(q, docs, meta="meta").select("query_id", "doc_id")


@query("""SELECT q.s_suppkey AS query_id, c.c_custkey, levenshtein(lower(c.c_name), lower(q.s_name)) AS distance
FROM customer c, supplier q WHERE q.s_suppkey % 20 = 0 AND levenshtein(lower(c.c_name), lower(q.s_name)) <= 8""")
def levenshtein_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query"))
    return retrieve.levenshtein_scan(q, table(spark, sf_dir, "customer"), 8, text="c_name").select("query_id", "c_custkey", "distance")


@query()
def fuzzy_ratio_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rows(spark, [(1, "smal ring"), (2, "red wigdet"), (3, "widget red")], "query_id int, query string")
    return retrieve.fuzzy_scan(q, table(spark, sf_dir, "part"), text="p_name", threshold=80.0, mode="wratio").select("query_id", "p_partkey", F.round("fuzzy_score", 6).alias("fuzzy_score"))


_TERMS = [(1, "the of thon"), (2, "password secret clown"), (3, "und der nicht"), (4, "zzzz qqqq")]


@query("""
WITH q AS (SELECT * FROM (VALUES (1, 'the of thon'), (2, 'password secret clown'), (3, 'und der nicht'), (4, 'zzzz qqqq')) q(query_id, query)
), w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents
), st AS (SELECT count(*) AS n, avg(len(w)::DOUBLE) AS avgdl FROM w
), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL
), idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, st GROUP BY term, n
), mean AS (SELECT avg(raw) AS mean FROM idf
), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM idf, mean
), t AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(string_split(query, ' ')) AS term FROM q) GROUP BY ALL
), s AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN i USING (term) JOIN t USING (term), st GROUP BY ALL
), a AS (SELECT q.query_id, d.doc_id, coalesce(s.score, 0) AS score FROM q CROSS JOIN documents d LEFT JOIN s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a) WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rows(spark, _TERMS, "query_id int, query string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return retrieve.bm25(q, docs, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_LISTS = """a AS (SELECT o_custkey AS query_id, o_orderkey AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
b AS (SELECT o_custkey AS query_id, o_orderkey AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)"""


def _order_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders ranked by price and by date: two lists a query."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("content"), "o_totalprice", "o_orderdate")
    a = retrieve.top_k(o, 10, F.desc("o_totalprice"), "content").select("query_id", "content", "rank")
    b = retrieve.top_k(o, 10, "o_orderdate", "content").select("query_id", "content", "rank")
    return a, b


_RRF = """f AS (SELECT query_id, content, sum(w / (60 + rank)) AS score FROM (SELECT *, {0} AS w FROM a WHERE rank <= 10 UNION ALL SELECT *, {1} AS w FROM b WHERE rank <= 10) GROUP BY ALL)
SELECT query_id, content, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, content) AS rank FROM f"""


@query(f"WITH {_LISTS}, " + _RRF.format("0.5::DOUBLE", "0.5::DOUBLE"))
def ensemble_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "orders").count()
    return compose.rrf(list(_order_lists(spark, sf_dir)), most=most).select("query_id", "content", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_LISTS}, " + _RRF.format("0.7::DOUBLE", "0.3::DOUBLE"))
def vector_graph_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "orders").count()
    return compose.vector_graph_hybrid(*_order_lists(spark, sf_dir), most=most).select("query_id", "content", F.round("score", 9).alias("score"), "rank")


_LINES = """h AS (SELECT l_suppkey AS query_id, l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)"""


def _line_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Each supplier's k dearest order lines: hits whose parents are orders."""
    lines = table(spark, sf_dir, "lineitem").withColumn("query_id", F.col("l_suppkey"))
    return retrieve.top_k(lines, k, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query(f"""WITH {_LINES}, s AS (SELECT *, l_quantity * (1 - l_discount) AS score FROM h WHERE rank <= 30), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM s)
SELECT query_id, l_orderkey, l_linenumber, rerank, round(score, 6) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank FROM m WHERE score >= 0.8 * top) WHERE rerank <= 5""")
def rerank_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compose.rerank(_line_hits(spark, sf_dir, 30), F.col("l_quantity") * (1 - F.col("l_discount")), 5, 0.8)
    return found.select("query_id", "l_orderkey", "l_linenumber", "rerank", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {_LINES}, s AS (SELECT *, l_quantity * (1 - l_discount) AS score FROM h WHERE rank <= 30),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, (rank - 1) // 10 ORDER BY score DESC, rank) AS p, count(*) OVER (PARTITION BY query_id, (rank - 1) // 10) AS n, count(*) OVER (PARTITION BY query_id) AS t FROM s),
k1 AS (SELECT query_id, l_orderkey, l_linenumber, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN t <= 10 THEN 0 ELSE (rank - 1) // 10 END, CASE WHEN t <= 10 THEN rank ELSE p END) AS rank FROM r1 WHERE t <= 10 OR p <= (n + 1) // 2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, (rank - 1) // 10 ORDER BY score DESC, rank) AS p, count(*) OVER (PARTITION BY query_id, (rank - 1) // 10) AS n, count(*) OVER (PARTITION BY query_id) AS t FROM k1),
k2 AS (SELECT query_id, l_orderkey, l_linenumber, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN t <= 10 THEN 0 ELSE (rank - 1) // 10 END, CASE WHEN t <= 10 THEN rank ELSE p END) AS rank FROM r2 WHERE t <= 10 OR p <= (n + 1) // 2)
SELECT query_id, l_orderkey, l_linenumber, rerank, round(score, 6) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank FROM k2) WHERE rerank <= 5""")
def tournament_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compose.tournament_rerank(_line_hits(spark, sf_dir, 30), F.col("l_quantity") * (1 - F.col("l_discount")), 10, 5)
    return found.select("query_id", "l_orderkey", "l_linenumber", "rerank", F.round("rerank_score", 6).alias("rerank_score"))


def _hits_and_parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line hits with their order as parent; only closed orders are in the store."""
    hits = _line_hits(spark, sf_dir, 12).select("query_id", "rank", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("parent_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("content"), (F.col("l_quantity") / 50).alias("score"))
    parents = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("parent_content"))
    return hits, parents


_HYDRATE = f"""WITH {_LINES}, c AS (SELECT query_id, rank, l_orderkey || '-' || l_linenumber AS id, l_orderkey AS parent_id, 'line ' || l_linenumber AS content, l_quantity / 50 AS score,
  max(l_quantity / 50) OVER (PARTITION BY query_id, l_orderkey) AS top FROM h WHERE rank <= 12),
j AS (SELECT c.*, 'order ' || o_orderkey || ' ' || o_orderpriority AS up, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM c LEFT JOIN orders ON o_orderkey = parent_id AND o_orderstatus = 'F'), """
_NUMBERED = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY section, rank, id) AS position, id, content, round(score, 6) AS score FROM r"


@query(_HYDRATE + "r AS (SELECT query_id, 0 AS section, rank, parent_id::VARCHAR AS id, coalesce(up, content) AS content, CASE WHEN up IS NULL THEN score ELSE top END AS score FROM j WHERE up IS NULL OR n = 1) " + _NUMBERED)
def hydrate_parents_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.hydrate(*_hits_and_parents(spark, sf_dir), "parents_replace").withColumn("score", F.round("score", 6))


@query(_HYDRATE + "r AS (SELECT query_id, 0 AS section, rank, id, CASE WHEN up IS NULL THEN content ELSE up || chr(10) || chr(10) || content END AS content, score FROM j) " + _NUMBERED)
def hydrate_children_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.hydrate(*_hits_and_parents(spark, sf_dir), "children_enriched").withColumn("score", F.round("score", 6))


@query(_HYDRATE + "r AS (SELECT query_id, 0 AS section, rank, id, content, score FROM j UNION ALL SELECT query_id, 1, rank, parent_id::VARCHAR, up, top FROM j WHERE up IS NOT NULL AND n = 1) " + _NUMBERED)
def hydrate_children_plus_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.hydrate(*_hits_and_parents(spark, sf_dir), "children_plus_parents").withColumn("score", F.round("score", 6))


@query(_HYDRATE + "p AS (SELECT query_id, parent_id, min(rank) AS first_rank, any_value(up) AS parent_content FROM j WHERE up IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS position FROM p")
def dual_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.dual_storage(*_hits_and_parents(spark, sf_dir))


def _scored_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as child chunks of their label; only labels below 5 are in the store."""
    e = table(spark, sf_dir, "embeddings")
    children = e.select(F.col("vec_id").alias("id"), F.col("label").alias("parent_id"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"))
    parents = e.where("label < 5").select(F.col("label").alias("parent_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("parent_content")).distinct()
    return e, children, parents


_SCORED = f"""WITH h AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, {_COS} AS cos, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0),
c AS (SELECT query_id, rank, vec_id::VARCHAR AS id, label AS parent_id, 'chunk ' || vec_id AS content, {{0}} AS score FROM h WHERE rank <= 6 {{1}}),
j AS (SELECT *, CASE WHEN parent_id < 5 THEN 'label ' || parent_id END AS up, max(score) OVER (PARTITION BY query_id, parent_id) AS top, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM c), """


@query(_SCORED.format("NULL::DOUBLE", "") + "r AS (SELECT query_id, 0 AS section, rank, parent_id::VARCHAR AS id, coalesce(up, content) AS content, CASE WHEN up IS NULL THEN score ELSE top END AS score FROM j WHERE up IS NULL OR n = 1) " + _NUMBERED)
def scored_similarity_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, hydration: parents in place of their hits; plain similarity gives no scores."""
    return scored.retrieve_scored(_query_vectors(spark, sf_dir), *_scored_tables(spark, sf_dir), k=6).withColumn("score", F.round("score", 6))


@query(_SCORED.format("least(greatest((1 + cos) / 2, 0), 1)", "AND (1 + cos) / 2 >= 0.6") + "r AS (SELECT query_id, 0 AS section, rank, id, CASE WHEN up IS NULL THEN content ELSE up || chr(10) || chr(10) || '--- MATCHED CHILD CHUNK ---' || chr(10) || chr(10) || content END AS content, score FROM j) " + _NUMBERED)
def scored_threshold_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with a least relevance, hits enriched with their parents."""
    config = scored.Search("similarity_score_threshold", threshold=0.6)
    return scored.retrieve_scored(_query_vectors(spark, sf_dir), *_scored_tables(spark, sf_dir), config, "children_enriched", k=6).withColumn("score", F.round("score", 6))


@query(_SCORED.format("least(greatest((1 + cos) / 2, 0), 1)", "AND (1 + cos) / 2 >= 0.6") + "r AS (SELECT query_id, 0 AS section, rank, id, content, score FROM j UNION ALL SELECT query_id, 1, rank, parent_id::VARCHAR, up, top FROM j WHERE up IS NOT NULL AND n = 1) " + _NUMBERED)
def scored_threshold_plus_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = scored.Search("similarity_score_threshold", threshold=0.6)
    return scored.retrieve_scored(_query_vectors(spark, sf_dir), *_scored_tables(spark, sf_dir), config, "children_plus_parents", k=6).withColumn("score", F.round("score", 6))


@query()
def scored_mmr_plus_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diverse hits first, then their parents."""
    return scored.retrieve_scored(_query_vectors(spark, sf_dir), *_scored_tables(spark, sf_dir), scored.Search("mmr", fetch=20), "children_plus_parents", k=4)


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9\\x{400}-\\x{4FF}]+')) AS t FROM documents),
q AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9\\x{400}-\\x{4FF}]+')), lambda x: NOT list_contains(['a','an','and','are','for','in','is','of','on','or','the','to','what','who','и','в','на','по','с','что','как'], x)) AS q FROM benchmark WHERE item_id % 20 = 0)
SELECT item_id AS query_id, doc_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS overlap FROM t, q WHERE len(q) > 0 AND len(list_intersect(q, t)) / len(q) >= 0.5""")
def contamination_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.without_stopwords(T.tokens(F.col("text"))).alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    share = F.size(F.array_intersect("q", "t")) / F.size("q")
    return retrieve.in_blocks(q, lambda b: docs.join(b, (F.size("q") > 0) & (share >= 0.5))).select("query_id", "doc_id", F.round(share, 6).alias("overlap"))
