"""Registered indexing, enrichment, community, tree and stream queries and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import communities as C
from folioforge.operators import enrich, index, models, tree
from folioforge.plans.graphs import tables
from folioforge.session import table
from folioforge.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT doc_id, length(text) AS chars, greatest(1, CASE WHEN length(text) > 1 THEN least(b2, length(text) - 1) ELSE b2 END)::BIGINT AS budget
FROM (SELECT doc_id, text, CASE WHEN length(text) > 200 THEN greatest(b, 200) ELSE b END AS b2 FROM (SELECT doc_id, text, least(1000, greatest(1, trunc(length(text) * 0.3::DOUBLE)))::BIGINT AS b FROM documents))""")
def summary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", chars.alias("chars"), T.summary_budget(chars, 0.3, 200, 1000).alias("budget"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sum ' || source ELSE text END AS text, (doc_id % 3 = 0) AS is_summary, lang AS lang, doc_id % 3 = 0 AS flag FROM documents""")
def index_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    segments = d.select(F.col("doc_id").cast("string").alias("segment_id"), F.lit(None).cast("string").alias("parent_id"), F.col("text").alias("content"), F.lit("text").alias("type"), F.col("lang").alias("original_format"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sum "), "source")).alias("summary"))
    rows = index.payload(segments, with_content=False)
    flag = F.col("payload")["is_summary_embedding"] == "true"
    return rows.select(F.col("segment_id").cast("long").alias("doc_id"), "text", flag.alias("is_summary"), F.col("payload")["original_format"].alias("lang"), flag.alias("flag"))


@query("""SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return index.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("v", F.lit("new")), "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND starts_with(c_name, 'Customer#')")
def store_delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kept = index.delete(c, c.where("c_custkey % 7 = 0"), "c_custkey")
    return kept.join(index.keys_of(kept, "Customer#", "c_name").distinct(), "c_name", "left_semi").select("c_custkey")


@query("""SELECT doc_id, source AS generated_title, lang || '|' || doc_id AS keywords, 'n ' || n_chars AS summary FROM documents""")
def enrichment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("TITLE: "), "source", F.lit("\nkeywords: "), "lang", F.lit(", "), F.col("doc_id").cast("string"), F.lit("\n Summary:  n "), F.col("n_chars").cast("string"), F.lit(" "))
    e = enrich.parse_enrichment(answer)
    return table(spark, sf_dir, "documents").select("doc_id", e["generated_title"].alias("generated_title"), F.array_join(e["keywords"], "|").alias("keywords"), e["summary"].alias("summary"))


@query()
def segment_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    def stand_in(prompt: str) -> str:
        text = prompt.split("\n\n", 1)[1]
        return f"Title: {text[:20].strip()}\nKeywords: {', '.join(text.split()[:3])}\nSummary: {models.extractive_summary(text, 120)}".replace("\r", " ")

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit("text").alias("type"))
    return enrich.enrich(d, stand_in)


@query("""SELECT 's' || s_suppkey AS id, 'supplier' AS type, s_name AS label, 1::BIGINT AS edges FROM supplier""")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations out of JSON answers, written here from the supplier table."""
    s = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    entity = F.to_json(F.struct(F.array(F.struct(key.alias("name"), F.lit("supplier").alias("type"), F.col("s_name").alias("description"))).alias("entities"), F.array(F.struct(key.alias("source"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target"))).alias("relations")))
    nodes, edges = enrich.parse_graph(s.select(key.alias("segment_id"), F.concat(F.lit("Here it is:\n"), entity).alias("answer")))
    n = edges.where("relation_type = 'RELATED_TO' and weight = 1.0").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(n, "id").select("id", "type", F.col("description").alias("label"), "edges")


@query("""WITH RECURSIVE d AS (SELECT 'n' || n_nationkey AS u, 'r' || n_regionkey AS v FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
e AS (SELECT u, v FROM d UNION ALL SELECT v, u FROM d), r AS (SELECT DISTINCT u AS id, u AS o FROM e UNION SELECT e.v, r.o FROM r JOIN e ON e.u = r.id) SELECT id, min(o) AS component FROM r GROUP BY id""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.connected_components(tables(spark, sf_dir)[1])


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detect(tables(spark, sf_dir)[1])


@query()
def community_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tables(spark, sf_dir)
    return C.summaries(C.detect(edges), nodes).select("segment_id", "community_id", F.size("node_ids").alias("n"), "content")


def _by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed two-level tree: embeddings under their label, labels under their parity."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("segment_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("up"))
    labels = e.select("up").distinct()
    up = labels.select(F.col("up").alias("segment_id"), F.concat(F.lit("p"), (F.substring("up", 2, 9).cast("int") % 2).cast("string")).alias("up"))
    leaf = e.select("segment_id", F.array().cast("array<string>").alias("child_ids"))
    mid = e.groupBy(F.col("up").alias("segment_id")).agg(F.collect_set("segment_id").alias("child_ids"))
    top = up.groupBy(F.col("up").alias("segment_id")).agg(F.collect_set("segment_id").alias("child_ids"))
    return leaf.unionByName(mid).unionByName(top)


@query("""SELECT 'v' || vec_id AS segment_id, 2 AS depth_from_root, 'l' || label AS parent_id FROM embeddings UNION ALL SELECT DISTINCT 'l' || label, 1, 'p' || (label % 2) FROM embeddings UNION ALL SELECT DISTINCT 'p' || (label % 2), 0, NULL FROM embeddings""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.finalize(_by_label(spark, sf_dir)).select("segment_id", "depth_from_root", "parent_id")


@query()
def raptor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over the items of the benchmark, clustered by mixtures in two steps."""
    leaves = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("segment_id"), F.col("text").alias("content"))
    built = tree.finalize(tree.build(leaves, models.hashed_embedder(32), 3))
    return built.select("segment_id", "raptor_level", "depth_from_root", F.size("child_ids").alias("children"), F.length("content").alias("chars"), "budget", "ratio", "error", "exceeds_max_chars")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.event_counts(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("""SELECT s_nationkey, 'Table with headers: s_suppkey,s_name. Contains data rows.' AS summary FROM supplier GROUP BY s_nationkey""")
def table_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), "\n").alias("b"))
    return rows.select("s_nationkey", models.table_summary(F.concat(F.lit("s_suppkey,s_name\n"), "b")).alias("summary"))


