"""Registered queries over files, stores, links and streams, and their SQL. What they read
is written to the shared folder first."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import html_dom
from folioforge.functions import tables as md
from folioforge.functions import text as T
from folioforge.operators import graph, index, models, split
from folioforge.session import scratch_root, table
from folioforge.sources import files, web
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


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _one_file_each(rows: DataFrame, name: str) -> str:
    """``rows(key, value)`` as text files, one a key; a glob of them."""
    path = _folder(rows.sparkSession, name)
    rows.repartition("key").write.partitionBy("key").text(path)
    return f"{path}/*"


def _key() -> Column:
    return F.regexp_extract("source", r"key=(\d+)", 1).cast("int").alias("key")


# --- files -----------------------------------------------------------------------------


@query("SELECT r_regionkey AS key, r_name || chr(10) || 'second line' || chr(10) AS content FROM region")
def text_files_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.concat("r_name", F.lit("\nsecond line")).alias("value"))
    return files.text_files(spark, _one_file_each(rows, "text-files")).select(_key(), "content")


_JSON = "n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)"


@query(f"""WITH {_JSON} SELECT n_regionkey AS key, '"' || n_name || '"' AS picked, '{{"name": "' || n_name || '", "key": ' || n_nationkey || '}}' AS row_json,
'## Item 1' || chr(10) || '- name: ' || n_name || chr(10) || '- key: ' || n_nationkey AS markdown, '{{}}' AS odd FROM n WHERE i = 1""")
def json_files_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as a JSON file: a value by path, a row serialised again, the same as markdown.
    A path that isn't there and a file that isn't JSON give no row (``odd`` is what is left of two such)."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("x"))
    rows = n.groupBy(F.col("n_regionkey").alias("key")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    rows = rows.select("key", F.to_json(F.struct(F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["key"].alias("key"))).alias("rows"))).alias("value"))
    path = _one_file_each(rows, "json-files")
    broken = _one_file_each(rows.withColumn("value", F.lit("{not json")), "json-files")
    load = lambda p, schema, form="json": files.json_files(spark, p, schema, form).select(_key(), "content")
    none = load(path, "rows.99.name").unionByName(load(broken, ".")).groupBy("key").agg(F.first("content").alias("odd"))
    out = load(path, "rows.0.name").withColumnRenamed("content", "picked").join(load(path, "rows.0").withColumnRenamed("content", "row_json"), "key").join(load(path, "rows.0", "markdown").withColumnRenamed("content", "markdown"), "key")
    return out.join(none, "key", "left").withColumn("odd", F.coalesce("odd", F.lit("{}")))


@query("""SELECT n_regionkey AS key, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN '| ' || n_nationkey || ' | a|b |' ELSE '| ' || n_nationkey || ' | ' || n_name || ' | more |' END, chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY 1""")
def plain_tables_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files as markdown without escapes; rows of another width stay as they are."""
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit(",a|b"))).otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(","), "n_name", F.lit(",more")))
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("x"))
    rows = n.select("key", F.concat(F.lit("key,name\n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("value"))
    return files.plain_table_files(spark, _one_file_each(rows, "csv-files")).select(_key(), "content")


_DOCUMENT = "'# ' || r_name || chr(10) || 'before' || chr(10) || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10) || t || chr(10) || chr(10) || 'after'"
_ROWS = "t AS (SELECT n_regionkey AS key, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY 1)"


def _documents_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    rows = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda s: s["line"]), "\n").alias("t"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), "r_name")
    return rows.join(r, "doc_id").select("doc_id", F.concat(F.lit("# "), "r_name", F.lit("\nbefore\n\n| key | name |\n|---|---|\n"), "t", F.lit("\n\nafter")).alias("text"))


@query(f"""WITH {_ROWS} SELECT r_regionkey AS doc_id, 0 AS chunk_index, 'text' AS type, '# ' || r_name || chr(10) || 'before' AS content FROM region
UNION ALL SELECT key, 1, 'table', '| key | name |' || chr(10) || '|---|---|' || chr(10) || t FROM t UNION ALL SELECT r_regionkey, 2, 'text', 'after' FROM region""")
def markdown_table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.explode_dicts(_documents_with_tables(spark, sf_dir), split.markdown_tables, "content string, type string, start int, end int")
    return rows.select("doc_id", "chunk_index", "type", "content")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT n_regionkey AS doc_id, (i // 2) * 2 AS first_row, least((i // 2) * 2 + 2, max(max(i)) OVER (PARTITION BY n_regionkey) + 1) AS end_row,
'| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '_', '_') || ' |', chr(10) ORDER BY n_nationkey) AS content FROM n GROUP BY n_regionkey, i // 2""")
def table_row_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables parsed and packed again by two rows, their ranges half open."""
    rows = split.explode_dicts(_documents_with_tables(spark, sf_dir), lambda t: split.markdown_tables(t, max_rows=2), "content string, type string, start int, end int")
    return rows.where("type = 'table'").select("doc_id", F.col("start").cast("long").alias("first_row"), F.col("end").cast("long").alias("end_row"), "content")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Table Summary:' || chr(10) || 'of ' || n_regionkey || chr(10) || chr(10) || '---' || chr(10) || chr(10) || n_name
WHEN 2 THEN 'Chunk Summary:' || chr(10) || 'part' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || n_name
ELSE 'Table Summary:' || chr(10) || 'of ' || n_regionkey || chr(10) || chr(10) || 'Chunk Summary:' || chr(10) || 'part' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || n_name END AS content FROM nation""")
def summary_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(content: pd.Series, of: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([md.inject_summaries(*x) for x in zip(content, of, part, strict=True)])

    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    return n.select("n_nationkey", run("n_name", F.when(k.isin(1, 3), F.concat(F.lit("of "), F.col("n_regionkey").cast("string"))), F.when(k.isin(2, 3), F.lit("part"))).alias("content"))


@query("""SELECT r_regionkey AS doc_id, 1 AS level, r_name AS title, '' AS path, 'Part ' || r_name || chr(10) || 'intro' AS content FROM region
UNION ALL SELECT n_regionkey, 2, n_name, r_name, 'Item: ' || n_name || chr(10) || 'key ' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey""")
def regex_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    part = F.concat(F.lit("Item: "), "n_name", F.lit("\nkey "), F.col("n_nationkey").cast("string"))
    docs = n.groupBy(F.col("r_regionkey").alias("doc_id"), "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", part.alias("p")))).alias("x"))
    text = docs.select("doc_id", F.concat(F.lit("Part "), "r_name", F.lit("\nintro\n"), F.array_join(F.transform("x", lambda s: s["p"]), "\n")).alias("text"))
    rows = split.explode_dicts(text, lambda t: split.hierarchy(t, [(1, r"^Part (.*)$"), (2, r"^Item: ")]), "content string, title string, level int, path array<string>")
    return rows.select("doc_id", "level", "title", F.array_join("path", "/").alias("path"), "content")


# --- the index and the graph --------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sum ' || source ELSE text END AS text, 32::INT AS dimensions, (doc_id % 3 = 0) AS is_summary, CASE WHEN doc_id % 2 = 0 THEN 'p' || lang END AS parent, n_chars::BIGINT AS stored_chars FROM documents""")
def index_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written to a vector table and a document store, both read back and joined."""
    d = table(spark, sf_dir, "documents")
    segments = d.select(F.col("doc_id").cast("string").alias("segment_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), "lang")).alias("parent_id"), F.col("text").alias("content"), F.lit("text").alias("type"), F.col("lang").alias("original_format"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sum "), "source")).alias("summary"))
    vectors, store = _folder(spark, "vectors"), _folder(spark, "store")
    index.index(segments, models.hashed_embedder(32), vectors, store, with_content=False)
    v, s = spark.read.parquet(vectors), spark.read.parquet(store)
    joined = v.join(s.select("segment_id", F.length("content").cast("long").alias("stored_chars")), "segment_id")
    return joined.select(F.col("segment_id").cast("long").alias("doc_id"), "text", F.size("embedding").alias("dimensions"), (F.col("payload")["is_summary_embedding"] == "true").alias("is_summary"), F.col("payload")["parent_id"].alias("parent"), "stored_chars")


@query("""SELECT doc_id::VARCHAR AS id, text AS content, '1' AS level, 'a/b' AS path, 'text' AS type, lang AS original_format, CASE WHEN doc_id % 2 = 0 THEN 'p' END AS parent_id, source AS own FROM documents""")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    segments = d.select(
        F.col("doc_id").cast("string").alias("segment_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("p")).otherwise(F.lit("")).alias("parent_id"), F.col("text").alias("content"), F.lit(1).alias("level"), F.array(F.lit("a"), F.lit("b")).alias("path"),
        F.lit("text").alias("type"), F.col("lang").alias("original_format"), F.create_map(F.lit("own"), F.col("source"), F.lit("level"), F.lit("overruled")).alias("metadata"),
    )
    m = F.col("metadata")
    return index.to_documents(segments).select("id", "content", *[m[k].alias(k) for k in ("level", "path", "type", "original_format", "parent_id", "own")])


@query("""SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1""")
def graph_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's node, in two loads."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq"))
    first, second = o.where("seq % 2 = 0"), o.where("seq % 2 = 1")
    return graph.upsert_nodes(graph.upsert_nodes(first.limit(0), first), second).select("id", "label")


@query("""SELECT 'c' || n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey % 2 = 0 AND contains(lower(n_name), '_1') ORDER BY id LIMIT 4""")
def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 4 == 0, "community_summary").when(F.col("n_nationkey") % 2 == 0, "community").otherwise("concept")
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), kind.alias("type"), F.col("n_name").alias("label"), F.lit(None).cast("string").alias("description"))
    return graph.community_summaries(nodes, 4, "N_1").select("id", "label")


@query("""SELECT l_suppkey AS query_id, 's' || (l_orderkey % 50) AS source_segment_id, min(l_orderkey) AS place FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL""")
def graph_source_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit("s"), (F.col("l_orderkey") % 50).cast("string"))).alias("source_segment_id"), F.col("l_orderkey").alias("place"))
    return graph.source_segments(rows).select("query_id", "source_segment_id", "place")


# --- the web -------------------------------------------------------------------------------


@query("""SELECT 'u' || user_id AS url, event_type = 'click' AS is_navigation, arg_max(event_id % 4, (event_id % 4) * 1000000000 + event_id)::INT AS n_classes, arg_max('e' || event_id, (event_id % 4) * 1000000000 + event_id) AS text FROM events GROUP BY ALL""")
def link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of a link: that with the most classes stands, of equal ones the latest."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), (F.col("event_type") == "click").alias("is_navigation"), F.array_repeat(F.lit("k"), (F.col("event_id") % 4).cast("int")).alias("classes"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"), F.col("event_id").alias("seq"))
    return web.merge_links(e).select("url", "is_navigation", F.size("classes").alias("n_classes"), "text")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT 'n' || s_nationkey || CASE WHEN n > 1 THEN '#nav-state=' || i ELSE '' END AS source, s_name AS content, 'separate' AS mode FROM s
UNION ALL SELECT 'n' || s_nationkey, string_agg('===== NAVIGATION STATE ' || i || '/' || n || ' =====' || chr(10) || s_name, chr(10) || chr(10) ORDER BY i), 'single' FROM s GROUP BY s_nationkey""")
def navigation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("url"), F.col("s_suppkey").alias("state"), F.col("s_name").alias("content"))
    return web.state_documents(states).withColumn("mode", F.lit("separate")).unionByName(web.state_documents(states, "single_document").withColumn("mode", F.lit("single")))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'docx' END AS kind, page_id % 4 = 3 OR page_id % 5 = 0 AS login FROM pages""")
def download_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetched URL holds, by its extension, its content type or the file name offered; and whether it asks for a login."""
    k = F.col("page_id") % 4
    host = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(host, F.when(k == 0, F.lit("/a/file.PDF?x=1")).when(k == 3, F.lit("/account/Login/next")).otherwise(F.lit("/a/file"))).alias("u"), F.when(k == 1, F.lit("Text/CSV; charset=utf-8")).alias("ctype"),
        F.when(k == 2, F.lit('attachment; filename="report.docx"')).alias("disposition"), F.when(F.col("page_id") % 5 == 0, 403).otherwise(200).alias("status"),
    )
    return p.select("page_id", T.download_kind(F.col("u"), F.col("ctype"), F.col("disposition")).alias("kind"), T.needs_login(F.col("u"), F.col("status")).alias("login"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'More' ELSE 'Next' END AS label, regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN page_id % 3 = 2 THEN '/m' ELSE '/' || (page_id + 1) END AS next_url,
CASE page_id % 3 WHEN 0 THEN 195 WHEN 1 THEN 115 ELSE 35 END AS score FROM pages""")
def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of a pager that leads on, among ones that lead back, are hidden or disabled."""
    marks = html_dom.Navigation(classes=("pager",), texts=("More",))

    @F.pandas_udf("struct<label:string,next_url:string,score:int>")
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        best = [html_dom.next_candidates(h, u, marks)[0] for h, u in zip(html, url, strict=True)]
        return pd.DataFrame({"label": [b["text"] for b in best], "next_url": [b["url"] for b in best], "score": [b["score"] for b in best]})

    k, page = F.col("page_id") % 3, (F.col("page_id") + 1).cast("string")
    on = F.when(k == 0, F.concat(F.lit('<a rel="next" href="/'), page, F.lit('">Next</a>'))).when(k == 1, F.concat(F.lit('<a href="/'), page, F.lit('">Next</a>'))).otherwise(F.lit('<a href="/m">More</a>'))
    html = F.concat(F.lit('<div class="x pager"><a rel="prev" href="/p">Back</a>'), on, F.lit('<a style="display: none" rel="next" href="/h">Next</a><button disabled aria-label="next">&gt;</button></div><a rel="next" href="/o">Next</a>'))
    return table(spark, sf_dir, "pages").select("page_id", run(html, F.col("url")).alias("b")).select("page_id", "b.*")


# --- streams ----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, kept by a stream of keyed upserts."""
    out = _folder(spark, "upserts")
    ingest.upsert_stream(_event_stream(spark, sf_dir), "user_id", "event_id", out, _folder(spark, "upserts-at")).awaitTermination()
    return ingest.read_upserts(spark, "user_id", out).select("user_id", "event_id", "event_type")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and types of event, each once, by a stream that drops repeats."""
    out = _folder(spark, "first-seen")
    timed = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ingest.first_seen(timed, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "first-seen-at")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, (greatest(0, ceil((len(w) - 200) / 180.0)) + 1)::BIGINT)) AS chunk_index FROM w WHERE len(w) > 0)
SELECT doc_id, chunk_index, array_to_string(w[chunk_index * 180 + 1:chunk_index * 180 + 200], ' ') AS content FROM c""")
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into windows as they arrive."""
    out = _folder(spark, "segments")
    docs = ingest.read_documents(spark, f"{sf_dir}/documents.parquet*", table(spark, sf_dir, "documents").schema)
    ingest.segment_stream(docs, out, _folder(spark, "segments-at")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "chunk_index", "content")
