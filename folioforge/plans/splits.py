"""Registered splitter, table, JSON and web queries and their SQL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import html_dom, jsons
from folioforge.functions import text as T
from folioforge.operators import split
from folioforge.session import table
from folioforge.sources import web

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, (greatest(0, ceil((len(w) - 128) / 112.0)) + 1)::BIGINT)) AS chunk_index, (greatest(0, ceil((len(w) - 128) / 112.0)) + 1)::BIGINT AS chunk_total FROM w WHERE len(w) > 0)
SELECT doc_id, chunk_index, chunk_total, array_to_string(w[chunk_index * 112 + 1:chunk_index * 112 + 128], ' ') AS content FROM c""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.token_windows(table(spark, sf_dir, "documents"), 128, 16).select("doc_id", "chunk_index", "chunk_total", "content")


_LINES = "l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS c, text FROM documents), e AS (SELECT doc_id, c, text, unnest(range(0, len(c))) AS chunk_index, len(c) AS chunk_total FROM l WHERE len(c) > 0)"


@query(f"WITH {_LINES} SELECT doc_id, chunk_index, chunk_total, c[chunk_index + 1] AS content, md5(doc_id || chr(31) || 'regex' || chr(31) || chunk_index) AS segment_id FROM e")
def regex_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return split.emit(docs, split.regex_split(F.col("text"), "\n"), "regex", starts=False).select("doc_id", "chunk_index", "chunk_total", "content", "segment_id")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM l),
s AS (SELECT doc_id, i, c[i] AS x, CASE WHEN i = 1 THEN 0 ELSE list_sum(list_transform(c[1:i - 1], lambda y: length(y) + 1)) END AS pos FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, pos::BIGINT AS start_index FROM s WHERE x <> ''""")
def split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return split.emit(docs, split.regex_split(F.col("text"), "\n"), "regex").select("doc_id", "chunk_index", "start_index")


@query("""WITH p AS (SELECT u.conv_id, u.turn, 'Q: ' || u.text || chr(10) || 'A: ' || a.text AS qa FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT conv_id, string_agg(qa, chr(10) || chr(10) ORDER BY turn) AS t FROM p GROUP BY conv_id),
s AS (SELECT conv_id, list_filter(list_transform(string_split(t, 'Q: '), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS c FROM t)
SELECT conv_id, i AS chunk_index, 'Q: ' || c[i + 1] AS content, regexp_replace(regexp_replace(string_split(c[i + 1], chr(10))[1], '^\\s+', ''), '\\s+$', '') AS question FROM (SELECT conv_id, c, unnest(range(0, len(c))) AS i FROM s)""")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    qa = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("Q: "), "q", F.lit("\nA: "), "a").alias("qa"))
    text = qa.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "qa"))), lambda x: x["qa"]), "\n\n").alias("text"))
    return split.emit(text, split.qa_pairs(F.col("text")), "qa", key="conv_id", starts=False).select("conv_id", "chunk_index", "content", split.question_of(F.col("content")).alias("question"))


@query("""WITH n AS (SELECT s_nationkey, s_suppkey, s_suppkey || ',' || s_name AS line, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)
SELECT s_nationkey, n // 3 AS chunk_index, 's_suppkey,s_name' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS content, min(n) AS data_row_start, max(n) + 1 AS data_row_end FROM n GROUP BY ALL""")
def csv_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return split.row_chunks(s, F.lit("s_suppkey,s_name"), F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name"), 3, by=["s_nationkey"], order=["s_suppkey"])


@query("""SELECT r_name, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS content
FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def markdown_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.replace("n_name", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    rows = split.row_chunks(joined, F.lit("| n_nationkey | n_name |\n| --- | --- |"), line, 1000, by=["r_name"], order=["n_nationkey"])
    return rows.select("r_name", "content")


@query("SELECT event_id, 'json__k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_leaf_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.json_split(table(spark, sf_dir, "events"), key="event_id", text="props")
    return rows.select("event_id", F.explode("metadata").alias("key", "value")).where("key <> 'json_index'")


@query("""SELECT user_id, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id""")
def json_path_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"items": ['), F.array_join(F.collect_list("props"), ", "), F.lit("]}")).alias("text"))
    rows = split.json_split(blob, "items", key="user_id")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("metadata")["json__k"].cast("long")).alias("total"))


_LAT = r"length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_CYR = r"length(regexp_replace(text, '[^\x{400}-\x{4FF}]', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {_CYR} > {_LAT} AND {_CYR} >= 0.3 * n THEN 'russian' WHEN {_LAT} >= 0.3 * n THEN 'english' END AS script FROM (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents)")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", split.detect_language(F.col("text")).alias("script"))


@query("""WITH l AS (SELECT doc_id AS page, source, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS pos, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents),
z AS (SELECT source, page, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '', 'g'), '\\s+', ' ', 'g')) AS sig FROM l WHERE pos <= 4 OR pos > n - 4),
p AS (SELECT source, count(DISTINCT page) AS pages FROM l GROUP BY source)
SELECT z.source, sig, count(*) AS uses, count(DISTINCT page) AS pages_with FROM z JOIN p USING (source) WHERE sig <> '' AND p.pages >= 2 GROUP BY z.source, sig, p.pages HAVING count(*) >= 2 AND count(DISTINCT page) >= 2 AND count(DISTINCT page) / p.pages >= 0.2""")
def header_footer_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.sources import files

    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return files.repeated_lines(pages).withColumnRenamed("doc", "source")


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label, vec_id, list_cosine_similarity(v, lead(v) OVER w) AS sim FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
t AS (SELECT *, quantile_cont(sim, 0.3) OVER (PARTITION BY label) AS threshold FROM s), b AS (SELECT *, CASE WHEN lag(sim) OVER w < threshold THEN 1 ELSE 0 END AS b FROM t WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, round(sim, 6) AS sim, round(threshold, 6) AS threshold, sum(b) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS chunk_id FROM b""")
def semantic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.semantic_boundaries(table(spark, sf_dir, "embeddings"), by=["label"], order="vec_id", mode="percentile", percentile=30)
    return rows.select("label", "vec_id", F.round("sim", 6).alias("sim"), F.round("threshold", 6).alias("threshold"), "chunk_id")


@query()
def semantic_boundaries_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.semantic_boundaries(table(spark, sf_dir, "embeddings"), by=["label"], order="vec_id", mode="percentile_local", percentile=30, local=10, least=5, window=2)
    return rows.select("label", "vec_id", F.round("threshold", 6).alias("threshold"), "chunk_id")


def _text_chunks(spark: SparkSession, sf_dir: str, fn) -> DataFrame:
    return split.emit(table(spark, sf_dir, "documents"), split.python_chunks(fn, F.col("text")), fn.__name__, starts=False)


@query()
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    def recursive_500(t: str) -> list[str]:
        return split.recursive(t, 500, 50)

    return _text_chunks(spark, sf_dir, recursive_500)


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sentence_500(t: str) -> list[str]:
        return split.pack_sentences(t, 500, 80)

    return _text_chunks(spark, sf_dir, sentence_500)


_MD = """r AS (SELECT r_regionkey, r_name, string_agg('## ' || n_name || chr(10) || 'key ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS body FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)"""


@query(f"""SELECT r_regionkey AS doc_id, 1 AS level, r_name AS title, '' AS path, '# ' || r_name || chr(10) || 'intro' AS content FROM region
UNION ALL SELECT n_regionkey, 2, n_name, r_name, '## ' || n_name || chr(10) || 'key ' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey""")
def markdown_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    part = F.concat(F.lit("## "), "n_name", F.lit("\nkey "), F.col("n_nationkey").cast("string"))
    docs = n.groupBy(F.col("r_regionkey").alias("doc_id"), "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", part.alias("p")))).alias("x"))
    text = docs.select("doc_id", F.concat(F.lit("# "), "r_name", F.lit("\nintro\n"), F.array_join(F.transform("x", lambda s: s["p"]), "\n")).alias("text"))
    rows = split.explode_dicts(text, split.markdown_hierarchy, "content string, title string, level int, path array<string>")
    return rows.select("doc_id", "level", "title", F.array_join("path", "/").alias("path"), "content")


@query("""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), o AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS url FROM h WHERE href LIKE '/%')
SELECT page_id, count(DISTINCT string_split(url, '#')[1]) AS links FROM o GROUP BY page_id""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.page_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.page_blocks(table(spark, sf_dir, "pages")).select("page_id", "position", "kind", "level", "title", "markdown")


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.render(F.col("html")).alias("markdown"))


@query(r"SELECT page_id, false AS page_is_xml, '# Page ' || page_id || chr(10) || chr(10) || 'at ' || replace(url, '_', '\_') AS made FROM pages")
def html_strict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parsing: the pages, none of which is well-formed, and a well-formed one made of each."""
    made = F.concat(F.lit("<html><body><h1>Page "), F.col("page_id").cast("string"), F.lit("</h1><p>at "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</p></body></html>"))
    return table(spark, sf_dir, "pages").select("page_id", web.render(F.col("html"), strict=True).isNotNull().alias("page_is_xml"), web.render(made, strict=True).alias("made"))


@query()
def html_repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.drop_repeated_blocks(web.page_blocks(table(spark, sf_dir, "pages"))).select("page_id", "position", "kind", "markdown")


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return split.explode_dicts(pages, html_dom.split_html, "content string, type string, level int, path array<string>, parent int", key="page_id", text="html")


@query("""SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, trim(regexp_replace(url, '#.*$', '')) AS url,
regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) LIKE '%.example.com' AS in_domain,
regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) = sh AS same_host, regexp_extract(lower(url), '([^./]+[.][^./:?#]+)(?:[:/?#]|$)', 1) = regexp_extract(sh, '([^.]+[.][^.]+)$', 1) AS same_domain, starts_with(lower(url), 'http') AS anywhere
FROM pages, (SELECT regexp_extract(lower(min(url)), '^[a-z]+://([^/?#:]+)', 1) AS sh FROM pages)""")
def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    p = p.crossJoin(F.broadcast(p.agg(F.min("url").alias("start"))))  # one row
    return p.select("page_id", T.url_host(F.col("url")).alias("host"), T.normalize_url(F.col("url")).alias("url"), *[T.in_scope(F.col("url"), F.col("start"), scope, ("example.com",)).alias(name) for name, scope in (("in_domain", "allowed_domains"), ("same_host", "same_host"), ("same_domain", "same_domain"), ("anywhere", "allow_all"))])


@query("""WITH RECURSIVE p AS (SELECT DISTINCT regexp_replace(trim(url), '#.*$', '') AS u, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, min(page_id) OVER (PARTITION BY regexp_replace(trim(url), '#.*$', '')) AS id FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id, u) AS k FROM p), e AS (SELECT a.u, b.u AS v, 1 AS cost FROM o a JOIN o b ON a.host = b.host AND b.k IN (2 * a.k, 2 * a.k + 1) UNION ALL SELECT a.u, b.u, 0 FROM o a JOIN o b ON a.host = b.host AND b.k = a.k + 40),
r AS (SELECT u AS url, 0 AS depth FROM o WHERE k = 1 UNION SELECT e.v, depth + cost FROM r JOIN e ON e.u = r.url WHERE depth + cost <= 3)
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a synthetic web: the k-th page of a host links to those of 2k and 2k + 1, and its
    navigation to that of k + 40, at the same depth."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "pages").select(T.normalize_url(F.col("url")).alias("u"), T.url_host(F.col("url")).alias("host"), "page_id").groupBy("u", "host").agg(F.min("page_id").alias("id"))
    o = p.withColumn("k", F.row_number().over(W.partitionBy("host").orderBy("id", "u")))
    child = o.select("host", F.col("u").alias("url"), F.col("k").alias("kk"), F.floor(F.col("k") / 2).alias("k"))
    links = o.join(child, ["host", "k"]).select(F.col("u").alias("page_url"), "url", F.lit(False).alias("is_navigation"))
    beside = o.select("host", F.col("u").alias("url"), (F.col("k") - 40).alias("k"))
    links = links.unionByName(o.join(beside, ["host", "k"]).select(F.col("u").alias("page_url"), "url", F.lit(True).alias("is_navigation")))
    return web.crawl(o.where("k = 1").select(F.col("u").alias("url")), links, 3).select("url", "depth")


@query("""SELECT event_id, '## Item 1' || chr(10) || '- k: ' || regexp_extract(props, '"k": ([0-9]+)', 1) AS markdown FROM events""")
def json_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: jsons.as_markdown(json.loads(t)) if t else None)

    return table(spark, sf_dir, "events").select("event_id", run("props").alias("markdown"))


@query("SELECT s_nationkey, count(*)::BIGINT AS row_count, ';' AS delimiter, string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY s_suppkey) AS body FROM supplier GROUP BY s_nationkey")
def csv_blob_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one CSV file a nation, read by the CSV source's parser and rendered as markdown."""
    from folioforge.functions import tables as md
    from folioforge.sources import files

    def parse(data: bytes) -> list[tuple[str, dict]]:
        text = data.decode()
        d = md.sniff_delimiter(text)
        t = md.parse_csv(text, d)
        return [(md.render_markdown(t), {"row_count": len(t.rows), "delimiter": d})]

    s = table(spark, sf_dir, "supplier")
    line = F.concat_ws(";", F.col("s_suppkey").cast("string"), "s_name")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n")
    blobs = s.groupBy("s_nationkey").agg(F.encode(F.concat(F.lit("key;name\n"), text), "UTF-8").alias("data")).withColumn("source", F.col("s_nationkey").cast("string"))
    rows = files.extract(blobs.select("source", "data"), parse)
    body = F.array_join(F.slice(F.split("content", "\n"), 3, 1_000_000), "\n")
    return rows.select(F.col("source").cast("int").alias("s_nationkey"), F.col("metadata")["row_count"].cast("long").alias("row_count"), F.col("metadata")["delimiter"].alias("delimiter"), body.alias("body"))


@query("SELECT page_id, count(DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) || href) AS urls FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href LIKE '/%' AND NOT contains(href, 'e.') GROUP BY page_id")
def profile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static ``attributes`` profile with an exclusion."""

    @F.pandas_udf("array<string>")
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([html_dom.profile_urls(h, u, "attributes", exclude=(r"://[^/]+/.*e\.",)) for h, u in zip(html, url, strict=True)])

    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(run("html", "url")).alias("u"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("urls"))
