"""Web parts, engines, stores, indexing and streams."""

from __future__ import annotations

import math
import random
import sys
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions import html_dom
from folioforge.functions import text as T
from folioforge.operators import compose, graph, graph_retriever, index, models, retrieve, split, stores
from folioforge.sources import engines, files, web
from folioforge.streaming import ingest

DIR = "/root/testdata/sf0.001"


# --- the web ---------------------------------------------------------------------------


def test_rules_and_cleanup():
    html = '''<div class="top bar x"><a href="/a">A</a></div><div class="top"><a href="/b" class="k">B</a></div><p style="display : NONE">gone</p><nav class="menu"><a href="/n">Next</a></nav><a href="/t">More</a>'''
    root = html_dom.parse(html)
    assert [html_dom.has_rule(e, ["bar top"]) for e in root.walk() if e.tag == "div"] == [True, False]
    assert [html_dom.has_style(e, ["display:none"]) for e in root.walk() if e.tag == "p"] == [True]
    left = html_dom.cleanup(root, ["bar top", "menu"], ("display:none",))
    assert [e.attrs["href"] for e in left.walk() if e.tag == "a"] == ["/b", "/t"] and "gone" not in left.text()
    found = html_dom.links(html, "http://h/", ignore=("bar top",), navigation=("menu",), texts=("More",))
    assert [(x["url"], x["is_navigation"]) for x in found] == [("http://h/b", False), ("http://h/n", True), ("http://h/t", True)]
    a, b = (html_dom.parse(f"<p>Same <a href='/{u}'>x</a></p>") for u in "12")
    assert html_dom.duplicate_signature(a) == html_dom.duplicate_signature(html_dom.parse("<p>same  <a href='/1'>X</a></p>")) != html_dom.duplicate_signature(b)


def test_merged_links(spark):
    rows = [("u", False, ["a"], "one", 1), ("u", False, ["a", "b"], "two", 2), ("u", True, [], "nav", 3), ("v", False, ["a"], "old", 4), ("v", False, ["b"], "new", 5)]
    merged = web.merge_links(spark.createDataFrame(rows, "url string, is_navigation boolean, classes array<string>, text string, seq int"))
    assert {(r.url, r.is_navigation): r.text for r in merged.collect()} == {("u", False): "two", ("u", True): "nav", ("v", False): "new"}


def test_states(spark):
    states = spark.createDataFrame([("u", 1, "A"), ("u", 2, "B"), ("v", 1, "C")], "url string, state int, content string")
    assert sorted((r.source, r.content) for r in web.state_documents(states).collect()) == [("u#nav-state=1", "A"), ("u#nav-state=2", "B"), ("v", "C")]
    one = {r.source: r.content for r in web.state_documents(states, "single_document").collect()}
    assert one["u"] == "===== NAVIGATION STATE 1/2 =====\nA\n\n===== NAVIGATION STATE 2/2 =====\nB"


def test_profiles():
    html = """<a href="/a.pdf">x</a><div data-url="/b"></div><button onclick="location.href='/c'">c</button><a href="http://o/x">y</a>"""
    assert html_dom.profile("links").urls(html, "http://h/") == ["http://h/a.pdf", "http://o/x"]
    assert html_dom.profile("documents").urls(html, "http://h/") == ["http://h/a.pdf"]
    assert html_dom.composed_urls(html, "http://h/", [html_dom.profile("script_links"), html_dom.profile("data_links", exclude=("//o/",))]) == ["http://h/c", "http://h/a.pdf", "http://h/b"]
    for bad in ({"kind": "eval"}, {"include": ("(",)}, {"kind": "attributes", "attributes": ()}, {"kind": "onclick_regex", "pattern": "x"}):
        with pytest.raises(ValueError):
            html_dom.Profile(**bad)
    with pytest.raises(ValueError):
        html_dom.profile("none")


def test_downloads_and_login(spark):
    rows = [("http://h/a.PDF?x", None, None, 200, "pdf", False), ("http://h/a", "text/csv; charset=x", None, 200, "csv", False), ("http://h/login/x", None, 'attachment; filename="r.docx"', 200, "docx", True), ("http://h/", None, None, 403, None, True), ("http://h/my/page", None, None, 200, None, True), ("http://h/blogin", None, None, 200, None, False)]
    df = spark.createDataFrame(rows, "url string, ctype string, disposition string, status int, kind string, login boolean")
    got = df.select("kind", "login", T.download_kind(F.col("url"), F.col("ctype"), F.col("disposition")).alias("k"), T.needs_login(F.col("url"), F.col("status"), "http://h/my").alias("l")).collect()
    assert [(r.k, r.l) for r in got] == [(r.kind, r.login) for r in got]


def test_fetch(spark):
    def primary(url):
        if "bad" in url:
            raise OSError("no")
        return f"<p>{url}</p>"

    def fallback(url):
        if "worse" in url:
            raise ValueError("never")
        return "other"

    urls = spark.createDataFrame([("good",), ("bad",), ("badworse",)], "url string")
    got = {r.url: (r.html, r.backend, r.error) for r in web.fetch(urls, primary, fallback, retries=1).collect()}
    assert got == {"good": ("<p>good</p>", "primary", None), "bad": ("other", "fallback", None), "badworse": (None, "fallback", "ValueError: never")}


def test_routed_downloads(spark):
    rows = [("a", b"x;y\n1;2", "csv"), ("b", b"<h1>T</h1>", "html"), ("c", b'{"k": 1}', "json"), ("d", b"plain", "text"), ("e", b"not a zip", "docx")]
    got = {r.source: (r.content, r.error is None) for r in files.route(spark.createDataFrame(rows, "source string, data binary, kind string"), F.col("kind")).collect()}
    assert got["a"][0].startswith("| x | y |") and got["b"][0] == "# T" and "- k: 1" in got["c"][0] and got["d"] == ("plain", True) and got["e"] == (None, False)


def test_headers(spark):
    df = spark.createDataFrame([({"Content-Type": "Text/HTML; x"}, "http://h/a.pdf"), ({"x": "y"}, "http://h/a.pdf"), ({}, "http://h/a")], "h map<string,string>, url string")
    ctype = T.header(F.col("h"), "content-type")
    assert [(r[0], r[1]) for r in df.select(ctype, T.is_html_response(ctype, F.col("url"))).collect()] == [("Text/HTML; x", True), (None, False), (None, True)]


# --- models ------------------------------------------------------------------------------------


def test_cluster_summarizer():
    asked = []
    short = models.ClusterSummarizer(lambda p: asked.append(p) or " brief ")
    assert short("some text", 50) == "brief" and "at most 50 characters" in asked[0] and "in english" in asked[0]
    short("немного текста", 50)
    assert "in russian" in asked[1]
    for bad in ("{context}", "{context} {max_chars} {target_ratio", "no placeholder"):
        with pytest.raises(ValueError):
            models.ClusterSummarizer(str, bad)
    with pytest.raises(TypeError):
        models.ClusterSummarizer(lambda p: None)("x", 1)
    assert models.table_summarizer(lambda p: p.split("\n\n")[1] + " ")("| a |") == "| a |"


def test_model_keywords(spark):
    def model(query):
        if "broken" in query:
            raise OSError("down")
        return '{"high": [" River ", "river"], "low": ["delta"]}' if "good" in query else '{"high": [], "low": ["x"]}'

    rows = graph_retriever.model_keywords(spark.createDataFrame([(1, "good one"), (2, "broken thing"), (3, "empty answer")], "query_id int, query string"), model)
    assert {r.query_id: (r.high, r.low) for r in rows.collect()} == {1: (["river"], ["delta"]), 2: (["broken", "thing"], ["broken", "thing"]), 3: (["answer", "empty"], ["empty", "answer"])}
    nodes = spark.createDataFrame([("a", "t", "delta", None, None)], "id string, type string, label string, description string, source_segment_id string")
    edges = graph.append_edges(spark.createDataFrame([("a", "a", "r", 1.0, None, 1)], "source_id string, target_id string, relation_type string, weight double, source_segment_id string, seq int"))
    chunks = spark.createDataFrame([("s", "x")], "segment_id string, content string")
    found = graph_retriever.retrieve(rows, graph_retriever.GraphTables(nodes, edges, chunks), graph_retriever.GraphQuery(mode="local")).collect()
    assert {r.query_id for r in found} == {1}


# --- engines -------------------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"page one\fpage two")
    (tmp_path / "two.pdf").write_bytes(b" \f ")
    return str(tmp_path)


def test_pdf_engines(spark, folder):
    pages = lambda d: d.decode().split("\f")
    got = {r.source[-7:]: (r.content, r.error) for r in engines.pdf_pages(spark, f"{folder}/*.pdf", pages, "PERMISSIVE").collect()}
    assert got["one.pdf"] == ("<!-- page: 1 -->\npage one\n\n<!-- page: 2 -->\npage two", None) and "no page has text" in got["two.pdf"][1]
    tables = engines.pdf_tables(spark, f"{folder}/one.pdf", lambda d: [[["a", "b"], ["1", "2"]], [["c"], ["3"]]], lambda t: f"{len(t)} characters").collect()
    assert [r.content.split("\n")[0] for r in sorted(tables, key=lambda r: r.part)] == ["| a | b |", "| c |"] and tables[0].metadata["rows"] == "1" and "summary" in tables[0].metadata
    for call in (engines.pdf_pages, engines.pdf_tables, engines.converted_files):
        with pytest.raises(NotImplementedError):
            call(spark, folder, None)
    with pytest.raises(NotImplementedError):
        engines.image_files(spark, folder)


def test_converter(spark, folder):
    script = "import sys, pathlib; d = pathlib.Path(sys.argv[2]); (d / 'a.md').write_text('x'); (d / 'b.md').write_text('the larger ' + pathlib.Path(sys.argv[1]).read_text()[:8])"
    good = (sys.executable, "-c", script, "{input}", "{output}")
    converter = engines.Converter((("/no/such/tool",), (sys.executable, "-c", "print('Fatal error')", "{input}"), good))
    row = engines.converted_files(spark, f"{folder}/one.pdf", converter).head()
    assert row.content == "the larger page one" and row.metadata["variant"] == "2"
    with pytest.raises(RuntimeError, match="TimeoutExpired"):
        engines.Converter(((sys.executable, "-c", "import time; time.sleep(9)"),), timeout=0.2)(b"")


def test_images_and_visuals(spark, tmp_path):
    (tmp_path / "cat.png").write_bytes(b"\x89PNG data")
    row = engines.image_files(spark, str(tmp_path), lambda d: " seen ", lambda url: url[:22]).head()
    assert row.content == "# cat\n\n## Summary\n\ndata:image/png;base64,\n\n## OCR\n\nseen"

    def model(prompt, url):
        if "broken" in prompt:
            raise OSError("down")
        return f"{'image' if url else 'text'}: {prompt.split('Slide title: ')[1][:5]}"

    rows = spark.createDataFrame([("Title", "chart", "1, 2", None), (None, "picture", None, bytearray(b"\xff\xd8\xff")), ("broken", "chart", "", None)], "title string, kind string, text string, image binary")
    got = [(r.summary, r.summary_error) for r in engines.summarize_visuals(rows, model).collect()]
    assert got == [("text: Title", None), ("image: none.", None), (None, "OSError: down")]


# --- stores, indexing ----------------------------------------------------------------------


def test_vector_store(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    store = stores.create_vector_store(spark, path, models.hashed_embedder(32))
    row = "segment_id string, text string, payload map<string,string>"
    store.add(spark.createDataFrame([("a", "red widget", {"k": "1"}), ("b", "blue gadget", {}), ("b", "blue gadget", {})], row))
    store.add(spark.createDataFrame([("b", "green gadget", {"k": "2"}), ("c", "red ring", None)], row))
    asked = spark.createDataFrame([(1, "green gadget")], "query_id int, query string")
    top = store.search(asked, 1).head()
    assert (top.segment_id, top.payload, round(top.score, 5)) == ("b", {"k": "2"}, 1.0)
    store.delete(spark.createDataFrame([("b",)], "segment_id string"))
    assert {r.segment_id for r in store.search(asked, 5).collect()} == {"a", "c"}
    before = sorted(r.segment_id for r in store.table.rows().collect())
    store.table.compact()
    assert sorted(r.segment_id for r in store.table.rows().collect()) == before and len(store.table._batches()) == 1
    assert stores.create_vector_store(spark, path, models.hashed_embedder(32), cleanup=True).table.rows().count() == 0
    with pytest.raises(ValueError):
        stores.create_vector_store(spark, path, None)
    with pytest.raises(ValueError):
        stores.create_vector_store(spark, path, models.hashed_embedder(4), "elsewhere")


def test_graph_store(spark, tmp_path):
    seen = {}
    stores.GRAPH_STORES["remote"] = lambda spark, path, auth, **_: seen.update(auth=auth)
    stores.create_graph_store(spark, "x", "remote", settings={"user": "u", "password": "p"})
    assert seen["auth"] == ("u", "p")
    stores.create_graph_store(spark, "x", "remote", auth=("a", "b"), settings={"user": "u"})
    assert seen.pop("auth") == ("a", "b") and stores.GRAPH_STORES.pop("remote")
    store = stores.create_graph_store(spark, f"file://{tmp_path}/graph")
    store.nodes.put(spark.createDataFrame([("a", "t", "old", None, None)], "id string, type string, label string, description string, source_segment_id string"))
    store.nodes.put(spark.createDataFrame([("a", "t", "new", None, None), ("b", "t", "b", None, None)], "id string, type string, label string, description string, source_segment_id string"))
    assert {r.id: r.label for r in store.nodes.rows().collect()} == {"a": "new", "b": "b"} and store.edges.rows().count() == 0
    with pytest.raises(ValueError):
        stores.create_graph_store(spark, "x", "none")


def test_index(spark, tmp_path):
    segments = spark.createDataFrame([("s1", "p", "long content", "text", "txt", "short"), ("s2", None, "content only", "text", "txt", None)], "segment_id string, parent_id string, content string, type string, original_format string, summary string")
    vectors, store = f"file://{tmp_path}/v", f"file://{tmp_path}/s"
    index.index(segments, models.hashed_embedder(16), vectors, store)
    got = {r.segment_id: r for r in spark.read.parquet(vectors).collect()}
    assert got["s1"].text == "short" and got["s1"].payload["is_summary_embedding"] == "true" and got["s1"].payload["parent_id"] == "p" and "parent_id" not in got["s2"].payload
    assert len(got["s2"].embedding) == 16 and spark.read.parquet(store).count() == 2
    newest = index.latest(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, seq int, v string"), "id", "seq").collect()
    assert [(r.id, r.v) for r in newest] == [("a", "y")]


def test_auto_ensemble(spark):
    one = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 16)], "query_id int, content string, rank int")
    two = spark.createDataFrame([(1, f"c{i}", 21 - i) for i in range(6, 21)], "query_id int, content string, rank int")
    score = lambda df: F.substring("content", 2, 9).cast("double")
    got = compose.auto_ensemble_rerank([one, two], score, 3).orderBy("rerank").collect()
    assert [r.content for r in got] == ["c20", "c19", "c18"]
    assert [r.content for r in compose.auto_ensemble_rerank([one], score, 1).collect()] == ["c15"]


# --- streams -------------------------------------------------------------------------------


def test_segment_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    (tmp_path / "in").mkdir()
    docs.where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/in/a")
    read = lambda: ingest.read_documents(spark, f"{tmp_path}/in/*", docs.schema)
    out, at = f"{tmp_path}/out", f"{tmp_path}/at"
    ingest.segment_stream(read(), out, at, 50, 5).awaitTermination()
    first = spark.read.parquet(out).count()
    ingest.segment_stream(read(), out, at, 50, 5).awaitTermination()
    assert spark.read.parquet(out).count() == first > 0
    docs.where("doc_id % 2 = 1").write.parquet(f"{tmp_path}/in/b")
    ingest.segment_stream(read(), out, at, 50, 5).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(out).select("doc_id").distinct().collect()} == {r.doc_id for r in docs.where("text <> ''").collect()}


def test_upsert_stream(spark, tmp_path):
    schema, out, at = "k int, n int, v string", f"{tmp_path}/out", f"{tmp_path}/at"
    for i, rows in enumerate(([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], [(2, 2, "d"), (3, 1, "e")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "k", "n", out, at).awaitTermination()
    want = [(1, "b"), (2, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in ingest.read_upserts(spark, "k", out).collect()) == want
    ingest.compact_upserts(spark, "k", out)
    assert sorted((r.k, r.v) for r in ingest.read_upserts(spark, "k", out).collect()) == want and spark.read.parquet(out).count() == 3


def test_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "x"), (1, "2024-01-01 00:01:00", "x"), (2, "2024-01-01 00:02:00", "y")], "id int, ts string, body string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.first_seen(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["id"], "ts", "10 minutes")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_event_counts_as_a_stream(spark, tmp_path):
    """The stream's closed windows are those of the batch query."""
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    counted = ingest.event_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    counted.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = {(r.start, r.event_type): r.n for r in ingest.event_counts(events).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(batch) - len(got) <= 10


# --- edit distance ------------------------------------------------------------------------


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_against_all_pairs(spark, monkeypatch):
    """Queries up to a word of bits are compared in batches, each distinct one once; no pair of texts goes to the built-in."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abÉя𝒳") for _ in range(rng.randint(0, n)))
    texts = [(i, rng.choice([None, word(4), word(9), "x" * 62 + word(6)])) for i in range(60)] + [(60, ""), (61, "x" * 70)]
    asked = [(i, rng.choice([None, word(4), word(9), "X" * 60 + word(4)])) for i in range(30)] + [(30, ""), (31, "x" * 64), (32, "x" * 64)]
    corpus, queries = spark.createDataFrame(texts, "id int, content string"), spark.createDataFrame(asked, "query_id int, query string")
    want = {(q, i, d) for q, x in asked for i, t in texts if x is not None and t is not None and (d := edits(x.lower(), t.lower())) <= 3}
    long = queries.unionByName(spark.createDataFrame([(99, "x" * 68)], "query_id int, query string"))
    found = retrieve.levenshtein_scan(long, corpus, 3).select("query_id", "id", "distance").collect()
    assert {(*r,) for r in found} == want | {(99, i, d) for i, t in texts if t is not None and (d := edits("x" * 68, t.lower())) <= 3} and len(found) == len({(*r,) for r in found})

    def refused(*_):
        raise AssertionError("pair by pair")

    monkeypatch.setattr(retrieve.F, "levenshtein", refused)
    found = retrieve.levenshtein_scan(queries, corpus, 3).select("query_id", "id", "distance").collect()
    assert {(*r,) for r in found} == want and len(found) == len(want)


# --- crawls -----------------------------------------------------------------------------------


def test_crawl_of_long_chains_takes_no_waves(spark, monkeypatch):
    """A host's links are followed in a task, with the results of following them wave by wave."""
    rng = random.Random(7)
    page = lambda h, i: f"http://{'AB'[h]}.com/{i}"
    links = [(page(h, rng.randrange(14)), page(h if rng.random() < 0.9 else 1 - h, rng.randrange(14)), rng.random() < 0.3) for h in (0, 1) for _ in range(22)]
    starts = spark.createDataFrame([(page(0, 0),), (page(0, 1) + "#x",), (page(1, 2),), ("http://c.com/",), ("nowhere",)], "url string")
    table = spark.createDataFrame([*links, (page(0, 0), "ftp://a.com/x", False)], "page_url string, url string, is_navigation boolean")
    rows = lambda df: sorted((r.url, r.start_url, r.depth) for r in df.collect())
    want = rows(web.crawl(starts, table, 2, most=0))
    assert len(want) > 12 and max(d for *_, d in want) == 2
    chain = spark.createDataFrame([(page(0, i), page(0, i + 1), True) for i in range(400)], "page_url string, url string, is_navigation boolean")

    def refused(*_):
        raise AssertionError("wave by wave")

    monkeypatch.setattr(web, "_follow", refused)
    assert rows(web.crawl(starts, table, 2)) == want
    assert [r.depth for r in web.crawl(starts.limit(1), chain, 1).collect()] == [0] * 401


# --- vector search in bounded memory ------------------------------------------------------------


def test_vector_search_holds_a_block_of_scores(spark, monkeypatch):
    """Rows of a batch are scored a block at a time; the k first of each query stay, ties by key, over all blocks and batches."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (12000, 4)).astype(float)
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(200)] + [(200, None)], "query_id int, embedding array<double>")
    corpus, taken = spark.createDataFrame([(0, [1.0])], "vec_id int, embedding array<double>"), []
    kind = type(corpus)
    real = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda df, run, schema: taken.append(run) or real(df, run, schema))
    retrieve.vector_search(queries, corpus, 5)
    order = rng.permutation(12000)
    batches = [pd.DataFrame({"vec_id": part, "embedding": [vectors[i] for i in part]}) for part in (order[:10000], order[10000:10003], order[10003:])]
    tracemalloc.start()
    found = pd.concat(list(taken[0](iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    norm = np.linalg.norm(vectors, axis=1)
    scores = np.divide(vectors[:200] @ vectors.T, norm[:200, None] * norm[None], out=np.zeros((200, 12000)), where=norm[:200, None] * norm[None] > 0)
    for q, rows in found.groupby("query_id"):
        mine = scores[q] if q < 200 else np.zeros(12000)
        best = set(np.lexsort((np.arange(12000), -mine))[:5])
        assert len(rows) == 5 and np.allclose(np.sort(rows["score"]), np.sort(mine[list(best)])) and (q < 200 or set(rows["vec_id"]) == best)
    assert found["query_id"].nunique() == 201 and peak < 20 << 20  # all of a batch: 16 MB an array, several of them



def searched(spark, monkeypatch, queries, batches, k):
    """What one task of the vector search yields for batches, and its peak of traced memory."""
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    corpus, taken = spark.createDataFrame([(0, [1.0])], "vec_id int, embedding array<double>"), []
    real = type(corpus).mapInPandas
    with monkeypatch.context() as m:
        m.setattr(type(corpus), "mapInPandas", lambda df, run, schema: taken.append(run) or real(df, run, schema))
        retrieve.vector_search(asked, corpus, k)
    tracemalloc.start()
    found = pd.concat(list(taken[0](iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, peak


def test_vector_search_holds_no_more_where_all_scores_tie(spark, monkeypatch):
    """Rows that tie for all queries take no more memory than others: not all pairs of a block are held at once."""
    row = [float(x) for x in np.random.default_rng(5).normal(size=8)]
    keys = np.random.default_rng(6).permutation(4096)
    batches = [pd.DataFrame({"vec_id": part, "embedding": [np.array(row)] * len(part)}) for part in (keys[:4000], keys[4000:])]
    found, peak = searched(spark, monkeypatch, [(i, row) for i in range(1024)], batches, 6)
    got = found.sort_values(["query_id", "vec_id"])["vec_id"].to_numpy().reshape(1024, 6)
    assert (got == np.arange(6)).all() and peak < 32 << 20


def test_vector_search_scores_a_pair_alike_wherever_it_is(spark, monkeypatch):
    """Copies of a row tie, whatever rows stand about them; a score is the sum in order over the root of the product of norms."""
    rng = np.random.default_rng(7)
    one = rng.normal(size=(37, 67))
    vectors = np.tile(one, (29, 1))
    vectors[rng.integers(0, len(vectors), 30)] *= 1e-3  # parallel, of another norm
    cuts = [0, 1, 4, 11, 500, 513, len(vectors)]
    batches = [pd.DataFrame({"vec_id": range(a, b), "embedding": list(vectors[a:b])}) for a, b in zip(cuts, cuts[1:])]
    asked = rng.normal(size=(41, 67))
    found, _ = searched(spark, monkeypatch, [(i, [float(x) for x in v]) for i, v in enumerate(asked)], batches, 5)
    for i, v in enumerate(asked):
        scores = []
        for x in vectors:
            dot = left = right = 0.0
            for a, b in zip(map(float, v), map(float, x)):
                dot, left, right = dot + a * b, left + a * a, right + b * b
            scores.append(min(1.0, max(-1.0, dot / math.sqrt(left * right))))
        want = sorted(range(len(vectors)), key=lambda j: (-scores[j], j))[:5]
        rows = found[found["query_id"] == i].sort_values(["score", "vec_id"], ascending=[False, True])
        assert rows["vec_id"].tolist() == want and rows["score"].tolist() == [scores[j] for j in want]


def test_vector_search_of_odd_vectors(spark, monkeypatch):
    """Other lengths, none, zero, huge and tiny vectors; a score of NaN comes first, as in Spark's order."""
    given = {0: [1.0, 0.0], 1: [0.0, 0.0], 2: None, 3: [1.0], 4: [float("nan"), 1.0], 5: [1e-90, 1e-90], 6: [-1e90, 1e90], 7: [2.0, 1e-9], 8: [-1.0, 0.0], 9: [float("inf"), 0.0]}
    batches = [pd.DataFrame({"vec_id": [i], "embedding": [None if v is None else np.array(v)]}) for i, v in given.items()]
    together = [pd.concat(batches)]
    asked = [(0, [1.0, 0.0]), (1, None), (2, [-3.0]), (3, [0.0, 0.0]), (4, [1e-90, 0.0])]
    want = {0: [9, 0, 7, 5], 1: [0, 1, 2, 3], 2: [0, 1, 2, 4], 3: [0, 1, 2, 3], 4: [9, 0, 7, 5]}
    for given in (batches, together):
        found, _ = searched(spark, monkeypatch, asked, given, 4)
        got = {}
        for q, rows in found.groupby("query_id"):
            rows = rows.assign(first=rows["score"].isna(), score=rows["score"].round(9)).sort_values(["first", "score", "vec_id"], ascending=[False, False, True])
            got[q] = rows["vec_id"].tolist()
        assert got == want


# --- batches of bounded bytes ---------------------------------------------------------------------


@pytest.mark.parametrize("use", [lambda df: split.python_chunks(lambda t: [t], F.col("text")), lambda df: split.json_split(df), lambda df: web.render(F.col("text")), lambda df: web.page_blocks(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")))])
def test_batches_are_bounded_by_bytes(spark, use):
    """Functions over texts get batches of a megabyte or so, however long the texts are; a lower bound stays."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))
    use(df)

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    assert df.select(together("text").alias("n")).agg(F.max("n")).head()[0] <= (1 << 20) + 100_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000")
    use(df)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


# --- graph search for a few queries ---------------------------------------------------------------


def test_few_graph_queries_are_not_scored_pair_by_pair(spark, monkeypatch):
    """Rows are marked once with the tokens of a few queries; pairs and scores are those of all pairs, whatever is near what."""
    labels = ["alpha", "alphabet soup", "beta station", "stationary", "tion", "  ", "ABC abc al", "the phab", "phabet", "soup's of day", "дельта река", "льта", "a%b_c.*", "station beta x"]
    nodes = spark.createDataFrame([(f"n{i}", x, None if i % 3 else "part of beta") for i, x in enumerate(labels)], "id string, label string, description string")
    edges = graph.append_edges(spark.createDataFrame([(f"n{i}", f"n{(i * 5) % 14}", "near", 1.0 + i, None, i) for i in range(14)], "source_id string, target_id string, relation_type string, weight double, source_segment_id string, seq int"))
    priors = graph.node_priors(nodes, edges)
    asked = spark.createDataFrame([((1, q), q) for q in ["alphabet", "Station beta", "soup of", "al", "", " ", "zzzz", "дельта", "a%b_c.*", "abc"]], "query_id struct<of:int,query:string>, query string")
    found, plans = [], []
    for words in (graph.FEW_WORDS, 0):
        monkeypatch.setattr(graph, "FEW_WORDS", words)
        both = graph.search_nodes_hybrid(asked, nodes, priors, 100), graph.search_edges_hybrid(asked, nodes, edges, priors, 100)
        plans.append([df._jdf.queryExecution().executedPlan().toString() for df in both])
        found.append([sorted(map(tuple, df.select("query_id", key, "score").collect())) for df, key in zip(both, ("id", "edge_id"), strict=True)])
    assert found[0] == found[1] and all(len(x) > 40 for x in found[0])
    assert not any("array_intersect" in p for p in plans[0]) and all("array_intersect" in p for p in plans[1])


def test_hashed_embedder_hashes_a_word_once(monkeypatch):
    """The vectors are those of one hash an occurrence, also when words are forgotten."""
    import hashlib
    import re

    texts = ["the cat and the dog and the cat", "", "Ünïcode ünïcode река", " ".join(f"w{i % 7}" for i in range(200))]
    want = []
    for t in texts:
        v = np.zeros(16)
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 16] += 1 if h >> 63 else -1
        want.append((v / np.sqrt(v @ v) if v.any() else v).tolist())
    real, calls = hashlib.blake2b, []
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert models.hashed_embedder(16)(texts) == want and len(calls) == 4 + 2 + 7
    monkeypatch.setattr(models, "SLOTS", 3)
    assert models.hashed_embedder(16)(texts) == want


# --- fusion in bounded tasks -------------------------------------------------------------------------


def test_fusion_spreads_queries_by_the_rows_of_the_lists(spark, monkeypatch):
    """However few bytes the lists have, a task fuses a bounded number of rows; scores and ranks are the same."""
    from folioforge.plans.catalogue import QUERIES

    lists = [spark.createDataFrame([(q, f"k{(i * s) % 9}", i + 1) for q in range(50) for i in range(7)], "query_id int, content string, rank int") for s in (1, 2, 4)]
    want = defaultdict(float)
    for s, w in ((1, 0.5), (2, 0.3), (4, 0.2)):
        for i in range(7):
            want[f"k{(i * s) % 9}"] += w / (60 + i + 1)
    order = sorted(want, key=lambda k: (-round(want[k], 12), k))
    monkeypatch.setattr(compose, "TASK_ROWS", 100)
    found = compose.rrf(lists, [0.5, 0.3, 0.2], most=350)
    assert found.rdd.getNumPartitions() == 11
    for q, rows in pd.DataFrame([r.asDict() for r in found.collect()]).groupby("query_id"):
        rows = rows.sort_values("rank")
        assert list(rows["content"]) == order and np.allclose(rows["score"], [want[k] for k in order])
    twice = spark.createDataFrame([(1, "a", 5), (1, "a", 2), (1, "b", 1)], "query_id int, content string, rank int")
    assert {r.content: r.score for r in compose.rrf([twice, twice.where("content = 'b'")]).collect()} == {"a": 0.5 / 62, "b": 0.5 / 61 + 0.5 / 61}
    orders = 1500
    for name in ("ensemble_rrf", "vector_graph_hybrid"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 2 * orders // 100


def test_texts_come_to_few_hits_without_a_shuffle(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"s{i}", f"text {i}") for i in range(40)], "segment_id string, content string")
    hits = spark.createDataFrame([(q, f"s{q * 3}", q / 10) for q in range(8)] + [(9, "none", 0.5)], "query_id int, segment_id string, score double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        few = graph_retriever.with_texts(hits, chunks)
        assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" not in plan(few)
        monkeypatch.setattr(graph_retriever, "FEW_HITS", 5)
        many = graph_retriever.with_texts(hits, chunks)
        assert "BroadcastHashJoin" not in plan(many)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted((f"s{q * 3}", q, q / 10, f"text {q * 3}") for q in range(8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
