from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import communities, compose, graph, graph_retriever, retrieve, tree
from folioforge.sources import files


def test_hydration(spark):
    hits = spark.createDataFrame([(1, 1, "a", "p1", "A", 0.4), (1, 2, "b", "p1", "B", 0.9), (1, 3, "c", "p2", "C", 0.5), (1, 4, "d", None, "D", 0.1)], "query_id int, rank int, id string, parent_id string, content string, score double")
    parents = spark.createDataFrame([("p1", "Parent 1"), ("p2", "Parent 2")], "parent_id string, parent_content string")
    out = compose.hydrate(hits, parents).orderBy("position").collect()
    assert [(r.content, r.score) for r in out] == [("Parent 1", 0.9), ("Parent 2", 0.5), ("D", 0.1)]
    out = compose.hydrate(hits, parents, "children_plus_parents").orderBy("position").collect()
    assert [r.content for r in out] == ["A", "B", "C", "D", "Parent 1", "Parent 2"]
    with pytest.raises(ValueError):
        compose.hydrate(hits, parents, "none")


def test_fuzzy_scores():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(2))
        assert retrieve.lcs(a, b) == brute(a, b)
    assert retrieve.partial_ratio("abc", "xxabcxx") == 100 and retrieve.token_set_ratio("b a", "a b c") == 100


def test_fusion_ignores_list_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, content string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, content string, rank int")
    one, two = (sorted((r.content, round(r.score, 12)) for r in compose.rrf(x).collect()) for x in ([a, b], [b, a]))
    assert one == two
    with pytest.raises(ValueError):
        compose.rrf([])
    with pytest.raises(ValueError):
        compose.tournament_rerank(a, F.lit(1.0), 1)


def _edges(spark, pairs):
    return graph.append_edges(spark.createDataFrame([(a, b, "r", 1.0, None, i) for i, (a, b) in enumerate(pairs)], "source_id string, target_id string, relation_type string, weight double, source_segment_id string, seq int"))


def test_hops_and_cap(spark):
    edges = _edges(spark, [("A", "B"), ("B", "C"), ("A", "B"), ("C", "C")])
    assert {r.edge_id for r in edges.collect()} == {"A|r|B|0", "A|r|B|1", "B|r|C|0", "C|r|C|0"}
    seeds = spark.createDataFrame([(1, "A", 1)], "query_id int, id string, seat int")
    assert {r.id for r in graph.expand(edges, seeds, 1)[0].collect()} == {"A", "B"}
    nodes, inside = graph.expand(edges, seeds, 2)
    assert {(r.id, r.hop) for r in nodes.collect()} == {("A", 0), ("B", 1), ("C", 2)} and inside.count() == 3
    assert {r.id for r in graph.expand(edges, seeds, 2, 2)[0].collect()} == {"A", "B"}
    assert {r.id: r.degree for r in graph.degrees(edges).collect()} == {"A": 2, "B": 3, "C": 3}
    assert graph.expand(edges, seeds, -1)[0].count() == 0


def test_communities(spark):
    edges = _edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y"), ("Y", "Z"), ("Z", "X")])
    by = {r.id: r.community_id for r in communities.detect(edges).collect()}
    assert by["A"] == by["B"] == by["C"] != by["X"] == by["Y"] == by["Z"]
    found = communities.greedy_modularity([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "z"), ("z", "x")])
    assert found == [["a", "b", "c"], ["x", "y", "z"]]


def test_greedy_communities_of_hubs_take_few_steps(monkeypatch):
    """The heap takes a few entries an edge; it took one for each pair of a hub's leaves. Gains that tie go by least member."""
    pushed, push = [0], communities.heapq.heappush

    def counted(heap, item):
        pushed[0] += 1
        push(heap, item)

    monkeypatch.setattr(communities.heapq, "heappush", counted)
    edges = [(f"n{i}", "r") for i in range(4)] + [(f"c{j:04}", f"n{j % 4}") for j in range(2000)]
    found = communities.greedy_modularity(edges)
    assert found == [["c0000", *(f"c{j:04}" for j in range(4, 2000, 4)), "n0", "r"], *(sorted([f"n{i}", *(f"c{j:04}" for j in range(i, 2000, 4))]) for i in (1, 2, 3))]
    assert pushed[0] < 10 * len(edges)
    assert communities.greedy_modularity([("b", "a"), ("c", "b"), ("d", "c")]) == [["a", "b"], ["c", "d"]]
    assert communities.greedy_modularity([("a", "a"), ("a", "b"), ("a", "b"), ("c", "b")]) == [["b", "c"], ["a"]]


def test_label_propagation(spark):
    """Large components: two cliques and a bridge; a star, whose two sides would swap labels for ever."""
    ring = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    by = {r.id: r.community for r in communities.label_propagation(_edges(spark, ring)).collect()}
    assert len({by[f"a{i}"] for i in range(6)}) == len({by[f"b{i}"] for i in range(6)}) == 1
    assert communities.label_propagation(_edges(spark, [("s", f"l{i}") for i in range(4)])).count() == 5
    found = communities.detect(_edges(spark, ring), most=5)
    assert {r.id for r in found.collect()} == set(by)


def test_budget_passes_over(spark):
    rows = spark.createDataFrame([(1, i, " ".join(["w"] * n)) for i, n in enumerate((4, 40, 4))], "query_id int, i int, content string")
    got = graph_retriever.pick_budget(rows, 10, ["i"]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.picked)] == [0, 2]
    assert graph_retriever.pick_budget(rows, 0, ["i"]).count() == 0


def test_graph_modes(spark):
    nodes = spark.createDataFrame([("a", "concept", "alpha", "first letter", "s1"), ("b", "concept", "beta", None, "s2"), ("c", "concept", "gamma", None, None)], "id string, type string, label string, description string, source_segment_id string")
    edges = _edges(spark, [("a", "b"), ("b", "c")])
    chunks = spark.createDataFrame([("s1", "alpha text"), ("s2", "beta text"), ("s3", "other")], "segment_id string, content string")
    near = spark.createDataFrame([(1, "s3", 0.9)], "query_id int, segment_id string, score double")
    asked = spark.createDataFrame([(1, "alpha"), (2, " ")], "query_id int, query string")
    tables = graph_retriever.GraphTables(nodes, edges, chunks, near)
    for mode in graph_retriever.MODES:
        rows = graph_retriever.retrieve(asked, tables, graph_retriever.GraphQuery(mode=mode)).collect()
        assert rows and {r.query_id for r in rows} == {1}
        assert all(0 <= r.score <= 1 for r in rows)
        assert [r.score for r in sorted(rows, key=lambda r: r.rank)] == sorted((r.score for r in rows), reverse=True)
    with pytest.raises(graph_retriever.GraphConfigurationError):
        graph_retriever.GraphQuery(hops=-1).check()


def test_minmax(spark):
    rows = spark.createDataFrame([(1, -0.2), (1, 0.6), (2, 0.3), (2, 0.4)], "query_id int, score double")
    assert sorted(r.score for r in graph_retriever.minmax(rows).collect()) == [0.0, 0.3, 0.4, 1.0]
    with pytest.raises(Exception, match="outside"):
        graph_retriever.minmax(rows, strict=True).collect()


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "ACME Report 1\nbody one\n34"), ("d", 2, "ACME Report 2\nbody two\n35")], "doc string, page int, text string")
    assert files.clean_pages(pages).head().content == "body one\n\nbody two"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;Café\n2;B\n")
    (tmp_path / "b.json").write_text('[{"id": 1, "text": "foo"}]')
    csv = files.csv_files(spark, str(tmp_path / "a.csv")).head()
    assert csv.metadata["delimiter"] == ";" and "| 1 | Café |" in csv.content
    assert files.json_files(spark, str(tmp_path / "b.json"), "0.text").head().content == '"foo"'
    assert files.json_files(spark, str(tmp_path / "b.json"), "1.text").count() == 0
    assert files.docx_files(spark, str(tmp_path / "a.csv"), mode="PERMISSIVE").head().error
    with pytest.raises(NotImplementedError):
        files.pdf_files(spark, str(tmp_path))


def test_vector_search_handles_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, None), (4, [0.0, 0.0]), (5, [0.6, 0.8])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = retrieve.vector_search(q, rows, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 5, 2] and math.isclose(got[1].score, 0.6, rel_tol=1e-6)
    assert retrieve.vector_search(q, rows.limit(0), 3).count() == 0


def test_tree(spark):
    rows = spark.createDataFrame([("a", []), ("b", []), ("c", []), ("s", ["a", "b"]), ("t", ["b", "c"]), ("r", ["s", "t"])], "segment_id string, child_ids array<string>")
    got = {r.segment_id: (r.depth_from_root, r.parent_id) for r in tree.finalize(rows).collect()}
    assert got == {"r": (0, None), "s": (1, "r"), "t": (1, "r"), "a": (2, "s"), "b": (2, None), "c": (2, "t")}
