"""Queries that SQL can't express, against plain Python over the same rows."""

from __future__ import annotations

import html as html_module
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import html_dom
from folioforge.functions.text import STOPWORDS
from folioforge.operators import communities, graph, graph_retriever, models, tree
from folioforge.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet").collect()


# --- retrieval --------------------------------------------------------------------------


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def brute_mmr(q, vectors, k, fetch, weight):
    near = sorted(vectors, key=lambda v: (-cosine(q, v[1]), v[0]))[:fetch]
    taken = []
    while len(taken) < min(k, len(near)):
        gain = lambda v: weight * cosine(q, v[1]) - (1 - weight) * max((cosine(v[1], t[1]) for t in taken), default=0.0)
        taken.append(max((v for v in near if v not in taken), key=lambda v: round(gain(v), 9)))
    return [v[0] for v in taken]


def test_mmr(spark):
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows_of(spark, "embeddings")]
    got = defaultdict(list)
    for r in sorted(QUERIES["mmr_topk"](spark, DIR).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    assert got == {i: brute_mmr(v, vectors, 4, 20, 0.5) for i, v in vectors if i % 20 == 0}


def test_scored_mmr(spark):
    """Diverse hits, then each found parent once, in order of its first hit."""
    rows = rows_of(spark, "embeddings")
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows]
    label = {r.vec_id: r.label for r in rows}
    got = defaultdict(list)
    for r in sorted(QUERIES["scored_mmr_plus_parents"](spark, DIR).collect(), key=lambda r: r.position):
        got[r.query_id].append(r.content)
        assert r.score is None
    for i, v in vectors:
        if i % 20 == 0:
            hits = brute_mmr(v, vectors, 4, 20, 0.5)
            up = dict.fromkeys(label[x] for x in hits if label[x] < 5)
            assert got[i] == [f"chunk {x}" for x in hits] + [f"label {x}" for x in up]


def brute_lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, t[j] = t[j], before + 1 if x == y else max(t[j], t[j - 1])
    return t[-1]


def ratio(a, b):
    return 200 * brute_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def brute_wratio(a, b):
    x, y = sorted((a, b), key=len)
    s, t = set(a.split()), set(b.split())
    common, left, right = (" ".join(sorted(z)) for z in (s & t, s - t, t - s))
    if common and (not left or not right):
        by_set = 100.0
    else:
        one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
        by_set = max([ratio(one, two), *([ratio(common, one), ratio(common, two)] if common else [])])
    best = ratio(a, b)
    if len(y) / len(x) < 1.5:
        return max(best, 0.95 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 0.95 * by_set)
    scale = 0.9 if len(y) / len(x) < 8 else 0.6
    partial = max(ratio(x, y[max(0, i) : i + len(x)]) for i in range(-len(x) + 1, len(y)))
    return max(best, scale * partial, 0.95 * scale * by_set)


def test_fuzzy_scan(spark):
    asked = {1: "smal ring", 2: "red wigdet", 3: "widget red"}
    want = {(q, r.p_partkey): s for r in rows_of(spark, "part") for q, text in asked.items() if (s := brute_wratio(text, r.p_name)) >= 80}
    got = {(r.query_id, r.p_partkey): r.fuzzy_score for r in QUERIES["fuzzy_ratio_scan"](spark, DIR).collect()}
    assert got == pytest.approx(want, abs=1e-5) and {q for q, _ in got} == {1, 2, 3}


# --- the graph ---------------------------------------------------------------------------------


def tok(s):
    return list(dict.fromkeys(re.findall("[A-Za-z0-9Ѐ-ӿ]+", (s or "").lower())))


def over(q, t):
    own = [x for x in tok(q) if x not in STOPWORDS]
    return len(set(own) & set(tok(t))) / len(own) if own else 0.0


def lexical(q, t):
    own, theirs = tok(q), tok(t)
    if not own:
        return 0.0
    stem = sum(len(x) >= 4 and any(len(y) >= 4 and (x in y or y in x or x[:4] == y[:4]) for y in theirs) for x in own)
    return min(1.0, (0.55 * len(set(own) & set(theirs)) + 0.20 * stem) / len(own) + 0.25 * (q.strip().lower() in t.lower()))


clamp = lambda x: min(1.0, max(0.0, x))
squash = lambda s: re.sub(r"\s+", " ", s or "").strip().lower()


class Brute:
    """Retrieval for one query over dictionaries, as the modes are described."""

    def __init__(self, nodes, edges, chunks, near, config):
        self.nodes, self.edges, self.chunks, self.near, self.c = nodes, edges, chunks, near, config
        degree = defaultdict(int)
        for e in edges:
            degree[e["a"]] += 1
            degree[e["b"]] += 1
        self.prior = {n: degree[n] / max(degree.values()) for n in nodes}
        heaviest = max(abs(e["w"]) for e in edges)
        self.eprior = {e["id"]: abs(e["w"]) / heaviest for e in edges}

    def best(self, asked, score, n):
        """Each text's n best; of all of them each key's best score, the n best again."""
        seen = {}
        for q in asked:
            found = sorted(((k, s) for k, s in score(q) if s > 0), key=lambda x: (-x[1], x[0]))[:n]
            for k, s in found:
                seen[k] = max(seen.get(k, 0), clamp(s))
        return dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:n])

    def node_scores(self, q):
        for i, n in self.nodes.items():
            if lex := lexical(q, f"{n['label']} {n['description'] or ''}".strip()):
                yield i, min(1.0, 0.65 * lex + 0.15 * self.prior[i])

    def edge_scores(self, q):
        for e in self.edges:
            if lex := lexical(q, f"{self.nodes[e['a']]['label']} {e['rel']} {self.nodes[e['b']]['label']}"):
                yield e["id"], min(1.0, 0.55 * lex + 0.15 * self.eprior[e["id"]] + 0.10 * (self.prior[e["a"]] + self.prior[e["b"]]) / 2)

    def keywords(self, q, level):
        kept = [x for x in tok(q) if x not in STOPWORDS] or [q.strip().lower()]
        words = kept[:12] if level else sorted(kept, key=lambda t: (-len(t), t))[:2]
        return list(dict.fromkeys([q, *words]))

    def entity(self, i, score):
        n = self.nodes[i]
        return {"id": i, "kind": "entity", "content": f"Entity: {n['label']}\nType: {n['type']}\nDescription: {n['description'] or 'No description'}", "score": clamp(score), "seg": n["seg"]}

    def relation(self, e, score):
        return {"id": e["id"], "kind": "relation", "content": f"{e['a']} -[{e['rel']}]-> {e['b']}\nWeight: {e['w']}", "score": clamp(score), "seg": e["seg"]}

    def with_chunks(self, q, items):
        found = sorted({x["seg"] for x in items if x["seg"] in self.chunks}, key=lambda s: (-clamp(over(q, self.chunks[s])), s))[: self.c.chunks]
        return items + self.chunk_items(q, {s: clamp(over(q, self.chunks[s])) for s in found})

    def chunk_items(self, q, scores):
        return self.dedupe([{"id": s, "kind": "chunk", "content": self.chunks[s], "score": clamp(0.75 * x + 0.25 * over(q, self.chunks[s])), "seg": s} for s, x in scores.items()])

    def key(self, x):
        return ("s", x["seg"]) if x["seg"] else ("h", squash(x["content"])) if x["content"].strip() else (x["kind"], x["id"])

    def order(self, x):
        import hashlib

        return ({"chunk": 0, "relation": 1, "entity": 2}[x["kind"]], x["id"], x["seg"] or "", hashlib.sha1(squash(x["content"]).encode()).hexdigest())

    def ranked(self, items):
        return sorted(items, key=lambda x: (-x["score"], *self.order(x)))

    def dedupe(self, items):
        out = {}
        for x in self.ranked(items):
            out.setdefault(self.key(x), x)
        return list(out.values())

    def fuse(self, lists):
        total, best = defaultdict(float), {}
        for n, one in enumerate(lists):
            for rank, x in enumerate(self.ranked(one), 1):
                total[self.key(x)] += 1 / (60 + rank)
                if self.key(x) not in best or (-x["score"], n, rank) < best[self.key(x)][0]:
                    best[self.key(x)] = ((-x["score"], n, rank), x)
        most = max(total.values(), default=1)
        return [x | {"score": clamp(0.55 * x["score"] + 0.45 * total[k] / most)} for k, (_, x) in best.items()]

    def local(self, q):
        seeds = self.best(self.keywords(q, 1), self.node_scores, self.c.entities)
        most, around = self.c.entities * (self.c.hops + 2), defaultdict(set)
        for e in self.edges:
            if e["a"] != e["b"]:
                around[e["a"]].add(e["b"])
                around[e["b"]].add(e["a"])
        hop, queue = {s: 0 for s in list(seeds)[:most]}, list(seeds)[:most]
        for i in queue:
            for v in sorted(around[i]) if hop[i] < self.c.hops else ():
                if v not in hop and len(queue) < most:
                    hop[v] = hop[i] + 1
                    queue.append(v)
        items = [self.entity(i, 0.45 * seeds.get(i, 0) + 0.30 * 0.85**h + 0.15 * self.prior[i] + 0.10 / (1 + h)) for i, h in hop.items()]
        inside = [e for e in self.edges if e["a"] in hop and e["b"] in hop and min(hop[e["a"]], hop[e["b"]]) < self.c.hops]
        top = max((abs(e["w"]) for e in inside), default=1)
        for e in inside:
            ends = max(seeds.get(e["a"], 0), seeds.get(e["b"], 0))
            items.append(self.relation(e, 0.35 * ends + 0.30 * 0.85 ** min(hop[e["a"]], hop[e["b"]]) + 0.25 * abs(e["w"]) / top + 0.10 * self.eprior[e["id"]]))
        return self.with_chunks(q, items)

    def global_(self, q):
        asked, by_id = self.keywords(q, 0), {e["id"]: e for e in self.edges}
        best = self.best(asked, self.edge_scores, self.c.relations)
        items = [self.relation(by_id[i], 0.8 * s + 0.2 * self.eprior[i]) for i, s in best.items()]
        scores = self.best(asked, self.node_scores, self.c.entities)
        for i, s in best.items():
            for end in (by_id[i]["a"], by_id[i]["b"]):
                scores[end] = max(scores.get(end, 0), s)
        items += [self.entity(i, 0.8 * s + 0.2 * self.prior[i]) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: self.c.entities]]
        return self.with_chunks(q, items)

    def pick(self, items, budget):
        used, out = 0, []
        for x in items:
            cost = max(1, int(0.75 * len(re.findall(r"\S+", x["content"]))))
            if used < budget and (not out or used + cost <= budget):
                out.append(x)
                used += cost
        return out

    def run(self, q):
        q, c = q.strip(), self.c
        if c.mode == "local":
            items = self.local(q)
        elif c.mode == "global":
            items = self.global_(q)
        else:
            items = self.fuse([self.local(q), self.global_(q)])
            if c.mode == "mix":
                items = self.fuse([items, self.chunk_items(q, self.near)])
        items = [x | {"score": clamp(0.75 * x["score"] + 0.25 * over(q, x["content"]))} for x in self.dedupe(items)]
        chosen = [self.pick(self.ranked([x for x in items if x["kind"] == kind]), n) for kind, n in (("chunk", c.budget_chunks), ("relation", c.budget_relations), ("entity", c.budget_entities))]
        total = self.pick([x for part in chosen for x in part], c.budget_total)
        return [(x["kind"], x["id"], round(x["score"], 9)) for x in self.ranked(total)]


@pytest.mark.parametrize("mode", graph_retriever.MODES)
def test_graph_modes(spark, mode):
    names = ["alpha station", "beta stations", "gamma river", "delta river mouth", "epsilon", "zeta of alpha", "eta gamma", "theta"]
    nodes = {f"n{i}": {"label": x, "type": "place", "description": f"{x} described" if i % 3 else None, "seg": f"s{i % 5}" if i % 4 else None} for i, x in enumerate(names)}
    pairs = [(0, 1, 2.0), (1, 2, -3.5), (2, 3, 1.0), (3, 4, 0.5), (4, 5, 4.25), (0, 5, 1.5), (6, 2, 2.5), (0, 1, 1.0), (7, 7, 1.0)]
    rows = spark.createDataFrame([(f"n{a}", f"n{b}", "flows to" if i % 2 else "near", w, f"s{i % 6}", i) for i, (a, b, w) in enumerate(pairs)], "source_id string, target_id string, relation_type string, weight double, source_segment_id string, seq int")
    edges = graph.append_edges(rows)
    chunks = {f"s{i}": f"{x} and the text of it, " * (3 + i * 9) for i, x in enumerate(names[:6])}
    near = {"s1": 0.8, "s4": 0.4, "s5": 0.9}
    asked = ["alpha station", "what is the river of gamma", "epsilon near delta", "nothing there"]
    tables = graph_retriever.GraphTables(
        spark.createDataFrame([(i, n["type"], n["label"], n["description"], n["seg"]) for i, n in nodes.items()], "id string, type string, label string, description string, source_segment_id string"), edges,
        spark.createDataFrame(list(chunks.items()), "segment_id string, content string"), spark.createDataFrame([(q, s, x) for q in range(len(asked)) for s, x in near.items()], "query_id int, segment_id string, score double"),
    )
    config = graph_retriever.GraphQuery(mode=mode, entities=3, relations=4, chunks=3, hops=1, budget_chunks=90, budget_relations=40, budget_entities=30, budget_total=140)
    got = defaultdict(list)
    for r in graph_retriever.retrieve(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), tables, config).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.kind, r.evidence_id, round(r.score, 9)))
    flat = [{"id": r.edge_id, "a": r.source_id, "b": r.target_id, "rel": r.relation_type, "w": r.weight, "seg": r.source_segment_id} for r in edges.collect()]
    brute = Brute(nodes, flat, chunks, near, config)
    for i, q in enumerate(asked):
        assert got[i] == brute.run(q), q
    assert any(got.values())


def test_graph_index_finds_the_same(spark, monkeypatch):
    """Many queries by the index, few by all pairs."""
    words = ["alpha", "al", "pha", "gamma", "gam", "st", "station", "stations", "ha", "delta alpha", "x"]
    nodes = spark.createDataFrame([(f"n{i}", f"{a} {b}", None) for i, (a, b) in enumerate(itertools.product(words, words))], "id string, label string, description string")
    edges = graph.append_edges(spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 121}", "near", 1.0 + i, None, i) for i in range(121)], "source_id string, target_id string, relation_type string, weight double, source_segment_id string, seq int"))
    priors = graph.node_priors(nodes, edges)
    asked = spark.createDataFrame(list(enumerate([*words, "", " ", "a st", "alphabet", "gammastation", "PHA GAM", "near al"])), "query_id int, query string")
    found = []
    for few in (0, 1000):
        monkeypatch.setattr(graph, "FEW", few)
        one = graph.search_nodes_hybrid(asked, nodes, priors, 200).select("query_id", "id", F.round("score", 9)).collect()
        two = graph.search_edges_hybrid(asked, nodes, edges, priors, 200).select("query_id", "edge_id", F.round("score", 9)).collect()
        found.append((sorted(map(tuple, one)), sorted(map(tuple, two))))
    assert found[0] == found[1] and len(found[0][0]) > 300 and len(found[0][1]) > 300


def test_graph_vector_terms(spark):
    """0.20 of the cosine for nodes and for edges; it is evidence of its own."""
    nodes = spark.createDataFrame([("a", "alpha", None, [1.0, 0.0]), ("b", "beta", None, [0.6, 0.8]), ("c", "gamma", None, None)], "id string, label string, description string, embedding array<float>")
    edges = spark.createDataFrame([("a", "b", "r", 1.0, None, "e1", [0.0, 1.0]), ("b", "c", "r", 0.5, None, "e2", [0.6, 0.8]), ("a", "c", "r", 0.5, None, "e3", None)], "source_id string, target_id string, relation_type string, weight double, source_segment_id string, edge_id string, embedding array<float>")
    priors = graph.node_priors(nodes, edges)
    asked = spark.createDataFrame([(1, "zzz", [1.0, 0.0])], "query_id int, query string, embedding array<float>")
    got = {r.id: r.score for r in graph.search_nodes_hybrid(asked, nodes, priors).collect()}
    assert got == pytest.approx({"a": 0.20 + 0.15, "b": 0.12 + 0.15})
    got = {r.edge_id: r.score for r in graph.search_edges_hybrid(asked, nodes, edges, priors).collect()}
    assert got == pytest.approx({"e2": 0.20 * 0.6 + 0.15 * 0.5 + 0.10})


def modularity(edges, groups):
    m, degree = len(edges), defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    where = {x: i for i, g in enumerate(groups) for x in g}
    return sum(where[a] == where[b] for a, b in edges) / m - sum((sum(degree[x] for x in g) / (2 * m)) ** 2 for g in groups)


def brute_greedy(edges):
    """Merge the pair of groups of the greatest gain while there is one."""
    groups = [[x] for x in sorted({x for e in edges for x in e})]
    while True:
        now = modularity(edges, groups)
        linked = lambda g, h: any((a in g and b in h) or (a in h and b in g) for a, b in edges)
        gains = [(modularity(edges, [*(x for k, x in enumerate(groups) if k not in (i, j)), groups[i] + groups[j]]) - now, -i, -j) for i, j in itertools.combinations(range(len(groups)), 2) if linked(groups[i], groups[j])]
        if not gains or max(gains)[0] <= 1e-12:
            return now
        _, i, j = max(gains)
        groups[-i] += groups[-j]
        del groups[-j]


def test_communities_are_as_good_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(12):
        edges = [(f"{a}", f"{b}") for a, b in rng.integers(0, 9, (14, 2)) if a != b]
        found = communities.greedy_modularity(edges)
        assert sorted(x for g in found for x in g) == sorted({x for e in edges for x in e})
        assert modularity(edges, found) >= brute_greedy(edges) - 0.06


def test_communities_query(spark):
    rows = QUERIES["communities"](spark, DIR).collect()
    component = {r.id: r.component for r in QUERIES["graph_components"](spark, DIR).collect()}
    groups = defaultdict(set)
    for r in rows:
        groups[r.community_id].add(r.id)
    assert {r.id for r in rows} == set(component) and len(rows) == len(component)
    assert all(len({component[x] for x in g}) == 1 for g in groups.values())
    texts = QUERIES["community_texts"](spark, DIR).collect()
    assert sorted(r.n for r in texts) == sorted(map(len, groups.values())) and all(r.content.count("- Name: ") == r.n for r in texts)


# --- splitting -------------------------------------------------------------------------------------


def test_local_boundaries(spark):
    rows = sorted(rows_of(spark, "embeddings"), key=lambda r: (r.label, r.vec_id))
    got = {r.vec_id: r.chunk_id for r in QUERIES["semantic_boundaries_local"](spark, DIR).collect()}
    assert set(got) == {r.vec_id for r in rows}
    for _, part in itertools.groupby(rows, key=lambda r: r.label):
        ids = [got[r.vec_id] for r in part]
        assert ids[0] == 0 and all(b - a in (0, 1) for a, b in itertools.pairwise(ids))


@pytest.mark.parametrize(("name", "limit"), [("recursive_split", 500), ("sentence_split", 500)])
def test_splits_keep_all_text(spark, name, limit):
    texts = {r.doc_id: r.text for r in rows_of(spark, "documents")}
    found = defaultdict(list)
    for r in QUERIES[name](spark, DIR).collect():
        found[r.doc_id].append((r.position if "position" in r else 0, r.content))
    for i, text in texts.items():
        chunks = [c for _, c in sorted(found[i], key=lambda x: x[0])]
        at = 0
        for c in chunks:
            words = c.split()
            assert len(c) <= limit or len(words) == 1 or name == "sentence_split"
            assert c.strip() in text or " ".join(words) in " ".join(text.split())
        at = {w for c in chunks for w in c.split()}
        assert {w for w in text.split()} <= at or not chunks and not text.strip()


def test_repeated_blocks(spark):
    seen, want = set(), []
    for r in sorted(rows_of(spark, "pages"), key=lambda r: r.page_id):
        for i, b in enumerate(html_dom.blocks(html_dom.strip_content_free(html_dom.parse(r.html)))):
            if (b.kind, b.markdown) not in seen:
                seen.add((b.kind, b.markdown))
                want.append((r.page_id, i, b.kind, b.markdown))
    assert sorted(tuple(r) for r in QUERIES["html_repeated_blocks"](spark, DIR).collect()) == sorted(want)


def test_pages_keep_their_text(spark):
    """Blocks, sections and markdown have the words that the pages' elements have."""
    pages = {r.page_id: r.html for r in rows_of(spark, "pages")}
    words = lambda s: re.findall(r"\w+", s)
    blocks, sections = defaultdict(list), defaultdict(list)
    for r in QUERIES["html_blocks"](spark, DIR).orderBy("page_id", "position").collect():
        blocks[r.page_id] += words(r.markdown)
    for r in QUERIES["html_sections"](spark, DIR).collect():
        sections[r.page_id] += words(r.content)
    markdown = {r.page_id: words(r.markdown) for r in QUERIES["html_to_markdown"](spark, DIR).collect()}
    for i, html in pages.items():
        body = re.sub(r"(?s)<(script|style|head|noscript)\b.*?</\1>|<!--.*?-->", " ", html)
        own = {w for w in words(html_module.unescape(re.sub(r"<[^>]*>", " ", body))) if len(w) > 3}
        assert len(own & set(markdown[i])) >= 0.8 * len(own) and set(blocks[i]) >= {w for w in markdown[i] if len(w) > 3}
        assert len(own & set(sections[i])) >= 0.75 * len(own)


# --- enrichment, trees ---------------------------------------------------------------------------


def test_segment_enrich(spark):
    texts = {r.doc_id: r.text for r in rows_of(spark, "documents")}
    rows = QUERIES["segment_enrich"](spark, DIR).collect()
    assert sum(r.generated_title is not None for r in rows) > 0.8 * len(rows) and len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.summary is None or r.summary in " ".join(text.split()) or r.summary in text
        assert r.generated_title is None or r.generated_title in text


def test_mixture_finds_groups(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(12)[:4]
    rows = [(f"s{g}-{i}", (centres[g] + 0.05 * rng.standard_normal(12)).tolist()) for g in range(4) for i in range(20)]
    found = tree.mixture_clusters(spark.createDataFrame(rows, "segment_id string, embedding array<double>"), dim=5, most=8).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.cluster].add(r.segment_id[:2])
    assert {r.segment_id for r in found} == {i for i, _ in rows} and all(len(g) == 1 for g in groups.values())
    own, loglik = tree.fit_mixture(np.array([x for _, x in rows])[:, :4], 4)
    assert np.allclose(own.sum(1), 1) and np.isfinite(loglik)


def test_tree_of_summaries(spark):
    rows = QUERIES["raptor_levels"](spark, DIR).collect()
    leaves = len(rows_of(spark, "benchmark"))
    assert sum(r.raptor_level == 0 for r in rows) == leaves and max(r.raptor_level for r in rows) >= 1
    made = [r for r in rows if r.raptor_level]
    assert all(r.children >= 1 and r.chars <= r.budget and r.exceeds_max_chars is False and 0 < r.ratio <= 1 for r in made)
    short = spark.createDataFrame([(f"s{i}", f"text number {i} of some length") for i in range(30)], "segment_id string, content string")
    one = lambda df: df.selectExpr("segment_id", "0 as cluster")
    built = tree.build(short, models.hashed_embedder(8), 1, cluster=one, summarize=lambda t, b: t + t).where("raptor_level = 1").head()
    assert built.error == "not shorter" and built.exceeds_max_chars
    with pytest.raises(Exception, match="empty"):
        tree.build(short, models.hashed_embedder(8), 1, cluster=one, summarize=lambda t, b: "", strict=True).collect()
