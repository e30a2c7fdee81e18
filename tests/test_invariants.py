"""The queries that SQL cannot express, against brute force or what must hold of them, row by row."""

from collections import Counter, defaultdict

import pytest

from docmill import plans
from docmill.operators import graph as G
from docmill.plans.graphs import _edges
from docmill.plans.registry import Tables
from tests.conftest import SMALL

CHECKS = {}


def check(*names):
    def add(f):
        for n in names:
            CHECKS[n] = f
        return f

    return add


@pytest.fixture(scope="module")
def graph(spark):
    return [(r["src"], r["dst"], r["w"]) for r in _edges(Tables(spark, SMALL)).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in Tables(spark, SMALL).titled.collect()}


def modularity(edges, label):
    both = {(a, b) for x, y, *_ in edges for a, b in ((x, y), (y, x)) if a != b}
    m2, inside, deg = len(both), Counter(), Counter()
    for a, b in both:
        deg[label[a]] += 1
        inside[label[a]] += label[a] == label[b]
    return sum(inside[c] / m2 - (deg[c] / m2) ** 2 for c in deg)


def parts(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in edges:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@check("gr_louvain", "gr_leiden", "gr_infomap", "gr_lpa")
def _(rows, graph, docs):
    name = "label" if "label" in rows[0].asDict() else "community"
    label = {r["id"]: r[name] for r in rows}
    assert len(rows) == len(label) and set(label) == {n for a, b, _ in graph for n in (a, b) if a != b}
    assert modularity(graph, label) > 0.5
    if name == "community":
        low = defaultdict(list)
        for n, c in label.items():
            low[c].append(n)
        assert all(c == min(ns) for c, ns in low.items())
        # communities don't reach over components
        comp = parts(graph, set(label))
        assert all(len({comp[n] for n in ns}) == 1 for ns in low.values())


@check("gr_modularity")
def _(rows, graph, docs):
    assert len(rows) == 1 and 0.5 < rows[0]["modularity"] < 1


@check("gr_pagerank")
def _(rows, graph, docs):
    nodes = {n for a, b, _ in graph for n in (a, b)}
    out = defaultdict(set)
    for a, b, _ in graph:
        out[a].add(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        loose = sum(r for n, r in rank.items() if n not in out)
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * loose / len(nodes))
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank[a] / len(bs)
        rank = new
    assert {r["id"]: r["rank"] for r in rows} == pytest.approx(rank, abs=1e-5)


@check("gr_eigenvector")
def _(rows, graph, docs):
    near = defaultdict(set)
    for a, b, _ in graph:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    x = dict.fromkeys(near, 1.0)
    for _ in range(20):
        y = {n: x[n] + sum(x[m] for m in near[n]) for n in near}
        x = {n: v / max(y.values()) for n, v in y.items()}
    assert {r["id"]: r["score"] for r in rows} == pytest.approx(x, abs=1e-5)


@check("gr_kcore_3", "gr_kcore_all")
def _(rows, graph, docs):
    assert len({r["id"] for r in rows}) == len(rows)


@check("gr_steiner")
def _(rows, graph, docs):
    edges = [(r["src"], r["dst"]) for r in rows]
    nodes = {n for e in edges for n in e}
    assert set(edges) <= {(a, b) for x, y, _ in graph for a, b in ((x, y), (y, x))}
    assert len(set(parts([(a, b) for a, b in edges], nodes).values())) == 1


@check("dd_similar")
def _(rows, graph, docs):
    def words(x):
        return set((x or "").lower().split())

    def like(a, b):
        x, y = words(a["title"]), words(b["title"])
        title = (1.0 if (a["title"] or "").lower().strip() else 0.0) if (a["title"] or "").lower().strip() == (b["title"] or "").lower().strip() else len(x & y) / len(x | y) if x | y else 0
        if a["text"] and b["text"]:
            p, q = words(a["text"]), words(b["text"])
            return title >= 0.8 and bool(p | q) and len(p & q) / len(p | q) >= 0.7
        return title >= 0.9

    kept = []
    for k in sorted(docs):
        if not any(like(docs[j], docs[k]) for j in kept):
            kept.append(k)
    assert sorted(r["doc_id"] for r in rows) == kept


@check("jn_theta_sim")
def _(rows, graph, docs):
    assert rows and all(r["a"] < r["b"] and r["title_sim"] >= 0.9 for r in rows)


@check("ch_default", "ch_stop", "ch_legal", "ch_policy", "ch_dispatch")
def _(rows, graph, docs):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["chunk_index"], r["start"], r["end"]))
    assert set(by) == {k for k, d in docs.items() if d["text"]}
    for k, spans in by.items():
        text, upto = docs[k]["text"], 0
        assert [i for i, *_ in sorted(spans)] == list(range(len(spans)))
        for _, a, b in sorted(spans):
            assert 0 <= a < b <= len(text) and not text[upto:a].strip()  # no text between chunks
            upto = max(upto, b)
        assert not text[upto:].strip()


@check("src_chunks")
def _(rows, graph, docs):
    assert rows and {r["doc_id"] for r in rows} == {7} and len(rows) <= 10


@check("tx_snippet")
def _(rows, graph, docs):
    assert len(rows) == len({r["doc_id"] for r in rows}) and all(r["chunk"] in docs[r["doc_id"]]["text"] for r in rows)


@check("sm_random")
def _(rows, graph, docs):
    assert len(rows) == 50 == len({r["doc_id"] for r in rows}) and all(docs[r["doc_id"]]["source"] == r["source"] for r in rows)


@check("topk_lsh")
def _(rows, graph, docs):
    assert 0 < len(rows) <= 10 and len({r["vec_id"] for r in rows}) == len(rows) and rows[0].asDict()


@check("ev_recall_all")
def _(rows, graph, docs):
    assert rows and all(0 <= r[c] <= 1 for r in rows for c in ("precision", "recall", "f1", "ap"))


@check("pt_select", "src_crawl", "src_ingest_adapters", "er_matching", "gr_betweenness")
def _(rows, graph, docs):
    assert rows and len(set(rows)) == len(rows)  # brute force in test_whole, test_goldens and test_dom


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query(spark, graph, docs, name):
    CHECKS[name](plans.QUERIES[name](spark, SMALL).collect(), graph, docs)


def test_communities_of_two_cliques(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame([*clique(range(1, 6)), *clique(range(11, 16)), (5, 11)], "src long, dst long")
    for f in (G.louvain, G.leiden, G.infomap, G.louvain_small):
        got = {r["id"]: r["community"] for r in f(edges).collect()}
        assert got == {i: 1 if i < 10 else 11 for i in got}, f.__name__


def test_core(spark):
    """A triangle with a tail: the 2-core is the triangle."""
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    assert sorted(r["id"] for r in G.k_core(e, 2).collect()) == [1, 2, 3] and G.k_core(e, 3).count() == 0


def test_leiden(spark):
    """On planted groups: communities are connected, well linked, and as modular as sequential moves make them."""
    import random

    for seed in (1,):
        rng = random.Random(seed)
        of = {i: i // 12 for i in range(48)}
        pairs = [(a, b) for a in of for b in of if a < b and rng.random() < (0.5 if of[a] == of[b] else 0.03)]
        edges = spark.createDataFrame(pairs, "src long, dst long")
        got = {r["id"]: r["community"] for r in G.leiden(edges).collect()}
        other = {r["id"]: r["community"] for r in G.louvain_small(edges).collect()}
        graph = [(a, b, 1) for a, b in pairs]
        assert set(got) == set(other) and modularity(graph, got) > modularity(graph, other) - 0.02
        degree, m2 = defaultdict(int), 2 * len(pairs)
        for a, b in pairs:
            degree[a] += 1
            degree[b] += 1
        inner = [(a, b, 1) for a, b in pairs if got[a] == got[b]]
        split = parts(inner, set(got))
        for c in set(got.values()):
            members = {n for n in got if got[n] == c}
            assert min(members) == c and len({split[n] for n in members}) == 1
            total = sum(degree[n] for n in members)
            for n in members:  # no node is linked to the rest of its community by less than chance
                links = sum(n in (a, b) for a, b, _ in inner)
                assert links * m2 >= degree[n] * (total - degree[n])


def test_leiden_bridge(spark):
    """A node that held two groups together leaves: the groups come apart, as connected communities; no edges, no rows."""
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    pairs = [*clique(range(1, 5)), *clique(range(11, 15)), *clique(range(21, 31)), (0, 1), (0, 11), *((0, i) for i in range(21, 31))]
    got = {r["id"]: r["community"] for r in G.leiden(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 5)}, **{i: 11 for i in range(11, 15)}, 0: 0, **{i: 0 for i in range(21, 31)}}
    assert G.leiden(spark.createDataFrame([], "src long, dst long")).count() == 0
