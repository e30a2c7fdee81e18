"""Queries over whole tables, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from docmill import plans
from docmill.operators import retrieval
from tests.conftest import SMALL


def test_kcore_all(spark):
    near = defaultdict(set)
    pairs = {(r["l_partkey"], r["l_suppkey"] + 100000) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    nodes, k = set(near), -(-len(pairs) // len({a for a, _ in pairs}))
    left, low = set(nodes), {None}
    while low:
        low = {v for v in left if len(near[v] & left) < k}
        left -= low
    got = [r["id"] for r in plans.QUERIES["gr_kcore_all"](spark, SMALL).collect()]
    assert sorted(got) == sorted(left) and 0 < len(left) < len(nodes)


def test_matching_all(spark):
    """Each part's greatest total, by trying every set of line numbers for one supplier after another."""
    weight = defaultdict(lambda: defaultdict(lambda: defaultdict(float)))
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity").collect():
        weight[r["l_partkey"]][r["l_suppkey"]][r["l_linenumber"]] += r["l_quantity"]
    got, seen = defaultdict(float), set()
    for r in plans.QUERIES["er_matching"](spark, SMALL).collect():
        assert r["weight"] == weight[r["blk"]][r["a"]][r["b"]] > 0
        for side in ("a", "b"):
            assert (r["blk"], side, r[side]) not in seen
            seen.add((r["blk"], side, r[side]))
        got[r["blk"]] += r["weight"]
    want = {}
    for part, rows in weight.items():
        best = {0: 0.0}
        for lines in rows.values():
            for used, total in list(best.items()):
                for line, w in lines.items():
                    if not used >> line & 1:
                        best[used | 1 << line] = max(best.get(used | 1 << line, 0.0), total + w)
        want[part] = max(best.values())
    assert got == want


def test_nearest(spark):
    """Several cells, equal vectors, zeros, lengths and blocks, against all pairs."""
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4)], int(i) % 3) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(60)]
    rows += [(500, [0.0] * 4, 0), (501, [1.0, 2.0], 0), (502, [2.0, 4.0], 0), (503, None, 0), (504, [1.0, None, 1.0, 1.0], 0), (505, [1.0] * 4, None)]
    ok = [(i, np.array(v), b) for i, v, b in rows if b is not None and v and None not in v]
    want = set()
    for i, v, b in ok:
        near = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w, c in ok if j != i and c == b and len(w) == len(v) and w.any() and v.any()]
        want |= {(i, j) for s, j in sorted(near)[:5] if -s >= 0.2}
    d = spark.createDataFrame(rows, "id long, v array<double>, b long")
    got = [(r["a"], r["b"]) for r in retrieval.nearest(d, "id", "v", "b", 5, 0.2, cell_rows=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    every = {r["vec_id"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()}
    linked = {r["a"] for r in plans.QUERIES["lb_knn_all"](spark, SMALL).collect()}
    assert linked <= every and len(linked) > 50


def test_betweenness_all(spark):
    """The sum over all pairs of the share of their shortest paths through a node."""
    near = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/part.parquet").where("p_size <= 20").collect():
        a, b = r["p_partkey"], (r["p_partkey"] * 37 + r["p_size"]) % 1999 + 1
        if a != b:
            near[a].add(b)
            near[b].add(a)
    walk = {}
    for s in near:
        dist, paths, front = {s: 0}, {s: 1}, [s]
        while front:
            nxt = []
            for v in front:
                for u in near[v]:
                    if u not in dist:
                        dist[u], paths[u] = dist[v] + 1, 0
                        nxt.append(u)
                    if dist[u] == dist[v] + 1:
                        paths[u] += paths[v]
            front = nxt
        walk[s] = dist, paths
    want = defaultdict(float)
    for s, (dist, paths) in walk.items():
        for t in dist:
            for v in dist:
                if v not in (s, t) and t != s and dist[v] + walk[v][0][t] == dist[t]:
                    want[v] += paths[v] * walk[v][1][t] / paths[t]
    got = {r["id"]: r["score"] for r in plans.QUERIES["gr_betweenness"](spark, SMALL).collect()}
    assert {v: s for v, s in got.items() if s} == {v: pytest.approx(s, abs=1e-5) for v, s in want.items() if s}


def test_starts_all(spark):
    tree = plans.QUERIES["gr_jurisdiction_all"](spark, SMALL)
    assert tree.select("start").distinct().count() == sum(spark.read.parquet(f"{SMALL}/{x}.parquet").count() for x in ("region", "nation", "customer"))
    assert plans.QUERIES["gr_impact_all"](spark, SMALL).where("start > 60").count() > 0


def test_extensions_all(spark):
    n = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert plans.QUERIES["src_with_ext_all"](spark, SMALL).count() == n > 500
