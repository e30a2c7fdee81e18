"""Rows on an edge, sums that turn on their order, keys that meet and events out of order, against SQL or by hand."""

import datetime
import random
from collections import defaultdict

import pytest

from docmill import plans
from docmill.operators import entities, graph, spatial
from pyspark.sql import functions as F
from tests.test_oracle import connected, norm


def agrees(spark, folder, name, **tables):
    """The query's rows over the given tables, held against its SQL."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{folder}/{t}.parquet")
    got = norm(plans.QUERIES[name](spark, str(folder)).toPandas())
    assert got == norm(connected(folder).sql(plans.ORACLE[name]).df())
    return got[1]


def test_points_on_edges_of_polygons(spark, tmp_path):
    ring = lambda a, b: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))))
    rings = F.array(ring(0, 4), ring(1, 2))
    points = {(0, 3): False, (4, 3): False, (3, 0): False, (3, 4): False, (1, 1.5): True, (2, 1.5): True, (1.5, 1): True, (1.5, 2): True, (1.5, 1.5): False, (3, 3): True}
    d = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    assert {(r["x"], r["y"]): r["i"] for r in d.select("x", "y", spatial.in_polygon(F.col("x"), F.col("y"), rings).alias("i")).collect()} == points
    # the left edge of the corner that is cut off belongs to the area
    assert agrees(spark, tmp_path, "flt_geo", customer=([(7, 1, -833.0)], "c_custkey long, c_nationkey int, c_acctbal double"), part=([(1, 51)], "p_partkey long, p_size int")) == [(7.0, 1.0)]


def test_weighted_means_add_in_order_of_time(spark):
    claims = [(0, "size", "40", 959.9 / 2500, 1), (0, "size", "13", 960.0 / 2500, 2), (0, "size", "4", 960.1 / 2500, 3)]
    total = weight = 0.0
    for _, _, v, r, _ in claims:
        total, weight = total + float(v) * r, weight + r
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        d = spark.createDataFrame([claims[i] for i in order], "entity long, property string, value string, reliability double, ts long").coalesce(1)
        row = entities.resolve(d, "weighted").first()
        assert float(row["value"]) == total / weight and row["confidence"] == weight / 3


def test_inserted_ids_of_another_source_may_be_known(spark, tmp_path):
    rows = agrees(spark, tmp_path, "snk_upsert_source", part=([(i, i % 7) for i in (*range(9), *range(1000000, 1000006))], "p_partkey long, p_size int"))
    assert len(rows) == 21


def test_balances_on_the_edge_of_a_range(spark, tmp_path):
    # 113.68 - 50 is a hair above 63.68; a hundredth of each is the same number
    customer = [(1, 3, 63.68), (2, 3, 63.69), (3, 5, 113.68), (4, 2, 163.68), (5, 4, 163.69)]
    rows = agrees(spark, tmp_path, "jn_spatial", customer=(customer, "c_custkey long, c_nationkey int, c_acctbal double"), supplier=([(9, 3, 113.68)], "s_suppkey long, s_nationkey int, s_acctbal double"))
    assert rows == [(2.0, 9.0), (4.0, 9.0)]


def test_rates_of_events_out_of_order(spark, tmp_path):
    from docmill.streaming import events as S

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    late = [(i, at(10 + i), u, kind, 1.0, "") for i, (u, kind) in enumerate([(1, "error"), (2, "view"), (2, "error"), (3, "view"), *[(4, "error")] * 8])]
    early = [(50 + i, at(1), u, kind, 1.0, "") for i, (u, kind) in enumerate([(1, "error"), (2, "error"), (3, "error"), (3, "error"), (4, "view")])]
    middle = [(60, at(15), 4, "view", 1.0, "")]
    for i, rows in enumerate((late, early, middle)):
        spark.createDataFrame(rows, S.SCHEMA.replace("_ntz", "")).selectExpr("* EXCEPT (ts)", "CAST(ts AS timestamp_ntz) AS ts").toPandas().to_parquet(f"{tmp_path}/events{i}.parquet", coerce_timestamps="us")
    S.latest(S.rates(S.read(spark, str(tmp_path), files=1)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("user_id").agg(F.max_by(F.struct("seen", "delay"), "epoch").alias("r"))
    assert {r["user_id"]: tuple(r["r"]) for r in got.collect()} == {1: (2, 4.0), 2: (3, 2.0), 3: (3, 1.0), 4: (10, 64.0)}


def test_betweenness_of_folded_nodes(spark):
    """Chains, trees, cycles, pairs and loops, with all or some sources, walked in tasks or by joins, against plain Brandes."""
    rng = random.Random(5)
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (23, 25), (25, 26), (30, 30)]
    edges += [(100 + i, 100 + rng.randint(0, i - 1)) for i in range(1, 25)] + [(100 + rng.randint(0, 24), 100 + rng.randint(0, 24)) for _ in range(6)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    d = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({x for e in edges for x in e})
    for some in (nodes, [2, 5, 11, 26, 30, 101, 107]):
        want = {}
        for s in some:
            dist, paths, order = {s: 0}, {s: 1}, [s]
            for v in order:
                for u in near[v]:
                    if u not in dist:
                        dist[u], paths[u] = dist[v] + 1, 0
                        order.append(u)
                    if dist[u] == dist[v] + 1:
                        paths[u] += paths[v]
            share = dict.fromkeys(order, 0.0)
            for u in reversed(order):
                for v in near[u]:
                    if dist[v] == dist[u] - 1:
                        share[v] += paths[v] / paths[u] * (1 + share[u])
                if u != s:
                    want[u] = want.get(u, 0.0) + share[u]
        starts = spark.createDataFrame([(x,) for x in some], "id long")
        for held in (1000, 0):
            got = {r["id"]: r["score"] for r in graph.betweenness(d, starts, at_once=8, held=held).collect()}
            assert got == pytest.approx(want), (len(some), held)


def test_leaves_ask_for_no_walks(spark, monkeypatch):
    """A star's betweenness takes a few tables, not some for each of its leaves."""
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda *a, **k: made.append(1) or cut(*a, **k))
    star = spark.range(1, 13).selectExpr("0L AS src", "id AS dst")
    got = {r["id"]: r["score"] for r in graph.betweenness(star, graph.nodes_of(star), at_once=1, held=0).collect()}
    assert got == {0: 132.0} | dict.fromkeys(range(1, 13), 0.0) and len(made) < 20


def test_similar_rows_in_blocks(spark, monkeypatch):
    """Sketches of each width, blocks of a title, copies, rows without a text or with a blank one, against all pairs."""
    from docmill.operators import dedup

    monkeypatch.setattr(dedup, "_BLOCK", 3)
    monkeypatch.setattr(dedup, "_SKETCH", ((30, 16), (60, 64), (120, 256), (2**62, 1024)))
    rng = random.Random(7)
    titles = ["een twee drie vier vijf", "een twee drie vier zes", "a b c d e f g h i j", "a b c d e f g h i k", "alleen", "", None, " \t"]
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (8, 25, 40, 80, 200)]
    rows = []
    for i in range(110):
        words = [w if rng.random() < 0.93 else f"x{rng.randint(0, 99)}" for w in base[i % 5]]
        rows.append((i, titles[rng.choice((0, 0, 0, 1, 2, 3, 4, 5, 6))], " ".join(words)))
    rows += [(200, titles[0], ""), (201, titles[0], None), (202, titles[1], ""), (203, titles[2], ""), (204, titles[3], "  "), (205, titles[3], "  "), (206, titles[2], "  "), (207, titles[7], "z"), (208, titles[7], "z"), (209, "lang", "  "), (210, "lang", "  ")]
    rows += [(300 + i, titles[0], rows[i][2]) for i in (0, 1, 2, 2)] + [(310, "Een  twee\tdrie vier vijf", rows[0][2].upper())]
    sets = {i: (set((t or "").lower().split()), set((x or "").lower().split()), bool(x)) for i, t, x in rows}
    share = lambda p, q: len(p & q) / len(p | q) if p | q else 0.0

    def like(i, j):
        (t, x, full), (u, y, also) = sets[i], sets[j]
        sims = share(t, u), share(x, y) if full and also else None
        return sims if sims[0] >= 0.8 and (sims[1] >= 0.7 if sims[1] is not None else sims[0] >= 0.9) else None

    ids = sorted(sets)
    want = {(i, j): like(i, j) for i in ids for j in ids if i < j and like(i, j)}
    d = spark.createDataFrame([r for r in rows if r[0] in sets], "id long, title string, text string").dropDuplicates(["id"])
    got = [(r["a"], r["b"], r["title_sim"], r["text_sim"]) for r in dedup.similar_pairs(d, "id", "title", "text").collect()]
    from collections import Counter
    print('DBG', [x for x in got if want.get(x[:2]) != x[2:]], [x for x in want if x not in {g[:2] for g in got}], [k for k, v in Counter(g[:2] for g in got).items() if v > 1])
    assert len(got) == len(want) > 250 and {(a, b): (s, x) for a, b, s, x in got} == want
    kept = []
    for j in ids:
        if not any((i, j) in want for i in kept):
            kept.append(j)
    assert sorted(r["id"] for r in dedup.similar(d, "id", "title", "text").collect()) == kept
