"""Queries of the graph operators. The test graph is a sparse one over part keys, the hierarchy region > nation > customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import graph as G
from docmill.plans.analytics import R, rounded
from docmill.plans.registry import query

EDGES = "(SELECT DISTINCT p_partkey AS src, (p_partkey * 37 + p_size) % 1999 + 1 AS dst, p_size AS w FROM part WHERE p_size <= 20)"


def _edges(t):
    return t.part.where("p_size <= 20").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 37 + F.col("p_size")) % 1999 + 1).alias("dst"), F.col("p_size").alias("w")).distinct()


def _tree(t):
    """(child, parent) of region > nation > customer, ids offset by 1000 and 100."""
    n = t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
    return n.unionByName(t.customer.select((F.col("c_custkey") + 1000).alias("child"), (F.col("c_nationkey") + 100).cast("long").alias("parent")))


TREE = "(SELECT n_nationkey::BIGINT + 100 AS child, n_regionkey::BIGINT AS parent FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey::BIGINT + 100 FROM customer)"


def _start(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "id long")


@query("gr_neighbors", f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT x AS start, x AS id, 0 AS hops FROM (SELECT unnest([1, 2, 3, 4, 5]::BIGINT[]) AS x) UNION SELECT start, dst, hops + 1 FROM r JOIN e ON id = src WHERE hops < 3) SELECT start, id, min(hops)::INT AS hops FROM r GROUP BY ALL""")
def _(t):
    return G.k_hop(_edges(t), _start(t, 1, 2, 3, 4, 5), 3)


@query("jn_self_path", f"WITH e AS (SELECT * FROM {EDGES}) SELECT a.src, b.dst, a.w + b.w AS w FROM e a JOIN e b ON a.dst = b.src")
def _(t):
    e = _edges(t)
    return e.select("src", F.col("dst").alias("m"), F.col("w").alias("wa")).join(e.select(F.col("src").alias("m"), "dst", F.col("w").alias("wb")), "m").select("src", "dst", (F.col("wa") + F.col("wb")).alias("w"))


@query("jn_antijoin_graph", f"WITH e AS (SELECT src, dst FROM {EDGES}) SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.src = e.dst AND x.dst = e.src)")
def _(t):
    e = _edges(t).select("src", "dst")
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


_BFS = f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT 1::BIGINT AS id, 0 AS hops, [1::BIGINT] AS path UNION ALL SELECT y, hops + 1, list_append(path, y) FROM r JOIN (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e) ON id = x WHERE hops < 4 AND NOT list_contains(path, y)), m AS (SELECT id, min(hops) AS hops FROM r GROUP BY id)"


@query("gr_bfs", _BFS + " SELECT id, hops::INT AS hops, array_to_string(min(path), '>') AS path FROM r JOIN m USING (id, hops) GROUP BY ALL")
def _(t):
    return G.bfs_paths(_edges(t), _start(t, 1), 4, "both").select("id", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("gr_weighted", f"WITH RECURSIVE e AS (SELECT src, dst, 1 - w / 100.0::DOUBLE AS w FROM {EDGES}), r AS (SELECT unnest([1, 2, 3]::BIGINT[]) AS id, 1::DOUBLE AS s, 0 AS h UNION ALL SELECT dst, s * w, h + 1 FROM r JOIN e ON id = src WHERE h < 4) SELECT id, round(max(s), 6) AS score FROM r GROUP BY id")
def _(t):
    return rounded(G.best_first(_edges(t).withColumn("w", 1 - F.col("w") / 100), _start(t, 1, 2, 3), "w", 4))


@query("gr_path", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT 7::BIGINT AS id, 0 AS h UNION SELECT dst, h + 1 FROM r JOIN e ON id = src WHERE h < 60) SELECT id, min(h)::INT AS hops FROM r GROUP BY id")
def _(t):
    return G.k_hop(_edges(t), _start(t, 7), 60).select("id", "hops")


@query("gr_subgraph", f"SELECT src, dst, w FROM {EDGES} WHERE src <= 900 AND dst IN (SELECT p_partkey FROM part WHERE p_partkey <= 900)")
def _(t):
    return G.subgraph(_edges(t), t.part.where("p_partkey <= 900").select(F.col("p_partkey").alias("id")))


@query("gr_steiner")
def _(t):
    comp = G.components(_edges(t))
    big = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ids = [r["id"] for r in comp.join(big, "component").orderBy("id").limit(4).collect()]
    return G.steiner(_edges(t), ids, "w")


_CLOSURE = f"WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), c AS (SELECT DISTINCT src AS a, src AS b FROM e UNION SELECT a, dst FROM c JOIN e ON b = src)"


@query("gr_wcc", _CLOSURE + " SELECT a AS id, min(b) AS component FROM c GROUP BY a")
def _(t):
    return G.components(_edges(t))


_REACH = f"WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES}), n AS (SELECT src AS x FROM e UNION SELECT dst FROM e), c AS (SELECT x AS a, x AS b FROM n UNION SELECT a, dst FROM c JOIN e ON b = src)"


@query("gr_scc", _REACH + " SELECT c.a AS id, max(c.b) AS component FROM c JOIN c d ON c.a = d.b AND c.b = d.a GROUP BY c.a")
def _(t):
    return G.strong_components(_edges(t))


@query("gr_kcore_3")
def _(t):
    return G.k_core(t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst")), 3)


@query("gr_kcore_all")
def _(t):
    # k is the mean number of a part's suppliers, rounded up, so that nodes are peeled at any size
    e = t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst")).distinct()
    k = e.agg(F.ceil(F.try_divide(F.count("*"), F.count_distinct("src"))).alias("k")).first()["k"]
    return G.k_core(e, k or 1)


@query("gr_dijkstra", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT unnest([1, 2, 3]::BIGINT[]) AS start, unnest([1, 2, 3]::BIGINT[]) AS id, 0 AS cost, 0 AS h UNION SELECT start, dst, cost + w, h + 1 FROM r JOIN e ON id = src WHERE h < 60) SELECT start, id, min(cost)::DOUBLE AS cost FROM r GROUP BY ALL")
def _(t):
    return G.shortest_paths(_edges(t), _start(t, 1, 2, 3), "w").select("start", "id", "cost")


@query("gr_lpa")
def _(t):
    return G.label_propagation(_edges(t))


@query("gr_louvain")
def _(t):
    return G.louvain(_edges(t))


@query("gr_modularity")
def _(t):
    return rounded(G.modularity(_edges(t), G.louvain(_edges(t)).select("id", F.col("community").alias("label"))))


@query("gr_pagerank")
def _(t):
    return rounded(G.pagerank(_edges(t)))


@query("gr_eigenvector")
def _(t):
    return rounded(G.eigenvector(_edges(t)))


@query("gr_betweenness")
def _(t):
    return rounded(G.betweenness(_edges(t), G.nodes_of(_edges(t))))


@query("gr_degree", f"WITH e AS (SELECT * FROM {EDGES}) SELECT id, sum(i)::BIGINT AS ins, sum(o)::BIGINT AS outs FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id")
def _(t):
    return G.degrees(_edges(t))


@query("gr_comm_stats", f"WITH e AS (SELECT * FROM {EDGES}) SELECT least(src % 7, dst % 7) AS a, greatest(src % 7, dst % 7) AS b, count(*) AS edges FROM e GROUP BY ALL")
def _(t):
    e = _edges(t)
    return G.community_stats(e, G.nodes_of(e).withColumn("label", F.col("id") % 7))


@query("gr_meta", "SELECT r_name AS a, c_mktsegment AS b, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("a"), F.col("c_mktsegment").alias("b")).agg(F.count("*").alias("weight"))


@query("gr_meta_incr", "SELECT c_mktsegment AS k, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 GROUP BY 1")
def _(t):
    # counts before, plus changes of the touched keys alone
    old = t.customer.where("c_custkey % 2 = 0").groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"))
    add = t.customer.where("c_custkey % 2 = 1").select(F.col("c_mktsegment").alias("k"), F.lit(1).alias("d"))
    gone = t.customer.where("c_custkey % 10 = 3").select(F.col("c_mktsegment").alias("k"), F.lit(-1).alias("d"))
    delta = add.unionByName(gone).groupBy("k").agg(F.sum("d").alias("d"))
    return old.join(delta, "k", "full_outer").select("k", (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")).where("n > 0")


@query("gr_url_cluster", r"SELECT array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/'), lambda p: p <> '')[1:2], '/') AS cluster, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return G.path_clusters(t.pages, "url", 2)


@query("gr_layout", "SELECT n_nationkey AS id, round(cos(2 * pi() * (row_number() OVER (ORDER BY n_nationkey) - 1) / count(*) OVER ()), 6) AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY n_nationkey) - 1) / count(*) OVER ()), 6) AS y FROM nation")
def _(t):
    return rounded(G.circular(t.nation.select(F.col("n_nationkey").alias("id"))))


@query("gr_hierarchy", f"WITH RECURSIVE e AS (SELECT * FROM {TREE}), r AS (SELECT 2::BIGINT AS id, 0 AS hops UNION SELECT child, hops + 1 FROM r JOIN e ON parent = id) SELECT id, hops::INT AS hops FROM r")
def _(t):
    return G.descendants(_tree(t), _start(t, 2))


@query("gr_jurisdiction", f"WITH RECURSIVE e AS (SELECT * FROM {TREE}), r AS (SELECT x AS start, x AS id FROM (SELECT child AS x FROM e UNION SELECT parent FROM e) UNION SELECT start, parent FROM r JOIN e ON child = id) SELECT start, id FROM r")
def _(t):
    up = _tree(t).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return G.k_hop(up, G.nodes_of(up), None).select("start", "id")


@query("gr_jurisdiction_all", f"WITH RECURSIVE e AS (SELECT * FROM {TREE}), r AS (SELECT x AS start, x AS id FROM (SELECT child AS x FROM e UNION SELECT parent FROM e) UNION SELECT start, parent FROM r JOIN e ON child = id) SELECT start, id FROM r")
def _(t):
    up = _tree(t).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return G.k_hop(up, G.nodes_of(up), None).select("start", "id")


@query("gr_inf_transitive", f"WITH e AS (SELECT src, dst FROM {EDGES}) SELECT DISTINCT a.src, b.dst, 0.72::DOUBLE AS confidence FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = a.src AND x.dst = b.dst)")
def _(t):
    return rounded(G.transitive(_edges(t)))


@query("gr_inf_temporal", "WITH d AS (SELECT o_orderkey AS newer, lag(o_orderkey) OVER w AS older, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / (365 * 86400000000.0::DOUBLE) AS y FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT newer, older, round(greatest(0.5, 0.8 - 0.1 * y), 6) AS confidence FROM d WHERE older IS NOT NULL")
def _(t):
    return rounded(G.supersedes(t.orders, "o_orderkey", "o_custkey", "o_orderdate"))


@query("gr_inf_hier", f"WITH e AS (SELECT * FROM {TREE}) SELECT a.child AS src, b.parent AS dst, 0.75::DOUBLE AS confidence FROM e a JOIN e b ON a.parent = b.child")
def _(t):
    e = _tree(t)
    return e.select(F.col("child").alias("src"), F.col("parent").alias("m")).join(e.select(F.col("child").alias("m"), F.col("parent").alias("dst")), "m").select("src", "dst", F.lit(0.75).alias("confidence"))


@query("gr_impact", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT x AS start, x AS id, 0 AS h FROM (SELECT DISTINCT dst AS x FROM e) UNION SELECT start, src, h + 1 FROM r JOIN e ON id = dst WHERE h < 3), m AS (SELECT start, id, min(h) AS h FROM r GROUP BY ALL) SELECT start, count(*) AS affected, round(least(1, sum(0.5::DOUBLE ^ (h - 1)) / count(*)), 6) AS impact FROM m WHERE h > 0 GROUP BY start")
def _(t):
    e = _edges(t)
    return rounded(G.impact(e, e.select(F.col("dst").alias("id")).distinct(), 3))


@query("gr_impact_all", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT x AS start, x AS id, 0 AS h FROM (SELECT DISTINCT dst AS x FROM e) UNION SELECT start, src, h + 1 FROM r JOIN e ON id = dst WHERE h < 3), m AS (SELECT start, id, min(h) AS h FROM r GROUP BY ALL) SELECT start, count(*) AS affected, round(least(1, sum(0.5::DOUBLE ^ (h - 1)) / count(*)), 6) AS impact FROM m WHERE h > 0 GROUP BY start")
def _(t):
    e = _edges(t)
    return rounded(G.impact(e, e.select(F.col("dst").alias("id")).distinct(), 3))


_HREF = r"(SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=[" + '"' + r"'']([^" + '"' + r"'']+)[" + '"' + r"'']', 1)) AS href FROM pages)"


@query("gr_dependency", f"SELECT page_id, href, count(*) AS n FROM {_HREF} GROUP BY ALL")
def _(t):
    return G.links_of(t.pages, "page_id", "html").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("gr_nav_stats", f"SELECT p.page_id, count(href) AS links, count(DISTINCT href) AS targets FROM pages p LEFT JOIN {_HREF} h USING (page_id) GROUP BY p.page_id")
def _(t):
    h = G.links_of(t.pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))
    return t.pages.select("page_id").join(h, "page_id", "left").fillna(0, ["links", "targets"])


@query("gr_isolated", f"SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM {EDGES}) AND p_partkey NOT IN (SELECT dst FROM {EDGES})")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id")).join(G.nodes_of(_edges(t)), "id", "left_anti")


@query("cr_plan", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT 1::BIGINT AS id, 0 AS h UNION SELECT dst, h + 1 FROM r JOIN e ON id = src WHERE h < 3) SELECT id, min(h)::INT AS hops FROM r GROUP BY id ORDER BY 2, 1 LIMIT 50")
def _(t):
    return G.bfs_paths(_edges(t), _start(t, 1), 3, most=50).select("id", "hops")


@query("src_crawl")
def _(t):
    from docmill.sources import crawl

    return crawl.explore(t.pages.select("url", "html"), t.pages.orderBy("page_id").limit(3).select("url"), 3)
