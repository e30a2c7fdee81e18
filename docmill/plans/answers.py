"""Queries of composed retrieval, extension points and the benchmark runner."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import chunking, evaluate, retrieval
from docmill.operators import graph as G
from docmill.plans.analytics import R, rounded
from docmill.plans.graphs import EDGES, _edges
from docmill.plans.registry import query
from docmill.plans.search import _SEM, _sem
from docmill.sources import readers

_FACTS = "(SELECT p_partkey AS id, least(1, 0.5 + 0.2 * contains(p_type, 'LARGE')::INT + CASE WHEN contains(lower(p_name), 'ring') THEN 0.3 WHEN contains(lower(p_type), 'ring') THEN 0.1 ELSE 0 END) AS relevance FROM part WHERE contains(lower(p_name), 'ring'))"


def _facts(t):
    p = t.part.where(F.contains(F.lower("p_name"), F.lit("ring")))
    return p.select(F.col("p_partkey").alias("id"), retrieval.fact_score(F.col("p_name"), F.col("p_type"), ["ring"], F.contains("p_type", F.lit("LARGE")), F.lit(False)).alias("relevance"))


_HYB = f"""v AS (SELECT doc_id AS id, round(score, 9) AS v FROM {_SEM} ORDER BY 2 DESC, 1 LIMIT 50), g AS (SELECT id, relevance AS g FROM {_FACTS} ORDER BY relevance DESC, id LIMIT 50),
h AS (SELECT coalesce(v.id, g.id) AS id, v, g FROM v FULL JOIN g ON v.id = g.id),
r AS (SELECT h.id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS uri, round(0.5 * coalesce(v, 0) + 0.25 * coalesce(g, 0) + 0.1 * coalesce(p_size / 50.0::DOUBLE, 0.5) + 0.15 * 0.5, 9) AS score FROM h LEFT JOIN part ON h.id = p_partkey),
d AS (SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY score DESC, id) AS k FROM r) WHERE uri IS NULL OR k = 1 ORDER BY score DESC, id LIMIT 15)"""


def _hybrid(t):
    top = lambda df: df.orderBy(F.desc("score"), "id").limit(50)
    v = top(_sem(t).select(F.col("doc_id").alias("id"), "score"))
    g = top(_facts(t).withColumnRenamed("relevance", "score"))
    about = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("uri"), (F.col("p_size") / 50).alias("recency"), F.lit(None).cast("double").alias("metadata"))
    return retrieval.hybrid_kg(v, g, about, _edges(t), 15, 10)


@query("rt_hybrid_kg", f"WITH {_HYB} SELECT id, round(score, 6) AS score FROM d")
def _(t):
    return rounded(_hybrid(t)[0].select("id", "score"))


@query("rt_related", f"WITH {_HYB}, e AS (SELECT src, dst FROM {EDGES} UNION ALL SELECT dst, src FROM {EDGES}) SELECT dst AS id, count(DISTINCT src) AS touches FROM e WHERE src IN (SELECT id FROM d) AND dst NOT IN (SELECT id FROM d) GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return _hybrid(t)[1]


_RAG = f"""WITH f AS (SELECT row_number() OVER (ORDER BY relevance DESC, id) AS place, id AS fact, relevance FROM {_FACTS} QUALIFY place <= 40),
c AS (SELECT doc_id AS chunk, doc_id // 2 AS entity, round(score, 9) AS s FROM {_SEM} WHERE score >= 0.05), k AS (SELECT chunk, place, fact, relevance, s FROM c JOIN f ON entity = fact QUALIFY row_number() OVER (PARTITION BY fact ORDER BY s DESC, chunk) <= 5),
b AS (SELECT chunk, fact, s FROM k QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY relevance DESC, place) = 1 ORDER BY s DESC, chunk LIMIT 20)
SELECT f.place, f.fact, b.chunk, round(greatest(0, least(1, 0.6 * relevance + 0.4 * coalesce(s, 0))), 6)::DOUBLE AS score, '[' || f.place || ']' AS citation FROM f LEFT JOIN b ON f.fact = b.fact"""


@query("rt_graphrag", _RAG)
def _(t):
    chunks = _sem(t).select(F.col("doc_id").alias("id"), F.expr("doc_id div 2").alias("entity"), F.col("score").alias("similarity"))
    return rounded(retrieval.graph_rag(_facts(t), chunks, 40, 5, 20, 0.05).withColumn("place", F.col("place").cast("long")))


@query("rt_expand_graph", f"WITH e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), m AS (SELECT p_partkey AS id FROM part WHERE contains(p_name, 'ring')) SELECT DISTINCT p_name AS term FROM part JOIN e ON p_partkey = dst WHERE src IN (SELECT id FROM m) UNION SELECT p_name FROM part WHERE contains(p_name, 'ring')")
def _(t):
    # a term's entities, and those that they are linked with
    named = t.part.where(F.contains("p_name", F.lit("ring"))).select(F.col("p_partkey").alias("id"))
    near = G.k_hop(_edges(t), named, 1, "both").select("id").union(named).distinct()
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term")).join(near, "id", "left_semi").select("term").distinct()


# extension points
@query("ud_embed", "SELECT c_custkey, round((length(c_mktsegment) - length(replace(lower(c_mktsegment), 'e', ''))) / length(c_mktsegment)::DOUBLE, 6) AS e FROM customer")
def _(t):
    return rounded(retrieval.through(t.customer, "c_mktsegment", "embed", "letters", "v").select("c_custkey", F.col("v")[4].alias("e")))


@query("ud_llm", "SELECT c_custkey, c_name || '.' AS out FROM customer")
def _(t):
    return retrieval.through(t.customer.withColumn("x", F.concat(F.lit(" "), "c_name", F.lit(". Lives in "), "c_mktsegment", F.lit("."))), "x", "llm", "first_sentence").select("c_custkey", "out")


@query("ud_chunker", r"SELECT c_custkey, i::INT - 1 AS chunk_index, p AS chunk FROM (SELECT c_custkey, unnest(string_split(c_name || ' | ' || c_mktsegment, ' | ')) AS p, generate_subscripts(string_split(c_name || ' | ' || c_mktsegment, ' | '), 1) AS i FROM customer)")
def _(t):
    def bars(text):
        at, out = 0, []
        for part in text.split(" | "):
            out.append((at, at + len(part), ""))
            at += len(part) + 3
        return out

    chunking.register("bars", bars)
    d = t.customer.withColumn("x", F.concat_ws(" | ", "c_name", "c_mktsegment"))
    return chunking.chunk(d, "c_custkey", "x", "bars").select("c_custkey", "chunk_index", "chunk")


@query("ud_adapter", "SELECT 'customers' AS source, c_custkey::VARCHAR AS source_id, c_name AS title FROM customer")
def _(t):
    @readers.adapter("customers")
    def _own(raw):
        return raw.select(F.lit("customers").alias("source"), F.col("c_custkey").cast("string").alias("source_id"), F.lit(None).cast("string").alias("url"), F.col("c_name").alias("title"), F.lit("").alias("text"))

    return readers.ingest({"customers": t.customer}).select("source", "source_id", "title")


@query("ud_weight", f"WITH RECURSIVE e AS (SELECT src, dst, CASE WHEN w % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS w FROM {EDGES}), r AS (SELECT unnest([1, 2, 3]::BIGINT[]) AS id, 1::DOUBLE AS s, 0 AS h UNION ALL SELECT dst, s * w, h + 1 FROM r JOIN e ON id = src WHERE h < 4) SELECT id, round(max(s), 6) AS score FROM r GROUP BY id")
def _(t):
    weight = lambda e: F.when(e["w"] % 2 == 0, 0.9).otherwise(0.5)
    e = _edges(t)
    return rounded(G.best_first(e.select("src", "dst", weight(e).alias("x")), t.spark.createDataFrame([(1,), (2,), (3,)], "id long"), "x", 4))


@query("ud_heuristic", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT x AS start, x AS id, 0 AS cost, 0 AS h FROM (SELECT unnest([7, 8, 9]::BIGINT[]) AS x) UNION SELECT start, dst, cost + w, h + 1 FROM r JOIN e ON id = src WHERE h < 60) SELECT start, min(cost)::DOUBLE AS cost FROM r WHERE id = (SELECT max(id) FROM r r1 WHERE r1.start = r.start) GROUP BY start")
def _(t):
    e, s = _edges(t), t.spark.createDataFrame([(7,), (8,), (9,)], "id long")
    goals = G.k_hop(e, s, 60).groupBy("start").agg(F.max("id").alias("goal"))
    least = e.agg(F.min("w")).first()[0] or 0
    return G.astar(e, goals, "w", lambda node, goal: F.when(node == goal, 0.0).otherwise(float(least))).select("start", "cost")


@query("st_cache", "SELECT lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'hits', 1")
def _(t):
    cache = retrieval.ResultCache(t.spark, ttl=60, most=8)
    make = lambda: t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    cache.get("langs", make)
    again = cache.get("langs", make)
    return again.union(t.spark.createDataFrame([("hits", cache.hits)], "lang string, n long"))


@query("fn_p_value", "SELECT o_orderkey, round(2 * (1 - (0.5 * (1 + (1 - (((((1.061405429::DOUBLE * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k) * exp(-x * x))))), 6) AS p FROM (SELECT o_orderkey, x, 1 / (1 + 0.3275911 * x) AS k FROM (SELECT o_orderkey, (o_orderkey % 40) / 10.0::DOUBLE / sqrt(2::DOUBLE) AS x FROM orders))")
def _(t):
    return rounded(t.orders.select("o_orderkey", evaluate.p_value((F.col("o_orderkey") % 40) / 10).alias("p")))


@query("ev_flake", """WITH r AS (SELECT o_custkey, o_orderstatus <> 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), g AS (SELECT o_custkey, count(*) AS runs, avg(ok::INT) AS rate FROM r WHERE r <= 10 GROUP BY 1 HAVING count(*) >= 5)
SELECT o_custkey, runs, round(rate, 6) AS rate, CASE WHEN rate = 1 THEN 'stable' WHEN rate = 0 THEN 'failing' ELSE 'flaky' END AS status FROM g""")
def _(t):
    from docmill.operators import analytics as A

    return rounded(A.flakes(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderstatus") != "F").cast("int").alias("ok")), "o_custkey", "o_orderdate", "ok", "o_orderkey"))


@query("ev_drift", """WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, floor(count(*) OVER (PARTITION BY o_custkey) * 0.9::DOUBLE) AS cut FROM orders), g AS (SELECT o_custkey, median(v) FILTER (WHERE i < cut) AS before, median(v) FILTER (WHERE i >= cut) AS after FROM r GROUP BY 1)
SELECT o_custkey, round(before, 6) AS before, round(after, 6) AS after, round((after - before) / before, 6) AS change, CASE WHEN (after - before) / before > 0.2 THEN 'slower' WHEN (after - before) / before < -0.2 THEN 'faster' ELSE 'stable' END AS status FROM g""")
def _(t):
    from docmill.operators import analytics as A

    return rounded(A.drift(t.orders, "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey"))


@query("ev_runner", "SELECT name, runs::BIGINT AS runs, true AS ordered FROM (VALUES ('count', 3), ('scan', 3)) v(name, runs)")
def _(t):
    d = t.nation
    got = evaluate.run_benchmarks({"count": lambda: d.count(), "scan": lambda: d.collect()}, iterations=3, warmup=1, timeout=600)
    b = t.spark.createDataFrame(got, "name string, runs long, failed long, min_s double, mean_s double, p50_s double, p95_s double, max_s double")
    ordered = (F.col("min_s") <= F.col("p50_s")) & (F.col("p50_s") <= F.col("p95_s")) & (F.col("p95_s") <= F.col("max_s")) & (F.col("failed") == 0)
    return b.select("name", "runs", ordered.alias("ordered"))
