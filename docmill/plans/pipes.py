"""Queries of sources, sinks, extension points and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import guard
from docmill.plans.analytics import R, rounded
from docmill.plans.registry import query
from docmill.sources import readers, sinks
from docmill.streaming import events as S


def _ev(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("src_doc_find", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 400 AND source = 'src0' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def _(t):
    return readers.find(t.documents.select("doc_id", "lang", "n_chars", "source"), {"lang": ["en", "de"], "n_chars": (400, None), "source": "src0"}, [F.desc("n_chars"), "doc_id"], 10, 20).drop("source")


@query("src_doc_by_id", "SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 900) OR source = '5'")
def _(t):
    keys = t.spark.createDataFrame([("3",), ("5",), ("900",)], "key string")
    d = t.documents.select("doc_id", "source", F.col("doc_id").cast("string").alias("k"))
    return readers.by_keys(d, F.broadcast(keys), "k", "source").select("doc_id", "source")


@query("src_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-02-01'")
def _(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return readers.find(t.orders, {"o_orderdate": (day("1995-01-01"), day("1995-02-01"))}).select("o_orderkey")


def _lines_of(t, orders):
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return readers.with_extensions(orders.select("o_orderkey"), "o_orderkey", {"lines": l}).select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n"))


@query("src_with_ext", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(t):
    return _lines_of(t, t.orders)


@query("src_with_ext_all", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(t):
    return _lines_of(t, t.orders)


@query("src_sql", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 300 GROUP BY lang")
def _(t):
    t.documents.createOrReplaceTempView("documents")
    return guard.read_only_sql(t.spark, "SELECT lang, count(*) AS n FROM documents WHERE n_chars > :least GROUP BY lang", least=300)


@query("src_cdx_query", r"SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain, count(*) AS n FROM pages WHERE regexp_matches(url, 'a') GROUP BY 1")
def _(t):
    return t.pages.where(F.col("url").rlike("a")).groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("src_cdx_batches", "SELECT s::DATE::VARCHAR AS range_start, least(s + INTERVAL 7 DAY, DATE '2024-02-01')::DATE::VARCHAR AS range_end FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 7 DAY)) AS s)")
def _(t):
    d = readers.date_ranges(t.spark, "2024-01-01", "2024-02-01", 7)
    return d.select(*(F.col(c).cast("string").alias(c) for c in d.columns))


@query("src_ingest_adapters")
def _(t):
    return readers.ingest({"web": t.pages, "documents": t.documents}).select("source", "source_id", "title")


_V2 = "(SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 1000000, 1 FROM part WHERE p_partkey <= 5)"


@query("snk_upsert_source", f"SELECT p_partkey, p_size FROM {_V2} UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    # keys are ids within a source: the inserted parts are another source's, whose ids may be those of known parts
    p = t.part.select(F.lit("a").alias("source"), "p_partkey", F.col("p_size").cast("int").alias("p_size"), F.lit(1).alias("seq"))
    other = p.where("p_partkey <= 5").withColumn("source", F.lit("b")).withColumn("p_partkey", F.col("p_partkey") + 1000000).withColumn("p_size", F.lit(1))
    new = p.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100).unionByName(other)
    return sinks.upsert(p, new, ["source", "p_partkey"], "seq").drop("source", "seq")


@query("snk_upsert_fp", "SELECT sha256(text) AS fp, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    d = t.documents.select(F.sha2("text", 256).alias("fp"), "doc_id")
    return sinks.upsert(d.limit(0), d, ["fp"], "doc_id")


@query("snk_bulk_update", "SELECT doc_id, CASE WHEN doc_id IN (1, 2, 3) THEN 'done' ELSE lang END AS lang FROM documents")
def _(t):
    return sinks.bulk_update(t.documents.select("doc_id", "lang"), "doc_id", [1, 2, 3], "lang", "done")


@query("snk_vector_upsert", "SELECT vec_id % 100 AS chunk_id, max(vec_id) AS updated_at FROM embeddings GROUP BY 1")
def _(t):
    e = t.embeddings.select((F.col("vec_id") % 100).alias("chunk_id"), F.lit("m").alias("model_id"), "embedding", F.col("vec_id").alias("updated_at"))
    return sinks.upsert_vectors(e.limit(0), e, 64).select("chunk_id", "updated_at")


@query("snk_rdf", "SELECT '<n' || n_nationkey || '> <name> \"' || n_name || '\" <g> .' AS value FROM nation")
def _(t):
    return sinks.triples(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("s"), F.lit("name").alias("p"), F.col("n_name").alias("o"), F.lit(True).alias("literal")), "g")


@query("st_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(t):
    return rounded(S.tumbling(_ev(t)))


@query("st_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS s FROM events) GROUP BY 1")
def _(t):
    return S.sliding(_ev(t))


@query("st_sessions", "WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def _(t):
    return S.sessions(_ev(t))


@query("st_metrics", "SELECT event_type, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 25) AS le_25, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 75) AS le_75, count(*) AS le_inf, round(sum(value), 6) AS total FROM events GROUP BY 1")
def _(t):
    return rounded(S.buckets(_ev(t)))


@query("st_threshold", "SELECT date_trunc('hour', ts) AS start, round(avg((event_type = 'error')::INT), 6) AS rate, CASE WHEN avg((event_type = 'error')::INT) >= 0.5 THEN 'critical' ELSE 'warning' END AS level FROM events GROUP BY 1 HAVING avg((event_type = 'error')::INT) >= 0.25")
def _(t):
    return rounded(S.alerts(_ev(t)))


@query("st_progress", "SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 1000")
def _(t):
    return S.replay(t.events.select("event_id", "event_type"), 5000)


@query("st_ttl", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def _(t):
    return sinks.retained(t.events, "ts", "2024-02-01", 7).select("event_id")


@query("ud_action", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 300 ORDER BY n_chars DESC, doc_id LIMIT 10")
def _(t):
    from docmill.plans import actions

    flow = actions.Workflow().step("long", lambda c: c["docs"].where("n_chars > 300")).step("top", lambda c: c["long"].select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10))
    return flow.run({"docs": t.documents})["top"]


@query("ud_factor", "SELECT doc_id, round((0.3 * 0.5 + 0.2 * least(n_chars / 1000.0::DOUBLE, 1)) / 0.5, 6) AS score FROM documents")
def _(t):
    from docmill.operators import scoring

    f = {"authority": F.lit(0.5), "keyword": F.least(F.col("n_chars") / 1000, F.lit(1.0))}
    return rounded(t.documents.select("doc_id", scoring.linear(f).alias("score")))
