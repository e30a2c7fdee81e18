"""Queries of deduplication, scoring, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import analytics as A
from docmill.operators import dedup, evaluate, retrieval, scoring
from docmill.plans.analytics import R, rounded
from docmill.plans.registry import query
from docmill.plans.scalars import _norm

TERMS = ["the", "than", "ouble"]


def _qvec(t, vec=0):
    return [float(x) for x in t.embeddings.where(F.col("vec_id") == vec).first()["embedding"]]


_KW = "(SELECT doc_id, s AS score FROM (SELECT doc_id, least(1, (" + " + ".join(f"10 * regexp_matches(title, '(?i){w}')::INT + regexp_matches(text, '(?i){w}')::INT" for w in TERMS) + ") / 33.0::DOUBLE) AS s FROM @titled) WHERE s > 0.1)"
_SEM = "(SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"


def _kw(t):
    return t.titled.select("doc_id", retrieval.keyword_regex(F.col("title"), F.col("text"), TERMS).alias("score")).where("score > 0.1")


def _top(t, d, k):
    return d.orderBy(F.desc("score"), "doc_id").limit(k)


def _sem(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), R(T.cosine(F.col("embedding"), F.lit(_qvec(t)).cast("array<double>")), 9).alias("score"))


@query("dd_exact", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256({_norm('text')}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(t):
    return dedup.exact(t.documents.withColumn("fp", T.fingerprint(F.col("text"))).select("doc_id", "fp"), "fp", "doc_id").select("doc_id")


@query("dd_exact_last", f"SELECT max(doc_id) AS doc_id FROM documents GROUP BY sha256({_norm('text')})")
def _(t):
    return dedup.exact(t.documents.withColumn("fp", T.fingerprint(F.col("text"))).select("doc_id", "fp"), "fp", "doc_id", "last").select("doc_id")


@query("dd_simple", """WITH RECURSIVE o AS (SELECT s_suppkey AS id, s_nationkey % 7 AS k1, floor(s_acctbal / 700)::BIGINT AS k2, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
r(i, kept, a, b) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN list_contains(a, k1) OR list_contains(b, k2) THEN kept ELSE list_append(kept, id) END,
 CASE WHEN list_contains(a, k1) OR list_contains(b, k2) THEN a ELSE list_append(a, k1) END, CASE WHEN list_contains(a, k1) OR list_contains(b, k2) THEN b ELSE list_append(b, k2) END FROM r JOIN o ON o.i = r.i + 1)
SELECT unnest(kept) AS id FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)""")
def _(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 7).alias("k1"), F.floor(F.col("s_acctbal") / 700).alias("k2"))
    return dedup.simple(rows, "id", "k1", "k2").select("id")


_TOK = r"list_distinct(list_filter(string_split_regex(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '\s+'), lambda w: w <> ''))"


@query("dd_similar_pairs", f"""WITH s AS (SELECT doc_id, {_TOK.format('title')} AS x, {_TOK.format('text')} AS y FROM @titled), p AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN len(a.x) = 0 THEN 0 ELSE len(list_intersect(a.x, b.x)) END AS i, len(a.x) + len(b.x) AS n,
 len(list_intersect(a.y, b.y)) AS j, len(a.y) + len(b.y) AS m FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE least(len(a.x), len(b.x)) >= 0.8 * greatest(len(a.x), len(b.x)) AND list_has_any(a.x, b.x)) SELECT a, b FROM p WHERE i / (n - i)::DOUBLE >= 0.8 AND j / (m - j)::DOUBLE >= 0.7""")
def _(t):
    return dedup.similar_pairs(t.titled, "doc_id", "title", "text").select("a", "b")


@query("dd_similar")
def _(t):
    return dedup.similar(t.titled.select("doc_id", "title", "text"), "doc_id", "title", "text").select("doc_id")


@query("jn_theta_sim")
def _(t):
    return rounded(dedup.similar_pairs(t.titled, "doc_id", "title", "text", title_least=0.9).select("a", "b", "title_sim"))


@query("dd_merge", """SELECT lang, arg_max(title, (length(title), -doc_id)) AS title, arg_min(source, (CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, doc_id)) AS source, min(doc_id) AS doc_id, count(*) AS merged FROM @titled GROUP BY lang""")
def _(t):
    return dedup.merge(t.titled.select("lang", "title", "text", "source", "doc_id"), "lang", "title", "text", "source", "doc_id", ["src3", "src1"]).drop("text")


@query("rt_kw_regex", f"SELECT doc_id, round(score, 6) AS score FROM {_KW}")
def _(t):
    return rounded(_kw(t))


@query("rt_kw_contains", "SELECT doc_id, least(100, (" + " + ".join(f"10 * contains(lower(title), '{w}')::INT + contains(lower(text), '{w}')::INT" for w in TERMS) + ") / 10.0::DOUBLE) AS score FROM @titled")
def _(t):
    return t.titled.select("doc_id", retrieval.keyword_contains(F.col("title"), F.col("text"), TERMS).alias("score"))


@query("rt_kw_boost", "SELECT doc_id, (10 * regexp_matches(title, '(?i)of the')::INT + 5 * regexp_matches(text, '(?i)of the')::INT + regexp_matches(source, '(?i)of the')::INT)::DOUBLE AS score FROM @titled")
def _(t):
    return t.titled.select("doc_id", retrieval.keyword_boost({"title": F.col("title"), "summary": F.col("text"), "url": F.col("source")}, "of the").alias("score"))


@query("rt_text_index", r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda w: w <> '')) AS token FROM documents), tf AS (SELECT token, doc_id, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token) SELECT doc_id, round(sum(tf * ln(1 + (SELECT count(*) FROM documents) / df::DOUBLE)), 6) AS score FROM tf JOIN df USING (token) WHERE token IN ('licensed', 'than', 'by') GROUP BY doc_id")
def _(t):
    return rounded(retrieval.text_search(retrieval.inverted_index(t.documents, "doc_id", "text"), "doc_id", ["licensed", "than", "by"]))


@query("topk_vector", f"SELECT doc_id AS vec_id, round(score, 6) AS score FROM {_SEM} ORDER BY {_SEM[1:2] and 'score'} DESC, doc_id LIMIT 20")
def _(t):
    return rounded(retrieval.vector_top(t.embeddings, "vec_id", "embedding", _qvec(t), 20))


@query("topk_pgvector", f"SELECT doc_id AS vec_id, round(1 - score, 6) AS distance FROM {_SEM} WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, doc_id LIMIT 10")
def _(t):
    some = t.embeddings.join(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieval.vector_top(some, "vec_id", "embedding", _qvec(t), 10).select("vec_id", R(1 - F.col("score")).alias("distance"))


@query("topk_lsh")
def _(t):
    return rounded(retrieval.lsh_top(t.embeddings, "vec_id", "embedding", _qvec(t), 10))


@query("topk_quota", f"SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM {_SEM} ORDER BY score DESC, doc_id LIMIT 50) WHERE doc_id % 2 = 0 ORDER BY score DESC, doc_id LIMIT 10")
def _(t):
    # over-fetch five times the limit, then filter: the order of these two decides the result
    return rounded(_top(t, retrieval.vector_top(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _qvec(t), 50).where("doc_id % 2 = 0"), 10))


@query("rt_semantic", "WITH s AS (SELECT vec_id % 100 AS doc, vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) SELECT doc, round(max(s), 6) AS score FROM s GROUP BY doc HAVING max(s) >= 0.3 ORDER BY max(s) DESC, doc LIMIT 10")
def _(t):
    return rounded(retrieval.semantic(t.embeddings.withColumn("doc", F.col("vec_id") % 100), "doc", "vec_id", "embedding", _qvec(t), 10, 0.3))


_LISTS = f"k AS (SELECT doc_id, round(score, 9) AS score FROM {_KW} ORDER BY round(score, 9) DESC, doc_id LIMIT 50), s AS (SELECT doc_id, round(score, 9) AS score FROM {_SEM} ORDER BY round(score, 9) DESC, doc_id LIMIT 50)"


def _lists(t):
    kw = _kw(t).withColumn("score", R(F.col("score"), 9))
    return _top(t, kw, 50), _top(t, _sem(t), 50)


_RRF = f"WITH {_LISTS}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM k), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round((coalesce(1 / (60 + a.r)::DOUBLE, 0) + coalesce(1 / (60 + b.r)::DOUBLE, 0)) * CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN 1.1::DOUBLE ELSE 1 END, 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id"


@query("rt_fuse_rrf", _RRF)
def _(t):
    return retrieval.fuse_rrf(*_lists(t), "doc_id").withColumn("score", R(F.col("score"), 9))


@query("win_rrf_rank", f"WITH {_LISTS} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s")
def _(t):
    return A.ranked(_lists(t)[1], "score", "doc_id").select("doc_id", "rank")


_MM = "CASE WHEN max(score) OVER () = min(score) OVER () THEN (score > 0)::INT::DOUBLE ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"


_WEIGHTED = f"WITH {_LISTS}, a AS (SELECT doc_id, {_MM} AS n FROM k), b AS (SELECT doc_id, {_MM} AS n FROM s) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN least((0.4 * a.n + 0.6 * b.n) * 1.1, 1) ELSE 0.4 * coalesce(a.n, 0) + 0.6 * coalesce(b.n, 0) END, 6) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id"


@query("rt_fuse_weighted", _WEIGHTED)
def _(t):
    return rounded(retrieval.fuse_weighted(*_lists(t), "doc_id"))


@query("rt_merge_geo", f"WITH {_LISTS} SELECT coalesce(k.doc_id, s.doc_id) AS doc_id, round(CASE WHEN s.score IS NULL THEN k.score ELSE 0.7 * s.score + 0.3 * coalesce(k.score, 0.5) END, 6) AS score FROM k FULL JOIN s ON k.doc_id = s.doc_id")
def _(t):
    k, s = _lists(t)
    j = k.withColumnRenamed("score", "k").join(s.withColumnRenamed("score", "s"), "doc_id", "full_outer")
    return rounded(j.select("doc_id", retrieval.merge_geo(F.col("k"), F.col("s")).alias("score")))


@query("rt_unified", f"WITH c AS (SELECT doc_id, score FROM {_KW} ORDER BY round(score, 9) DESC, doc_id LIMIT 100), v AS (SELECT s.doc_id, s.score FROM {_SEM} s JOIN c USING (doc_id) ORDER BY round(s.score, 9) DESC, doc_id LIMIT 20) SELECT doc_id, round(0.7 * v.score + 0.3 * c.score, 6) AS score FROM v JOIN c USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    # at most 100 candidates by keyword, the best 2 k of them by vector, fused, k kept
    c = _top(t, _kw(t).withColumn("score", R(F.col("score"), 9)), 100)
    v = _top(t, _sem(t).join(c.select("doc_id"), "doc_id", "left_semi"), 20).withColumnRenamed("score", "s")
    both = v.join(c.withColumnRenamed("score", "k"), "doc_id")
    return both.select("doc_id", R(retrieval.merge_geo(F.col("k"), F.col("s"))).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("rt_rerank", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, score FROM ({_RRF}))), f AS (SELECT *, CASE WHEN r <= 20 THEN 0.6 * score + 0.4 * (doc_id % 10) / 10.0::DOUBLE ELSE score END AS final FROM r) SELECT doc_id, round(final, 6) AS final, row_number() OVER (ORDER BY (r > 20)::INT, CASE WHEN r <= 20 THEN -final ELSE r END, doc_id)::INT AS rank FROM f")
def _(t):
    fused = retrieval.fuse_rrf(*_lists(t), "doc_id").withColumn("score", R(F.col("score"), 9))
    return rounded(retrieval.rerank(fused, "doc_id", "score", (F.col("doc_id") % 10) / 10).select("doc_id", "final", "rank"))


@query("rt_chunk", "SELECT doc_id, round(sum(CASE WHEN n > 0 THEN 1 + 0.5 * (n - 1) ELSE 0 END) / 2.0::DOUBLE, 6) AS score FROM (SELECT doc_id, len(regexp_extract_all(lower(text), w)) AS n FROM documents, (SELECT unnest(['than', 'licensed']) AS w)) GROUP BY doc_id")
def _(t):
    return rounded(t.documents.select("doc_id", retrieval.chunk_score(F.col("text"), ["than", "licensed"]).alias("score")))


@query("rt_expand", r"WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2)) AS term FROM benchmark), b AS (SELECT item_id, term FROM w UNION SELECT item_id, s FROM w JOIN (VALUES ('the', 'article'), ('and', 'plus')) v(t, s) ON term = t) SELECT item_id, string_agg(term, ' ' ORDER BY term) AS terms FROM b GROUP BY item_id")
def _(t):
    syn = t.spark.createDataFrame([("the", "article"), ("and", "plus")], "term string, synonym string")
    return retrieval.expand(t.benchmark, "item_id", "text", F.broadcast(syn)).select("item_id", F.array_join("terms", " ").alias("terms"))


@query("rt_fact_score", "SELECT p_partkey, round(least(1, 0.5 + 0.2 * contains(p_type, 'STEEL')::INT + CASE WHEN contains(lower(p_name), 'part') THEN 0.3 WHEN contains(lower(p_type), 'part') THEN 0.1 ELSE 0 END), 6) AS score FROM part")
def _(t):
    return rounded(t.part.select("p_partkey", retrieval.fact_score(F.col("p_name"), F.col("p_type"), ["part"], F.contains("p_type", F.lit("STEEL")), F.lit(False)).alias("score")))


@query("rt_kg_conf", "SELECT c_custkey, round(0.3 * (c_custkey % 10) / 10.0::DOUBLE + 0.3 * 0.9 + 0.2 * (c_nationkey % 5) / 5.0::DOUBLE + 0.2 * 0.5, 6) AS score FROM customer")
def _(t):
    return rounded(t.customer.select("c_custkey", retrieval.kg_confidence((F.col("c_custkey") % 10) / 10, F.lit(0.9), (F.col("c_nationkey") % 5) / 5, F.lit(0.5)).alias("score")))


@query("rt_hybrid_kgvec", f"WITH {_LISTS} SELECT s.doc_id, round(0.6 * coalesce(k.score, 0) + 0.4 * s.score, 6) AS score FROM s LEFT JOIN k ON s.doc_id = k.doc_id")
def _(t):
    k, s = _lists(t)
    return s.withColumnRenamed("score", "s").join(k.withColumnRenamed("score", "k"), "doc_id", "left").select("doc_id", R(0.6 * F.coalesce("k", F.lit(0.0)) + 0.4 * F.col("s")).alias("score"))


@query("rt_relation_score", "WITH f AS (SELECT o_orderpriority AS p, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS f FROM orders GROUP BY 1) SELECT o_orderkey, round(0.25 * f + 0.3 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0.3 END + 0.3 * 0.5 + 0.15 * CASE WHEN o_orderkey % 400 <= 30 THEN 1 WHEN o_orderkey % 400 <= 365 THEN 0.7 ELSE 0.4 END, 6) AS score FROM orders JOIN f ON p = o_orderpriority")
def _(t):
    n = t.orders.agg(F.count("*").alias("n"))
    f = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("c")).join(F.broadcast(n), F.lit(True)).select("o_orderpriority", (F.col("c") / F.col("n")).alias("f"))
    return rounded(t.orders.join(f, "o_orderpriority").select("o_orderkey", retrieval.relation_score(F.col("f"), F.col("o_orderstatus") == "F", F.lit(0.5), F.col("o_orderkey") % 400).alias("score")))


@query("rt_community_score", "SELECT label, round(0.4 * (label % 3) / 3.0::DOUBLE + 0.2 * least(count(*) / 100.0::DOUBLE, 1), 6) AS score FROM embeddings GROUP BY label")
def _(t):
    return rounded(t.embeddings.groupBy("label").agg(F.count("*").alias("n")).select("label", retrieval.community_score(None, (F.col("label") % 3) / 3, F.col("n")).alias("score")))


@query("rt_conflict_band", "SELECT event_id, CASE WHEN value / 100 - 0.5 > 0.3 THEN 'high' WHEN value / 100 - 0.5 > 0.1 THEN 'medium' ELSE 'none' END AS conflict FROM events")
def _(t):
    return t.events.select("event_id", retrieval.entropy_conflict(F.lit(0.5), F.col("value") / 100).alias("conflict"))


@query("rt_missing_emb", "SELECT doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL OR n_chars > 2000 * (label + 1)")
def _(t):
    j = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return j.where(F.col("label").isNull() | (F.col("n_chars") > 2000 * (F.col("label") + 1))).select("doc_id")


# scores
@query("sc_linear", "SELECT doc_id, round((0.3 * CASE WHEN source = 'src0' THEN 0.9 ELSE 0.5 END + 0.2 * (n_chars % 10) / 10.0::DOUBLE + 0.1 * 0.5) / (0.3 + 0.2 + 0.1), 6) AS score FROM documents")
def _(t):
    f = {"authority": F.when(F.col("source") == "src0", 0.9).otherwise(0.5), "keyword": (F.col("n_chars") % 10) / 10, "recency": F.lit(0.5)}
    return rounded(t.documents.select("doc_id", scoring.linear(f).alias("score")))


@query("sc_rule", "SELECT doc_id, least(0.1, (n_chars % 20) * 0.01)::DOUBLE AS score FROM documents")
def _(t):
    return t.documents.select("doc_id", scoring.rule(F.col("n_chars") % 20).alias("score"))


@query("sc_ml", "SELECT doc_id, round(((n_chars % 10) / 10.0::DOUBLE + 0.5) / 2, 6) AS score FROM documents")
def _(t):
    return rounded(t.documents.select("doc_id", scoring.plain_mean({"keyword": (F.col("n_chars") % 10) / 10, "recency": F.lit(0.5)}).alias("score")))


@query("sc_hybrid", "SELECT doc_id, round(0.5 * (0.2 * (n_chars % 10) / 10.0::DOUBLE + 0.1 * 0.5) / (0.2 + 0.1) + 0.5 * ((n_chars % 10) / 10.0::DOUBLE + 0.5) / 2, 6) AS score FROM documents")
def _(t):
    return rounded(t.documents.select("doc_id", scoring.hybrid({"keyword": (F.col("n_chars") % 10) / 10, "recency": F.lit(0.5)}).alias("score")))


def _points(f, each):
    return f"CASE WHEN contains(lower({f}), 'licensed') THEN {each} ELSE 0 END + CASE WHEN contains(lower({f}), 'than-the') THEN {each} ELSE floor((contains(lower({f}), 'than')::INT + contains(lower({f}), 'the')::INT) / 2.0::DOUBLE * {each}) END"


@query("sc_relevance", f"SELECT doc_id, p::BIGINT AS points, CASE WHEN p >= 10 THEN 'high' WHEN p >= 5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT doc_id, {_points('title', 5)} + {_points('text', 3)} + {_points('source', 2)} AS p FROM @titled)")
def _(t):
    p = scoring.relevance_points(F.col("title"), F.col("text"), F.col("source"), ["licensed", "than-the"])
    return t.titled.select("doc_id", p.cast("long").alias("points"), scoring.band(p).alias("band"))


@query("sc_meta_boost", "SELECT doc_id, round(0.4 * (1 + least(0.5, (n_chars % 7) / 7.0::DOUBLE * 0.9)), 6) AS score FROM documents")
def _(t):
    return rounded(t.documents.select("doc_id", scoring.meta_boost(F.lit(0.4), (F.col("n_chars") % 7) / 7, F.lit(0.9), True).alias("score")))


@query("sc_rank_graph", "WITH d AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) SELECT n_nationkey, round(0.5 * 0.8 + 0.25 * greatest(0, least(1, (0.4 * (2 * coalesce(n, 0) + coalesce(m, 0)) / 10 + 0.4 * 0.5 + 0.2 * least(coalesce(n, 0) / 10.0::DOUBLE, 1)) / 2)) + 0.1 * 0.5 + 0.15 * 0.3, 6) AS score FROM nation LEFT JOIN d ON d.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey")
def _(t):
    d = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("i"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("o"))
    j = t.nation.join(d, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0, ["i", "o"])
    return rounded(j.select("n_nationkey", scoring.graph_rank(F.lit(0.8), F.col("i"), F.col("o"), F.lit(0.5), F.col("i") / 10, F.lit(0.5), F.lit(0.3)).alias("score")))


@query("ln_boost", "WITH c AS (SELECT item, count(*) FILTER (WHERE type = 'accept') / nullif(count(*) FILTER (WHERE type IN ('accept', 'reject')), 0)::DOUBLE AS acc, avg(value) FILTER (WHERE type = 'view') / 20 AS r FROM @interactions GROUP BY item) SELECT item, round(CASE WHEN acc > 0.7 THEN 1.2 WHEN acc > 0.5 THEN 1.1 ELSE 1 END * CASE WHEN r >= 4 THEN 1.1 WHEN r >= 3 THEN 1.05 ELSE 1 END, 6)::DOUBLE AS boost FROM c")
def _(t):
    of = lambda k: F.col("type") == k
    acts = F.count_if(F.col("type").isin("accept", "reject"))
    c = t.interactions.groupBy("item").agg((F.count_if(of("accept")) / F.nullif(acts, F.lit(0))).alias("acc"), (F.avg(F.when(of("view"), F.col("value"))) / 20).alias("r"))
    return rounded(c.select("item", scoring.learned_boost(F.col("acc"), F.lit(0), F.col("r")).alias("boost")))


# evaluation: the run ranks documents for each of five queries, the judgments come from labels
_EVAL = """q AS (SELECT unnest(range(5)) AS query), run AS (SELECT query, doc_id AS doc, row_number() OVER (PARTITION BY query ORDER BY (doc_id * 7919 + query * 104729) % 1009, doc_id) AS rank FROM documents, q WHERE doc_id % 5 = query),
rel AS (SELECT doc_id AS doc, quality * 2 + (1 - toxic) AS relevance FROM labels), j AS (SELECT query, doc, rank, relevance, (relevance IS NOT NULL)::INT AS hit, row_number() OVER (PARTITION BY query ORDER BY relevance DESC NULLS LAST, rank) AS ir FROM run LEFT JOIN rel USING (doc) WHERE rank <= 30),
h AS (SELECT *, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS so FROM j), g AS (SELECT query, sum(hit) FILTER (WHERE rank <= 10) AS hits, count(*) FILTER (WHERE rank <= 10) AS ret, sum(hit) AS found, sum(hit * so / rank::DOUBLE) AS ap, sum(coalesce(relevance, 0) / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg, sum(coalesce(relevance, 0) / log2(ir + 1)) FILTER (WHERE ir <= 10) AS idcg FROM h GROUP BY query)"""


def _eval(t, **options):
    q = t.spark.range(5).withColumnRenamed("id", "query")
    d = t.documents.select(F.col("doc_id").alias("doc")).withColumn("query", F.col("doc") % 5).join(F.broadcast(q), "query")
    run = d.withColumn("rank", F.row_number().over(A.Window.partitionBy("query").orderBy((F.col("doc") * 7919 + F.col("query") * 104729) % 1009, "doc"))).where("rank <= 30")
    rel = t.labels.select(F.col("doc_id").alias("doc"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("relevance")).withColumn("query", F.col("doc") % 5)
    return rounded(evaluate.metrics(run, rel, **options))


for _n, _c, _s in (("ev_precision", "precision", "hits / ret::DOUBLE"), ("ev_recall", "recall", "hits / found::DOUBLE"), ("ev_map", "ap", "ap / found"), ("ev_ndcg", "ndcg", "dcg / idcg")):

    @query(_n, f"WITH {_EVAL} SELECT query, round({_s}, 6) AS {_c} FROM g")
    def _(t, c=_c):
        return _eval(t).select("query", c)


@query("ev_f1", f"WITH {_EVAL} SELECT query, round(2 * (hits / ret::DOUBLE) * (hits / found::DOUBLE) / (hits / ret::DOUBLE + hits / found::DOUBLE), 6) AS f1 FROM g")
def _(t):
    return _eval(t).select("query", "f1")


@query("ev_recall_all")
def _(t):
    return _eval(t, denominator="all")


_CDF = "0.5 * (1 + (1 - (((((1.061405429::DOUBLE * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k) * exp(-x * x)))"


@query("ev_ab", f"""WITH g AS (SELECT avg((quality = 1)::INT) FILTER (WHERE doc_id % 2 = 0) AS pa, avg((quality = 1)::INT) FILTER (WHERE doc_id % 2 = 1) AS pb, count(*) FILTER (WHERE doc_id % 2 = 0) AS na, count(*) FILTER (WHERE doc_id % 2 = 1) AS nb, avg((quality = 1)::INT) AS p FROM labels),
z AS (SELECT *, (pb - pa) / sqrt(p * (1 - p) * (1 / na::DOUBLE + 1 / nb::DOUBLE)) AS z FROM g), x AS (SELECT *, abs(z) / sqrt(2::DOUBLE) AS x FROM z), k AS (SELECT *, 1 / (1 + 0.3275911 * x) AS k FROM x), v AS (SELECT *, 2 * (1 - ({_CDF})) AS pv FROM k)
SELECT round(pa, 6) AS pa, round(pb, 6) AS pb, round(100 * (pb - pa) / pa, 6) AS change_pct, round(z, 6) AS z, round(pv, 6) AS p_value, CASE WHEN pv >= 0.05 THEN 'none' WHEN z > 0 THEN 'b' ELSE 'a' END AS winner FROM v""")
def _(t):
    return rounded(evaluate.ab_test(t.labels.select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("v"), F.col("quality").cast("double").alias("s")), "v", "s"))


@query("ev_stability", "SELECT event_type, round(avg((value > 20)::INT) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), 6) AS previous, round(avg((value > 20)::INT) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), 6) AS current FROM events GROUP BY event_type")
def _(t):
    e = t.events.withColumn("ok", (F.col("value") > 20).cast("double"))
    return rounded(A.period_compare(e, "event_type", "ts", "ok", "2000-01-01", "2024-01-16", "2100-01-01").drop("change_pct"))


@query("ev_patterns", "WITH m AS (SELECT 'Error ' || event_type || ' N' AS p, CASE WHEN contains(event_type, 'e') THEN 'timeout after N ms' ELSE 'assert N' END AS q FROM events) SELECT CASE WHEN contains(q, 'timeout') THEN 'timeout' ELSE 'assertion' END AS category, q AS pattern, count(*) AS n FROM m GROUP BY ALL")
def _(t):
    m = F.when(F.contains("event_type", F.lit("e")), F.concat(F.lit("timeout  after "), F.col("user_id"), F.lit(" ms"))).otherwise(F.concat(F.lit("assert '"), F.col("user_id"), F.lit("'")))
    return evaluate.failure_patterns(t.events.withColumn("m", m), "m")
