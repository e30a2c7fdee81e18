"""Queries of entity resolution, fusion, validation, versioning, chunking, metadata and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import analytics as A
from docmill.operators import chunking as C
from docmill.operators import entities as E
from docmill.operators import graph as G
from docmill.operators import retrieval
from docmill.plans.analytics import R, rounded
from docmill.plans.graphs import EDGES, _edges
from docmill.plans.registry import query

@query("er_conf", "SELECT doc_id, round(least(0.9, 0.5 + (s - 0.85) / 0.15 * 0.4), 6)::DOUBLE AS name_conf, round(least(0.85, 0.6 + (s - 0.75) / 0.25 * 0.25), 6)::DOUBLE AS sem_conf FROM (SELECT doc_id, 0.85::DOUBLE + (doc_id % 15) / 100.0::DOUBLE AS s FROM documents)")
def _(t):
    s = 0.85 + (F.col("doc_id") % 15) / 100
    return rounded(t.documents.select("doc_id", E.name_confidence(s).alias("name_conf"), E.semantic_confidence(s).alias("sem_conf")))


@query("er_field_sim", "SELECT a.s_suppkey, round((0.3 * CASE WHEN a.s_name = b.s_name THEN 1 ELSE 1 - levenshtein(lower(a.s_name), lower(b.s_name)) / greatest(length(a.s_name), length(b.s_name))::DOUBLE END + 0.2 * (a.s_nationkey = b.s_nationkey)::INT) / 0.5, 6) AS sim FROM supplier a JOIN supplier b ON a.s_suppkey + 1 = b.s_suppkey")
def _(t):
    a, b = t.supplier, t.supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("n2"), F.col("s_nationkey").alias("k2"))
    sims = {"name": T.levenshtein_sim(F.col("s_name"), F.col("n2")), "jurisdiction": (F.col("s_nationkey") == F.col("k2")).cast("double"), "uri": F.lit(None).cast("double")}
    return rounded(a.join(b, "s_suppkey").select("s_suppkey", E.field_similarity(sims).alias("sim")))


@query("er_matching")
def _(t):
    p = t.lineitem.groupBy(F.col("l_partkey").alias("blk"), F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b")).agg(F.sum("l_quantity").alias("weight"))
    return rounded(E.matching(p, "blk"))


@query("jn_type_block", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) < 2000")
def _(t):
    s = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    b = s.select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("s_acctbal").alias("bal"))
    return s.join(b, "s_nationkey").where((F.col("s_suppkey") < F.col("b")) & (F.abs(F.col("s_acctbal") - F.col("bal")) < 2000)).select(F.col("s_suppkey").alias("a"), "b")


@query("jn_bipartite", "SELECT s_suppkey, n_nationkey, w FROM (SELECT s_suppkey, n_nationkey, (s_suppkey * 31 + n_nationkey * 17) % 100 AS w FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey) WHERE w >= 60")
def _(t):
    j = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") % 5 == F.col("n_regionkey"))
    return j.select("s_suppkey", "n_nationkey", ((F.col("s_suppkey") * 31 + F.col("n_nationkey") * 17) % 100).alias("w")).where("w >= 60")


@query("jn_interval_overlap", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate <= b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY")
def _(t):
    o = t.orders.withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return E.overlapping_periods(o, "o_orderkey", "o_custkey", "o_orderdate", "until")


@query("jn_spatial", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 50 AND s_acctbal + 50 AND c_nationkey BETWEEN s_nationkey - 1 AND s_nationkey + 1")
def _(t):
    from docmill.operators import spatial

    # balances as they are, since a division may move one onto or off an edge; nations are scaled to them, which is exact
    p = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    b = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 50).alias("x0"), (F.col("s_acctbal") + 50).alias("x1"), ((F.col("s_nationkey") - 1) * 100.0).alias("y0"), ((F.col("s_nationkey") + 1) * 100.0).alias("y1"))
    return spatial.grid_join(p, b, 200.0).select("c_custkey", "s_suppkey")


_CLAIMS = "(SELECT p_partkey // 3 AS entity, unnest(['type', 'brand', 'size']) AS property, unnest([p_type, p_brand, p_size::VARCHAR]) AS value, p_retailprice / 2500 AS reliability, p_partkey AS ts FROM part)"


def _claims(t):
    s = F.explode(F.map_from_arrays(F.array(*map(F.lit, ["type", "brand", "size"])), F.array("p_type", "p_brand", F.col("p_size").cast("string"))))
    return t.part.select(F.expr("p_partkey div 3").alias("entity"), s.alias("property", "value"), (F.col("p_retailprice") / 2500).alias("reliability"), F.col("p_partkey").alias("ts"))


@query("fu_conflicts", f"SELECT entity, property, n AS n_values, CASE WHEN property IN ('type', 'status') THEN 'critical' WHEN n > 2 THEN 'high' ELSE 'low' END AS severity FROM (SELECT entity, property, count(DISTINCT lower(trim(value))) AS n FROM {_CLAIMS} GROUP BY ALL) WHERE n > 1")
def _(t):
    return E.conflicts(_claims(t))


@query("fu_resolve", f"WITH r AS (SELECT *, row_number() OVER w AS r, lead(reliability) OVER w AS nxt FROM {_CLAIMS} WINDOW w AS (PARTITION BY entity, property ORDER BY reliability DESC, ts DESC, value)), c AS (SELECT *, CASE WHEN reliability - nxt < 0.1 THEN reliability * 0.7 ELSE reliability END AS c FROM r WHERE r = 1) SELECT entity, property, value, round(c, 6) AS confidence, CASE WHEN c >= 0.85 THEN 'auto' WHEN c < 0.7 THEN 'review' ELSE 'suggest' END AS decision FROM c")
def _(t):
    return rounded(E.resolve(_claims(t)))


@query("fu_merge", "SELECT p_partkey // 3 AS k, arg_min(p_size, p_partkey) FILTER (WHERE p_size > 10) AS size, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def _(t):
    p = t.part.select(F.expr("p_partkey div 3").alias("k"), "p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), F.col("p_brand").alias("brand"))
    return E.merge_entities(p, "k", "p_partkey", ["size", "brand"])


@query("fu_merge_recent", "SELECT p_partkey // 3 AS k, arg_max(p_size, p_partkey) AS size, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def _(t):
    p = t.part.select(F.expr("p_partkey div 3").alias("k"), "p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return E.merge_entities(p, "k", "p_partkey", ["size", "brand"], "keep_most_recent")


@query("fu_reliability", "SELECT p_partkey, round(0.35 * (p_size / 50.0::DOUBLE) + 0.2 * 0.5 + 0.15 * (p_partkey % 4) / 4.0::DOUBLE + 0.3 * CASE WHEN p_partkey % 3 = 0 THEN 0.8 WHEN p_partkey % 3 = 1 THEN 0.7 ELSE 0.5 END, 6) AS score FROM part")
def _(t):
    other = F.when(F.col("p_partkey") % 3 == 1, 1).when(F.col("p_partkey") % 3 == 2, 0)
    return rounded(t.part.select("p_partkey", E.reliability(F.col("p_size") / 50, F.lit(0.5), (F.col("p_partkey") % 4) / 4, other).alias("score")))


@query("fu_provenance", f"SELECT entity, property, string_agg(ts::VARCHAR, ',' ORDER BY ts) AS sources FROM {_CLAIMS} GROUP BY ALL")
def _(t):
    return _claims(t).groupBy("entity", "property").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ts")), lambda x: x.cast("string")), ",").alias("sources"))


# validation
@query("va_orphan", f"SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM {EDGES} UNION SELECT dst FROM {EDGES})")
def _(t):
    return E.orphans(t.part.select(F.col("p_partkey").alias("id")), _edges(t))


@query("va_cycle", f"WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES}), c AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM c JOIN e ON b = src) SELECT DISTINCT a AS id FROM c WHERE a = b")
def _(t):
    c = G.strong_components(_edges(t))
    big = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return c.join(big, "component", "left_semi").select("id").union(_edges(t).where("src = dst").select("src")).distinct()


@query("va_selfloop", f"SELECT src FROM {EDGES} WHERE src = dst")
def _(t):
    return _edges(t).where("src = dst").select("src")


@query("va_contradiction", "SELECT l_orderkey, coalesce(l_returnflag, 'unknown') AS category, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", F.coalesce("l_returnflag", F.lit("unknown")).alias("category")).agg(F.countDistinct("l_suppkey").alias("n")).where("n > 1")


@query("va_shapes", "SELECT c_custkey, 'balance' AS rule FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') UNION ALL SELECT c_custkey, 'name' FROM customer WHERE length(c_name) < 3")
def _(t):
    return E.violations(t.customer, "c_custkey", {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "name": F.length("c_name") >= 3})


@query("va_schema", "SELECT doc_id, 'chars' AS rule FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang NOT IN ('en', 'de')")
def _(t):
    return E.violations(t.documents, "doc_id", {"chars": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("en", "de")})


@query("va_relation", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(t):
    return t.lineitem.join(t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("va_triplet", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT 0.25 * (value / 100) + 0.25 * (user_id % 10) / 10.0::DOUBLE + 0.2 * 0.5 + 0.1 + 0.1 * 0.5 + 0.1 * (value / 100) AS s FROM events)) GROUP BY band")
def _(t):
    s = E.triplet_quality([F.col("value") / 100, (F.col("user_id") % 10) / 10, F.lit(0.5), F.lit(1.0), F.lit(0.5), F.col("value") / 100])
    return t.events.groupBy(E.quality_band(s).alias("band")).agg(F.count("*").alias("n"))


@query("va_etl", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("al_uncertainty", "SELECT doc_id, least(1, CASE WHEN abs(c - 0.5) < 0.1 THEN 0.5 WHEN c < 0.7 THEN 0.3 ELSE 0 END + CASE WHEN doc_id % 5 > 3 THEN 0.2 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 0 END)::DOUBLE AS u FROM (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS c FROM documents)")
def _(t):
    return t.documents.select("doc_id", E.uncertainty((F.col("doc_id") % 100) / 100, F.col("doc_id") % 5, F.col("doc_id") % 2 == 0).alias("u"))


# versions: the second version of part drops every fifth row and grows some sizes
def _v2(t):
    return t.part.where("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_size") > 40, F.col("p_size") + 1).otherwise(F.col("p_size")))


_V2 = "(SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)"
_CH = f"SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'deleted' WHEN a.p_size <> b.p_size THEN 'updated' ELSE 'same' END AS change FROM part a LEFT JOIN {_V2} b ON a.p_partkey = b.p_partkey"


@query("vs_change", _CH)
def _(t):
    return E.changes(t.part, _v2(t), "p_partkey", ["p_name", "p_size"])


@query("vs_diff", f"SELECT * FROM ({_CH}) WHERE change <> 'same'")
def _(t):
    return E.changes(t.part, _v2(t), "p_partkey", ["p_name", "p_size"]).where("change <> 'same'")


@query("vs_filter", f"SELECT * FROM ({_CH}) WHERE change = 'updated'")
def _(t):
    return E.changes(t.part, _v2(t), "p_partkey", ["p_name", "p_size"]).where("change = 'updated'")


@query("vs_apply", f"SELECT a.p_partkey, coalesce(b.p_size, a.p_size) AS p_size, b.p_partkey IS NULL AS deleted FROM part a LEFT JOIN {_V2} b ON a.p_partkey = b.p_partkey")
def _(t):
    c = E.changes(t.part, _v2(t), "p_partkey", ["p_name", "p_size"])
    return E.apply_changes(t.part, _v2(t), c, "p_partkey").select("p_partkey", "p_size", "deleted")


@query("vs_entity", "SELECT o_orderkey, row_number() OVER w::INT AS version, lead(o_orderdate) OVER w AS until FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)".replace("OVER w::INT", "OVER w"))
def _(t):
    return E.versions(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("version").cast("long").alias("version"), "until")


@query("vs_active_on", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '1996-01-01')")
def _(t):
    o = t.orders.withColumn("until", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")))
    return E.active_on(o, "o_orderdate", "until", "1996-01-01").select("o_orderkey")


@query("vs_range", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1996-01-01'")
def _(t):
    return t.orders.where((F.col("o_orderdate") <= F.lit("1996-06-01").cast("timestamp")) & (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") >= F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey")


@query("vs_asof", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1")
def _(t):
    return t.orders.where(F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp")).groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))


@query("vs_history", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '>' ORDER BY o_orderdate, o_orderkey) AS history FROM orders GROUP BY 1")
def _(t):
    h = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(h, ">").alias("history"))


# chunks and metadata
@query("ch_tokens", "SELECT doc_id, i::INT AS chunk_index, substr(text, i * 1800 + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 200) / 1800.0::DOUBLE))::BIGINT)) AS i FROM documents WHERE length(text) > 0)")
def _(t):
    return C.windows(t.documents, "doc_id", "text")


@query("tx_summary_chunks", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(greatest(1, ceil((length(text) - 400) / 3600.0::DOUBLE))::BIGINT)) AS i FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def _(t):
    return C.windows(t.documents, "doc_id", "text", 1000, 100).groupBy("doc_id").agg(F.count("*").alias("n"))


for _s in ("default", "stop", "legal", "policy"):

    @query(f"ch_{_s}")
    def _(t, s=_s):
        return C.chunk(t.documents, "doc_id", "text", s).drop("chunk")


@query("ch_dispatch")
def _(t):
    return C.chunk(t.documents, "doc_id", "text", C.dispatch(F.when(F.col("lang") == "de", "Juridisch").otherwise("Web"), F.lit("x"))).drop("chunk")


@query("src_chunks")
def _(t):
    return C.chunk(t.documents.where("doc_id = 7"), "doc_id", "text").orderBy("chunk_index").limit(10).drop("chunk")


@query("md_citation", r"SELECT doc_id, 'url' AS kind, c AS citation, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s<>" + '"' + r"'')]+')) AS c FROM documents) GROUP BY ALL")
def _(t):
    return C.citations(t.documents, "doc_id", "text", {"url": C.CITATIONS["url"]})


@query("md_extract", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b(19|20)[0-9]{2}\b'))) AS found FROM documents")
def _(t):
    return C.extract(t.documents, "doc_id", "text", r"\b(19|20)[0-9]{2}\b")


@query("lb_extract", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'Licen[cs]e[d]? under [A-Z][A-Za-z -]+'))) AS found FROM documents")
def _(t):
    return C.extract(t.documents, "doc_id", "text", "Licen[cs]e[d]? under [A-Z][A-Za-z -]+")


@query("md_quality", "SELECT source, round(avg((text <> '')::INT), 6) AS has_text, round(avg((lang IN ('en', 'de', 'fr', 'es'))::INT), 6) AS known_lang, round(avg((n_chars = length(text))::INT), 6) AS right_size FROM documents GROUP BY source")
def _(t):
    share = lambda c: F.avg(c.cast("int"))
    return rounded(t.documents.groupBy("source").agg(share(F.col("text") != "").alias("has_text"), share(F.col("lang").isin("en", "de", "fr", "es")).alias("known_lang"), share(F.col("n_chars") == F.length("text")).alias("right_size")))


@query("md_terms", r"WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 3)) AS term FROM conversations), c AS (SELECT term, conv_id * 1000 + turn AS k, count(*) AS c FROM w GROUP BY ALL), g AS (SELECT term, sum(c)::BIGINT AS f, count(*) AS docs FROM c GROUP BY term HAVING sum(c) >= 2) SELECT term, f, docs, round(0.6 * least(1, f / 10.0::DOUBLE) + 0.4 * docs / (SELECT count(*) FROM conversations)::DOUBLE, 6) AS score FROM g")
def _(t):
    return rounded(C.terms(t.conversations.withColumn("k", F.col("conv_id") * 1000 + F.col("turn")), "k", "text"))


@query("tx_domain", r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\b(licen|copyr)') THEN 'legal' END AS a, CASE WHEN regexp_matches(lower(text), '\b(die|der)') THEN 'german' END AS b FROM documents")
def _(t):
    labels = C.classify(F.col("text"), {"legal": ["licen", "copyr"], "german": ["die", "der"]})
    has = lambda k: F.when(F.array_contains(labels, k), k)
    return t.documents.select("doc_id", has("legal").alias("a"), has("german").alias("b"))


@query("tx_compound", r"SELECT doc_id, array_to_string(list_transform(string_split_regex(lower(title), '\s+'), lambda w: CASE w WHEN 'thereof' THEN 'there of' WHEN 'into' THEN 'in to' ELSE w END), ' ') AS out FROM @titled")
def _(t):
    return t.titled.select("doc_id", F.array_join(C.split_compounds(F.split(F.lower("title"), r"\s+"), {"thereof": "there of", "into": "in to"}), " ").alias("out"))


@query("dp_compare", "SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN s > 0.95 THEN 'identical' WHEN s > 0.8 THEN 'similar' ELSE 'changed' END AS kind FROM (SELECT a.vec_id, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) AS x(a, b, s) WHERE s > 0.4".replace("a.vec_id AS a, b.vec_id AS b, CASE", "a, b, CASE"))
def _(t):
    e = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label")
    f = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "label")
    j = e.join(f, "label").where("a < b").withColumn("s", T.cosine(F.col("x"), F.col("y"))).where("s > 0.4")
    return j.select("a", "b", F.when(F.col("s") > 0.95, "identical").when(F.col("s") > 0.8, "similar").otherwise("changed").alias("kind"))


# monitoring and further analytics
@query("an_mttr", "SELECT o_custkey, round(avg(coalesce((epoch_us(l) - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE, 0)), 6) AS hours FROM (SELECT o_custkey, o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS l FROM orders) GROUP BY o_custkey")
def _(t):
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l"))
    h = T.days(F.col("o_orderdate"), F.col("l")) * 24
    return rounded(t.orders.join(l, "o_orderkey", "left").groupBy("o_custkey").agg(F.avg(F.coalesce(h, F.lit(0.0))).alias("hours")))


@query("an_recurrence", "SELECT item, round(greatest(a, r) / n::DOUBLE, 6) AS rate FROM (SELECT item, count(DISTINCT CASE WHEN type = 'accept' THEN user_id END) AS a, count(DISTINCT CASE WHEN type = 'reject' THEN user_id END) AS r, count(*) AS n FROM @interactions GROUP BY item)")
def _(t):
    u = lambda k: F.countDistinct(F.when(F.col("type") == k, F.col("user_id")))
    g = t.interactions.groupBy("item").agg(u("accept").alias("a"), u("reject").alias("r"), F.count("*").alias("n"))
    return rounded(g.select("item", (F.greatest("a", "r") / F.col("n")).alias("rate")))


@query("an_chronic", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    return rounded(t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("ts").alias("last")).where("n >= 5"))


@query("an_diff_sets", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 80), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 80) SELECT count(*) FILTER (WHERE b.user_id IS NULL) AS a_only, count(*) FILTER (WHERE a.user_id IS NULL) AS b_only, count(*) FILTER (WHERE a.user_id = b.user_id) AS common, round(count(*) FILTER (WHERE a.user_id = b.user_id) / count(*)::DOUBLE, 6) AS jaccard FROM a FULL JOIN b ON a.user_id = b.user_id")
def _(t):
    of = lambda k, n: t.events.where((F.col("event_type") == k) & (F.col("value") > 80)).select("user_id").distinct().withColumn(n, F.lit(1))
    j = of("signup", "a").join(of("purchase", "b"), "user_id", "full_outer")
    return rounded(j.agg(F.count_if(F.col("b").isNull()).alias("a_only"), F.count_if(F.col("a").isNull()).alias("b_only"), F.count_if(F.col("a") == F.col("b")).alias("common"), (F.count_if(F.col("a") == F.col("b")) / F.count("*")).alias("jaccard")))


@query("an_dedup_max", "SELECT url, max(length(html)) AS best, count(*) AS n FROM pages GROUP BY url")
def _(t):
    return t.pages.groupBy("url").agg(F.max(F.length("html")).cast("long").alias("best"), F.count("*").alias("n"))


@query("an_baseline", "WITH g AS (SELECT event_type, quantile_cont(value, 0.95) FILTER (WHERE ts < TIMESTAMP '2024-01-24') AS b, quantile_cont(value, 0.95) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS c FROM events GROUP BY 1) SELECT event_type, round(b, 6) AS base, round(c, 6) AS now, round(100 * (c - b) / b, 6) AS deviation FROM g")
def _(t):
    old = F.col("ts").cast("timestamp") < F.lit("2024-01-24").cast("timestamp")
    g = t.events.groupBy("event_type").agg(F.percentile(F.when(old, F.col("value")), 0.95).alias("base"), F.percentile(F.when(~old, F.col("value")), 0.95).alias("now"))
    return rounded(g.withColumn("deviation", 100 * (F.col("now") - F.col("base")) / F.col("base")))


@query("an_ops_stats", "SELECT event_type, quantile_disc(value, 0.95) AS p95, round(avg((value > 90)::INT), 6) AS error_rate FROM events GROUP BY 1")
def _(t):
    n = A.nearest_rank(t.events, "event_type", "value", 90.0)
    return rounded(n.select("event_type", "p95", (F.col("slow") / F.col("n")).alias("error_rate")), "p95")


@query("an_queue", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CASE WHEN count(*) > 1000 THEN 'high' WHEN count(*) > 500 THEN 'medium' ELSE 'low' END AS severity FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).withColumn("severity", F.when(F.col("n") > 1000, "high").when(F.col("n") > 500, "medium").otherwise("low"))


@query("an_collection_size", "SELECT source, count(*) AS n, count(*) > 50 AS over FROM documents GROUP BY source")
def _(t):
    limits = t.documents.select("source").distinct().withColumn("limit", F.lit(50))
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).join(limits, "source").select("source", "n", (F.col("n") > F.col("limit")).alias("over"))


@query("an_source_deprecate", "SELECT source, CASE WHEN avg(quality) < 0.85 THEN 'deprecated' ELSE 'active' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(t):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.when(F.avg("quality") < 0.85, "deprecated").otherwise("active").alias("status"))


@query("an_dependency", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT x AS start, x AS id, 0 AS h FROM (SELECT unnest([11, 12, 13]::BIGINT[]) AS x) UNION SELECT start, src, h + 1 FROM r JOIN e ON id = dst WHERE h < 5) SELECT start, count(DISTINCT id) - 1 AS dependents FROM r GROUP BY start")
def _(t):
    s = t.spark.createDataFrame([(11,), (12,), (13,)], "id long")
    return G.k_hop(_edges(t), s, 5, "in").groupBy("start").agg((F.count("*") - 1).alias("dependents"))


@query("an_log_quality", "SELECT event_id, round(0.4 * (props IS NOT NULL)::INT + 0.3 * least(length(event_type) / 10.0::DOUBLE, 1) + 0.3 * (value > 0)::INT, 6) AS q FROM events")
def _(t):
    return rounded(t.events.select("event_id", (0.4 * F.col("props").isNotNull().cast("int") + 0.3 * F.least(F.length("event_type") / 10, F.lit(1.0)) + 0.3 * (F.col("value") > 0).cast("int")).alias("q")))


@query("an_coverage", "SELECT source, count(label) AS covered, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, quality AS label FROM labels) USING (doc_id) GROUP BY source")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("quality").alias("covered"), F.count("*").alias("n"))


@query("an_sustain", "SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.date_trunc("quarter", "o_orderdate").alias("quarter")).agg(R(F.sum("o_totalprice"), 2).alias("total"))


@query("lb_knn", "WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.2) WHERE r <= 5")
def _(t):
    return retrieval.nearest(t.embeddings, "vec_id", "embedding", "label", 5, 0.2).select("a", "b")


@query("lb_knn_all", "WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.2) WHERE r <= 5")
def _(t):
    return retrieval.nearest(t.embeddings, "vec_id", "embedding", "label", 5, 0.2).select("a", "b")


@query("lb_rules_join", "SELECT c_custkey AS src, n_nationkey AS dst, 'LOCATED_IN' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, n_regionkey, 'PART_OF' FROM nation")
def _(t):
    a = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src"), F.col("n_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("type"))
    return a.union(t.nation.select(F.col("n_nationkey").cast("long"), "n_regionkey", F.lit("PART_OF")))


@query("lb_cleanup", f"SELECT src, dst FROM {EDGES} WHERE src <> dst AND src % 4 <> dst % 4")
def _(t):
    return _edges(t).where("src <> dst AND src % 4 <> dst % 4").select("src", "dst")


@query("lb_align", "SELECT term, arg_max(best, (s, best)) AS best, round(max(s), 6) AS sim FROM (SELECT lower(c_mktsegment) AS term, lower(p_type) AS best, 1 - levenshtein(lower(c_mktsegment), lower(p_type)) / greatest(length(c_mktsegment), length(p_type))::DOUBLE AS s FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT p_type FROM part)) WHERE s >= 0.3 GROUP BY term")
def _(t):
    return rounded(E.align(t.customer.select(F.lower("c_mktsegment").alias("name")), t.part.select(F.lower("p_type").alias("name")), 0.3))


@query("tx_orphan_files", "SELECT page_id, CASE WHEN length(html) < 2000 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(t):
    p = t.pages.join(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")
    return p.select("page_id", F.when(F.length("html") < 2000, 0.9).otherwise(0.6).alias("confidence"))


@query("tx_embed_stale", "SELECT doc_id FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END)")
def _(t):
    return t.documents.where(F.sha2("text", 256) != F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)).select("doc_id")


@query("tx_snippet")
def _(t):
    from docmill.operators import retrieval

    w = C.windows(t.documents, "doc_id", "text", 60, 10).withColumn("s", retrieval.chunk_score(F.col("chunk"), ["the", "than"]))
    return A.top_n_per_group(w, "doc_id", "s", "chunk_index", 1).select("doc_id", "chunk_index", "chunk")


@query("pt_score", "SELECT page_id, round(0.7 * (0.6 * (length(url) % 10) / 10.0::DOUBLE + 0.4 * (page_id % 5) / 5.0::DOUBLE) + 0.3 * 0.5, 6) AS score FROM pages WHERE 0.7 * (0.6 * (length(url) % 10) / 10.0::DOUBLE + 0.4 * (page_id % 5) / 5.0::DOUBLE) + 0.3 * 0.5 >= 0.4")
def _(t):
    s = 0.7 * (0.6 * (F.length("url") % 10) / 10 + 0.4 * (F.col("page_id") % 5) / 5) + 0.3 * 0.5
    return rounded(t.pages.select("page_id", s.alias("score")).where("score >= 0.4"))


@query("pt_url_ok", r"SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$') AS ok FROM pages")
def _(t):
    return t.pages.select("page_id", F.col("url").rlike(r"^https?://[^\s/$.?#].[^\s]*$").alias("ok"))


@query("wq_filter", r"WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS d FROM pages WHERE regexp_matches(url, '^https?://') AND length(html) >= 100) SELECT d AS domain, url FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY length(url) DESC, url, page_id) AS r FROM p) WHERE r = 1")
def _(t):
    p = t.pages.where(F.col("url").rlike("^https?://") & (F.length("html") >= 100)).select("page_id", "url", T.domain(F.col("url")).alias("domain"), F.length("url").alias("n"))
    w = A.Window.partitionBy("domain").orderBy(F.desc("n"), "url", "page_id")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("domain", "url")


@query("rv_auto", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'approve' WHEN quality = 0 THEN 'reject' ELSE 'review' END AS decision FROM labels")
def _(t):
    return t.labels.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approve").when(F.col("quality") == 0, "reject").otherwise("review").alias("decision"))


@query("gp_geo_docs", "SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS x0, max(c_acctbal) AS x1 FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("x0"), F.max("c_acctbal").alias("x1"))


@query("gp_results", "SELECT u AS url, page_id FROM (SELECT regexp_replace(regexp_replace(lower(url), '#.*$', ''), '/$', '') AS u, page_id, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(url), '#.*$', ''), '/$', '') ORDER BY length(html) DESC, page_id) AS r FROM pages) WHERE r = 1")
def _(t):
    p = t.pages.select(T.norm_url_eval(F.col("url")).alias("url"), "page_id", F.length("html").alias("n"))
    return p.withColumn("r", F.row_number().over(A.Window.partitionBy("url").orderBy(F.desc("n"), "page_id"))).where("r = 1").select("url", "page_id")


@query("ln_pattern", "SELECT user_id, round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    return rounded(t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("double")).alias("rate")).where("n >= 10").drop("n"))


@query("lk_score", "SELECT page_id, round(0.7 * contains(lower(url), 'a')::INT + 0.2 * contains(lower(url), 'a')::INT + CASE WHEN regexp_matches(lower(url), '\\.(pdf|docx?|xml)$') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM pages".replace("\\\\", "\\"))
def _(t):
    from docmill.operators import scoring

    return rounded(scoring.prioritized(t.pages.select("page_id", "url"), "url", "url", ["a"]).select("page_id", "score"))
