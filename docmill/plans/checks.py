"""Queries of entity matching, fusion strategies, validators, branches, and of graph analyses that need more than one step."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import entities as E
from docmill.operators import graph as G
from docmill.operators import retrieval, validate
from docmill.plans.analytics import R, rounded
from docmill.plans.graphs import EDGES, _edges
from docmill.plans.registry import query

# entities: parts, whose type, name and brand are shared by many, suppliers' account balances as some uris
_ENT = "(SELECT p_partkey AS id, p_type AS type, lower(trim(p_name)) AS name, CASE WHEN p_partkey % 10 = 0 THEN 'u' || (p_partkey // 20) END AS uri, CASE WHEN p_size <= 40 THEN p_brand END AS jurisdiction, CASE WHEN p_size % 3 = 0 THEN p_size END AS date FROM part)"


def _ents(t):
    some = lambda ok, c: F.when(ok, c)
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), some(F.col("p_partkey") % 10 == 0, F.concat(F.lit("u"), F.expr("p_partkey div 20"))).alias("uri"), some(F.col("p_size") <= 40, F.col("p_brand")).alias("jurisdiction"), some(F.col("p_size") % 3 == 0, F.col("p_size")).alias("date"))


def _rule(keys: str, sim: float, conf: float, how: str) -> str:
    ks = keys.split()
    low = f"(SELECT {', '.join(ks)}, min(id) AS i, (list_sort(list(DISTINCT id)))[2] AS j FROM e WHERE {' AND '.join(k + ' IS NOT NULL' for k in ks)} GROUP BY ALL)"
    return f"SELECT e.id AS a, CASE WHEN i <> e.id THEN i ELSE j END AS b, {sim}::DOUBLE AS similarity, {conf}::DOUBLE AS confidence, '{how}' AS how FROM e JOIN {low} l ON {' AND '.join(f'e.{k} = l.{k}' for k in ks)} WHERE i <> e.id OR j IS NOT NULL"


_FIND = f"""WITH e AS MATERIALIZED (SELECT * FROM {_ENT}), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, p_type AS type FROM embeddings JOIN part ON vec_id = p_partkey),
n AS (SELECT type, name, min(id) AS b FROM e GROUP BY ALL),
l AS (SELECT x.type, x.name AS name, y.b, 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name))::DOUBLE AS s FROM n x JOIN n y ON x.type = y.type AND x.name <> y.name),
s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.type = b.type AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.3),
m AS (SELECT id AS a, id AS b, 1::DOUBLE AS similarity, 1::DOUBLE AS confidence, 'id' AS how FROM e UNION ALL {_rule('uri', 1.0, 1.0, 'uri')} UNION ALL {_rule('type name', 0.98, 0.95, 'name')}
 UNION ALL {_rule('type jurisdiction date', 0.9, 0.8, 'metadata')} UNION ALL {_rule('type jurisdiction', 0.7, 0.6, 'jurisdiction')}
 UNION ALL SELECT e.id, l.b, s, least(0.9, 0.5 + (s - 0.6) / 0.4 * 0.4), 'levenshtein' FROM e JOIN l USING (type, name) WHERE s >= 0.6 AND e.id <> l.b
 UNION ALL SELECT a, b, s, least(0.85, 0.6 + (s - 0.3) / 0.7 * 0.25), 'semantic' FROM k WHERE r <= 3)
SELECT a, b, round(m.similarity, 6) AS similarity, round(m.confidence, 6) AS confidence, m.how AS how FROM (SELECT a, b, max(struct_pack(similarity := similarity, confidence := confidence, how := how)) AS m FROM m GROUP BY a, b)"""


def _found(t):
    v = t.embeddings.join(t.part.select(F.col("p_partkey").alias("vec_id"), F.col("p_type").alias("type")), "vec_id")
    near = retrieval.nearest(v, "vec_id", "embedding", "type", 3, 0.3).withColumnRenamed("s", "similarity")
    return E.find_matches(_ents(t), _ents(t), near, 0.6, 0.3)


@query("er_find", _FIND)
def _(t):
    return rounded(_found(t))


@query("er_best", f"SELECT a, arg_max(b, (similarity, -b)) AS b FROM ({_FIND}) GROUP BY a")
def _(t):
    return E.best_match(_found(t).where("a <> b OR how = 'id'").withColumn("similarity", R(F.col("similarity")))).select("a", "b")


@query("er_similar_names", "SELECT x.k AS block, least(x.n, y.n) AS x, greatest(x.n, y.n) AS y, round(1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n))::DOUBLE, 6) AS sim FROM (SELECT DISTINCT c_nationkey AS k, lower(c_name) AS n FROM customer) x JOIN (SELECT DISTINCT c_nationkey AS k, lower(c_name) AS n FROM customer) y ON x.k = y.k AND x.n < y.n WHERE 1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n))::DOUBLE >= 0.95")
def _(t):
    n = t.customer.select(F.col("c_nationkey").alias("block"), F.lower("c_name").alias("name")).distinct()
    return rounded(E.similar_names(n, "block", 0.95))


# fusion
_CL = "(SELECT p_partkey // 3 AS entity, unnest(['type', 'size']) AS property, unnest([p_type, p_size::VARCHAR]) AS value, p_retailprice / 2500 AS reliability, p_partkey AS ts, p_size / 50.0::DOUBLE AS recency FROM part)"


def _claims(t):
    s = F.explode(F.map_from_arrays(F.array(F.lit("type"), F.lit("size")), F.array("p_type", F.col("p_size").cast("string"))))
    return t.part.select(F.expr("p_partkey div 3").alias("entity"), s.alias("property", "value"), (F.col("p_retailprice") / 2500).alias("reliability"), F.col("p_partkey").alias("ts"), (F.col("p_size") / 50).alias("recency"))


def _decided(c: str) -> str:
    return f"round({c}, 6) AS confidence, CASE WHEN {c} >= 0.85 THEN 'auto' WHEN {c} < 0.7 THEN 'review' ELSE 'suggest' END AS decision"


@query("fu_resolve_recent", f"SELECT entity, property, arg_max(value, ts) AS value, {_decided('arg_max(recency, ts)')} FROM {_CL} GROUP BY ALL")
def _(t):
    return rounded(E.resolve(_claims(t), "most_recent"))


_BEST = f"(SELECT *, CASE WHEN reliability - nxt < 0.1 THEN reliability * 0.7 ELSE reliability END AS c FROM (SELECT *, row_number() OVER w AS r, lead(reliability) OVER w AS nxt FROM {_CL} WINDOW w AS (PARTITION BY entity, property ORDER BY reliability DESC, ts DESC, value)) WHERE r = 1)"


@query("fu_resolve_weighted", f"SELECT entity, property, round(sum(value::DOUBLE * reliability) / sum(reliability), 4)::VARCHAR AS value, {_decided('avg(reliability)')} FROM {_CL} WHERE property = 'size' GROUP BY ALL UNION ALL SELECT entity, property, value, {_decided('c')} FROM {_BEST} WHERE property = 'type'")
def _(t):
    r = rounded(E.resolve(_claims(t), "weighted"))
    return r.withColumn("value", F.when(F.col("property") == "size", (F.round(F.col("value").cast("double") * 1e4) / 1e4).cast("string")).otherwise(F.col("value")))


@query("fu_resolve_human", f"SELECT DISTINCT entity, property, NULL::VARCHAR AS value, 0::DOUBLE AS confidence, 'review' AS decision FROM {_CL}")
def _(t):
    return E.resolve(_claims(t), "human")


@query("fu_merge_primary", "SELECT p_partkey // 3 AS k, arg_min(p_size, p_partkey) AS size, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def _(t):
    p = t.part.select(F.expr("p_partkey div 3").alias("k"), "p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return E.merge_entities(p, "k", "p_partkey", ["size", "brand"], "keep_primary")


@query("fu_merge_resolved", "SELECT p_partkey // 3 AS k, arg_max(p_size, (p_retailprice, p_partkey))::VARCHAR AS size, arg_max(p_brand, (p_retailprice, p_partkey)) AS brand FROM part GROUP BY 1")
def _(t):
    p = t.part.select(F.expr("p_partkey div 3").alias("k"), "p_partkey", (F.col("p_retailprice") / 2500).alias("reliability"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return E.merge_entities(p, "k", "p_partkey", ["size", "brand"], "resolve_conflicts")


# validators. Claims are lineitems: an order relates to a part by its return flag
_RE = "(SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS type FROM lineitem WHERE l_linenumber > 1)"
_CLAIM = "(SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS type, CASE WHEN l_linenumber = 3 THEN NULL ELSE 's' || l_suppkey END AS source, CASE l_linenumber WHEN 4 THEN 'soon' WHEN 5 THEN '1850-01-01' ELSE '2020-01-01' END AS effective FROM lineitem)"
_FACT = f"""WITH e AS (SELECT * FROM {_RE}), p AS (SELECT src, dst, list(DISTINCT type) AS types FROM e GROUP BY ALL), k AS (SELECT src, type, count(*) AS same FROM e GROUP BY ALL),
n AS (SELECT src, count(*) AS c, count(DISTINCT type) AS kinds FROM e GROUP BY ALL),
j AS (SELECT c.*, coalesce(list_contains(types, c.type), false) AS dup, coalesce(len(list_filter(types, lambda x: x <> c.type)), 0) AS other, coalesce(same > 10, false) AS many, coalesce(kinds = 1 AND n.c > 5, false) AS single,
 source IS NOT NULL AND (source NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey < 20)) AS gone, effective = 'soon' AS unread, effective = '1850-01-01' AS odd
 FROM {_CLAIM} c LEFT JOIN p ON c.src = p.src AND c.dst = p.dst LEFT JOIN k ON c.src = k.src AND c.type = k.type LEFT JOIN n ON c.src = n.src),
s AS (SELECT *, 0.9 - 0.2 * gone::INT - 0.1 * (source IS NULL)::INT - 0.1 * unread::INT - 0.05 * odd::INT AS s FROM j),
f AS (SELECT *, greatest(0, least(1, CASE WHEN dup THEN least(1, s + 0.1) ELSE s END - 0.1 * least(other, 2) - 0.05 * many::INT - 0.03 * single::INT)) AS confidence FROM s)
SELECT src, dst, type, round(confidence, 6)::DOUBLE AS confidence, round(confidence, 9) >= 0.7 AND NOT (gone OR source IS NULL OR unread OR odd OR other > 0 OR many OR single) AS accepted FROM f"""


@query("va_fact", _FACT)
def _(t):
    e = t.lineitem.where("l_linenumber > 1").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"))
    when = F.when(F.col("l_linenumber") == 4, "soon").when(F.col("l_linenumber") == 5, "1850-01-01").otherwise("2020-01-01")
    c = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linenumber") != 3, F.concat(F.lit("s"), "l_suppkey")).alias("source"), when.alias("effective"))
    known = t.supplier.where("s_nationkey < 20").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return rounded(validate.facts(c, e, known, "2024-01-01", 0.9).select("src", "dst", "type", "confidence", "accepted"))


_NODE = "(SELECT p_partkey AS id, CASE WHEN p_size <= 40 THEN p_brand END AS jur, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'municipality' WHEN 2 THEN 'province' WHEN 3 THEN 'national' ELSE 'european' END AS lev, CASE p_partkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS level, p_size AS starts, CASE WHEN p_partkey % 4 > 0 THEN p_size + 5 END AS ends FROM part)"
_SEMV = f"""WITH n AS (SELECT * FROM {_NODE}), e AS (SELECT src, dst, CASE w % 3 WHEN 0 THEN 'OVERRIDES' WHEN 1 THEN 'REFINES' ELSE 'REFERENCES' END AS type FROM {EDGES}),
j AS (SELECT src, dst, type, coalesce(lower(s.jur) = lower(d.jur), true) AS place, coalesce(s.starts <= d.ends, true) AND coalesce(d.starts <= s.ends, true) AS time, coalesce(s.level >= d.level, true) AS level FROM e JOIN n s ON src = s.id JOIN n d ON dst = d.id)
SELECT *, CASE WHEN (NOT place AND type IN ('REFINES')) OR (NOT time AND type IN ('OVERRIDES', 'REFINES')) OR (NOT level AND type = 'OVERRIDES') THEN 'error' WHEN NOT (place AND time AND level) THEN 'warning' ELSE 'valid' END AS verdict FROM j"""


@query("va_semantic", _SEMV)
def _(t):
    levels = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, validate.LEVELS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    n = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("jurisdiction"), levels.alias("level"), F.col("p_size").alias("starts"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") + 5).alias("ends"))
    kind = F.element_at(F.array(*map(F.lit, ("OVERRIDES", "REFINES", "REFERENCES"))), (F.col("w") % 3 + 1).cast("int"))
    e = _edges(t).select("src", "dst", kind.alias("type"))
    return validate.relations(e, n, ("REFINES",), ("OVERRIDES", "REFINES"), ("OVERRIDES",))


_MV = f"""WITH e AS (SELECT src, dst, CASE w % 3 WHEN 0 THEN 'APPLIES_TO' WHEN 1 THEN 'HAS_REQUIREMENT' ELSE 'DEFINED_IN' END AS type FROM {EDGES}),
o AS (SELECT src AS id, count(*) AS o, count(*) FILTER (WHERE type = 'APPLIES_TO') AS app, count(*) FILTER (WHERE type = 'DEFINED_IN') AS def FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS i, count(*) FILTER (WHERE type = 'HAS_REQUIREMENT') AS req FROM e GROUP BY 1),
n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'PolicyDocument' WHEN 1 THEN 'Regulation' WHEN 2 THEN 'Requirement' ELSE 'Concept' END AS type, p_name, p_size, coalesce(o, 0) AS o, coalesce(i, 0) AS i, coalesce(app, 0) AS app, coalesce(def, 0) AS def, coalesce(req, 0) AS req FROM part LEFT JOIN o ON p_partkey = o.id LEFT JOIN i ON p_partkey = i.id),
s AS (SELECT id, greatest(0, 1 - 0.3 * (id % 13 = 0)::INT - CASE type WHEN 'PolicyDocument' THEN 0.2 * (p_size > 40)::INT + 0.1 * (p_size % 3 > 0)::INT + 0.1 * (def = 0)::INT WHEN 'Regulation' THEN 0.2 * (p_size > 25)::INT + 0.1 * (app = 0)::INT WHEN 'Requirement' THEN 0.3 * (p_size < 10)::INT + 0.2 * (req = 0)::INT ELSE 0 END) AS plausibility,
 least(1, (o + i) / 3.0::DOUBLE) * CASE WHEN o + i = 0 AND type <> 'Concept' THEN 0.3 ELSE 1 END * CASE WHEN o > 0 AND i > 0 THEN 1 ELSE 0.8 END AS importance, NOT (p_size = 15) AND NOT (p_size % 3 = 0 AND id % 6 = 0) AS in_time FROM n)
SELECT id, round(plausibility, 6)::DOUBLE AS plausibility, round(importance, 6)::DOUBLE AS importance, in_time, round(0.4 * plausibility + 0.4 * importance + CASE WHEN in_time THEN 0.2 ELSE 0.1 END, 6)::DOUBLE AS score FROM s"""


@query("va_multi_view", _MV)
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("APPLIES_TO", "HAS_REQUIREMENT", "DEFINED_IN"))), (F.col("w") % 3 + 1).cast("int"))
    e = _edges(t).select("src", "dst", kind.alias("type"))
    type_ = F.element_at(F.array(*map(F.lit, ("PolicyDocument", "Regulation", "Requirement", "Concept"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    has = lambda ok, v="x": F.when(ok, v)
    date = F.when(F.col("p_size") == 15, "no date").when(F.col("p_size") % 3 == 0, "2020-06-01")
    expires = F.when(F.col("p_partkey") % 6 == 0, "2019-01-01")
    n = t.part.select(F.col("p_partkey").alias("id"), type_.alias("type"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_name")).otherwise(" ").alias("name"), has(F.col("p_size") <= 40).alias("jurisdiction"), date.alias("date"), has(F.col("p_size") <= 25).alias("category"), has(F.col("p_size") >= 10).alias("metric"), expires.alias("expires"))
    return rounded(validate.views(n, e))


@query("va_dynamic", "SELECT o_orderkey AS id, (o_totalprice < 10000)::INT + (o_orderstatus NOT IN ('O', 'F'))::INT AS errors, CASE WHEN o_orderkey % 7 = 0 THEN 'duplicate' END AS warning FROM orders")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    known = t.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    b = validate.batch(rows, {"price": F.col("o_totalprice") >= 10000, "status": F.col("o_orderstatus").isin("O", "F")}, known)
    return b.select("id", F.size("errors").alias("errors"), "warning")


_PER = "(SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS s, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate - INTERVAL 1 DAY WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 60 DAY END AS e FROM orders)"


@query("va_temporal", f"WITH p AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, v) AS n FROM {_PER}) SELECT k, v, 'ends_before_start' AS problem FROM p WHERE e < s UNION ALL SELECT k, v, 'overlaps_next' FROM p WHERE n IS NOT NULL AND (e IS NULL OR e > n) UNION ALL SELECT k, v, 'gap_before_next' FROM p WHERE e < n")
def _(t):
    until = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return validate.periods(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("s"), until.alias("e")), "k", "v", "s", "e")


_NAV = f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES}), n AS (SELECT p_partkey AS id, 'u' || (p_partkey % 1500) AS uri FROM part), c AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM c JOIN e ON b = src),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), w AS (SELECT id AS a, id AS b FROM n UNION SELECT w.a, u.b FROM w JOIN u ON w.b = u.a), k AS (SELECT a, min(b) AS comp FROM w GROUP BY a)
SELECT 'dangling' AS problem, count(*) AS n FROM e WHERE dst NOT IN (SELECT id FROM n) OR src NOT IN (SELECT id FROM n) UNION ALL SELECT 'orphan', count(*) FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)
UNION ALL SELECT 'cyclic', count(DISTINCT a) FROM c WHERE a = b UNION ALL SELECT 'duplicate_uri', count(*) FROM (SELECT uri FROM n GROUP BY uri HAVING count(*) > 1)
UNION ALL SELECT 'components', count(DISTINCT comp) FROM k JOIN n ON a = id UNION ALL SELECT 'bad_vector', count(*) FROM embeddings WHERE len(embedding) <> 64 OR list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)"""


@query("va_nav_graph", _NAV)
def _(t):
    n = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("u"), F.col("p_partkey") % 1500).alias("uri"))
    return G.graph_problems(n, _edges(t), t.embeddings.select("embedding"), 64)


# branches
_BR = "(SELECT 'main' AS branch, p_partkey AS id, p_size AS value FROM part WHERE p_partkey % 10 > 0 UNION ALL SELECT 'work', p_partkey, p_size + 1 FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'hot', p_partkey, p_size + p_partkey % 2 + 1 FROM part WHERE p_size % 6 = 0)"


def _branches(t):
    rows = lambda b, w, v: t.part.where(w).select(F.lit(b).alias("branch"), F.col("p_partkey").alias("id"), v.alias("value"))
    return rows("main", "p_partkey % 10 > 0", F.col("p_size").cast("long")).unionByName(rows("work", "p_size % 4 = 0", (F.col("p_size") + 1).cast("long"))).unionByName(rows("hot", "p_size % 6 = 0", F.col("p_size") + F.col("p_partkey") % 2 + 1))


@query("vs_branch", f"WITH b AS (SELECT * FROM {_BR}), l AS (SELECT * FROM b WHERE branch = 'work'), r AS (SELECT * FROM b WHERE branch = 'hot') SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' WHEN l.value = r.value THEN 'same' ELSE 'modified' END AS change FROM l FULL JOIN r ON l.id = r.id")
def _(t):
    return E.compare_branches(_branches(t), "id", "value", "work", "hot")


_SIDE = "(SELECT id, arg_min(value, branch = 'main') AS v FROM b WHERE branch IN ('{0}', 'main') GROUP BY id)"


@query("vs_merge", f"WITH b AS (SELECT * FROM {_BR}), m AS (SELECT id, value AS v FROM b WHERE branch = 'main'), s AS {_SIDE.format('work')}, t AS {_SIDE.format('hot')}, j AS (SELECT coalesce(m.id, s.id, t.id) AS id, m.v AS m, s.v AS s, t.v AS t FROM m FULL JOIN s ON m.id = s.id FULL JOIN t ON coalesce(m.id, s.id) = t.id) SELECT id, CASE WHEN s IS DISTINCT FROM m AND t IS DISTINCT FROM m AND s IS DISTINCT FROM t THEN s WHEN s IS DISTINCT FROM m THEN s ELSE t END AS value, s IS DISTINCT FROM m AND t IS DISTINCT FROM m AND s IS DISTINCT FROM t AS conflict FROM j")
def _(t):
    return E.merge_branches(_branches(t), "id", "value", "work", "hot", "main")


@query("vs_stash", f"SELECT id, value FROM {_BR} WHERE branch = 'work' UNION ALL SELECT id, value FROM {_BR} WHERE branch = 'main' AND id NOT IN (SELECT id FROM {_BR} WHERE branch = 'work')")
def _(t):
    b = _branches(t)
    stash = b.where("branch = 'work'").withColumn("branch", F.lit("stash/work"))  # set aside, then taken back
    back = b.where("branch <> 'work'").unionByName(stash).withColumn("branch", F.when(F.col("branch") == "stash/work", "work").otherwise(F.col("branch")))
    return E.on_branch(back, "id", "work").select("id", "value")


# graph analyses
@query("gr_kcore", f"WITH RECURSIVE u AS (SELECT DISTINCT src AS a, dst AS b FROM {EDGES} WHERE src <> dst UNION SELECT dst, src FROM {EDGES} WHERE src <> dst), r AS (SELECT 0 AS s, a, b FROM u UNION ALL SELECT s + 1, a, b FROM (SELECT s, a, b, count(*) OVER (PARTITION BY a) AS x, count(*) OVER (PARTITION BY b) AS y FROM r WHERE s < 100) WHERE x >= 2 AND y >= 2) SELECT DISTINCT a AS id FROM r WHERE s = 100")
def _(t):
    return G.k_core(_edges(t), 2)


@query("gr_all", f"WITH e AS (SELECT * FROM {EDGES}) SELECT id, sum(i)::BIGINT AS ins, sum(o)::BIGINT AS outs, true AS ranked FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id")
def _(t):
    m = G.centralities(_edges(t))
    ranked = F.col("pagerank").between(0, 1) & F.col("eigenvector").between(0, 1) & (F.col("betweenness") >= 0)
    return m.select("id", "ins", "outs", ranked.alias("ranked"))


_TREEISH = "(SELECT DISTINCT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0)"


@query("gr_dfs", f"WITH RECURSIVE e AS (SELECT * FROM {_TREEISH}), d AS (SELECT 0::BIGINT AS id, [0::BIGINT] AS path UNION ALL SELECT src, list_append(path, src) FROM d JOIN e ON dst = id AND src <> id) SELECT id, row_number() OVER (ORDER BY path) - 1 AS place, len(path)::INT - 1 AS depth FROM d")
def _(t):
    kids = t.part.where("p_partkey > 0").select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst"))
    return G.preorder(kids, 0)


@query("gr_relevance", f"""WITH RECURSIVE e AS (SELECT src, dst, w / 50.0::DOUBLE AS w, (dst % 10) / 10.0::DOUBLE AS v FROM {EDGES}),
r AS (SELECT x AS id, 1.0::DOUBLE AS s, 0 AS h FROM (SELECT unnest([1, 2, 3]::BIGINT[]) AS x) UNION ALL SELECT dst, s2, h + 1 FROM (SELECT dst, h, least(1, 0.9 * s + 0.1 * v + 0.2 * w) AS s2 FROM r JOIN e ON id = src WHERE h < 4) WHERE s2 >= 0.9) SELECT id, round(max(s), 6) AS score FROM r GROUP BY id""")
def _(t):
    e = _edges(t).select("src", "dst", (F.col("w") / 50).alias("w"), ((F.col("dst") % 10) / 10).alias("node"))
    return rounded(G.relevant(e, t.spark.createDataFrame([(1,), (2,), (3,)], "id long"), 4, 0.9))


@query("gr_astar", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT x AS start, x AS id, 0 AS cost, 0 AS h FROM (SELECT unnest([1, 2, 3]::BIGINT[]) AS x) UNION SELECT start, dst, cost + w, h + 1 FROM r JOIN e ON id = src WHERE h < 60) SELECT start, min(cost)::DOUBLE AS cost FROM r WHERE id = (SELECT max(id) FROM r r1 WHERE r1.start = r.start) GROUP BY start")
def _(t):
    e, s = _edges(t), t.spark.createDataFrame([(1,), (2,), (3,)], "id long")
    goals = G.k_hop(e, s, 60).groupBy("start").agg(F.max("id").alias("goal"))
    # a heuristic that never exceeds what is left: no step costs less than 1, and the goal itself is 0 away
    return G.astar(e, goals, "w", lambda node, goal: F.when(node == goal, 0.0).otherwise(1.0)).select("start", "cost")


_LEV = "CASE WHEN h = 1 THEN 1.0::DOUBLE ELSE 0.7 END * CASE w % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 ELSE 0.5 END * 0.9"


@query("gr_impact_typed", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT DISTINCT dst AS start, dst AS id, 0 AS h, 0 AS w FROM e UNION SELECT start, src, h + 1, e.w FROM r JOIN e ON id = dst WHERE h < 2), m AS (SELECT start, id, min(h) AS h FROM r WHERE h > 0 AND id <> start GROUP BY ALL), x AS (SELECT start, id, h, max({_LEV}) AS s FROM (SELECT DISTINCT r.start, r.id, r.h, r.w FROM r JOIN m USING (start, id, h)) GROUP BY ALL) SELECT start, count(*) AS n, round(least(1, sum(s) / count(*)), 6) AS impact FROM x GROUP BY start")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("OVERRIDES", "AMENDS", "REFERENCES"))), (F.col("w") % 3 + 1).cast("int"))
    e = _edges(t).select("src", "dst", kind.alias("type"), F.lit(0.9).alias("confidence"))
    return rounded(G.typed_impact(e, e.select(F.col("dst").alias("id")).distinct(), 2))


@query("gr_layout_grid", "SELECT c_custkey AS id, 100 + (i % c) * 50.0::DOUBLE AS x, 100 + (i // c) * 50.0::DOUBLE AS y FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, ceil(sqrt(count(*) OVER ()))::BIGINT AS c FROM customer)")
def _(t):
    return G.grid(t.customer.select(F.col("c_custkey").alias("id")), 50.0)


@query("gr_inf_type", "SELECT DISTINCT l_partkey AS src, o_custkey AS dst, 0.85::DOUBLE AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'N') AND NOT EXISTS (SELECT 1 FROM lineitem x JOIN orders y ON x.l_orderkey = y.o_orderkey WHERE x.l_returnflag = 'R' AND x.l_partkey = lineitem.l_partkey AND y.o_custkey = orders.o_custkey)")
def _(t):
    # an order is the document: it touches its customer's area and, unless the line was returned, defines its part's rule
    area = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("area"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("rule"), F.col("l_returnflag").alias("type"))
    known = lines.where("type = 'R'").join(area, "doc").select(F.col("rule").alias("src"), F.col("area").alias("dst")).distinct()
    return G.applies_to(area, lines, known, ("A", "N"))


@query("gr_xlink", "SELECT DISTINCT s_suppkey, page_id FROM (SELECT page_id, unnest(list_distinct(list_filter(string_split_regex(lower(html), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM pages) JOIN (SELECT s_suppkey, ['the', 'and', 'street', 'road', 'main'][s_suppkey % 5 + 1] AS name FROM supplier) ON w = name")
def _(t):
    name = F.element_at(F.array(*map(F.lit, ("the", "and", "street", "road", "main"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    words = F.array_distinct(F.filter(F.split(F.lower("html"), "[^a-z0-9]+"), lambda w: w != ""))
    return G.mentions(t.supplier.select(F.col("s_suppkey").alias("id"), name.alias("name")), t.pages.select(F.col("page_id").alias("page"), words.alias("words"))).select(F.col("id").alias("s_suppkey"), F.col("page").alias("page_id"))


@query("gr_change", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'added' WHEN c_custkey % 4 = 1 THEN 'updated' ELSE 'unchanged' END AS change, CASE WHEN c_custkey % 4 = 1 THEN 'title' ELSE '' END AS fields FROM customer WHERE c_custkey % 4 < 3 UNION ALL SELECT c_custkey, 'removed', '' FROM customer WHERE c_custkey % 4 = 3")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"))
    old = c.where("id % 4 <> 0")
    new = c.where("id % 4 <> 3").withColumn("title", F.when(F.col("id") % 4 == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return G.node_changes(old, new, "id", ["title", "kind"]).withColumn("fields", F.array_join("fields", ","))


@query("gr_infomap")
def _(t):
    return G.infomap(_edges(t))


@query("gr_leiden")
def _(t):
    return G.leiden(_edges(t))
