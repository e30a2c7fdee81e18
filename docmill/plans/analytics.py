"""Queries of the aggregation, window, paging, set and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import analytics as A
from docmill.plans.registry import query

R = lambda c, n=6: F.round(c, n)
_COUNTS = "SELECT item, count(*) FILTER (WHERE type = 'click') AS clicks, count(*) FILTER (WHERE type = 'accept') AS accepts, count(*) FILTER (WHERE type = 'reject') AS rejects, count(*) AS total FROM @interactions GROUP BY item"
_RATED = "SELECT item, avg(value) AS rating, count(*) FILTER (WHERE value >= 4) AS helpful, count(value) AS n FROM @interactions WHERE type = 'view' GROUP BY item"


def rounded(df, *keys):
    """Doubles to 6 places, so that the order of a sum doesn't show."""
    return df.select(*(R(F.col(c)).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def _rated(t):
    return A.ratings(t.interactions.where("type = 'view'"), "item", "value")


@query("agg_count_by", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def _(t):
    return A.count_by(t.documents, "source", "lang")


@query("agg_multi_key", "SELECT item, round(sum(value), 6) AS total, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT user_id) AS users FROM @interactions WHERE type = 'reject' GROUP BY item")
def _(t):
    return rounded(A.error_groups(t.interactions.where("type = 'reject'"), "item", "user_id", "value", "ts"))


@query("agg_cond", f"SELECT * FROM ({_COUNTS}) WHERE total >= 20")
def _(t):
    return A.interaction_counts(t.interactions, "item", 20)


@query("agg_avg", f"SELECT item, round(rating, 6) AS rating, helpful, n FROM ({_RATED})")
def _(t):
    return rounded(_rated(t))


@query("agg_doc_quality", f"""WITH c AS ({_COUNTS}), r AS ({_RATED}) SELECT item, round(greatest(0, least(1, 0.4 * CASE WHEN accepts + rejects > 0 THEN accepts / (accepts + rejects)::DOUBLE ELSE 0 END + 0.3 * coalesce(rating, 0) / 5
  + 0.2 * least(1, clicks / 10.0::DOUBLE) + 0.1 * (1 - CASE WHEN accepts + rejects > 0 THEN rejects / (accepts + rejects)::DOUBLE ELSE 0 END))), 6) AS quality FROM c LEFT JOIN r USING (item)""")
def _(t):
    return rounded(A.doc_quality(A.interaction_counts(t.interactions, "item"), _rated(t), "item"))


@query("agg_source_quality", f"""WITH c AS ({_COUNTS}), r AS ({_RATED}), g AS (SELECT source, sum(clicks) AS c, sum(accepts) AS a, sum(rejects) AS r, sum(total) AS t, avg(rating) AS rating, count(*) AS docs
  FROM documents d LEFT JOIN c ON d.doc_id = c.item LEFT JOIN r ON d.doc_id = r.item GROUP BY source)
SELECT source, docs, round(greatest(0, least(1, 0.4 * CASE WHEN coalesce(a + r, 0) > 0 THEN a / (a + r)::DOUBLE ELSE 0 END + 0.3 * coalesce(rating, 0) / 5 + 0.2 * CASE WHEN coalesce(t, 0) > 0 THEN least(c / t::DOUBLE, 1) ELSE 0 END
  + 0.1 * least(docs / 10.0::DOUBLE, 1))), 6) AS quality FROM g""")
def _(t):
    return rounded(A.source_quality(t.documents.withColumnRenamed("doc_id", "item"), A.interaction_counts(t.interactions, "item"), _rated(t), "item", "source"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("agg_term_importance", rf"""WITH w AS (SELECT unnest(string_split_regex(lower(text), '\s+')) AS term, quality * 5 AS rating, toxic = 0 AS ok FROM documents JOIN labels USING (doc_id)),
g AS (SELECT term, count(*) AS f, avg(rating) AS r, avg(ok::INT) AS a FROM w WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY term)
SELECT term, f, round(0.4 * least(1, f / 10.0::DOUBLE) + 0.3 * coalesce(r, 0) / 5 + 0.3 * coalesce(a, 0), 6) AS importance FROM g""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").select("text", (F.col("quality") * 5).alias("rating"), (F.col("toxic") == 0).alias("ok"))
    return rounded(A.term_importance(rows, "text", "rating", "ok"))


@query("agg_overall", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item) AS items, round(avg(value), 6) AS mean, count(*) FILTER (WHERE type = 'accept') AS accepts FROM @interactions")
def _(t):
    return rounded(t.interactions.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("item").alias("items"), F.avg("value").alias("mean"), F.count_if(F.col("type") == "accept").alias("accepts")))


@query("agg_unwind", "SELECT part, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS part FROM part) GROUP BY part")
def _(t):
    return A.count_by(t.part.select(F.explode(F.split("p_type", " ")).alias("part")), "part")


@query("agg_two_level", "SELECT type, sum(n)::BIGINT AS total, count(*) AS days, max(n) AS busiest FROM (SELECT type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM @interactions GROUP BY ALL) GROUP BY type")
def _(t):
    return A.two_level(t.interactions, "type", "ts").select("type", "total", F.size("trend").cast("long").alias("days"), F.array_max(F.transform("trend", lambda x: x["n"])).alias("busiest"))


@query("agg_nested_pattern", """
WITH d AS (SELECT type, item % 10 AS part, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM @interactions GROUP BY ALL) SELECT type, part, string_agg(day || ':' || n, ',' ORDER BY day) AS trend, sum(n)::BIGINT AS total FROM d GROUP BY type, part""")
def _(t):
    d = t.interactions.groupBy("type", (F.col("item") % 10).alias("part"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    trend = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: F.concat_ws(":", x["day"], x["n"].cast("string"))), ",")
    return d.groupBy("type", "part").agg(trend.alias("trend"), F.sum("n").alias("total"))


for _unit in ("hour", "day", "week", "month"):

    @query("agg_time_bucket" + ("" if _unit == "hour" else f"_{_unit}"), f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS bucket, count(*) AS n, round(sum(value), 6) AS total, min(ts) AS first FROM events GROUP BY 1")
    def _(t, unit=_unit):
        return rounded(A.time_buckets(t.events, "ts", unit, "value"))


@query("agg_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("agg_first_row", "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return A.first_row(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")


@query("agg_distinct", "SELECT count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents")
def _(t):
    return t.documents.agg(F.countDistinct("source").alias("sources"), F.countDistinct("text").alias("texts"), F.countDistinct("lang").alias("langs"))


@query("agg_dup_count", "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def _(t):
    return t.documents.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query("agg_domain", r"SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain, count(*) AS n FROM pages WHERE url LIKE 'http%' GROUP BY 1")
def _(t):
    return t.pages.where("url LIKE 'http%'").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("agg_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("agg_histogram", "SELECT least(floor(l_discount * 10 * 5), 4)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return A.histogram(t.lineitem.select((F.col("l_discount") * 10).alias("s")), "s")


@query("agg_report", "SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean, max(n_chars) AS longest FROM documents GROUP BY source")
def _(t):
    return rounded(t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean"), F.max("n_chars").alias("longest")))


@query("agg_percentile", "SELECT k_ AS k, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM (SELECT l_returnflag AS k_, l_extendedprice FROM lineitem) GROUP BY 1")
def _(t):
    return rounded(A.percentiles(t.lineitem.withColumnRenamed("l_returnflag", "k"), "k", "l_extendedprice"))


@query("agg_stats", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def _(t):
    return rounded(A.statistics(t.events, "event_type", "value"), "low", "high")


@query("agg_perf_ops", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(*) FILTER (WHERE value > 80) AS slow, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return A.nearest_rank(t.events, "event_type", "value", 80.0)


@query("agg_workflow_stats", "SELECT event_type, n, value AS p FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(floor(n * 0.95), n - 1)")
def _(t):
    return A.floor_index(t.events, "event_type", "value", 0.95)


@query("agg_workflow_cmp", """WITH m AS (SELECT event_type AS k, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1) SELECT a.k AS a, b.k AS b, round(b.mean - a.mean, 6) AS mean_delta, (b.n - a.n) AS n_delta FROM m a JOIN m b ON a.k < b.k""")
def _(t):
    m = t.events.groupBy(F.col("event_type").alias("k")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    x, y = m.alias("x"), m.alias("y")
    return x.join(y, F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), R(F.col("y.mean") - F.col("x.mean")).alias("mean_delta"), (F.col("y.n") - F.col("x.n")).alias("n_delta"))


@query("agg_ai_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value) * 0.002, 6) AS cost, round(avg((event_type = 'view')::INT), 6) AS hit_rate, round(avg((event_type = 'error')::INT), 6) AS error_rate, round(sum(value) * 0.0003, 6) AS carbon FROM events GROUP BY 1")
def _(t):
    share = lambda k: F.avg((F.col("event_type") == k).cast("int"))
    return rounded(t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.sum("value") * 0.002).alias("cost"), share("view").alias("hit_rate"), share("error").alias("error_rate"), (F.sum("value") * 0.0003).alias("carbon")))


@query("agg_linreg", """WITH d AS (SELECT date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, n FROM d), r AS (SELECT regr_slope(n, i) AS slope, regr_intercept(n, i) AS intercept, regr_r2(n, i) AS r2 FROM i)
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, CASE WHEN slope > 0.05 THEN 'up' WHEN slope < -0.05 THEN 'down' ELSE 'flat' END AS direction FROM r""")
def _(t):
    d = t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return rounded(A.linear_trend(d, "day", "n"))


@query("agg_counter", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failure FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failure"))


@query("agg_entity_counts", "SELECT r.r_name AS region, n.n_name AS nation, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY ALL")
def _(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


# joins
@query("jn_lookup_left", f"SELECT d.doc_id, coalesce(clicks, 0) AS clicks, coalesce(total, 0) AS total FROM documents d LEFT JOIN ({_COUNTS}) c ON d.doc_id = c.item")
def _(t):
    c = A.interaction_counts(t.interactions, "item").withColumnRenamed("item", "doc_id")
    return t.documents.select("doc_id").join(c, "doc_id", "left").select("doc_id", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("total", F.lit(0)).alias("total"))


@query("jn_hash_map", f"SELECT c.item, c.total, round(rating, 6) AS rating FROM ({_COUNTS}) c LEFT JOIN ({_RATED}) r ON c.item = r.item")
def _(t):
    return rounded(A.interaction_counts(t.interactions, "item").join(_rated(t), "item", "left").select("item", "total", "rating"))


@query("jn_full_outer", "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS errors FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.user_id = b.user_id")
def _(t):
    of = lambda k, n: t.events.where(F.col("event_type") == k).groupBy("user_id").agg(F.count("*").alias(n))
    return of("click", "clicks").join(of("error", "errors"), "user_id", "full_outer").select("user_id", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query("jn_semi", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(t):
    return t.embeddings.select("vec_id", "label").join(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query("jn_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("jn_anti_exist", "SELECT DISTINCT url FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def _(t):
    return t.pages.where("page_id % 2 = 1").select("url").join(t.pages.where("page_id % 2 = 0").select("url"), "url", "left_anti").dropDuplicates()


@query("jn_values", "SELECT n_name, v.w AS weight FROM nation JOIN (VALUES (0, 1.5::DOUBLE), (3, 2.5::DOUBLE)) v(k, w) ON n_regionkey = v.k")
def _(t):
    v = t.spark.createDataFrame([(0, 1.5), (3, 2.5)], "n_regionkey int, weight double")
    return t.nation.join(F.broadcast(v), "n_regionkey").select("n_name", "weight")


@query("jn_optional", "SELECT c_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    j = t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice")).withColumnsRenamed({"F": "f", "O": "o"})


@query("jn_asof_version", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY o_custkey")
def _(t):
    o = t.orders.where(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp"))
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"))


@query("jn_neighbor_counts", "SELECT k, direction, count(*) AS n FROM (SELECT n_regionkey AS k, 'in' AS direction FROM nation UNION ALL SELECT n_nationkey, 'out' FROM nation) GROUP BY ALL")
def _(t):
    return t.nation.select(F.col("n_regionkey").alias("k"), F.lit("in").alias("direction")).union(t.nation.select("n_nationkey", F.lit("out"))).groupBy("k", "direction").agg(F.count("*").alias("n"))


# windows, paging, sets
@query("win_rank", "SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part")
def _(t):
    return A.ranked(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@query("win_multi_rank", "SELECT s_suppkey, round((0.7 * s_acctbal + 0.3 * s_nationkey) / 1.0, 6) AS score, row_number() OVER (ORDER BY round((0.7 * s_acctbal + 0.3 * s_nationkey) / 1.0, 6) DESC, s_suppkey)::INT AS rank FROM supplier")
def _(t):
    w = {"s_acctbal": 0.7, "s_nationkey": -0.3}
    total = sum(map(abs, w.values()))
    score = R(sum(F.col(c) * abs(x) for c, x in w.items()) / total)
    return A.ranked(t.supplier.select("s_suppkey", score.alias("score")), "score", "s_suppkey")


@query("win_top_n_per_group", "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 3")
def _(t):
    return A.top_n_per_group(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 3)


@query("win_max_per_doc", "SELECT l_orderkey, max(l_extendedprice) AS best, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS line FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.max_by("l_linenumber", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"))).alias("line"))


@query("win_last_n", """WITH r AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), g AS (SELECT user_id, count(*) AS runs, avg(ok::INT) AS rate FROM r WHERE r <= 10 GROUP BY 1 HAVING count(*) >= 5)
SELECT user_id, runs, round(rate, 6) AS rate, CASE WHEN rate = 1 THEN 'stable' WHEN rate = 0 THEN 'failing' ELSE 'flaky' END AS status FROM g""")
def _(t):
    return rounded(A.flakes(t.events.select("user_id", "ts", "event_id", (F.col("event_type") != "error").cast("int").alias("ok")), "user_id", "ts", "ok", "event_id"))


@query("win_pct_split", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(count(*) OVER (PARTITION BY user_id) * 0.9::DOUBLE) AS cut FROM events), g AS (SELECT user_id, median(value) FILTER (WHERE i < cut) AS before, median(value) FILTER (WHERE i >= cut) AS after FROM r GROUP BY 1)
SELECT user_id, round(before, 6) AS before, round(after, 6) AS after, round((after - before) / before, 6) AS change, CASE WHEN (after - before) / before > 0.2 THEN 'slower' WHEN (after - before) / before < -0.2 THEN 'faster' ELSE 'stable' END AS status FROM g""")
def _(t):
    return rounded(A.drift(t.events, "user_id", "ts", "value", "event_id"))


@query("win_prev_next", "SELECT conv_id, turn, role, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    return A.prev_next(t.conversations, "conv_id", "turn", "role")


@query("win_period_compare", """WITH g AS (SELECT event_type, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS previous, avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-02-01') AS current FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT event_type, round(previous, 6) AS previous, round(current, 6) AS current, round(100 * (current - previous) / previous, 6) AS change_pct FROM g""")
def _(t):
    return rounded(A.period_compare(t.events, "event_type", "ts", "value", "2024-01-01", "2024-01-16", "2024-02-01"))


@query("win_minmax_norm", "SELECT source, doc_id, round(CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN (n_chars > 0)::INT::DOUBLE ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w)::DOUBLE END, 6) AS norm FROM documents WINDOW w AS (PARTITION BY source)")
def _(t):
    return rounded(A.min_max(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars").drop("n_chars"))


@query("win_review_trend", "WITH d AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, avg((event_type = 'purchase')::INT) AS rate FROM events GROUP BY 1) SELECT week, round(rate, 6) AS rate, round(rate - lag(rate) OVER (ORDER BY week), 6) AS change FROM d")
def _(t):
    d = t.events.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.avg((F.col("event_type") == "purchase").cast("int")).alias("rate"))
    return rounded(d.withColumn("change", F.col("rate") - F.lag("rate").over(A.Window.orderBy("week"))))


@query("srt_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 40 AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def _(t):
    return A.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20, 20)


@query("set_union_sources", "WITH u AS (SELECT text, doc_id, 0 AS seq FROM documents WHERE lang = 'en' UNION ALL SELECT text, doc_id, 1 FROM documents WHERE source = 'src0') SELECT text, doc_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq, doc_id) AS r FROM u) WHERE r = 1")
def _(t):
    d = t.documents.select("text", "doc_id", "lang", "source")
    return A.union_in_order([d.where("lang = 'en'").select("text", "doc_id"), d.where("source = 'src0'").select("text", "doc_id")], "text", "doc_id")


@query("set_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def _(t):
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("set_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'modified' ELSE 'same' END AS change FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k")
def _(t):
    p = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return A.set_difference(p.where("k % 3 <> 0"), p.where("k % 5 <> 0").withColumn("v", F.when(F.col("v") > 25, F.col("v") + 1).otherwise(F.col("v"))), "k", "v")


@query("set_distinct_terms", r"SELECT item_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS terms FROM (SELECT item_id, string_split_regex(lower(text), '\s+') AS w FROM benchmark)")
def _(t):
    return t.benchmark.select("item_id", F.array_join(F.array_distinct(F.split(F.lower("text"), r"\s+")), " ").alias("terms"))


@query("set_evidence_union", """WITH a AS (SELECT l_orderkey, l_linenumber AS n, max(l_discount * 5) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
SELECT l_orderkey, round(list_reduce(list(s ORDER BY n), lambda x, y: least(1, greatest(x, y) * 1.1)), 6) AS s FROM a GROUP BY l_orderkey""")
def _(t):
    step = lambda i: t.lineitem.where(F.col("l_linenumber") == i).groupBy("l_orderkey").agg(F.max(F.col("l_discount") * 5).alias("s"))
    return rounded(A.evidence_union([step(1), step(2), step(3)], "l_orderkey", "s"))


@query("sm_top", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("sm_bottom", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def _(t):
    return t.documents.select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(25)


@query("sm_random")
def _(t):
    return A.sample_random(t.documents.select("doc_id", "source"), "doc_id", 50)


@query("sm_stratified", "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, (SELECT count(DISTINCT source) FROM documents) AS g FROM documents) SELECT doc_id, source, n_chars FROM r ORDER BY (r > floor(50 / g))::INT, n_chars DESC, doc_id LIMIT 50")
def _(t):
    return A.sample_stratified(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 50)
