"""Queries of the scalar functions, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.plans.analytics import R, rounded
from docmill.plans.registry import query

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _norm(c: str) -> str:
    out = _TRIM.format(c)
    for p, to in ((r"\r\n", r"\n"), (r"\r", r"\n"), (r"[ \t]+", " "), (r"\n\s+", r"\n"), (r"\s+\n", r"\n"), (r"\n{3,}", r"\n\n")):
        out = f"regexp_replace({out}, '{p}', E'{to}', 'g')"
    return out


AS_OF = "2024-02-01"
_AT = "TIMESTAMP '2024-02-01'"
_DAYS = f"(epoch_us({_AT}) - epoch_us({{}})) / 86400000000.0::DOUBLE"
_SQUASH = r"regexp_replace(lower(" + _TRIM + r"), '\s+', ' ', 'g')"

for _name, _col, _sql in (
    ("fn_norm_text", lambda: T.norm_text(F.col("text")), _norm("text")),
    ("fn_sha256", lambda: T.fingerprint(F.col("text")), f"sha256({_norm('text')})"),
    ("fn_chunk_id", lambda: T.chunk_id(F.col("doc_id"), F.lit("v1"), F.lit(0), F.col("text")), f"doc_id || ':v1:0:' || substr(sha256({_norm('text')}), 1, 16)"),
    ("fn_content_hash", lambda: T.content_hash(F.col("title"), F.col("lang"), F.col("source")), f"sha256({_TRIM.format('title')} || '|' || lang || '|' || source)"),
    ("fn_norm_title", lambda: T.norm_title(F.col("title")), _TRIM.format(r"regexp_replace(" + _SQUASH.format("title") + r", '[^\w\s-]', '', 'g')")),
    ("fn_stable_id", lambda: T.stable_id(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit(""), F.col("source")), "CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END"),
    ("fn_query_terms", lambda: F.array_join(T.query_terms(F.col("title")), "|"), r"array_to_string(list_filter(string_split_regex(lower(title), '\s+'), lambda w: length(w) > 2), '|')"),
    ("fn_stopwords", lambda: F.array_join(T.without_stopwords(F.split(F.lower("title"), r"\s+")), " "), r"array_to_string(list_filter(string_split_regex(lower(title), '\s+'), lambda w: NOT w IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")), ' ')"),
    ("fn_type_pref", lambda: T.lookup(F.element_at(F.array(*map(F.lit, ["Nota", "Besluit", "Other"])), (F.col("doc_id") % 3 + 1).cast("int")), T.TYPE_PREFERENCE), "CASE doc_id % 3 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.85 ELSE 0.5 END"),
    ("fn_authority", lambda: T.authority(F.when(F.col("doc_id") % 4 == 0, "DSO").otherwise("none"), F.when(F.col("doc_id") % 4 == 1, "Gemeente X").when(F.col("doc_id") % 4 == 2, "Provincie Y")), "CASE doc_id % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 ELSE 0.5 END"),
    ("fn_snippet", lambda: T.snippet(F.col("text"), F.lit("and")), "CASE WHEN greatest(position('and' IN lower(text)) - 51, 0) > 0 THEN '...' ELSE '' END || substr(text, greatest(position('and' IN lower(text)) - 51, 0) + 1, 200) || CASE WHEN greatest(position('and' IN lower(text)) - 51, 0) + 200 < length(text) THEN '...' ELSE '' END"),
    ("fn_error_norm", lambda: T.error_norm(F.concat(F.lit("Error '"), F.col("doc_id"), F.lit("'  at "), F.col("source"))), "'Error N at ' || regexp_replace(source, '[0-9]+', 'N', 'g')"),
    ("fn_error_category", lambda: T.error_category(F.col("title")), "CASE WHEN regexp_matches(lower(title), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(title), 'network|econn|socket|dns') THEN 'network' WHEN regexp_matches(lower(title), 'assert|expect') THEN 'assertion' WHEN regexp_matches(lower(title), 'mongo|sql|database|query') THEN 'database' WHEN regexp_matches(lower(title), 'unauthori|forbidden|401|403') THEN 'auth' WHEN regexp_matches(lower(title), 'syntax|unexpected token|parse') THEN 'syntax' ELSE 'unknown' END"),
    ("fn_date_parse", lambda: T.parse_date(F.concat((F.col("doc_id") % 28 + 1).cast("string"), F.lit(" maart 2021"))).cast("string"), "make_date(2021, 3, (doc_id % 28 + 1)::INT)::VARCHAR"),
    ("fn_municipality", lambda: T.municipality(F.concat(F.lit(" Gemeente  's-"), F.col("source"))), "'s ' || lower(source)"),
    ("fn_token_est", lambda: T.token_estimate(F.col("text")), "ceil(length(text) * 0.25)::BIGINT"),
    ("tx_preprocess", lambda: T.preprocess(F.col("text")), _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\d),(\d)', '\1.\2', 'g'), '[“”„]', chr(34), 'g'), '[‘’]', '''', 'g'), '\.{2,}', '.', 'g'), '\s+', ' ', 'g')")),
    ("tx_embed_text", lambda: F.regexp_replace(F.substring(F.concat_ws("\n", "title", "text"), 1, 500), r"\s+\S*\z", ""), r"regexp_replace(substr(title || chr(10) || text, 1, 500), '\s+\S*\z', '')"),
):

    @query(_name, f"SELECT doc_id, {_sql} AS out FROM @titled")
    def _(t, col=_col):
        return t.titled.select("doc_id", col().alias("out"))


_RECENT = {
    "fn_recency_exp": (T.recency_exp, "exp(-d / 365)"),
    "fn_recency_pw": (T.recency_piecewise, "CASE WHEN d < 0 THEN 1 WHEN d <= 365 THEN 1 - 0.5 * d / 365 WHEN d <= 3650 THEN 0.5 * (1 - (d - 365) / 3285) ELSE 0 END"),
    "fn_recency_step": (T.recency_step, "CASE WHEN d < 0 THEN 0 WHEN d / 365 < 1 THEN 1 WHEN d / 365 < 2 THEN 0.7::DOUBLE WHEN d / 365 < 5 THEN 0.4 ELSE 0.1 END"),
    "fn_recency_linear": (T.recency_linear, "greatest(0, 1 - d / 365)"),
}
for _name, (_f, _sql) in _RECENT.items():

    @query(_name, f"SELECT o_orderkey, round({_sql}, 6) AS out FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '1998-09-01') - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS d FROM orders)")
    def _(t, f=_f):
        return t.orders.select("o_orderkey", R(f(F.col("o_orderdate"), F.lit("1998-09-01"))).alias("out"))


_PAIRS = "(SELECT a.doc_id, a.title AS x, b.title AS y FROM @titled a JOIN @titled b ON a.doc_id + 1 = b.doc_id)"
_SET = r"list_distinct(list_filter(string_split_regex(lower(" + _TRIM + r"), '\s+'), lambda w: w <> ''))"


def _pairs(t):
    a, b = t.titled.select("doc_id", F.col("title").alias("x")), t.titled.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("y"))
    return a.join(b, "doc_id")


def _jac(a: str, b: str, empty: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


@query("fn_jaccard_tokens", f"SELECT doc_id, round(CASE WHEN lower({_TRIM.format('x')}) = lower({_TRIM.format('y')}) THEN (x <> '')::INT ELSE {_jac(_SET.format('x'), _SET.format('y'), '0')} END, 6) AS out FROM {_PAIRS}")
def _(t):
    return _pairs(t).select("doc_id", R(T.jaccard_tokens(F.col("x"), F.col("y"))).alias("out"))


_CLEAN = r"regexp_replace({}, '[^\w\s]', ' ', 'g')"


@query("fn_jaccard_arr", f"SELECT doc_id, round({_jac(_SET.format(_CLEAN.format('x')), _SET.format(_CLEAN.format('y')), '1')}, 6) AS out FROM {_PAIRS}")
def _(t):
    return _pairs(t).select("doc_id", R(T.jaccard_arr(F.col("x"), F.col("y"))).alias("out"))


@query("tx_kb_sim", f"SELECT doc_id, round({_jac(f'list_filter({_SET.format(chr(120))}, lambda w: length(w) > 2)', f'list_filter({_SET.format(chr(121))}, lambda w: length(w) > 2)', '1')}, 6) AS out FROM {_PAIRS}")
def _(t):
    long = lambda c: F.filter(T.tokens(F.col(c)), lambda w: F.length(w) > 2)
    return _pairs(t).select("doc_id", R(T.jaccard(long("x"), long("y"), 1.0)).alias("out"))


@query("fn_levenshtein_sim", f"SELECT doc_id, round(CASE WHEN x = y THEN 1 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE END, 6) AS out FROM (SELECT c_custkey AS doc_id, lower(c_name) AS x, lower(c_mktsegment) AS y FROM customer)")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("doc_id"), R(T.levenshtein_sim(F.col("c_name"), F.col("c_mktsegment"))).alias("out"))


@query("fn_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS out FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def _(t):
    a, b = t.embeddings.select("vec_id", F.col("embedding").alias("x")), t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", R(T.cosine(F.col("x"), F.col("y"))).alias("out"))


@query("fn_entropy", "SELECT user_id, round(-sum(p * log2(p)), 6) AS out FROM (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)) GROUP BY user_id")
def _(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("p"))
    return g.select("user_id", R(T.entropy(F.col("p"))).alias("out"))


_T = "(1 / (1 + 0.3275911::DOUBLE * x))"


@query("fn_normal_cdf", f"SELECT event_id, round(0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429::DOUBLE * {_T} - 1.453152027) * {_T} + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T}) * exp(-x * x))), 6) AS out FROM (SELECT event_id, (value - 50) / 25 AS z, abs((value - 50) / 25) / sqrt(2::DOUBLE) AS x FROM events)")
def _(t):
    return t.events.select("event_id", R(T.normal_cdf((F.col("value") - 50) / 25)).alias("out"))


@query("fn_norm_url", r"SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) || regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/$', '') || '?a=1&b=2#h' AS out FROM pages WHERE url NOT LIKE '%?%' AND url NOT LIKE '%#%'")
def _(t):
    p = t.pages.where("url NOT LIKE '%?%' AND url NOT LIKE '%#%'")
    return p.select("page_id", T.norm_url(F.concat("url", F.lit("?b=2&utm_source=x&a=1#h"))).alias("out"))


@query("fn_norm_url_eval", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '#.*$', ''), '/$', '') AS out FROM pages")
def _(t):
    return t.pages.select("page_id", T.norm_url_eval(F.col("url")).alias("out"))


_REG = "https://omgevingswet.overheid.nl/"
_FORMS = ("https://service.omgevingswet.overheid.nl/publiek/v7/documenten/_akn_nl_act_{}?x=1", "https://omgevingswet.overheid.nl/document/NL.IMRO.{}", "https://omgevingswet.overheid.nl/regels-op-de-kaart/documenten/{}", "https://omgevingswet.overheid.nl/", "https://host.nl/api/v1/akn/nl/act/{}", "https://elsewhere.nl/{}", "https://host.nl/api/v1/NL.IMRO.{}/text")
_SHOWN = ("'_akn_nl_act_' || page_id", "'NL.IMRO.' || page_id", "page_id", "'id' || page_id", "'_akn_nl_act_' || page_id", "'id' || page_id", "'NL.IMRO.' || page_id")


@query("fn_dso_url", "SELECT page_id, '" + _REG + "regels-op-de-kaart/documenten/' || CASE page_id % 7 " + " ".join(f"WHEN {i} THEN ({x})::VARCHAR" for i, x in enumerate(_SHOWN)) + " END AS out FROM pages")
def _(t):
    parts = F.array(*(F.concat(F.lit(f.split("{}")[0]), F.col("page_id").cast("string") if "{}" in f else F.lit(""), F.lit(f.partition("{}")[2])) for f in _FORMS))
    url = F.element_at(parts, (F.col("page_id") % 7 + 1).cast("int"))
    return t.pages.select("page_id", T.public_url(url, F.concat(F.lit("id"), "page_id")).alias("out"))


@query("fn_domain", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain, CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages")
def _(t):
    return t.pages.select("page_id", T.domain(F.col("url")).alias("domain"), T.url_path(F.col("url")).alias("path"))


@query("fn_json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("src_html", r"SELECT page_id, " + _TRIM.format(r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g')") + " AS out FROM pages")
def _(t):
    return t.pages.select("page_id", T.strip_html(F.col("html")).alias("out"))


# filters and projections
@query("flt_doc", "SELECT doc_id, source, lang FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang = 'en' AND n_chars BETWEEN 500 AND 5000")
def _(t):
    return t.documents.where(F.col("source").isin("src0", "src1", "src2") & (F.col("lang") == "en") & F.col("n_chars").between(500, 5000)).select("doc_id", "source", "lang")


_VALID = "SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate + INTERVAL 90 DAY END AS valid_to FROM lineitem)"


def _validity(t):
    return t.lineitem.withColumn("valid_to", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")))


@query("flt_valid_overlap", _VALID + " WHERE (valid_to >= TIMESTAMP '1995-01-01' OR valid_to IS NULL) AND l_shipdate <= TIMESTAMP '1995-06-01'")
def _(t):
    v = _validity(t)
    return v.where(((F.col("valid_to") >= F.lit("1995-01-01").cast("timestamp")) | F.col("valid_to").isNull()) & (F.col("l_shipdate") <= F.lit("1995-06-01").cast("timestamp"))).select("l_orderkey", "l_linenumber")


@query("flt_temporal", _VALID + " WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND valid_to <= TIMESTAMP '1995-06-01'")
def _(t):
    return _validity(t).where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("valid_to") <= F.lit("1995-06-01").cast("timestamp"))).select("l_orderkey", "l_linenumber")


@query("flt_location", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'an')")
def _(t):
    place = F.regexp_replace(F.lower(F.concat(F.lit("Gemeente "), F.col("n_name"))), T.JURISDICTION_PREFIX, "")
    return t.nation.where(F.contains(place, F.lit("an"))).select("n_nationkey")


@query("flt_jurisdiction", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'land|national') THEN 'national' WHEN regexp_matches(lower(text), 'region|provinc') THEN 'regional' ELSE 'local' END AS level FROM documents")
def _(t):
    x = F.lower("text")
    return t.documents.select("doc_id", F.when(x.rlike("land|national"), "national").when(x.rlike("region|provinc"), "regional").otherwise("local").alias("level"))


@query("flt_area", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 7)")
def _(t):
    return t.customer.where(F.col("c_nationkey").isin(1, 5, 7)).select("c_custkey")


@query("flt_metadata", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(lower(p_type), ' '), lambda x: contains(x, 'steel') OR contains('steel', x))) > 0 AND p_size >= 10")
def _(t):
    both = lambda x: F.contains(x, F.lit("steel")) | F.contains(F.lit("steel"), x)
    return t.part.where(F.exists(F.split(F.lower("p_type"), " "), both) & (F.col("p_size") >= 10)).select("p_partkey")


@query("flt_geo_box", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15")
def _(t):
    # boxes (x0, x1, y0, y1) of points overlap the query box
    from docmill.operators import spatial

    b = t.customer.select("c_custkey", *(F.col("c_acctbal").alias(c) for c in ("x0", "x1")), *(F.col("c_nationkey").alias(c) for c in ("y0", "y1")))
    return b.where(spatial.overlaps((0, 5000, 5, 15))).select("c_custkey")


@query("flt_regex_or", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)ouble|there|licen')")
def _(t):
    words = [w for w in "of ouble there licen".split() if len(w) > 2]
    return t.documents.where(F.col("text").rlike("(?i)" + "|".join(rf"\Q{w}\E" for w in words))).select("doc_id")


@query("flt_condition", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50 AND event_type <> 'error' OR value < 5")
def _(t):
    from docmill.operators import guard

    e = t.events.withColumn("props", F.from_json("props", "k long"))
    return e.where(guard.condition("props.k > 50 and event_type != 'error' or value < 5", e.columns)).select("event_id")


@query("flt_threshold", "SELECT vec_id FROM embeddings WHERE embedding[1] >= 0.1")
def _(t):
    return t.embeddings.where(F.element_at("embedding", 1) >= 0.1).select("vec_id")


@query("flt_branch", "SELECT branch, id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch = 'main') AS r FROM (SELECT 'main' AS branch, p_partkey AS id, p_size AS value FROM part UNION ALL SELECT 'work', p_partkey, p_size + 1 FROM part WHERE p_size > 40 UNION ALL SELECT 'other', p_partkey, 0 FROM part) WHERE branch IN ('work', 'main')) WHERE r = 1")
def _(t):
    from docmill.operators import entities as E

    rows = lambda b, v, p: p.select(F.lit(b).alias("branch"), F.col("p_partkey").alias("id"), v.alias("value"))
    every = rows("main", F.col("p_size"), t.part).unionByName(rows("work", F.col("p_size") + 1, t.part.where("p_size > 40"))).unionByName(rows("other", F.lit(0), t.part))
    return E.on_branch(every, "id", "work")


@query("prj_flatten", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS item, value AS score FROM events")
def _(t):
    return t.events.withColumn("p", F.from_json("props", "k long")).select("event_id", F.col("p.k").alias("item"), F.col("value").alias("score"))


@query("prj_legacy", "SELECT doc_id AS id, title AS titel, source AS website_url, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) ELSE text END AS samenvatting FROM @titled")
def _(t):
    return t.titled.select(F.col("doc_id").alias("id"), F.col("title").alias("titel"), F.col("source").alias("website_url"), F.substring("text", 1, 300).alias("samenvatting"))


_CAT = "CASE WHEN source = 'src1' THEN 'jurisprudence' WHEN source = 'src2' THEN 'guidance' WHEN lang = 'de' THEN 'official_publication' WHEN lang IN ('en', 'fr') THEN 'policy' ELSE 'unverified_external' END"


def category(source, family, guidance):
    """The category of a document: order matters."""
    return F.when(source == "Rechtspraak", "jurisprudence").when(guidance, "guidance").when(family == "Juridisch", "official_publication").when(family.isin("Beleid", "Omgevingsinstrument", "Geo"), "policy").otherwise("unverified_external")


def _categorized(t):
    family = F.when(F.col("lang") == "de", "Juridisch").when(F.col("lang").isin("en", "fr"), "Beleid").otherwise("Web")
    return t.documents.withColumn("category", category(F.when(F.col("source") == "src1", "Rechtspraak").otherwise("Web"), family, F.col("source") == "src2"))


@query("prj_category", f"SELECT doc_id, {_CAT} AS category FROM documents")
def _(t):
    return _categorized(t).select("doc_id", "category")


@query("dp_categorize", f"SELECT category, lang, count(*) AS n FROM (SELECT *, {_CAT} AS category FROM documents) GROUP BY ALL")
def _(t):
    return _categorized(t).groupBy("category", "lang").agg(F.count("*").alias("n"))


@query("dp_normalize", f"SELECT doc_id, {_TRIM.format(r'regexp_replace(' + _SQUASH.format('title') + r', ' + chr(39) + r'[^\w\s-]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS norm_title, sha256({_norm('text')}) AS stable_id FROM @titled")
def _(t):
    return t.titled.select("doc_id", T.norm_title(F.col("title")).alias("norm_title"), T.stable_id(T.fingerprint(F.col("text")), F.lit(""), F.col("source")).alias("stable_id"))


@query("sc_keyword", r"""WITH w AS (SELECT unnest(['the', 'than', 'licensed']) AS w) SELECT doc_id, round(0.6 * sum(contains(lower(title), w)::INT) / 3.0::DOUBLE + 0.4 * sum(contains(lower(text), w)::INT) / 3.0::DOUBLE, 6) AS score FROM @titled, w GROUP BY doc_id""")
def _(t):
    from docmill.operators import scoring

    return rounded(t.titled.select("doc_id", scoring.keyword(F.col("title"), F.col("text"), ["the", "than", "licensed"]).alias("score")))
