"""Queries of node tables, selectors and learned patterns over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import dom
from docmill.operators.dedup import cut
from docmill.plans.analytics import rounded
from docmill.plans.registry import query

#: What a scraper of these pages would look for.
SELECTORS = {"heading": "article > h1", "links": "nav ul li a", "second": "ul > li:nth-child(2) > a", "paragraphs": "//article//p", "ads": "div.ad", "titles": "/html/head/title"}


@query("pt_select")
def _(t):
    return dom.select_all(cut(dom.nodes(t.pages, "page_id", "html")), "page_id", SELECTORS).select("selector", "page_id", "node", "tag", "text")


@query("pt_validate", r"SELECT page_id, selector, position = -1 AS ok, position::INTEGER AS position FROM (SELECT page_id, selector, CASE page_id % 5 WHEN 0 THEN -1 WHEN 1 THEN length(host) + 4 WHEN 2 THEN 0 WHEN 3 THEN 7 ELSE -1 END AS position FROM (SELECT page_id, host, CASE page_id % 5 WHEN 0 THEN 'div#' || host || ' > a' WHEN 1 THEN 'div.' || host || '!b' WHEN 2 THEN '> ' || host WHEN 3 THEN '//div/a[2]' || host ELSE '//' || host || '[@id=' || chr(39) || page_id || chr(39) || ']/a' END AS selector FROM (SELECT page_id, 'h' || regexp_replace(lower(split_part(split_part(url, '//', 2), '/', 1)), '[^a-z0-9]', '', 'g') AS host FROM pages)))")
def _(t):
    host = F.concat(F.lit("h"), F.regexp_replace(F.lower(F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))), "[^a-z0-9]", ""))
    k, lit = F.col("page_id") % 5, F.lit
    s = F.when(k == 0, F.concat(lit("div#"), host, lit(" > a"))).when(k == 1, F.concat(lit("div."), host, lit("!b"))).when(k == 2, F.concat(lit("> "), host)).when(k == 3, F.concat(lit("//div/a[2]"), host))
    s = s.otherwise(F.concat(lit("//"), host, lit("[@id='"), F.col("page_id").cast("string"), lit("']/a")))
    return t.pages.select("page_id", s.alias("selector")).withColumn("p", dom.selector_problems(F.col("selector"))).select("page_id", "selector", "p.ok", "p.position")


# contexts are pages; a pattern was learned from the first page of each pair of host and first path segment, whose digits it leaves open
_CTX = r"(SELECT page_id AS id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain, CASE WHEN page_id % 4 = 0 THEN 'Timeout of page ' || page_id % 3 WHEN page_id % 4 = 1 THEN 'No element' END AS error, sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), ',')) AS structure FROM pages)"
_PAT = rf"(SELECT min(id) AS pattern, domain, min_by(regexp_replace(url, '[0-9]+', '[0-9]+', 'g'), id) AS url_pattern, min_by(struct_pack(e := CASE WHEN id % 2 = 0 THEN upper(error) ELSE error END), id).e AS error, min_by(structure, id) AS structure, 0.5 + (min(id) % 50) / 100.0::DOUBLE AS confidence FROM {_CTX} WHERE url NOT LIKE '%?%' GROUP BY domain, regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1))"
_SEG = "list_filter(string_split(regexp_extract({}, 'https?://[^/]+(/[^?#]*)', 1), '/'), lambda s: s <> '')"
_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query("pt_rank", rf"""WITH c AS MATERIALIZED (SELECT * FROM {_CTX}), p AS MATERIALIZED (SELECT * FROM {_PAT}),
j AS (SELECT c.id, p.pattern, c.url, p.url_pattern, c.error AS e, p.error AS pe, c.structure AS s, p.structure AS ps, confidence, c.domain = p.domain AS dom FROM c JOIN p ON c.domain = p.domain OR c.structure = p.structure OR lower(c.error) = lower(p.error)),
x AS (SELECT *, {_SEG.format('url')} AS a, {_SEG.format('url_pattern')} AS b, {_WORDS.format('e')} AS ew, {_WORDS.format('pe')} AS pw FROM j),
y AS (SELECT id, pattern, confidence, CASE WHEN regexp_matches(url, url_pattern) THEN 1 WHEN regexp_extract(url, 'https?://([^/?]+)', 1) = regexp_extract(url_pattern, 'https?://([^/?]+)', 1) THEN CASE WHEN greatest(len(a), len(b)) = 0 THEN 1 ELSE len(list_filter(range(1, len(a) + 1), lambda i: i <= len(b) AND (a[i] = b[i] OR contains(b[i], '*') OR contains(b[i], '+')))) / greatest(len(a), len(b))::DOUBLE END ELSE 0 END AS url_sim,
 CASE WHEN e IS NULL OR pe IS NULL THEN 0 WHEN e = pe THEN 1 WHEN lower(e) = lower(pe) THEN 0.9 ELSE len(list_filter(ew, lambda w: list_contains(pw, w))) / len(list_distinct(list_concat(ew, pw)))::DOUBLE END AS error_sim,
 CASE WHEN s = ps THEN 1 ELSE len(list_filter(range(1, 65), lambda i: s[i] = ps[i])) / 64.0::DOUBLE END AS structure_sim FROM x),
z AS (SELECT *, round(0.5 * url_sim + 0.2 * error_sim + 0.3 * structure_sim, 9) AS score FROM y)
SELECT id, pattern, round(url_sim, 6)::DOUBLE AS url_sim, round(error_sim, 6)::DOUBLE AS error_sim, round(structure_sim, 6)::DOUBLE AS structure_sim, round(score, 6)::DOUBLE AS score, round(confidence, 6)::DOUBLE AS confidence, row_number() OVER (PARTITION BY id ORDER BY score DESC, confidence DESC, pattern)::INTEGER AS rank FROM z WHERE score >= 0.3 QUALIFY rank <= 10""")
def _(t):
    k = F.col("page_id")
    error = F.when(k % 4 == 0, F.concat(F.lit("Timeout of page "), (k % 3).cast("string"))).when(k % 4 == 1, "No element")
    tags = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))), ",")
    c = t.pages.select(k.alias("id"), "url", F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("domain"), error.alias("error"), F.sha2(tags, 256).alias("structure"))
    c = cut(c)
    first = lambda x: F.min_by(x, "id")
    p = c.where("url NOT LIKE '%?%'").groupBy("domain", F.regexp_extract("url", "^https?://[^/?#]+/([^/?#]*)", 1).alias("_s")).agg(F.min("id").alias("pattern"), first(F.regexp_replace("url", "[0-9]+", "[0-9]+")).alias("url_pattern"), first(F.when(F.col("id") % 2 == 0, F.upper("error")).otherwise(F.col("error"))).alias("error"), first(F.col("structure")).alias("structure"))
    return rounded(dom.rank_patterns(c, p.withColumn("confidence", 0.5 + F.col("pattern") % 50 / 100), 0.3, 10))
