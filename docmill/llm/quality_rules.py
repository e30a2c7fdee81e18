"""Quality rules whose cutoffs are certified on labelled documents, in DataFrame functions alone.

Each rule rejects documents whose measure exceeds a cutoff. In each stratum (language) the pairs of a rule and a candidate cutoff are put
in one order, from harmless to harmful, and tested jointly: step j rejects what any of the first j pairs rejects. A quarter of the good
labelled documents (by a digest of the doc_id) and the labelled bad ones set the order; the other good ones, n of a stratum, certify.
If the steps up to j rejected good documents at a rate above ``risk``, their k or fewer rejections would be seen with a probability of
at most P(Binomial(n, risk) <= k), an exact p-value. The steps are tested in their order, each at ``delta`` over the number of strata
(Bonferroni over these), up to the first that isn't certified: a fixed sequence, which needs no correction over the steps, as the
documents that certify had no say in it. So with a probability of 1 - delta the rules together reject no more than ``risk`` of the
good documents that pass the base rule, in every stratum. A stratum needs some 440 good documents that certify (four strata, the
defaults); below that its rules are off. A pair is used only if its share of the bad documents is above its share of the good ones that
order, these counted one higher, so that chance alone finds no use in a pair; without bad documents nothing is rejected. The fixed base
rule stands apart: it is no part of this guarantee.

Defined cases: a null or empty text has no words and fails the base rule; a null language is a stratum of its own; a doc_id with
several labels is good if all say so, else bad; null labels don't count; empty tables give no rows; no other column matters; a very
long text becomes one row of counts, within that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import common

RISK, DELTA = 0.01, 0.05
#: Rule: (measure as SQL over the counts, candidate cutoffs from strict to lax). Fixed values, parameters of the operator.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1L)", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1L)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / greatest(n_words, 1L)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "long_words": ("word_chars / greatest(n_words, 1L)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0)),
    "short_words": ("-word_chars / greatest(n_words, 1L)", (-4.5, -4.0, -3.5, -3.0, -2.5)),
}


def metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """The row's ``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long).

    Three-word windows are compared by a 64-bit hash within one text; only texts in which a window recurs are sorted.
    """
    blank = common.WORD.replace("^", "").rstrip("+")
    text, bare = F.coalesce(F.col("text"), F.lit("")), F.col("_bare")
    d = docs.select(*keep, text.alias("_text")).withColumn("_bare", F.btrim("_text", F.lit(common.SPACE)))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, blank + "+"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != "")
    d = d.select(*keep, words.alias("_w"), lines.alias("_l"), F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    long: Column = lambda c: c.cast("long")
    d = d.select(
        *keep,
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        "n_symbols",
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(F.size("_l")).alias("n_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    counts = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    some = F.when(F.size("_h") >= 3, F.slice("_h", 1, F.size("_h") - 2)).otherwise(F.array().cast("array<bigint>"))
    d = d.select(*counts, F.transform(some, lambda x, i: F.xxhash64(x, F.col("_h")[i + 1], F.col("_h")[i + 2])).alias("_win"))
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    d = d.select(*counts, F.when(twice, F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_s"))
    s, n = F.col("_s"), F.size("_s")
    again = F.filter(s, lambda e, i: F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]["x"] == e["x"]).otherwise(False) | F.when(i < n - 1, s[F.least(i + 1, n - 1)]["x"] == e["x"]).otherwise(False))
    # filter's second argument is the place in the sorted array
    d = d.select(*counts, F.when(s.isNotNull(), F.sort_array(F.transform(again, lambda e: e["i"]))).alias("_p"))
    p, m = F.col("_p"), F.size("_p")
    gaps = F.transform(p, lambda a, i: F.when(i < m - 1, F.least(F.lit(3), p[F.least(i + 1, m - 1)] - a)).otherwise(3))
    total = F.when(p.isNotNull(), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)
    return d.select(*counts, total.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    return {r: F.expr(f"CAST({m} AS DOUBLE)") for r, (m, _) in RULES.items()}


def _tests() -> list[tuple[str, float]]:
    return [(r, c) for r, (_, cs) in RULES.items() for c in cs]


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one column a rule): the strictest certified cutoff, or null. ``measured`` has doc_id, the stratum and the counts."""
    tests = _tests()
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("_good"))
    orders = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "4"
    measures = _measures()
    hit = F.array(*(measures[r] > c for r, c in tests))
    held = common.written(measured.where(~base_failed()).join(marked, "doc_id").select(F.col(stratum).alias("_of"), "_good", orders.alias("_orders"), hit.alias("_hit")), "rules-held")
    good, first = F.col("_good"), F.col("_orders")
    each = F.array(*(F.struct(F.count_if(good & first & F.col("_hit")[i]).alias("ko"), F.count_if(~good & F.col("_hit")[i]).alias("kb"), F.lit(-i).alias("i")) for i in range(len(tests))))
    seen = held.groupBy("_of").agg(F.count_if(good & ~first).alias("n"), F.count_if(good & first).alias("n_orders"), F.count_if(~good).alias("n_bad"), each.alias("_each"))
    useful = F.filter("_each", lambda e: e["kb"] * F.col("n_orders") > (e["ko"] + 1) * F.col("n_bad"))
    made = seen.select(F.count("*").alias("_made"))
    path = F.transform(F.sort_array(useful), lambda e: -e["i"]).alias("_path")
    paths = common.written(seen.join(F.broadcast(made), F.lit(True)).select("_of", "n", "_made", path), "rules-paths")  # one row is broadcast
    step = F.array_min(F.transform("_path", lambda i, j: F.when(F.col("_hit")[i], j)))
    steps = held.where(good & ~first).join(paths.select(F.col("_of").alias("_s"), "_path"), F.col("_of").eqNullSafe(F.col("_s"))).select("_of", step.alias("_step"))
    counts = steps.groupBy(F.col("_of").alias("_s")).agg(F.array(*(F.count_if(F.col("_step") <= j) for j in range(len(tests)))).alias("_k"))
    tail = f"""CASE WHEN k >= n * {risk}D THEN 1D ELSE aggregate(sequence(0L, k), named_struct('lp', n * ln(1 - {risk}D), 'acc', 0D),
        (s, i) -> named_struct('lp', s.lp + ln(CAST(n - i AS DOUBLE) / (i + 1)) + ln({risk}D / (1 - {risk}D)), 'acc', s.acc + exp(s.lp)), s -> s.acc) END"""
    passed = F.expr(f"size(filter(slice(_k, 1, size(_path)), k -> {tail} <= {delta}D / _made))").alias("_passed")  # k grows with the step
    done = paths.join(counts, F.col("_of").eqNullSafe(F.col("_s"))).select("_of", "_path", passed)
    done = done.select("_of", F.slice("_path", F.lit(1), F.col("_passed")).alias("_in"))
    best = (F.array_min(F.array(*(F.when(F.array_contains("_in", i), F.lit(c)) for i, (q, c) in enumerate(tests) if q == r))).alias(r) for r in RULES)
    return done.select(F.col("_of").alias(stratum), *best)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) of each document."""
    measured = common.written(metrics(docs, "doc_id", stratum), "rules-measured")
    cuts = common.written(cutoffs(measured, labels, stratum, **options), "rules-cutoffs").select(F.col(stratum).alias("_s"), *(F.col(r).alias(f"_{r}") for r in RULES))
    both = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    broken = F.filter(F.array(*(F.when(m > F.col(f"_{r}"), F.lit(r)) for r, m in _measures().items())), lambda x: x.isNotNull())
    out = both.withColumn("failed", broken).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept; the verdict depends on text and stratum, so it is found once more beside each row."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # whatever the columns are called
    measured = common.written(metrics(docs.select("doc_id", stratum, "text", row), "doc_id", stratum, "_row"), "rules-measured")
    cuts = common.written(cutoffs(measured, labels, stratum, **options), "rules-cutoffs").select(F.col(stratum).alias("_s"), *(F.col(r).alias(f"_{r}") for r in RULES))
    ok = ~base_failed()
    for r, m in _measures().items():
        ok = ok & ~F.coalesce(m > F.col(f"_{r}"), F.lit(False))
    kept = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("_s")), "left").where(ok)
    return kept.select("_row.*")


def oracle() -> str:
    """The same in DuckDB's SQL over ``documents`` and ``labels``, with the binomial tail by log-gamma."""
    sql = {r: m.replace("1L", "1") for r, (m, _) in RULES.items()}
    tests = _tests()
    hits = ", ".join(f"({sql[r]})::DOUBLE > {c}" for r, c in tests)
    names, values = ", ".join(f"'{r}'" for r, _ in tests), ", ".join(f"{c}::DOUBLE" for _, c in tests)
    wide = ", ".join(f"min(([{values}])[i]) FILTER (WHERE ([{names}])[i] = '{r}') AS c_{r}" for r in RULES)
    fails = " OR ".join(f"coalesce(({m})::DOUBLE > c_{r}, false)" for r, m in sql.items())
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
key AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM key) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
held AS (SELECT m.*, good, substr(md5(doc_id::VARCHAR), 1, 1) < '4' AS ord, row_number() OVER () AS r FROM m
  JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
tot AS (SELECT lang, count(*) FILTER (WHERE good AND NOT ord) AS n, count(*) FILTER (WHERE good AND ord) AS n_ord, count(*) FILTER (WHERE NOT good) AS n_bad FROM held GROUP BY lang),
hit AS (SELECT lang, r, good, ord, unnest(range(1, {len(tests)} + 1)) AS i, unnest([{hits}]) AS hit FROM held),
pair AS (SELECT lang, i, count(*) FILTER (WHERE hit AND good AND ord) AS ko, count(*) FILTER (WHERE hit AND NOT good) AS kb FROM hit GROUP BY lang, i),
path AS (SELECT pair.lang, i, n, row_number() OVER (PARTITION BY pair.lang ORDER BY ko, kb, i DESC) AS step
  FROM pair JOIN tot ON pair.lang IS NOT DISTINCT FROM tot.lang WHERE kb * n_ord > (ko + 1) * n_bad),
out AS (SELECT hit.lang, r, min(step) AS step FROM hit JOIN path ON hit.lang IS NOT DISTINCT FROM path.lang AND hit.i = path.i WHERE hit AND good AND NOT ord GROUP BY hit.lang, r),
run AS (SELECT path.lang, path.i, n, count(r) AS k FROM path LEFT JOIN out ON path.lang IS NOT DISTINCT FROM out.lang AND out.step <= path.step GROUP BY path.lang, path.i, n),
p AS (SELECT *, CASE WHEN n = 0 OR k >= n * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
  + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) END AS p FROM run),
x AS (SELECT lang, {wide} FROM p WHERE p <= {DELTA} / (SELECT count(*) FROM tot) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({fails}) AS kept
FROM m LEFT JOIN x ON m.lang IS NOT DISTINCT FROM x.lang"""
