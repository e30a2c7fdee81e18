"""Aggregations, windows, paging, set operations and sampling. Every operator maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def error_groups(df: DataFrame, key: str, user: str, value: str, ts: str) -> DataFrame:
    """Per key: occurrences, first and last time, distinct users; users are counted, not collected, so a hot key stays small."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.countDistinct(user).alias("users"))


def interaction_counts(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Clicks, accepts, rejects and all interactions per key, with at least ``least`` of them."""
    kind = lambda k: F.count_if(F.col("type") == k)
    out = df.groupBy(key).agg(kind("click").alias("clicks"), kind("accept").alias("accepts"), kind("reject").alias("rejects"), F.count("*").alias("total"))
    return out.where(F.col("total") >= least)


def ratings(df: DataFrame, key: str, rating: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(rating).alias("rating"), F.count_if(F.col(rating) >= 4).alias("helpful"), F.count(rating).alias("n"))


def doc_quality(counts: DataFrame, rated: DataFrame, key: str) -> DataFrame:
    """0.4 acceptance + 0.3 rating / 5 + 0.2 min(1, clicks / 10) + 0.1 (1 - rejection), clamped."""
    j = counts.join(rated, key, "left")
    acts = F.col("accepts") + F.col("rejects")
    acc = F.when(acts > 0, F.col("accepts") / acts).otherwise(0.0)
    rej = F.when(acts > 0, F.col("rejects") / acts).otherwise(0.0)
    q = 0.4 * acc + 0.3 * F.coalesce("rating", F.lit(0.0)) / 5 + 0.2 * F.least(F.lit(1.0), F.col("clicks") / 10) + 0.1 * (1 - rej)
    return j.select(key, clamp(q).alias("quality"))


def source_quality(docs: DataFrame, counts: DataFrame, rated: DataFrame, key: str, source: str) -> DataFrame:
    """Per source: 0.4 acceptance + 0.3 rating / 5 + 0.2 click rate + 0.1 min(docs / 10, 1)."""
    j = docs.select(F.col(key), F.col(source)).join(counts, key, "left").join(rated, key, "left")
    g = j.groupBy(source).agg(F.sum("clicks").alias("c"), F.sum("accepts").alias("a"), F.sum("rejects").alias("r"), F.sum("total").alias("t"), F.avg("rating").alias("rating"), F.count("*").alias("docs"))
    acts = F.coalesce(F.col("a") + F.col("r"), F.lit(0))
    acc = F.when(acts > 0, F.col("a") / acts).otherwise(0.0)
    ctr = F.when(F.coalesce("t", F.lit(0)) > 0, F.least(F.col("c") / F.col("t"), F.lit(1.0))).otherwise(0.0)
    q = 0.4 * acc + 0.3 * F.coalesce("rating", F.lit(0.0)) / 5 + 0.2 * ctr + 0.1 * F.least(F.col("docs") / 10, F.lit(1.0))
    return g.select(source, "docs", clamp(q).alias("quality"))


def term_importance(rows: DataFrame, text: str, rating: str, accepted: str) -> DataFrame:
    """Per term of a query text: 0.4 min(1, f / 10) + 0.3 rating / 5 + 0.3 acceptance; stopwords and short words left out."""
    words = F.filter(T.without_stopwords(F.split(F.lower(text), r"\s+")), lambda w: F.length(w) > 2)
    g = rows.select(F.explode(words).alias("term"), rating, accepted).groupBy("term").agg(F.count("*").alias("f"), F.avg(rating).alias("r"), F.avg(F.col(accepted).cast("double")).alias("a"))
    return g.select("term", "f", (0.4 * F.least(F.lit(1.0), F.col("f") / 10) + 0.3 * F.coalesce("r", F.lit(0.0)) / 5 + 0.3 * F.coalesce("a", F.lit(0.0))).alias("importance"))


def two_level(df: DataFrame, category: str, ts: str) -> DataFrame:
    """Category totals with the array of (day, n) in order of day."""
    daily = df.groupBy(category, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy(category).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("day", "n"))).alias("trend"))


def time_buckets(df: DataFrame, ts: str, unit: str, value: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(ts).alias("first"))


def first_row(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Each key's first whole row by time."""
    return df.groupBy(key).agg(F.min(F.struct(ts, tie, *(c for c in df.columns if c not in (key, ts, tie)))).alias("r")).select(key, "r.*")


def histogram(df: DataFrame, score: str, bins: int = 5) -> DataFrame:
    """Equal bins of scores in 0..1; 1.0 belongs to the last."""
    return df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, key: str, value: str, ps: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Linear interpolation; one pass and one buffer a key for all of them."""
    got = df.groupBy(key).agg(F.percentile(value, list(ps)).alias("_p"))
    return got.select(key, *(F.col("_p")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(ps)))


def nearest_rank(df: DataFrame, key: str, value: str, slow: float, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles and the count of slow rows."""
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(q * 100)}") for q in ps]
    return df.groupBy(key).agg(*p, F.count_if(F.col(value) > slow).alias("slow"), F.count("*").alias("n"))


def floor_index(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """The value at place min(floor(n p), n - 1) of each key's sorted values, by ranks rather than by an array of them all."""
    w = Window.partitionBy(key)
    r = df.select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("n"))
    return r.where(F.col("_i") == F.least(F.floor(F.col("n") * p), F.col("n") - 1)).select(key, "n", F.col(value).alias("p"))


def statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.median(value).alias("median"), F.stddev_pop(value).alias("sd"))


def linear_trend(df: DataFrame, at: str, value: str, flat: float = 0.05) -> DataFrame:
    """OLS of ``value`` over the row's place in order of ``at``, one row: slope, intercept, r2, direction. For daily series."""
    s = df.withColumn("_i", (F.row_number().over(Window.orderBy(at)) - 1).cast("double"))
    r = s.agg(F.regr_slope(value, "_i").alias("slope"), F.regr_intercept(value, "_i").alias("intercept"), F.regr_r2(value, "_i").alias("r2"))
    return r.withColumn("direction", F.when(F.col("slope") > flat, "up").when(F.col("slope") < -flat, "down").otherwise("flat"))


def ranked(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """1-based rank by score, descending, with explicit ties. A global order: use on results, not on corpora."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *ties)))


def top_n_per_group(df: DataFrame, key: str, score: str, tie: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where(F.col("rank") <= n)


def min_max(df: DataFrame, key: str | None, score: str) -> DataFrame:
    """Scores scaled to 0..1 within a key; equal scores become 1 if positive, else 0."""
    if key:
        lo, hi, rows = F.min(score).over(Window.partitionBy(key)), F.max(score).over(Window.partitionBy(key)), df
    else:  # one row for all
        rows = df.join(F.broadcast(df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))), F.lit(True))
        lo, hi = F.col("_lo"), F.col("_hi")
    return rows.select(*df.columns, F.when(hi == lo, F.when(F.col(score) > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - lo) / (hi - lo)).alias("norm"))


def flakes(runs: DataFrame, key: str, at: str, passed: str, tie: str, last: int = 10, least: int = 5) -> DataFrame:
    """Pass rate over each key's last runs: stable, flaky or failing."""
    r = runs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).where(F.col("_r") <= last)
    g = r.groupBy(key).agg(F.count("*").alias("runs"), F.avg(F.col(passed).cast("double")).alias("rate")).where(F.col("runs") >= least)
    return g.withColumn("status", F.when(F.col("rate") == 1, "stable").when(F.col("rate") == 0, "failing").otherwise("flaky"))


def drift(runs: DataFrame, key: str, at: str, value: str, tie: str, limit: float = 0.2) -> DataFrame:
    """Median of the last tenth against the first nine tenths."""
    w = Window.partitionBy(key)
    r = runs.withColumn("_i", F.row_number().over(w.orderBy(at, tie)) - 1).withColumn("_cut", F.floor(F.count("*").over(w) * 0.9))
    g = r.groupBy(key).agg(F.median(F.when(F.col("_i") < F.col("_cut"), F.col(value))).alias("before"), F.median(F.when(F.col("_i") >= F.col("_cut"), F.col(value))).alias("after"))
    change = (F.col("after") - F.col("before")) / F.col("before")
    return g.withColumn("change", change).withColumn("status", F.when(change > limit, "slower").when(change < -limit, "faster").otherwise("stable"))


def prev_next(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at)
    return df.select(key, at, value, F.lag(value).over(w).alias("prev"), F.lead(value).over(w).alias("next"))


def period_compare(df: DataFrame, key: str, ts: str, value: str, start: str, middle: str, end: str) -> DataFrame:
    """Average before and after ``middle`` within [start, end), and the change in percent."""
    span = lambda a, b: F.avg(F.when((F.col(ts) >= F.lit(a).cast("timestamp")) & (F.col(ts) < F.lit(b).cast("timestamp")), F.col(value)))
    g = df.groupBy(key).agg(span(start, middle).alias("previous"), span(middle, end).alias("current"))
    return g.withColumn("change_pct", 100 * (F.col("current") - F.col("previous")) / F.col("previous"))


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """One page and the total beside each row."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(skip).limit(limit).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > skip + limit)


def union_in_order(frames: list[DataFrame], key: str, tie: str) -> DataFrame:
    """Frames concatenated in a fixed order; of rows with one key the earliest frame's, then the least tie's, stays."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("seq", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("seq", tie))).where("_r = 1").drop("_r")


def set_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, modified or same for each key of two frames."""
    x, y = a.select(key, F.col(value).alias("old"), F.lit(True).alias("_a")), b.select(key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    j = x.join(y, key, "full_outer")
    return j.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("same").alias("change"))


def evidence_union(steps: list[DataFrame], key: str, score: str) -> DataFrame:
    """Results of several steps merged in step order: the greater score, times 1.1 on each repeat, at most 1."""
    out = None
    for i, f in enumerate(steps):
        f = f.select(key, score, F.lit(i).alias("_s"))
        out = f if out is None else out.unionByName(f)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("_s", score))), lambda s: s[score])
    g = out.groupBy(key).agg(scores.alias("_l"))  # at most one score a step
    rest = F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))
    return g.select(key, F.aggregate(rest, F.element_at("_l", 1), lambda a, x: F.least(F.lit(1.0), F.greatest(a, x) * 1.1)).alias(score))


def sample_random(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows whose seeded hash comes first."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def sample_stratified(df: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    """floor(n / strata) rows of each stratum, then filled from the rest in the same order."""
    groups = df.agg(F.countDistinct(stratum).alias("g"))
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).join(F.broadcast(groups), F.lit(True))
    first = (F.col("_r") > F.floor(F.lit(n) / F.col("g"))).cast("int")
    return r.orderBy(first, *order).limit(n).drop("_r", "g")
