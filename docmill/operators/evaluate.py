"""Retrieval metrics over a run (query, doc, rank) and judgments (query, doc, relevance)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rel (null: not judged)."""
    return run.join(qrels, ["query", "doc"], "left")


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10, denominator: str = "retrieved") -> DataFrame:
    """(query, precision, recall, f1, ap, ndcg) at k. A judged document counts as a hit whatever its grade; with
    ``denominator="retrieved"`` recall, AP and NDCG are normalized by the judged documents retrieved, with "all" by all judged."""
    j = judged(run, qrels).withColumn("hit", F.col("relevance").isNotNull().cast("int"))
    w = Window.partitionBy("query").orderBy("rank")
    j = j.withColumn("hits_so_far", F.sum("hit").over(w)).withColumn("ideal_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("relevance"), "rank")))
    gain = F.coalesce("relevance", F.lit(0))
    top = F.col("rank") <= k
    g = j.groupBy("query").agg(
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"),
        F.count_if(top).alias("returned"),
        F.sum("hit").alias("found"),
        F.sum(F.col("hit") * F.col("hits_so_far") / F.col("rank")).alias("ap_sum"),
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal_rank") <= k, gain / F.log2(F.col("ideal_rank") + 1)).otherwise(0.0)).alias("idcg"),
    )
    if denominator == "all":
        ideal = qrels.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "doc")))
        ideal = ideal.groupBy("query").agg(F.count("*").alias("all"), F.sum(F.when(F.col("_r") <= k, F.col("relevance") / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias("all_idcg"))
        g = g.join(ideal, "query", "left").withColumn("found", F.col("all")).withColumn("idcg", F.col("all_idcg"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("returned")), ratio(F.col("hits"), F.col("found"))
    return g.select("query", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("ap_sum"), F.col("found")).alias("ap"), ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"))


def ab_test(df: DataFrame, variant: str, success: str) -> DataFrame:
    """One row: rates of variants 'a' and 'b', change in percent, z, two-sided p."""
    rate = lambda v: F.avg(F.when(F.col(variant) == v, F.col(success)))
    n = lambda v: F.count_if(F.col(variant) == v)
    g = df.agg(rate("a").alias("pa"), rate("b").alias("pb"), n("a").alias("na"), n("b").alias("nb"), F.avg(success).alias("p"))
    z = (F.col("pb") - F.col("pa")) / F.sqrt(F.col("p") * (1 - F.col("p")) * (1 / F.col("na") + 1 / F.col("nb")))
    g = g.withColumn("z", z).withColumn("change_pct", 100 * (F.col("pb") - F.col("pa")) / F.col("pa"))
    g = g.withColumn("p_value", 2 * (1 - T.normal_cdf(F.abs("z"))))
    return g.select("pa", "pb", "change_pct", "z", "p_value", F.when(F.col("p_value") >= 0.05, "none").when(F.col("z") > 0, "b").otherwise("a").alias("winner"))


def failure_patterns(df: DataFrame, message: str) -> DataFrame:
    m = df.withColumn("category", T.error_category(F.col(message))).withColumn("pattern", F.substring(T.error_norm(F.col(message)), 1, 100))
    return m.groupBy("category", "pattern").agg(F.count("*").alias("n"))


def p_value(z: Column) -> Column:
    """The two-sided probability of a standard score at least as far from 0."""
    return F.least(F.lit(1.0), 2 * (1 - T.normal_cdf(F.abs(z))))


def run_benchmarks(suite: dict[str, Callable[[], object]], iterations: int = 10, warmup: int = 2, timeout: float = 300.0) -> list[tuple]:
    """(name, runs, failed, least, mean, median, 95th percentile and greatest seconds) of each function of the suite.

    Functions run one after the other on the driver, as each starts its own Spark jobs; an error counts as a failed run, and no run
    starts after ``timeout`` seconds of its function.
    """
    import time

    out = []
    for name, f in suite.items():
        took, failed, began = [], 0, time.monotonic()
        for i in range(warmup + iterations):
            if time.monotonic() - began > timeout:
                break
            at = time.perf_counter()
            try:
                f()
            except Exception:  # a failed run is a result
                failed += i >= warmup
                continue
            if i >= warmup:
                took.append(time.perf_counter() - at)
        s = sorted(took)
        rank = lambda q: s[min(len(s) - 1, max(0, -(-int(q * 100) * len(s) // 100) - 1))] if s else None  # noqa: B023, E731
        out.append((name, len(s), failed, rank(0.0), sum(s) / len(s) if s else None, rank(0.5), rank(0.95), rank(1.0)))
    return out
