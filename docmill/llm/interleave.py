"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded order; a row's fractional rank is (rank + 1/2) / rows of its source. In
the order of fractional rank every stretch holds the sources in their proportions, so cutting it into equal runs of rows gives shards that each
match the mixture, with row counts at most one apart.

Both ranks are places in a total order found by range partitioning, local numbering and prefix sums over partitions. A large
source is simply a longer stretch of ranges, so none is gathered in one task.

Equal texts, the groups of a query's contract, get no place of their own: under the law ``rows`` only counts decide, and their copies
spread over the shards like any rows.

Defined cases: a null text has no bytes and no characters; a null source is a source of its own; repeated rows are ordered by
all that is known of them and fall into neighbouring places; fewer rows than shards leave shards empty; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import common

ROWS_EACH = 1 << 20


def shards(docs: DataFrame, count: int = 8, seed: int = 11, parts: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs``."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", "source", size.alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = common.written(rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "shard-rows")
    n = rows.count()
    parts = parts or common.partitions_for(spark, n, ROWS_EACH)
    first = common.ordered(rows, [F.col("source"), F.col("_h"), F.col("doc_id"), F.col("text_crc32")], parts, "shard-ranks")
    runs = first.groupBy("source", "_pid").agg(F.count("*").alias("_c"), F.min("_idx").alias("_from"))
    # one row for each source and range: as many as there are sources and partitions together
    of = Window.partitionBy("source")
    runs = runs.select(F.col("source").alias("_src"), F.col("_pid").alias("_p"), "_from", (F.sum("_c").over(of.orderBy("_pid")) - F.col("_c")).alias("_before"), F.sum("_c").over(of).alias("_all"))
    runs = common.written(runs, "shard-runs")
    ranked = first.join(runs, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_pid") == F.col("_p")))
    rank = F.col("_before") + F.col("_idx") - F.col("_from")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "_h", ((rank + 0.5) / F.col("_all")).alias("_f"))
    ranked = common.written(ranked, "shard-fractions")
    second = common.ordered(ranked, [F.col("_f"), F.col("source"), F.col("_h"), F.col("doc_id"), F.col("text_crc32")], parts, "shard-order")
    at = common.prefix_offsets(second.groupBy("_pid").agg(F.count("*").alias("n")), "_pid", "n").select("_pid", "offset")
    place = second.join(F.broadcast(at) if parts <= 100_000 else at, "_pid").withColumn("_at", F.col("offset") + F.col("_idx"))
    shard = F.expr(f"(_at * {count}L) div {max(n, 1)}L")
    start = F.expr(f"(shard * {n}L + {count - 1}L) div {count}L")
    out = place.withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_at") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
