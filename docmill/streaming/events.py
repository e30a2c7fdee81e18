"""Structured Streaming over event files. Windows, watermarks and sessions are extensions; counters, rates and queues are the
reference's own. Every stream here is also checked against its batch form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int = 16) -> DataFrame:
    """Events as a stream of files, ts as event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, which also bounds the state kept."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def counters(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Running successes and failures; use output mode update or complete."""
    return events.groupBy(key).agg(F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failure"))


def rates(events: DataFrame, key: str = "user_id", backoff: float = 2.0, most: float = 64.0) -> DataFrame:
    """(key, seen, error_rate, delay): cumulative error rate, and a delay that doubles with each error in a row and resets at a success.

    Rows in a row are those in order of (ts, event_id), in whatever order and batches they arrive: the state holds the last success and,
    of the errors after it, the last ones, as many as raise the delay to its most (``backoff`` is above 1). A later success may drop some of them, never ask for others.
    """
    enough = max(1, math.ceil(math.log(most, backoff)))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, errors, good, bads = state.get if state.exists else (0, 0, None, [])
        good, bads = good and tuple(good), [tuple(b) for b in bads]
        for f in frames:
            bad = f["_bad"].to_numpy(bool)
            seen, errors = seen + len(bad), errors + int(bad.sum())
            at = list(zip(f["_at"].tolist(), f["_id"].tolist(), bad.tolist(), strict=True))
            good = max([*([good] if good else []), *((t, i) for t, i, b in at if not b)], default=None)
            bads = sorted(p for p in [*bads, *((t, i) for t, i, b in at if b)] if good is None or p > good)[-enough:]
        state.update((seen, errors, good and list(good), [list(b) for b in bads]))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "error_rate": [errors / seen], "delay": [min(most, backoff ** len(bads))]})

    out = f"{key} long, seen long, error_rate double, delay double"
    rows = events.select(key, F.coalesce(F.unix_micros("ts"), F.lit(-(2**63))).alias("_at"), F.coalesce("event_id", F.lit(-(2**63))).alias("_id"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("_bad"))
    return rows.groupBy(key).applyInPandasWithState(run, out, "seen long, errors long, good array<long>, bads array<array<long>>", "update", GroupStateTimeout.NoTimeout)


def buckets(events: DataFrame, edges: tuple[float, ...] = (10, 25, 50, 75)) -> DataFrame:
    """A histogram with fixed buckets, cumulative as in metrics exposition."""
    cum = [F.count_if(F.col("value") <= e).alias(f"le_{e:g}") for e in edges]
    return events.groupBy("event_type").agg(*cum, F.count("*").alias("le_inf"), F.sum("value").alias("total"))


def alerts(events: DataFrame, size: str = "1 hour", warn: float = 0.25, critical: float = 0.5) -> DataFrame:
    """(start, rate, level) of windows whose error rate passes a threshold."""
    w = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    g = w.groupBy(F.window("ts", size).alias("w")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    return g.where(F.col("rate") >= warn).select(F.col("w.start").alias("start"), "rate", F.when(F.col("rate") >= critical, "critical").otherwise("warning").alias("level"))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into Parquet, resuming from ``checkpoint``."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def queue(df: DataFrame, work, good: str, dead: str, checkpoint: str) -> None:
    """Applies ``work`` (a function of a DataFrame that adds a boolean column ok) to each batch; failures go to a second table."""

    def each(batch: DataFrame, epoch: int) -> None:
        done = work(batch).persist()
        done.where("ok").write.mode("overwrite").parquet(f"{good}/epoch={epoch}")  # a repeated epoch replaces itself
        done.where("NOT ok OR ok IS NULL").write.mode("overwrite").parquet(f"{dead}/epoch={epoch}")
        done.unpersist()

    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(events: DataFrame, last_id: int, limit: int = 1000) -> DataFrame:
    """Buffered progress after an event id, in order."""
    return events.where(F.col("event_id") > last_id).orderBy("event_id").limit(limit)


def latest(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream in update mode into a table with a folder for each epoch; the last epoch of a key holds."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    df.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
