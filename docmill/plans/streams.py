"""Queries that run streams: each reads the events as a stream of files, runs until it has read what is there, and returns what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docmill.operators import dedup
from docmill.plans.analytics import rounded
from docmill.plans.registry import query
from docmill.streaming import events as S


def _folder(t, name: str) -> str:
    return f"{dedup.shared_folder(t.spark)}/docmill/{name}-{uuid.uuid4().hex}"


def _stream(t, files: int = 16):
    return S.read(t.spark, t.dir, files=files)


def _drained(t, df, name: str, mode: str = "append"):
    path = _folder(t, name)
    S.drain(df, f"{path}/out", f"{path}/state", mode)
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


@query("st_stream_unique", "SELECT event_id FROM events")
def _(t):
    # each file's events twice: the state drops the second of each
    e = _stream(t)
    return _drained(t, S.unique(e.unionByName(e)), "unique").select("event_id")


@query("st_stream_progress", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase')")
def _(t):
    return _drained(t, _stream(t).where("event_type IN ('error', 'purchase')").select("event_id", "event_type", "value"), "progress")


def _last(t, df, key: str, name: str):
    """The last row of each key in update mode: epochs replace one another."""
    path = _folder(t, name)
    S.latest(df, f"{path}/out", f"{path}/state")
    rows = t.spark.read.parquet(f"{path}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*df.columns), "epoch").alias("r")).select("r.*")


@query("st_rate", """WITH o AS (SELECT user_id, (event_type = 'error')::INT AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), s AS (SELECT user_id, count(*) AS seen, avg(bad) AS error_rate, coalesce(min(r) FILTER (WHERE bad = 0), count(*) + 1) - 1 AS run FROM o GROUP BY 1)
SELECT user_id, seen, round(error_rate, 6) AS error_rate, least(64, pow(2, run))::DOUBLE AS delay FROM s""")
def _(t):
    return rounded(_last(t, S.rates(_stream(t)), "user_id", "rate"))


@query("st_counters", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failure FROM events GROUP BY 1")
def _(t):
    return _last(t, S.counters(_stream(t)), "user_id", "counters")


@query("st_queue", "SELECT event_type, 'done' AS state, count(*) AS n FROM events WHERE event_type <> 'error' AND value <= 100 GROUP BY 1 UNION ALL SELECT event_type, 'dead', count(*) FROM events WHERE event_type = 'error' OR value > 100 GROUP BY 1")
def _(t):
    path = _folder(t, "queue")
    S.queue(_stream(t), lambda b: b.withColumn("ok", (F.col("event_type") != "error") & (F.col("value") <= 100)), f"{path}/good", f"{path}/dead", f"{path}/state")
    part = lambda p, s: t.spark.read.parquet(f"{path}/{p}").groupBy("event_type").agg(F.lit(s).alias("state"), F.count("*").alias("n"))
    return part("good", "done").unionByName(part("dead", "dead"))


@query("st_checkpoint", "SELECT event_id, event_type FROM events")
def _(t):
    # run, stop, and run again from the checkpoint: nothing is read twice
    path, e = _folder(t, "resume"), _stream(t).select("event_id", "event_type")
    for _ in range(2):
        S.drain(e, f"{path}/out", f"{path}/state")
    return t.spark.read.schema(e.schema).parquet(f"{path}/out")


@query("st_stream_tumbling", "SELECT start, event_type, n, total FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def _(t):
    # windows are written once the watermark, ten minutes behind the latest event, has passed them
    return rounded(_drained(t, S.tumbling(_stream(t)), "tumbling"))


@query("st_stream_metrics", "SELECT event_type, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 25) AS le_25, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 75) AS le_75, count(*) AS le_inf, round(sum(value), 6) AS total FROM events GROUP BY 1")
def _(t):
    return rounded(_last(t, S.buckets(_stream(t)), "event_type", "metrics"))


@query("st_stream_threshold", "SELECT date_trunc('hour', ts) AS start, round(avg((event_type = 'error')::INT), 6) AS rate, CASE WHEN avg((event_type = 'error')::INT) >= 0.5 THEN 'critical' ELSE 'warning' END AS level FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1 HAVING avg((event_type = 'error')::INT) >= 0.25")
def _(t):
    return rounded(_drained(t, S.alerts(_stream(t)), "threshold"))


@query("st_stream_ttl", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1")
def _(t):
    from docmill.sources import sinks

    kept = _drained(t, sinks.retained(_stream(t), "ts", "2024-02-01", 7).select("event_id", "event_type"), "ttl")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))
