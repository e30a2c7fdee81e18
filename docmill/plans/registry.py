"""Registry of queries: a callable (spark, sf_dir) and, where SQL can express it, DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def titled(self) -> DataFrame:
        """documents with a title: the first 80 characters of the first line."""
        return self.documents.withColumn("title", F.substring(F.substring_index("text", "\n", 1), 1, 80))

    @property
    def interactions(self) -> DataFrame:
        """events as user interactions: item id from props, purchase as accept, error as reject."""
        kind = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise(F.col("event_type"))
        return self.events.select("event_id", "ts", "user_id", kind.alias("type"), "value", F.get_json_object("props", "$.k").cast("long").alias("item"))


#: DuckDB's counterparts of the two views above.
TITLED = "(SELECT *, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents)"
INTERACTIONS = "(SELECT event_id, ts, user_id, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' ELSE event_type END AS type, value, json_extract_string(props, '$.k')::BIGINT AS item FROM events)"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under ``name``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql.replace("@titled", TITLED).replace("@interactions", INTERACTIONS)
        return f

    return add
