"""Shared helpers: a folder every executor sees, written intermediates, scalable prefix sums and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of a word's border, as a regular-expression class and as characters: fixed values.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where it is unset a local master (tests) gets a temporary
    one; on a cluster that is an error, as no machine's own folder is shared."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("docmill.shared.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='docmill-')}"
        spark.conf.set("docmill.shared.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that neither side holds more than that of long texts at once.

    Plans read these settings when they run, after an operator has returned, so they stay set; a user's own values are left alone.
    """
    for key, spark_own, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", str(8 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", spark_own) == spark_own:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def short_plans(spark: SparkSession, most: int = 50_000) -> None:
    """Descriptions of plans of at most ``most`` characters: the driver prints each plan several times and keeps the text of past queries,
    megabytes each where a plan holds a large literal. A user's own setting is left alone."""
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")) > 1 << 30:
        spark.conf.set("spark.sql.maxPlanStringLength", str(most))


_open: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; ``scratch`` deletes it if it is open."""
    path = f"{shared_dir(spark)}/docmill/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end every intermediate table made within: for work whose result has been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        remove(spark, _open.pop())


def written(df: DataFrame, name: str, codec: str = "zstd", drop: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage, and a lost executor costs no recomputation.

    ``drop``: if given, gets the path, so that ``remove`` can delete the table once nothing reads it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    if drop is not None:
        drop.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables through Hadoop's file system, so any shared store works."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def prefix_offsets(counts: DataFrame, key: str, value: str, fan: int = 1024) -> DataFrame:
    """(key, offset, total): offset is the sum of ``value`` over smaller keys. ``key`` holds small integers, one row each.

    Two levels: blocks of ``fan`` keys, then sums of blocks, so that no task sees more than max(fan, keys / fan) rows.
    """
    blocks = counts.select(key, value, F.floor(F.col(key) / fan).alias("_b"))
    within = blocks.withColumn("_in", F.sum(value).over(Window.partitionBy("_b").orderBy(key)) - F.col(value))
    sums = blocks.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_o"))
    return within.join(before, "_b").select(key, (F.col("_in") + F.col("_o")).alias("offset"), F.col(value).alias("total"))


def ordered(df: DataFrame, by: list[Column], parts: int, name: str, drop: list[str] | None = None) -> DataFrame:
    """``df`` in the total order of ``by`` as a written table, with _pid (the range) and _idx (place in the range, from 0)."""
    put = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    put = put.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_idx", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    return written(put, name, drop=drop)


def trim() -> None:
    """Returns a worker's freed memory to the system: workers are reused, and what one task freed would count against the next."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions_for(spark: SparkSession, units: float, each: float, least: int = 1) -> int:
    """How many partitions hold ``each`` of ``units``; at least as many as there are cores, or ``least``."""
    return max(least, spark.sparkContext.defaultParallelism, int(units // each) + 1)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts have at most ``limit`` bytes (one longer text stands alone)."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        off = text_buffers(b.column(b.schema.get_field_index(text)))[1]
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def text_buffers(col: pa.Array):
    """(bytes as uint8 array, offsets int64 of length n+1) of a string column; null counts as empty."""
    import numpy as np

    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]
