"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target (weights, capped at a multiple of its size, the excess reshared), so each of its documents should
be copied target / size times on average. The whole part is certain; the fraction is settled by pivoting: two documents with
fractional mass exchange words until one has none or all of its size, which leaves the sum of words as it was and each
document's expectation too. Buckets of bounded size pivot first, each leaving one fractional document, and these meet in a
reduction tree of fixed fan-in, so a source's taken words miss its target by less than one document.

Draws depend on the seed, the source and the bucket alone; buckets depend on the rows alone, so reruns agree.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; equal rows
(source, doc_id, size) are pivoted among themselves first, so no bucket grows with their number; empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import common

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 20_000
FAN_IN = 256


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, more): size counts words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"), *more)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) of rows (source, size): the water level over the sources in order of cap by weight.

    One row a source; no more than that reaches one task.
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("_w", share).withColumn("_ratio", most * F.col("source_size") / F.col("_w"))
    by = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - most * (F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))
    src = src.withColumn("_level", left / F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return src.withColumn("_top", level).select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("_top") * F.col("_w")).alias("target"))


def _pairs(rows: np.ndarray, size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> int:
    """Pivots two rows at a time, in place; the row that stays fractional, or -1."""
    held, draw = -1, rng.random(len(rows)).tolist()
    for i, u in zip(rows.tolist(), draw, strict=True):
        if held < 0:
            held = i
            continue
        m, n, v, w = float(mass[held]), float(mass[i]), float(size[held]), float(size[i])
        up, down = min(v - m, n), min(m, w - n)  # to the held row, or from it
        if u * (up + down) < down:
            mass[held], mass[i] = (v, n - (v - m)) if v - m <= n else (m + n, 0)
        else:
            mass[i], mass[held] = (w, m - (w - n)) if w - n <= m else (n + m, 0)
        if 0 < mass[i] < w:
            held = i
        elif not 0 < mass[held] < v:
            held = -1
    return held


def _against(row: int, rest: np.ndarray, size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> None:
    """Pivots a row against all of ``rest`` as one, in place, until it or they hold no fraction."""
    v = size[row]
    while 0 < mass[row] < v and len(rest := rest[(mass[rest] > 0) & (mass[rest] < size[rest])]):
        m, n, w = mass[row], mass[rest], size[rest]
        room = np.minimum(n, w - n)  # what each may give or take alike
        up, down = min(v - m, room.sum()), min(m, room.sum())
        if rng.random() * (up + down) < down:
            mass[row] = v if up == v - m else m + up
            mass[rest] = np.maximum(n - room * (up / room.sum()), 0)
        else:
            mass[row] = 0 if down == m else m - down
            grown = n + room * (down / room.sum())
            mass[rest] = np.where((down == room.sum()) & (room == w - n), w, np.minimum(grown, w))


def _pivot(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(mass after pivoting: none or all of its size, but for one row; that row or -1)."""
    mass, held = mass.astype(float), -1
    grade = np.frexp(size)[1]
    for g in np.unique(grade)[::-1]:
        open_ = (mass > 0) & (mass < size)
        held = _pairs(np.flatnonzero(open_ & (grade == g)), size, mass, rng)
        if held >= 0:
            _against(held, np.flatnonzero(open_ & (grade < g)), size, mass, rng)
            if 0 < mass[held] < size[held]:
                break
            held = -1
    return mass, held


_SCHEMA = "source string, doc_id long, key long, size long, source_size long, target double, bucket long, copies long, taken_copies long, mass double"


def _settle(level: int, seed: int, last: bool):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "key"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{pdf['source'][0]!r}|{pdf['bucket'][0]}".encode()))
        size, mass = pdf["size"].to_numpy(float), pdf["mass"].to_numpy(float)
        mass, held = _pivot(size, mass, rng)
        if held >= 0 and last:
            mass[held] = size[held] if rng.random() * size[held] < mass[held] else 0
            held = -1
        one = (size > 0) & (mass >= size)
        pdf["taken_copies"] += one
        pdf["mass"] = np.nan
        if held >= 0:
            pdf.loc[held, "mass"] = mass[held]
        return pdf

    return go


def decide(rows: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(source, doc_id, key, size, source_size, target, copies, taken_copies, base) of rows (source, doc_id, key, size).

    ``copies`` equal rows stand in one result row; ``base`` copies of each are certain, ``taken_copies`` of them get one more.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = common.written(rows, "mix-rows")
    share = common.written(targets(rows, weights, most), "mix-targets")
    grouped = rows.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("copies"))
    n = rows.count()
    buckets = n // bucket_rows + 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    every = grouped.alias("g").join(share.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", "source_size", "target")
    every = every.withColumn("_f", ratio - F.floor(ratio))
    # of equal rows, all but one are settled among themselves
    sure = F.floor(F.col("copies") * F.col("_f")).cast("long")
    rest = F.col("copies") * F.col("_f") - sure
    cols = ["source", "doc_id", "key", "size", "source_size", "target", "bucket", "copies", "taken_copies", "mass"]
    every = every.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "size"), F.lit(buckets))).withColumn("taken_copies", sure).withColumn("mass", rest * F.col("size")).select(cols)
    found, level = [], 0
    while True:
        last = buckets == 1
        done = common.written(every.groupBy("source", "bucket").applyInPandas(_settle(level, seed, last), _SCHEMA), f"mix-{level}")
        found.append(done.where("mass is null"))
        if last:
            break
        buckets, level = (buckets - 1) // FAN_IN + 1, level + 1
        every = done.where("mass is not null").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).select(cols)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("base", F.floor(ratio).cast("long")).drop("bucket", "mass")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``: the words that the mix takes of it."""
    got = decide(sized(docs).withColumn("key", F.lit(0).cast("long")), **options)
    each = got.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    taken = F.col("size") * (F.col("base") + (F.col("_k") <= F.col("taken_copies")).cast("long"))
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    key = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key")
    rows = docs.select("doc_id", "source", "text", key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever the columns are called
    got = decide(sized(rows, "key"), **options).select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("key").alias("k"), "copies", "taken_copies", "base")
    both = rows.join(got, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    both = both.select("s", "d", "k", "copies", "taken_copies", "base", "row")
    one = both.where("copies = 1").withColumn("i", F.lit(1).cast("long"))
    # equal rows are numbered within the parts that hold them, and the parts by prefix sums: a group's size is nowhere bounded
    many = common.written(both.where("copies > 1").withColumn("at", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("at", 33)), "mix-equal")
    by = ["s", "d", "k"]
    runs = many.groupBy(*by, "pid").agg(F.count("*").alias("c"))
    runs = runs.withColumn("before", F.sum("c").over(Window.partitionBy(*by).orderBy("pid")) - F.col("c")).select(*(F.col(c).alias(f"_{c}") for c in [*by, "pid"]), "before")
    on = F.col("s").eqNullSafe(F.col("_s")) & F.col("d").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")) & (F.col("pid") == F.col("_pid"))
    place = F.row_number().over(Window.partitionBy(*by, "pid").orderBy("at")) + F.col("before")
    many = many.join(runs, on).withColumn("i", place).select(*one.columns)
    times = (F.col("base") + (F.col("i") <= F.col("taken_copies")).cast("long")).cast("int")
    out = one.unionByName(many).select("row", times.alias("times")).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
