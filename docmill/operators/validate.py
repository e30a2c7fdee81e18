"""Validators of a knowledge graph: facts, relation semantics, several views of an entity, and batches as they come.

Entities are rows (id, type, and the properties a rule asks for), edges (src, dst, type). Counts an entity needs are made by
grouping the edges once and joined, so a hub is a large count, not a large task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

#: How far a body's rules reach, least first; and what an entity of a type must have, with its penalty.
LEVELS = {"municipality": 1, "province": 2, "national": 3, "european": 4}
EXPECTED = {"PolicyDocument": (("jurisdiction", 0.2), ("date", 0.1)), "Regulation": (("category", 0.2),), "Requirement": (("metric", 0.3),)}
#: The relation an entity of a type should have, whether it leaves or enters it, and the penalty without one.
LINKED = {"Regulation": ("APPLIES_TO", "out", 0.1), "Requirement": ("HAS_REQUIREMENT", "in", 0.2), "PolicyDocument": ("DEFINED_IN", "out", 0.1)}


def _between(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def facts(claims: DataFrame, edges: DataFrame, sources: DataFrame, as_of: str, start: float = 1.0) -> DataFrame:
    """(claim columns, confidence, accepted) of claims (src, dst, type, source, effective).

    Starting from ``start``: 0.2 off where the source isn't among ``sources`` (id), 0.1 where it is null; 0.1 off for a date that can't be
    read, 0.05 for one over 100 years old or 10 years ahead; 0.1 more where the edge is known already, 0.1 off for each other type
    between the two (two at most); 0.05 off where the source node has over 10 edges of the type, 0.03 where its more than 5 edges
    are all of one type. Accepted at 0.7 or more without an issue.
    """
    pair = edges.groupBy("src", "dst").agg(F.collect_set("type").alias("_types"), F.count("*").alias("_pair"))
    kind = edges.groupBy("src", "type").agg(F.count("*").alias("_same"))
    node = edges.groupBy("src").agg(F.count("*").alias("_all"), F.count_distinct("type").alias("_kinds"))
    known = sources.select(F.col("id").alias("source"), F.lit(True).alias("_found")).distinct()
    c = claims.join(pair, ["src", "dst"], "left").join(kind, ["src", "type"], "left").join(node, "src", "left").join(known, "source", "left")
    day = F.expr("try_cast(effective AS date)")
    years = F.datediff(F.lit(as_of).cast("date"), day) / 365
    types = F.coalesce("_types", F.array().cast("array<string>"))
    dup, other = F.array_contains(types, F.col("type")), F.size(F.array_except(types, F.array("type")))
    gone, unread, odd = F.col("source").isNotNull() & F.col("_found").isNull(), F.col("effective").isNotNull() & day.isNull(), (years > 100) | (years < -10)
    many, single = F.col("_same") > 10, (F.col("_kinds") == 1) & (F.col("_all") > 5)
    score = F.lit(start) - 0.2 * _yes(gone) - 0.1 * _yes(F.col("source").isNull()) - 0.1 * _yes(unread) - 0.05 * _yes(odd)
    score = F.when(dup, F.least(F.lit(1.0), score + 0.1)).otherwise(score)
    score = _between(score - 0.1 * F.least(other, F.lit(2)) - 0.05 * _yes(many) - 0.03 * _yes(single))
    issues = _yes(gone) + _yes(F.col("source").isNull()) + _yes(unread) + _yes(odd) + (other > 0).cast("int") + _yes(many) + _yes(single)
    return c.select(*claims.columns, score.alias("confidence"), ((F.round(score, 9) >= 0.7) & (issues == 0)).alias("accepted"))


def relations(edges: DataFrame, nodes: DataFrame, needs_place: tuple[str, ...], needs_time: tuple[str, ...], downward: tuple[str, ...]) -> DataFrame:
    """(src, dst, type, place, time, level, verdict) of edges between nodes (id, jurisdiction, level, starts, ends).

    place: both have one jurisdiction, or one lacks it. time: their periods overlap, open ends included. level: the source's level is no
    lower than the target's. A failed test is an error for the types that need it, else a warning.
    """
    n = nodes.select("id", "jurisdiction", F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("level")).alias("level"), "starts", "ends")
    side = lambda p, key: n.select(*(F.col(c).alias(key if c == "id" else f"{p}_{c}") for c in n.columns))
    e = edges.join(side("s", "src"), "src").join(side("d", "dst"), "dst")
    place = F.coalesce(F.lower("s_jurisdiction") == F.lower("d_jurisdiction"), F.lit(True))
    time = F.coalesce(F.col("s_starts") <= F.col("d_ends"), F.lit(True)) & F.coalesce(F.col("d_starts") <= F.col("s_ends"), F.lit(True))
    level = F.coalesce(F.col("s_level") >= F.col("d_level"), F.lit(True))
    bad = lambda ok, kinds: (~ok) & F.col("type").isin(*kinds)
    error = bad(place, needs_place) | bad(time, needs_time) | bad(level, downward)
    verdict = F.when(error, "error").when(~(place & time & level), "warning").otherwise("valid")
    return e.select("src", "dst", "type", place.alias("place"), time.alias("time"), level.alias("level"), verdict.alias("verdict"))


def views(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, plausibility, importance, in_time, score) of nodes (id, type, name, jurisdiction, date, category, metric, expires).

    Plausibility falls by what the type should have; importance is the share of three edges a node, less where one direction is
    missing, 0.3 of it for types that must be connected; score is 0.4, 0.4 and 0.2 of the three, time counting 1 or 0.5.
    """
    one = lambda key, way: F.struct(F.col(key).alias("id"), F.lit(way).alias("way"), F.col("type").alias("t"))
    deg = edges.select(F.explode(F.array(one("src", "out"), one("dst", "in"))).alias("_e")).select("_e.*").groupBy("id")
    linked = [F.count_if((F.col("way") == way) & (F.col("t") == t)).alias(f"_{k}") for k, (t, way, _) in LINKED.items()]
    n = nodes.join(deg.agg(F.count_if(F.col("way") == "out").alias("_out"), F.count_if(F.col("way") == "in").alias("_in"), *linked), "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    kind, plausible = F.col("type"), F.lit(1.0) - 0.3 * (F.coalesce(T.trim(F.col("name")), F.lit("")) == "").cast("int")
    for k, wants in EXPECTED.items():
        for column, penalty in wants:
            plausible = plausible - penalty * _yes((kind == k) & F.col(column).isNull())
    for k, (_, _, penalty) in LINKED.items():
        plausible = plausible - penalty * _yes((kind == k) & (count(F.col(f"_{k}")) == 0))
    out, into = count(F.col("_out")), count(F.col("_in"))
    important = F.least(F.lit(1.0), (out + into) / 3) * F.when(kind.isin(*LINKED) & (out + into == 0), 0.3).otherwise(1.0) * F.when((out > 0) & (into > 0), 1.0).otherwise(0.8)
    day, until = F.expr("try_cast(date AS date)"), F.expr("try_cast(expires AS date)")
    in_time = ~(F.col("date").isNotNull() & day.isNull()) & ~(F.col("expires").isNotNull() & until.isNull()) & F.coalesce(until >= day, F.lit(True))
    n = n.select("id", _between(plausible).alias("plausibility"), _between(important).alias("importance"), in_time.alias("in_time"))
    return n.withColumn("score", 0.4 * F.col("plausibility") + 0.4 * F.col("importance") + 0.2 * F.when(F.col("in_time"), 1.0).otherwise(0.5))


def batch(rows: DataFrame, rules: dict[str, Column], known: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(rows, errors, warning): each row of a batch with the names of the rules it breaks, and "duplicate" where its key is known.

    The same expressions serve a stream's micro-batches (see ``guarded``), so checks that run as data arrives and checks of stored
    tables agree.
    """
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda x: x.isNotNull())
    out = rows.withColumn("errors", broken)
    if known is None:
        return out.withColumn("warning", F.lit(None).cast("string"))
    old = known.select(key).distinct().withColumn("warning", F.lit("duplicate"))
    return out.join(old, key, "left")


def guarded(rules: dict[str, Column], known: DataFrame | None, good: str, bad: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: sound rows go to ``good``, others to ``bad``, a folder an epoch, so a repeated epoch replaces itself."""

    def each(frame: DataFrame, epoch: int) -> None:
        seen = batch(frame, rules, known, key).persist()
        seen.where("size(errors) = 0").drop("errors").write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        seen.where("size(errors) > 0").write.mode("overwrite").parquet(f"{bad}/epoch={epoch}")
        seen.unpersist()

    return each


def periods(rows: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """(key, order, problem) of versions (key, order, start, end): ends_before_start, overlaps_next, gap_before_next."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(start, order)
    r = rows.select(key, order, start, end, F.lead(start).over(w).alias("_next"))
    found = F.array_compact(
        F.array(
            F.when(F.col(end) < F.col(start), "ends_before_start"),
            F.when(F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("_next"))), "overlaps_next"),
            F.when(F.col(end) < F.col("_next"), "gap_before_next"),
        )
    )
    return r.select(key, order, F.explode(found).alias("problem"))
