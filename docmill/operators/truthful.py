"""Facts that change how sure an answer is, and their conflicts with what was retrieved.

The mass of an answer is what chunks and facts give it. Entropies with and without each fact come from two sums a question and the mass of
the fact's own answer: with S the mass of all answers and A the sum of m log2 m, the entropy is log2 S - A / S, and taking a weight away
changes one term of A. So each fact is judged against the rest of its question without computing a distribution for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a chunk that speak of time, and relations that contradict.
TEMPORAL_WORDS = ["date", "datum", "jaar", "year", "tijd", "time", "periode", "period"]
CONTRADICTING = ["opposes", "conflicts", "contradicts", "versus"]


def _xlogx(c: Column) -> Column:
    return F.when(c > 1e-12, c * F.log2(c)).otherwise(0.0)


def _entropy(total: Column, terms: Column) -> Column:
    return F.when(total > 1e-12, F.greatest(F.lit(0.0), F.log2(total) - terms / total)).otherwise(0.0)


def severity(delta: Column, threshold: float = 0.1) -> Column:
    return F.when(delta > 0.3, "high").when(delta > threshold, "medium").otherwise("low")


def entropy_shifts(votes: DataFrame, facts: DataFrame, threshold: float = 0.1, alone: bool = False) -> DataFrame:
    """(question, fact, answer, weight, before, after, delta, corrective, severity) of ``facts`` (question, fact, answer, weight > 0).

    ``votes`` (question, answer, mass) are the chunks' masses. before: the entropy in bits of the question's answers without the fact, after: with it; a fact is
    corrective if its delta, after - before, is above the threshold. The rest of a question is its chunks and its other facts, or with ``alone`` its chunks only.
    """
    given = facts.groupBy("question", "answer").agg(F.sum("weight").alias("mass"))
    both = votes.select("question", "answer", "mass")
    if not alone:
        both = both.unionByName(given)
    mass = both.groupBy("question", "answer").agg(F.sum("mass").alias("_m"))
    sums = mass.groupBy("question").agg(F.sum("_m").alias("_s"), F.sum(_xlogx(F.col("_m"))).alias("_a"))
    j = facts.join(mass, ["question", "answer"], "left").join(sums, "question", "left").fillna(0.0, ["_m", "_s", "_a"])
    m, s, a, w = (F.col(c) for c in ("_m", "_s", "_a", "weight"))
    moved = (m, m + w) if alone else (m - w, m)  # the answer's mass without and with the fact
    rest = a - _xlogx(m)
    before, after = (_entropy(s - m + x, rest + _xlogx(x)) for x in moved)
    j = j.withColumn("before", before).withColumn("after", after).withColumn("delta", F.round(F.col("after") - F.col("before"), 9))
    return j.select("question", "fact", "answer", "weight", "before", "after", "delta", (F.col("delta") > threshold).alias("corrective"), severity(F.col("delta"), threshold).alias("severity"))


def conflict_type(text: Column, description: Column, relations: Column) -> Column:
    """temporal where the chunk speaks of time, contradiction where a relation of the fact contradicts, factual where the chunk holds the beginning of the
    fact's description, else semantic."""
    low, said = F.lower(text), F.lower(F.coalesce(description, F.lit("")))
    against = F.exists(F.coalesce(relations, F.array().cast("array<string>")), lambda r: F.exists(F.array(*map(F.lit, CONTRADICTING)), lambda w: F.contains(F.lower(r), w)))
    spoken = F.exists(F.array(*map(F.lit, TEMPORAL_WORDS)), lambda w: F.contains(low, w))
    return F.when(spoken, "temporal").when(against, "contradiction").when((said != "") & F.contains(low, F.substring(said, 1, 20)), "factual").otherwise("semantic")


def conflicts(chunks: DataFrame, facts: DataFrame, shifts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(question, chunk, fact, type, severity, delta, filtered) of ``chunks`` (question, chunk, text) and ``facts`` (question, fact, entity, name, description, relations) of one question.

    A chunk conflicts with a fact whose entity it names, if the mean delta of the entity's corrective facts is above the threshold; filtered: the chunk has a
    conflict of high severity. Both lists are results of a search, bounded a question.
    """
    fixed = shifts.where("corrective").select("question", "fact", "delta")
    mean = facts.join(fixed, ["question", "fact"]).groupBy("question", "entity").agg(F.round(F.avg("delta"), 9).alias("delta"))
    about = facts.where(F.coalesce(F.trim("name"), F.lit("")) != "").join(mean, ["question", "entity"]).where(F.col("delta") > threshold)
    met = chunks.join(about, "question").where(F.contains(F.lower("text"), F.lower("name")))
    out = met.select("question", "chunk", "fact", conflict_type(F.col("text"), F.col("description"), F.col("relations")).alias("type"), severity(F.col("delta"), threshold).alias("severity"), "delta")
    hard = out.groupBy("question", "chunk").agg(F.bool_or(F.col("severity") == "high").alias("filtered"))
    return out.join(hard, ["question", "chunk"])
