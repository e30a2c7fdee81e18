"""Document scores: factors are columns, strategies combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

#: Default factor weights; they sum to 1.1 and are renormalized.
WEIGHTS = {"authority": 0.3, "semantic": 0.3, "keyword": 0.2, "recency": 0.1, "type": 0.1, "rule": 0.1}


def _share(field: Column, terms: list[str]) -> Column:
    return sum((F.contains(F.lower(field), F.lit(w)).cast("int") for w in terms), F.lit(0)) / max(len(terms), 1)


def keyword(title: Column, text: Column, terms: list[str]) -> Column:
    """0.6 of the terms' share found in the title and 0.4 of that in the text; 0.5 without terms."""
    return 0.6 * _share(title, terms) + 0.4 * _share(text, terms) if terms else F.lit(0.5)


def linear(factors: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Sum of score times weight over the weights of the factors given."""
    total = sum(weights[k] for k in factors)
    return sum((factors[k] * weights[k] for k in factors), F.lit(0.0)) / total


def plain_mean(factors: dict[str, Column]) -> Column:
    """What a missing model falls back to."""
    return sum(factors.values(), F.lit(0.0)) / len(factors)


def hybrid(factors: dict[str, Column], model: Column | None = None, blend: float = 0.5) -> Column:
    return blend * linear(factors) + (1 - blend) * (model if model is not None else plain_mean(factors))


def rule(matches: Column) -> Column:
    """Without a query: a hundredth a rule, 0.1 at most."""
    return F.least(F.lit(0.1), matches * 0.01)


def relevance_points(title: Column, summary: Column, url: Column, words: list[str], semantic: Column | None = None) -> Column:
    """Additive points: 5 a word in title, 3 in summary, 2 in url, partial credit floor(share of its parts found x points)."""
    points = F.lit(0)
    for field, each in ((title, 5), (summary, 3), (url, 2)):
        for w in words:
            parts = w.split("-")
            ratio = sum((F.contains(F.lower(field), F.lit(p)).cast("int") for p in parts), F.lit(0)) / len(parts)
            points = points + F.when(F.contains(F.lower(field), F.lit(w)), each).otherwise(F.floor(ratio * each))
    if semantic is not None:
        points = points + F.least(F.lit(6), F.floor(6 * semantic + 0.5))
    return points


def band(points: Column) -> Column:
    return F.when(points >= 10, "high").when(points >= 5, "medium").otherwise("low")


def meta_boost(score: Column, boosts: Column, confidence: Column, multiply: bool = False) -> Column:
    """Boosts times confidence, 0.5 at most, added or multiplied."""
    b = F.least(F.lit(0.5), boosts * confidence)
    return score * (1 + b) if multiply else score + b


def graph_rank(vector: Column, ins: Column, outs: Column, type_weight: Column, relations: Column, recency: Column, metadata: Column) -> Column:
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    graph = clamp((0.4 * (2 * ins + outs) / 10 + 0.4 * type_weight + 0.2 * F.least(relations, F.lit(1.0))) / 2)
    return 0.5 * vector + 0.25 * graph + 0.1 * recency + 0.15 * metadata


def learned_boost(acceptance: Column, clicks: Column, rating: Column, accept_boost: float = 1.2, click_boost: float = 1.1) -> Column:
    by_use = F.when(acceptance > 0.7, accept_boost).when(acceptance > 0.5, click_boost).otherwise(1.0)
    return by_use * F.when(rating >= 4, 1.1).when(rating >= 3, 1.05).otherwise(1.0)


def prioritized(links: DataFrame, text: str, url: str, terms: list[str]) -> DataFrame:
    """Links with a relevance score, best first: terms in the anchor count more than in the address, documents get a bonus."""
    s = 0.7 * _share(F.col(text), terms) + 0.2 * _share(F.col(url), terms) + F.when(F.lower(url).rlike(r"\.(pdf|docx?|xml)$"), 0.1).otherwise(0.0)
    return links.withColumn("score", s).orderBy(F.desc("score"), url)


def recency_factor(at: Column, as_of: Column) -> Column:
    return T.recency_piecewise(at, as_of)
