"""Entity resolution, fusion, validation and versioning over entity tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T

FIELD_WEIGHTS = {"name": 0.3, "description": 0.2, "jurisdiction": 0.2, "date": 0.1, "type": 0.1, "uri": 0.1}


def name_confidence(sim: Column, least: float = 0.85) -> Column:
    return F.least(F.lit(0.9), 0.5 + (sim - least) / (1 - least) * 0.4)


def semantic_confidence(sim: Column, least: float = 0.75) -> Column:
    return F.least(F.lit(0.85), 0.6 + (sim - least) / (1 - least) * 0.25)


def normal_name(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return T.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _two_least(rows: DataFrame, on: list[str]) -> DataFrame:
    """(keys, least, second) ids of each key: two minima, each combined before it is shuffled."""
    some = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on)).select(*on, "id").distinct()
    least = some.groupBy(*on).agg(F.min("id").alias("least"))
    rest = some.join(least, on).where("id > least").groupBy(*on).agg(F.min("id").alias("second"))
    return least.join(rest, on, "left")


def similar_names(names: DataFrame, block: str, least: float = 0.85) -> DataFrame:
    """(block, x, y, sim): pairs of different names (block, name) of a block whose Levenshtein similarity is ``least`` or more.

    Names of length n within d edits share one of d + 1 pieces: of names with lengths m <= n, the pieces that cut the shorter name are
    looked up in the longer near their own place, so only names that share a piece are compared. ``names`` holds each name once.
    """
    d = lambda n: F.floor((1 - least) * n + 1e-9).cast("int")
    n = names.select(block, F.col("name"), F.length("name").alias("n")).where("n > 0")
    # a pair's greater length bounds its edits; the shorter may be as short as least * n
    short = n.withColumn("top", F.floor(F.col("n") / least + 1e-9).cast("int")).withColumn("big", F.explode(F.sequence("n", F.greatest("n", "top"))))
    cuts = d(F.col("big")) + 1
    short = short.select(block, F.col("name").alias("x"), "n", "big", cuts.alias("cuts"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("i"))
    begin = F.floor(F.col("i") * F.col("n") / F.col("cuts")).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("n") / F.col("cuts")).cast("int")
    short = short.select(block, "x", "n", "big", "i", F.substring("x", begin + 1, end - begin).alias("piece"))
    long = n.select(block, F.col("name").alias("y"), F.col("n").alias("big"), d(F.col("n")).alias("d"))
    # every place of a piece of a shorter name with n - d to n letters
    sizes = F.explode(F.sequence(F.greatest(F.lit(1), F.col("big") - F.col("d")), F.col("big"))).alias("m")
    at = long.select(block, "y", "big", "d", sizes).select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    b = F.floor(F.col("i") * F.col("m") / (F.col("d") + 1)).cast("int")
    e = F.floor((F.col("i") + 1) * F.col("m") / (F.col("d") + 1)).cast("int")
    at = at.select("*", b.alias("b"), (e - b).alias("k")).select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("b") - F.col("d")), F.least(F.col("b") + F.col("d"), F.greatest(F.lit(0), F.col("big") - F.col("k"))))).alias("o"))
    at = at.select(block, "y", "big", F.col("m").alias("n"), "i", F.substring("y", F.col("o") + 1, F.col("k")).alias("piece")).distinct()
    met = short.join(at, [block, "big", "n", "i", "piece"]).where("x <> y").select(block, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return met.withColumn("sim", 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))).where(F.col("sim") >= least)


def align(terms: DataFrame, vocabulary: DataFrame, least: float = 0.5) -> DataFrame:
    """(term, best, sim): for each distinct name of ``terms`` the most similar of ``vocabulary``, at ``least`` or more; only names that
    share a piece are compared."""
    a, b = terms.select("name").distinct(), vocabulary.select("name").distinct()
    every = a.union(b).distinct().select(F.lit(0).alias("block"), "name")
    p = similar_names(every, "block", least)
    pairs = p.select(F.col("x").alias("term"), F.col("y").alias("best"), "sim").union(p.select("y", "x", "sim")).union(a.join(b, "name").select("name", "name", F.lit(1.0)))
    pairs = pairs.join(a.select(F.col("name").alias("term")), "term", "left_semi").join(b.select(F.col("name").alias("best")), "best", "left_semi")
    return pairs.groupBy("term").agg(F.max(F.struct("sim", "best")).alias("m")).select("term", "m.best", "m.sim")


def find_matches(new: DataFrame, known: DataFrame, semantic: DataFrame | None = None, least_name: float = 0.85, least_semantic: float = 0.75) -> DataFrame:
    """(a, b, similarity, confidence, how): for each entity of ``new`` its matches among ``known``, the best rule for each candidate.

    Both hold (id, type, name, uri, jurisdiction, date), null where unknown. Rules: equal id 1; equal uri 1; of the same type, equal
    normalized name 0.98, names alike by Levenshtein, equal jurisdiction and date 0.9 or jurisdiction alone 0.7; ``semantic`` adds
    pairs (a, b, similarity) of vectors. Entities that share a key or a name stand for each other: the candidate is the one with the
    least id, so no rule lists all pairs of a large group.
    """
    x = new.select("id", "type", normal_name(F.col("name")).alias("name"), "uri", "jurisdiction", "date")
    y = known.select("id", "type", normal_name(F.col("name")).alias("name"), "uri", "jurisdiction", "date")

    def by(keys: list[str], similarity: float, confidence: float, how: str) -> DataFrame:
        j = x.select("id", *keys).join(_two_least(y, keys), keys)
        other = F.when(F.col("least") != F.col("id"), F.col("least")).otherwise(F.col("second"))
        return j.select(F.col("id").alias("a"), other.alias("b"), F.lit(similarity).alias("similarity"), F.lit(confidence).alias("confidence"), F.lit(how).alias("how")).where("b IS NOT NULL")

    same = x.select("id").join(y.select("id"), "id").distinct().select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("confidence"), F.lit("id").alias("how"))
    rules = [same, by(["uri"], 1.0, 1.0, "uri"), by(["type", "name"], 0.98, 0.95, "name"), by(["type", "jurisdiction", "date"], 0.9, 0.8, "metadata"), by(["type", "jurisdiction"], 0.7, 0.6, "jurisdiction")]
    names = x.select("type", "name").union(y.select("type", "name")).where("name IS NOT NULL").distinct()
    alike = similar_names(names, "type", least_name)
    both = alike.select("type", F.col("x").alias("name"), F.col("y").alias("other"), "sim").union(alike.select("type", "y", "x", "sim"))
    heads = y.where("name IS NOT NULL").groupBy("type", F.col("name").alias("other")).agg(F.min("id").alias("b"))
    near = x.select("id", "type", "name").join(both, ["type", "name"]).join(heads, ["type", "other"])
    rules.append(near.where("id <> b").select(F.col("id").alias("a"), "b", F.col("sim").alias("similarity"), name_confidence(F.col("sim"), least_name).alias("confidence"), F.lit("levenshtein").alias("how")))
    if semantic is not None:
        s = semantic.where((F.col("similarity") >= least_semantic) & (F.col("a") != F.col("b")))
        rules.append(s.select("a", "b", "similarity", semantic_confidence(F.col("similarity"), least_semantic).alias("confidence"), F.lit("semantic").alias("how")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.groupBy("a", "b").agg(F.max(F.struct("similarity", "confidence", "how")).alias("m")).select("a", "b", "m.*")


def best_match(matches: DataFrame) -> DataFrame:
    """One match an entity: the most similar, then the least id."""
    return matches.groupBy("a").agg(F.max(F.struct("similarity", -F.col("b"), "confidence", "how")).alias("m")).select("a", (-F.col("m.col2")).alias("b"), "m.similarity", "m.confidence", "m.how")


def field_similarity(sims: dict[str, Column]) -> Column:
    """Weighted mean of the fields that both sides have (a null similarity is left out)."""
    w = {k: FIELD_WEIGHTS.get(k, 0.05) for k in sims}
    total = sum((F.when(sims[k].isNotNull(), w[k]).otherwise(0.0) for k in sims), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(sims[k], F.lit(0.0)) * w[k] for k in sims), F.lit(0.0)) / total).otherwise(0.0)


def hungarian(weight: np.ndarray) -> list[tuple[int, int]]:
    """A matching of greatest total weight: shortest augmenting paths with potentials, one for each row of the shorter side."""
    if weight.shape[0] > weight.shape[1]:
        return [(i, j) for j, i in hungarian(weight.T)]
    m, n = weight.shape
    cost = np.zeros((m + 1, n + 1))
    cost[1:, 1:] = -weight
    u, v, match = np.zeros(m + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, m + 1):
        match[0], col, low, used, back = row, 0, np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[col] = True
            gap = cost[match[col]] - u[match[col]] - v
            better = ~used & (gap < low)
            better[0] = False
            low[better], back[better] = gap[better], col
            free = np.where(used, np.inf, low)
            free[0] = np.inf
            nxt = int(free.argmin())
            step = free[nxt]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col], col = match[back[col]], back[col]
    return [(int(match[c]) - 1, c - 1) for c in range(1, n + 1) if match[c] and weight[match[c] - 1, c - 1] > 0]


def matching(pairs: DataFrame, block: str) -> DataFrame:
    """(block, a, b, weight): the matching of greatest weight within each block of (block, a, b, weight)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["a", "b"])
        left, right = np.unique(f["a"]), np.unique(f["b"])
        w = np.zeros((len(left), len(right)))
        w[np.searchsorted(left, f["a"]), np.searchsorted(right, f["b"])] = f["weight"]
        got = hungarian(w)
        return pd.DataFrame({block: f[block].iloc[0], "a": [left[i] for i, _ in got], "b": [right[j] for _, j in got], "weight": [w[i, j] for i, j in got]})

    kinds = dict(pairs.dtypes)
    return pairs.select(block, "a", "b", "weight").groupBy(block).applyInPandas(run, f"{block} {kinds[block]}, a {kinds['a']}, b {kinds['b']}, weight double")


def reliability(authority: Column, recency: Column, completeness: Column, other_entities: Column) -> Column:
    """0.35 authority + 0.20 recency + 0.15 completeness + 0.30 consistency; consistency is 0.8 for a single source, else 0.5 or, with
    other entities beside it, 0.7."""
    consistency = F.when(other_entities.isNull(), 0.8).when(other_entities > 0, 0.7).otherwise(0.5)
    return 0.35 * authority + 0.2 * recency + 0.15 * completeness + 0.3 * consistency


def conflicts(claims: DataFrame, critical: tuple[str, ...] = ("type", "status")) -> DataFrame:
    """(entity, property, n_values, severity) of properties with several normalized values in (entity, property, value)."""
    v = claims.where("value IS NOT NULL").groupBy("entity", "property").agg(F.countDistinct(F.lower(T.trim(F.col("value")))).alias("n_values")).where("n_values > 1")
    return v.withColumn("severity", F.when(F.col("property").isin(*critical), "critical").when(F.col("n_values") > 2, "high").otherwise("low"))


def resolve(claims: DataFrame, strategy: str = "most_reliable") -> DataFrame:
    """(entity, property, value, confidence, decision) from (entity, property, value, reliability, ts, and recency for most_recent).

    most_reliable: the most reliable value, at 0.7 of its confidence when the runner-up is within 0.1. most_recent: the latest value, as
    sure as its recency. weighted: the mean of the numbers weighted by reliability, unrounded, as sure as the mean reliability; a property with
    any other value goes by most_reliable. human: no value, for review. Decisions: auto at 0.85 or more, review below 0.7.
    """
    keys = ["entity", "property"]
    decided = lambda c: F.when(c >= 0.85, "auto").when(c < 0.7, "review").otherwise("suggest").alias("decision")
    if strategy == "human":
        return claims.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit("review").alias("decision"))
    if strategy == "most_recent":
        got = claims.groupBy(*keys).agg(F.max(F.struct("ts", "reliability", "value", "recency")).alias("m"))
        return got.select(*keys, "m.value", F.col("m.recency").alias("confidence"), decided(F.col("m.recency")))
    if strategy == "weighted":
        # sums run in order of ts over whole groups, as a rounded mean or a decision may turn on the order of additions
        number = F.expr("try_cast(value AS double)")
        whole = Window.partitionBy(*keys).orderBy("ts", "value", "reliability").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        claims = claims.select("*", F.min(number.isNotNull()).over(whole).alias("_all"), (F.sum(number * F.col("reliability")).over(whole) / F.sum("reliability").over(whole)).alias("_mean"), F.avg("reliability").over(whole).alias("_sure"))
    w = Window.partitionBy(*keys).orderBy(F.desc("reliability"), F.desc("ts"), "value")
    r = claims.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("reliability").over(w)).where("_r = 1")
    c = F.when(F.col("reliability") - F.col("_next") < 0.1, F.col("reliability") * 0.7).otherwise(F.col("reliability"))
    if strategy == "weighted":
        mean = F.col("_all") & F.col("_mean").isNotNull()
        r = r.withColumn("value", F.when(mean, F.col("_mean").cast("string")).otherwise(F.col("value")))
        c = F.when(mean, F.col("_sure")).otherwise(c)
    return r.select(*keys, "value", c.alias("confidence"), decided(c))


def merge_entities(rows: DataFrame, key: str, order: str, columns: list[str], strategy: str = "merge_all") -> DataFrame:
    """One row a key: first non-null value by order (merge_all), the first row's (keep_primary), the last row's (keep_most_recent), or
    each column by ``resolve`` over rows that also have a reliability (resolve_conflicts), its values as text."""
    if strategy == "resolve_conflicts":
        long = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns))).alias("_p")
        claims = rows.select(F.col(key).alias("entity"), "reliability", F.col(order).alias("ts"), long).select("entity", "reliability", "ts", "_p.*").where("value IS NOT NULL")
        return resolve(claims).groupBy(F.col("entity").alias(key)).pivot("property", columns).agg(F.first("value"))
    if strategy == "merge_all":
        aggs = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    else:
        pick = F.min_by if strategy == "keep_primary" else F.max_by
        aggs = [pick(c, order).alias(c) for c in columns]
    return rows.groupBy(key).agg(*aggs)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_anti")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is true for sound rows, null counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def triplet_quality(parts: list[Column]) -> Column:
    """Six parts weighted 0.25, 0.25, 0.20, 0.10, 0.10, 0.10."""
    return sum((p * w for p, w in zip(parts, (0.25, 0.25, 0.2, 0.1, 0.1, 0.1), strict=True)), F.lit(0.0))


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): new, updated, deleted or same, by a hash of the columns."""
    a, b = old.select(key, row_hash(columns).alias("_o")), new.select(key, row_hash(columns).alias("_n"))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "updated").otherwise("same").alias("change"))


def apply_changes(old: DataFrame, new: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """The table after a change set; deleted rows stay, marked."""
    c = change.select(key, "change")
    fresh = new.join(c.where("change IN ('new', 'updated')"), key, "left_semi").withColumn("deleted", F.lit(False))
    kept = old.join(c.where("change IN ('new', 'updated')"), key, "left_anti").join(c.where("change = 'deleted'").select(key, F.lit(True).alias("_d")), key, "left")
    return fresh.unionByName(kept.withColumn("deleted", F.coalesce("_d", F.lit(False))).drop("_d"))


def versions(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Rows with version numbers and the next version's time."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("until", F.lead(at).over(w))


def active_on(rows: DataFrame, start: str, end: str, day: str) -> DataFrame:
    d = F.lit(day).cast("timestamp")
    return rows.where((F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | (F.col(end) >= d)))


def merge_versions(base: DataFrame, other: DataFrame, key: str, value: str, strategy: str = "other") -> DataFrame:
    """Both sides' keys; where both have one, the value of ``strategy``: base or other."""
    j = base.select(key, F.col(value).alias("_b")).join(other.select(key, F.col(value).alias("_o")), key, "full_outer")
    return j.select(key, (F.coalesce("_o", "_b") if strategy == "other" else F.coalesce("_b", "_o")).alias(value))


def overlapping_periods(rows: DataFrame, key: str, group: str, start: str, end: str) -> DataFrame:
    """(a, b): rows of a group whose periods overlap, the lesser key first.

    A running latest end cuts each group where no earlier period reaches, so rows meet only within such a stretch; there they are dealt
    to cells as long as the stretch's mean period, a pair meets in the cell where its later period starts, and only neighbours are
    compared. Its cost is that of its result, but for periods far longer than their stretch's mean.
    """
    r = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(start).cast("timestamp").alias("s"), F.col(end).cast("timestamp").alias("e")).where("s <= e")
    upto = F.max("e").over(Window.partitionBy("g").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", (upto.isNull() | (F.col("s") > upto)).cast("int"))
    r = r.withColumn("run", F.sum("_new").over(Window.partitionBy("g").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, 0)))
    us = lambda c: F.unix_micros(c)
    width = F.greatest(F.lit(1), F.avg(us(F.col("e")) - us(F.col("s"))).over(Window.partitionBy("g", "run")).cast("long"))
    alone = F.count("*").over(Window.partitionBy("g", "run"))
    r = r.withColumn("w", width).withColumn("_n", alone).where("_n > 1")
    at = lambda c: F.expr(f"unix_micros({c}) div w")
    later = r.select("g", "run", F.col("k").alias("kb"), F.col("s").alias("sb"), F.col("e").alias("eb"), at("s").alias("cell"))
    first = r.select("g", "run", F.col("k").alias("ka"), F.col("s").alias("sa"), F.col("e").alias("ea"), F.explode(F.sequence(at("s"), at("e"))).alias("cell"))
    met = first.join(later, ["g", "run", "cell"]).where("ka <> kb AND sb BETWEEN sa AND ea AND (sa < sb OR ka < kb)")
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def on_branch(rows: DataFrame, key: str, branch: str, base: str = "main") -> DataFrame:
    """The table as a branch sees it: its own row of a key, else the base's; other branches' rows are left out."""
    own = rows.where(F.col("branch") == branch)
    return own.unionByName(rows.where(F.col("branch") == base).join(own.select(key), key, "left_anti"))


def compare_branches(rows: DataFrame, key: str, value: str, left: str, right: str) -> DataFrame:
    """(key, change) between two branches' own rows: added, removed, modified or same."""
    side = lambda b, n: rows.where(F.col("branch") == b).select(key, F.struct(value).alias(n))
    j = side(left, "_l").join(side(right, "_r"), key, "full_outer")
    return j.select(key, F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("_l").eqNullSafe(F.col("_r")), "same").otherwise("modified").alias("change"))


def merge_branches(rows: DataFrame, key: str, value: str, source: str, target: str, base: str, strategy: str = "source") -> DataFrame:
    """(key, value, conflict): ``target`` after ``source`` is merged into it, against their common ``base``: what one side alone
    changed is taken; where both did differently, ``strategy`` (source, target or base) decides and the row is marked."""
    side = lambda b, n: on_branch(rows, key, b, base).select(key, F.struct(value).alias(n))
    j = side(base, "_b").join(side(source, "_s"), key, "full_outer").join(side(target, "_t"), key, "full_outer")
    b, s, t = F.col("_b"), F.col("_s"), F.col("_t")
    mine, theirs = ~s.eqNullSafe(b), ~t.eqNullSafe(b)
    conflict = mine & theirs & ~s.eqNullSafe(t)
    got = F.when(conflict, {"source": s, "target": t, "base": b}[strategy]).when(mine, s).otherwise(t)
    return j.select(key, got[value].alias(value), conflict.alias("conflict")).where(F.col(value).isNotNull())


def uncertainty(confidence: Column, labels: Column, disagreement: Column) -> Column:
    """Additive: unsure scores, many labels, disagreeing judges."""
    return F.least(F.lit(1.0), F.when(F.abs(confidence - 0.5) < 0.1, 0.5).when(confidence < 0.7, 0.3).otherwise(0.0) + F.when(labels > 3, 0.2).otherwise(0.0) + F.when(disagreement, 0.3).otherwise(0.0))


def extract_iter(frames: Iterator[pd.DataFrame], fn, text: str) -> Iterator[pd.DataFrame]:
    """Applies an injected function of texts (a model or a provider) to batches; the extension point for language models."""
    for f in frames:
        yield f.assign(out=fn(f[text]))
