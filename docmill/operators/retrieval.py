"""Keyword and vector search, fusion and reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T
from docmill.operators import analytics as A

FIELD_BOOSTS = {"title": 10.0, "summary": 5.0, "relevance": 5.0, "label": 2.0, "url": 1.0}


def keyword_regex(title: Column, text: Column, terms: list[str], indexed: bool = False) -> Column:
    """(10 title hits + text hits) / (11 terms), at most 1; 1.2 times that with a text index; 0.5 without terms."""
    if not terms:
        return F.lit(0.5)
    hit = lambda c, w: c.rlike(rf"(?i)\Q{w}\E").cast("int")
    points = sum((10 * hit(title, w) + hit(text, w) for w in terms), F.lit(0))
    return F.least(F.lit(1.0), points / (11.0 * len(terms)) * (1.2 if indexed else 1.0))


def keyword_contains(title: Column, text: Column, terms: list[str]) -> Column:
    points = sum((10 * F.contains(F.lower(title), F.lit(w)).cast("int") + F.contains(F.lower(text), F.lit(w)).cast("int") for w in terms), F.lit(0))
    return F.least(F.lit(100.0), points / 10)


def keyword_boost(fields: dict[str, Column], phrase: str) -> Column:
    return sum((c.rlike(rf"(?i)\Q{phrase}\E").cast("int") * FIELD_BOOSTS[k] for k, c in fields.items()), F.lit(0.0))


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf, df, n): an index that a search may filter by token."""
    n = df.agg(F.count("*").alias("n"))
    tf = df.select(key, F.explode(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))
    return tf.join(tf.groupBy("token").agg(F.count("*").alias("df")), "token").join(F.broadcast(n), F.lit(True))


def text_search(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score): tf-idf over documents that hold any term."""
    return index.where(F.col("token").isin(terms)).groupBy(key).agg(F.sum(F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("score"))


def vector_top(df: DataFrame, key: str, vector: str, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """Exact cosine top k; a heap of k rows a task, no sort of all."""
    s = df.select(key, T.cosine(F.col(vector), F.lit(query).cast("array<double>")).alias("score"))
    return (s if least is None else s.where(F.col("score") >= least)).orderBy(F.desc("score"), key).limit(k)


def nearest(df: DataFrame, key: str, vector: str, block: str, k: int, least: float, cell_rows: int = 4096) -> DataFrame:
    """(a, b, s): the k nearest other rows of each row by cosine to 9 places, at ``least`` (above 0) or more, within its block; ties go to
    the smaller key. Rows meet in cells of about ``cell_rows`` by ``cell_rows``, so a task is bounded however large a block is. Vectors with
    null or non-finite components, without a length or without a block take no part."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), F.col(block).alias("block"), x.alias("v"), F.size(vector).alias("dim"))
    rows = rows.where("id IS NOT NULL AND block IS NOT NULL AND dim > 0").where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    groups = rows.groupBy("block", "dim").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("g"))
    rows = rows.join(groups, ["block", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), "g").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    asks = rows.select("block", "dim", F.col("own").alias("qg"), every.alias("xg"), "id", "v", F.lit(True).alias("ask"))
    gives = rows.select("block", "dim", every.alias("qg"), F.col("own").alias("xg"), "id", "v", F.lit(False).alias("ask"))

    def cell(f: pd.DataFrame) -> pd.DataFrame:
        q, c = f[f["ask"]], f[~f["ask"]].sort_values("id")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            y, ids = np.stack(c["v"].to_list()), c["id"].to_numpy()
            long = np.linalg.norm(y, axis=1)
            for i in range(0, len(q), 256):
                z, own = np.stack(q["v"].iloc[i : i + 256].to_list()), q["id"].to_numpy()[i : i + 256]
                norms = np.linalg.norm(z, axis=1)[:, None] * long[None, :]
                s = np.round(np.divide(z @ y.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)
                s[(own[:, None] == ids[None, :]) | (s < least)] = -np.inf
                low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                for j in range(len(s)):
                    at = np.flatnonzero((s[j] >= low[j]) & (s[j] > -np.inf))  # all ties of the last place, by key
                    at = at[np.argsort(-s[j, at], kind="stable")[:k]]
                    out.append((np.full(len(at), own[j]), ids[at], s[j, at]))
        return pd.DataFrame(dict(zip("abs", map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {"a": [], "b": [], "s": []})

    kind = dict(df.dtypes)[key]
    part = asks.unionByName(gives).groupBy("block", "dim", "qg", "xg").applyInPandas(cell, f"a {kind}, b {kind}, s double")
    return A.top_n_per_group(part, "a", "s", "b", k).select("a", "b", "s")


def lsh_buckets(df: DataFrame, key: str, vector: str, dim: int, tables: int = 5, bits: int = 10, seed: int = 7) -> DataFrame:
    """(key, table, bucket): sign bits of seeded random hyperplanes."""
    import random

    rng = random.Random(seed)
    rows = []
    for t in range(tables):
        planes = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)]
        sign = [F.when(T.dot(F.col(vector), F.lit(p).cast("array<double>")) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
        rows.append(F.struct(F.lit(t).alias("table"), sum(sign, F.lit(0)).alias("bucket")))
    return df.select(key, F.explode(F.array(*rows)).alias("b")).select(key, "b.*")


def lsh_top(df: DataFrame, key: str, vector: str, query: list[float], k: int, **options) -> DataFrame:
    """Top k among rows that share a bucket with the query; all rows are scored where fewer than 5 k do."""
    q = df.sparkSession.createDataFrame([(query,)], "q array<double>").withColumn("_id", F.lit(0))
    mine = lsh_buckets(q.withColumnRenamed("q", vector), "_id", vector, len(query), **options).select("table", "bucket")
    near = lsh_buckets(df, key, vector, len(query), **options).join(F.broadcast(mine), ["table", "bucket"], "left_semi").select(key).distinct()
    few = near.limit(5 * k).count() < 5 * k
    return vector_top(df if few else df.join(near, key, "left_semi"), key, vector, query, k)


def semantic(chunks: DataFrame, doc: str, chunk: str, vector: str, query: list[float], k: int, least: float = 0.7) -> DataFrame:
    """Best chunk of each document among the top 5 k chunks, at or above ``least``, k documents."""
    top = chunks.select(doc, chunk, T.cosine(F.col(vector), F.lit(query).cast("array<double>")).alias("score")).orderBy(F.desc("score"), chunk).limit(5 * k)
    return top.groupBy(doc).agg(F.max("score").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), doc).limit(k)


def _both(kw: DataFrame, sem: DataFrame, key: str) -> DataFrame:
    a, b = kw.withColumn("_k", F.lit(True)), sem.withColumn("_s", F.lit(True))
    return a.join(b, key, "full_outer")


def fuse_weighted(kw: DataFrame, sem: DataFrame, key: str, w_kw: float = 0.4, w_sem: float = 0.6) -> DataFrame:
    """Min-max normalized lists (key, score), weighted; in both lists 1.1 times, at most 1."""
    a = A.min_max(kw, None, "score").select(key, F.col("norm").alias("kw"))
    b = A.min_max(sem, None, "score").select(key, F.col("norm").alias("sem"))
    j = _both(a, b, key)
    s = w_kw * F.coalesce("kw", F.lit(0.0)) + w_sem * F.coalesce("sem", F.lit(0.0))
    return j.select(key, F.when(F.col("_k") & F.col("_s"), F.least(s * 1.1, F.lit(1.0))).otherwise(s).alias("score"))


def fuse_rrf(kw: DataFrame, sem: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal ranks of two result lists (key, score), 1.1 times where both have the key."""
    rank = lambda d, n: d.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(n))
    j = _both(rank(kw, "ka"), rank(sem, "sb"), key)
    s = F.coalesce(1 / (k + F.col("ka")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("sb")), F.lit(0.0))
    return j.select(key, (s * F.when(F.col("_k") & F.col("_s"), 1.1).otherwise(1.0)).alias("score"))


def merge_geo(kw: Column, sem: Column, geo: Column | None = None) -> Column:
    """0.7 sem + 0.3 kw, or 0.6, 0.3 and 0.1 with geo; without sem kw alone, or 0.7 kw + 0.3 geo. A kw of 0 counts as 0.5."""
    k = F.when(F.coalesce(kw, F.lit(0.0)) == 0, 0.5).otherwise(kw)
    if geo is None:
        return F.when(sem.isNull(), k).otherwise(0.7 * sem + 0.3 * k)
    return F.when(sem.isNull(), 0.7 * k + 0.3 * geo).otherwise(0.6 * sem + 0.3 * k + 0.1 * geo)


def rerank(results: DataFrame, key: str, score: str, reranked: Column, top: int = 20) -> DataFrame:
    """The first ``top`` by 0.6 score + 0.4 reranker (0.5 where missing), the rest after them in their order."""
    r = results.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key)))
    new = F.when(F.col("_r") <= top, 0.6 * F.col(score) + 0.4 * F.coalesce(reranked, F.lit(0.5)))
    r = r.withColumn("final", F.coalesce(new, F.col(score)))
    w = Window.orderBy((F.col("_r") > top).cast("int"), F.when(F.col("_r") <= top, -F.col("final")).otherwise(F.col("_r")), key)
    return r.withColumn("rank", F.row_number().over(w)).drop("_r")


def chunk_score(text: Column, terms: list[str]) -> Column:
    """Per term found 1 + 0.5 (occurrences - 1), over the number of terms."""
    n = lambda w: F.regexp_count(F.lower(text), F.lit(rf"\Q{w}\E"))
    return sum((F.when(n(w) > 0, 1 + 0.5 * (n(w) - 1)).otherwise(0.0) for w in terms), F.lit(0.0)) / len(terms)


def expand(queries: DataFrame, key: str, text: str, synonyms: DataFrame) -> DataFrame:
    """(key, terms): query terms and their synonyms (term, synonym), sorted."""
    w = queries.select(key, F.explode(T.query_terms(F.col(text))).alias("term"))
    both = w.unionByName(w.join(synonyms, "term").select(key, F.col("synonym").alias("term")))
    return both.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def fact_score(name: Column, description: Column, terms: list[str], type_match: Column, place_match: Column) -> Column:
    s = F.lit(0.5) + 0.2 * type_match.cast("int") + 0.2 * place_match.cast("int")
    for w in terms:
        s = s + F.when(F.contains(F.lower(name), F.lit(w)), 0.3).when(F.contains(F.lower(description), F.lit(w)), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def kg_confidence(entity: Column, source: Column, relationship: Column, temporal: Column) -> Column:
    return 0.3 * entity + 0.3 * source + 0.2 * relationship + 0.2 * temporal


def community_score(semantic: Column | None, kw: Column, size: Column) -> Column:
    return 0.7 * semantic + 0.3 * kw if semantic is not None else 0.4 * kw + 0.4 * F.lit(0.0) + 0.2 * F.least(size / 100, F.lit(1.0))


def relation_score(frequency: Column, compatible: Column, pattern: Column, gap_days: Column) -> Column:
    near = F.when(gap_days <= 30, 1.0).when(gap_days <= 365, 0.7).when(gap_days <= 1825, 0.4).otherwise(0.2)
    return 0.25 * frequency + 0.3 * F.when(compatible, 1.0).otherwise(0.3) + 0.3 * pattern + 0.15 * near


def entropy_conflict(before: Column, after: Column, threshold: float = 0.1) -> Column:
    delta = after - before
    return F.when(delta > 0.3, "high").when(delta > threshold, "medium").otherwise("none")


#: The weights of a result's scores, and of graph against vector in a fact's.
RANK_WEIGHTS = {"vector": 0.5, "graph": 0.25, "recency": 0.1, "metadata": 0.15}
FACT_WEIGHTS = {"graph": 0.6, "vector": 0.4}


def hybrid_kg(vector: DataFrame, entities: DataFrame, about: DataFrame, edges: DataFrame, limit: int = 5, related: int = 10) -> tuple[DataFrame, DataFrame]:
    """(documents, related entities) of a question: vector hits (id, score) and entity hits (id, score) ranked together.

    ``about``: (id, uri, recency, metadata), each null where unknown and then 0.5. A document's score is the weighted sum of its four
    scores, a side that didn't find it counting 0; of documents with one uri the best stays. Related entities are the neighbours of
    what was found in edges (src, dst), by how many results they touch. Only the ``limit`` best reach one task.
    """
    hits = vector.select("id", F.col("score").alias("v")).join(entities.select("id", F.col("score").alias("g")), "id", "full_outer").join(about, "id", "left")
    part = {"vector": F.coalesce("v", F.lit(0.0)), "graph": F.coalesce("g", F.lit(0.0)), "recency": F.coalesce("recency", F.lit(0.5)), "metadata": F.coalesce("metadata", F.lit(0.5))}
    rank = sum((w * part[k] for k, w in RANK_WEIGHTS.items()), F.lit(0.0))
    ranked = hits.select("id", "uri", F.round(rank, 9).alias("score"))
    best = ranked.where("uri IS NOT NULL").groupBy("uri").agg(F.max(F.struct("score", (-F.col("id")).alias("n"))).alias("m")).select((-F.col("m.n")).alias("id"), "uri", "m.score")
    docs = ranked.where("uri IS NULL").unionByName(best.select("id", "uri", "score")).orderBy(F.desc("score"), "id").limit(limit)
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = both.join(F.broadcast(docs.select(F.col("id").alias("src"))), "src").join(F.broadcast(docs.select(F.col("id").alias("dst"))), "dst", "left_anti")
    near = near.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("touches")).orderBy(F.desc("touches"), "id").limit(related)
    return docs, near


def graph_rag(facts: DataFrame, chunks: DataFrame, most_facts: int = 10, per_fact: int = 5, per_query: int = 20, least: float = 0.3) -> DataFrame:
    """(place, fact, chunk, score, citation) of a question: ranked facts, each with the chunks that support it.

    ``facts``: (id, relevance), of which the ``most_facts`` best are kept; ``chunks``: (id, entity, similarity), at ``least`` or more, at most
    ``per_fact`` an entity and ``per_query`` in all, a chunk once, with its best fact. A row's score is 0.6 of its fact's and 0.4 of its
    chunk's; a fact without a chunk stands alone. Citations number the facts in order.
    """
    top = facts.orderBy(F.desc("relevance"), "id").limit(most_facts)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("relevance"), "id"))).select("place", F.col("id").alias("fact"), "relevance")
    c = chunks.where(F.col("similarity") >= least).join(F.broadcast(top), F.col("entity") == F.col("fact"))
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("fact").orderBy(F.desc("similarity"), "id"))).where(F.col("_r") <= per_fact)
    c = c.groupBy("id").agg(F.max(F.struct("relevance", (-F.col("place")).alias("n"), "fact", "similarity")).alias("m"))
    c = c.select(F.col("id").alias("chunk"), "m.fact", "m.similarity").orderBy(F.desc("similarity"), "chunk").limit(per_query)
    out = top.join(c, "fact", "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), FACT_WEIGHTS["graph"] * F.col("relevance") + FACT_WEIGHTS["vector"] * F.coalesce("similarity", F.lit(0.0))))
    return out.select("place", "fact", "chunk", score.alias("score"), F.concat(F.lit("["), "place", F.lit("]")).alias("citation"))


PROVIDERS: dict[str, dict[str, object]] = {"embed": {}, "llm": {}}


def provider(kind: str, name: str):
    """Registers a model: a function of a series of texts to vectors (embed) or to texts (llm), run in batches where the rows are."""

    def add(f):
        PROVIDERS[kind][name] = f
        return f

    return add


def through(df: DataFrame, text: str, kind: str, name: str, out: str = "out") -> DataFrame:
    """``df`` with the named provider's answer to its texts; a provider that fails or is unknown is an error, not an empty answer."""
    f = PROVIDERS[kind][name]

    @F.pandas_udf("array<double>" if kind == "embed" else "string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(f(texts.fillna("")))

    return df.withColumn(out, run(F.col(text)))


@provider("embed", "letters")
def _(texts: pd.Series):
    """Shares of the 26 letters: a stand-in without a model."""
    import string

    low = texts.str.lower()
    counts = np.array([[t.count(ch) for ch in string.ascii_lowercase] for t in low], float).reshape(len(low), 26)
    return list(counts / np.maximum(counts.sum(1, keepdims=True), 1))


@provider("llm", "first_sentence")
def _(texts: pd.Series):
    """The first sentence: the deterministic answer where no model is given."""
    return texts.str.extract(r"(?s)^\s*(.*?[.!?](?=\s|$)|.*)", expand=False).str.strip()


class ResultCache:
    """Results by key, kept as Spark's cached tables: the least recently used go beyond ``most``, and each after ``ttl`` seconds."""

    def __init__(self, spark, ttl: float = 300.0, most: int = 100):
        self.ttl, self.most, self.hits = ttl, most, 0
        self._held: dict[str, tuple[float, DataFrame]] = {}

    def get(self, key: str, make) -> DataFrame:
        """The cached result of ``key``, or that of ``make()``, which is then cached."""
        import time

        now = time.monotonic()
        if key in self._held and now - self._held[key][0] <= self.ttl:
            self.hits += 1
            self._held[key] = self._held.pop(key)
            return self._held[key][1]
        self.drop(key)
        self._held[key] = (now, make().cache())
        while len(self._held) > self.most:
            self.drop(next(iter(self._held)))
        return self._held[key][1]

    def drop(self, key: str) -> None:
        if key in self._held:
            self._held.pop(key)[1].unpersist()
