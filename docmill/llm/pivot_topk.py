"""Exact top-k by inner product with a table of pivot distances (LAESA-style elimination).

With d the Euclidean distance, 2 q.x = |q|^2 + |x|^2 - d(q, x)^2, and d(q, x) is at least |d(q, p) - d(x, p)| for each pivot p.
So the largest of these differences, over many pivots whose distances are stored beforehand, bounds a score from above
without touching x. Candidates are evaluated in the order of that bound until it falls below the k-th best exact score.

Queries and candidates meet in blocks: a grid of (query group, candidate group) cells, each bounded in both directions, so a
task holds at most ``query_rows`` queries and ``cell_rows`` candidates however many rows there are. Each cell returns k rows a
query, and a second grouping merges them.

Defined cases: vectors that are null, hold null or non-finite components, or are empty take no part; only vectors of one
length meet; rows with the query's vec_id count as its own; a repeated query row answers once; query rows of one vec_id with different vectors give one list, of the best over all of them; ties go to the smaller vec_id;
scores beyond 64 bits are held at the bounds of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import common

PIVOTS = 32
SAMPLE = 4096
_STEP = 256


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * component), whole numbers held as doubles; unusable vectors are left out."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    floor = F.transform(x, lambda e: F.expr("0.0D") + F.rint(e * scale) - F.when(F.rint(e * scale) > e * scale, 1.0).otherwise(0.0))
    return vectors.where(ok).select("vec_id", floor.alias("v"))


def pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By vector length, up to ``count`` pivots far from each other, from a fixed sample of at most ``sample`` vectors.

    Any pivots give exact results; the sample only decides how much they save.
    """
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    out: dict[int, np.ndarray] = {}
    for dim in sorted({len(r["v"]) for r in picked}):
        x = np.array([r["v"] for r in picked if len(r["v"]) == dim])
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(count, len(x)):
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        out[dim] = x[chosen]
    return out


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - p[None, :, :]) ** 2).sum(2), 0)) if len(x) * len(p) * x.shape[1] < 1 << 24 else np.concatenate([_distances(x[i : i + 4096], p) for i in range(0, len(x), 4096)])


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64: in doubles while they stay below 2^53, else in Python's integers."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 2.0**52:
        return (x @ q).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x.tolist()]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in big], np.int64)


def eliminate(qid: np.ndarray, q: np.ndarray, qp: np.ndarray, xid: np.ndarray, x: np.ndarray, xp: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """((query_id, vec_id, score) of the k best candidates of each query, exact evaluations made)."""
    half = (x**2).sum(1) / 2
    order = np.argsort(xid, kind="stable")
    xid, x, xp, half = xid[order], x[order], xp[order], half[order]
    out, made = [], 0
    for i in range(len(q)):
        own = (q[i] ** 2).sum() / 2
        low = np.abs(xp[:, 0] - qp[i, 0])
        for p in range(1, xp.shape[1]):
            np.maximum(low, np.abs(xp[:, p] - qp[i, p]), out=low)
        bound = half + own - low**2 / 2
        bound += 1 + 1e-9 * (half + own)  # room for rounding
        bound[xid == qid[i]] = -np.inf
        left, best_s, best_i, start, step = int((xid != qid[i]).sum()), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, _STEP
        ranked = np.argpartition(-bound, min(4 * step, len(bound) - 1)) if len(bound) else np.zeros(0, np.int64)
        head = min(4 * step, len(bound))
        ranked[:head] = ranked[:head][np.argsort(-bound[ranked[:head]], kind="stable")]
        whole = head == len(bound)
        while start < left:
            if start >= head and not whole:
                rest = ranked[head:]  # the head keeps its places, so that each candidate is met once, equal bounds or not
                ranked[head:], whole = rest[np.argsort(-bound[rest], kind="stable")], True
            if len(best_s) == k and bound[ranked[start]] < best_s[-1]:
                break
            at = ranked[start : min(start + step, left, len(ranked) if whole else head)]
            made += len(at)
            s = np.concatenate([best_s, _scores(x[at], q[i])])
            ids = np.concatenate([best_i, xid[at]])
            keep = np.lexsort((ids, -s.astype(object)))[:k] if len(s) and s.min() == -(1 << 63) else np.lexsort((ids, -s))[:k]
            best_s, best_i = s[keep], ids[keep]
            start += len(at)
        out += [(int(qid[i]), int(b), int(a)) for b, a in zip(best_i, best_s, strict=True)]
    return out, made


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, count: int = PIVOTS, query_rows: int = 8192, cell_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = common.written(quantized(vectors, scale), "pivot-rows")
    # per length: a table of distances is made once and stored
    table = {d: spark.sparkContext.broadcast(p) for d, p in pivots(rows, count).items()}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby(f["v"].map(len)):
                x = np.stack(part["v"].to_list())
                p = table[dim].value if dim in table else x[:0]
                d = _distances(x, p) if len(p) else np.zeros((len(x), 1))
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "dim": dim, "v": [r.tobytes() for r in x], "d": [r.tobytes() for r in d]})

    known = common.written(rows.mapInPandas(measure, "vec_id long, dim int, v binary, d binary"), "pivot-table")
    n = known.count()
    asked = F.pmod("vec_id", F.lit(every)) == 0
    groups = known.where(asked).count() // query_rows + 1
    cells = max(n // cell_rows + 1, min(4 * spark.sparkContext.defaultParallelism, n // 512 + 1))
    all_q, all_x = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(cells - 1))
    at = F.xxhash64("vec_id", "v")
    asks = known.where(asked).dropDuplicates(["vec_id", "v"]).withColumn("qg", F.pmod(at, F.lit(groups)).cast("int")).withColumn("xg", F.explode(all_x)).withColumn("ask", F.lit(True))
    # repeated rows spread over the cells, so a place is drawn from the row's place in its partition
    gives = known.withColumn("xg", F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int")).withColumn("qg", F.explode(all_q)).withColumn("ask", F.lit(False))

    def cell(f: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        mine, theirs = f[f["ask"]], f[~f["ask"]]
        for dim, q in mine.groupby("dim"):
            x = theirs[theirs["dim"] == dim]
            if len(x):
                mat = lambda s: np.frombuffer(b"".join(s), np.float64).reshape(len(s), -1)
                found += eliminate(q["vec_id"].to_numpy(), mat(q["v"]), mat(q["d"]), x["vec_id"].to_numpy(), mat(x["v"]), mat(x["d"]), k)[0]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    # query rows of one vec_id with different vectors give one list: the k best scores over all of them
    both = asks.unionByName(gives)
    part = both.groupBy("dim", "qg", "xg").applyInPandas(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
