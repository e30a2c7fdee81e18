"""Quality classifier: a generalised additive model with pairwise interactions, boosted by cycling over its terms.

Each feature is cut into at most ``bins`` bins. Boosting visits the features in turn, again and again, and adds a small step
of a shallow tree (up to four leaves) over that feature's bins to its lookup table; then the pairs of features that explain most of
what is left get tables over coarse bins, boosted likewise. A score is the sigmoid of the intercept and one table entry a term,
so scoring is a search for bins and additions over whole batches.

The model is fitted on at most ``sample`` labelled rows (a documented bound) outside the held-out third; every document is
scored on its whole text.

Defined cases: a null or empty text has zero features and gets a score; without labels, or with one class only, the
intercept alone answers (0.5 without labels); a doc_id labelled several times takes the lowest label; null labels don't
count; a null doc_id isn't held out; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import common, pretok

FEATURES = ("log_words", "word_bytes", "distinct", "stutter", "capitals", "digits", "symbols", "shouts", "bars", "stops", "dup_lines", "non_ascii", "bare")
SAMPLE = 20_000

_KIND = np.zeros((7, 256), bool)
_KIND[0, 65:91] = True  # capitals
_KIND[1, 65:91] = _KIND[1, 97:123] = True  # letters
_KIND[2, 48:58] = True
_KIND[3, [ord(c) for c in "#*$%&<>"]] = True
_KIND[4, ord("!")] = True
_KIND[5, ord("|")] = True
_KIND[6, [ord(c) for c in ".,;:"]] = True


def _first_seen(key: np.ndarray, of: np.ndarray, docs: int) -> np.ndarray:
    """How many distinct keys each document has; ``of`` is the document of each key."""
    import pandas as pd

    fresh = ~pd.Series(pretok.mix(key ^ pretok.mix(of.astype(np.uint64) + np.uint64(1)))).duplicated().to_numpy()
    return np.bincount(of[fresh], minlength=docs)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, features) of the texts data[off[i]:off[i + 1]]."""
    docs = len(off) - 1
    out = np.zeros((docs, len(FEATURES)))
    if not len(data):
        return out
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off])
    starts, ends, n = pretok.words(data, off)
    of = np.repeat(np.arange(docs), n)
    h = pretok.span_hashes(data, starts, ends)
    words, size = np.maximum(n, 1), np.maximum(np.diff(off), 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    letter = np.concatenate([[0], np.cumsum(_KIND[1][data] | (data >= 0x80), dtype=np.int64)])
    # lines that hold a word, by their first word's place: a line is the bytes between line ends
    nl = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], nl + 1]))
    ls = ls[ls < len(data)]
    le = np.append(ls[1:], len(data))
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[has], le[has]
    le = np.where(data[le - 1] == 10, le - 1, le)
    lof = np.searchsorted(off, ls, side="right") - 1
    lines = np.bincount(lof, minlength=docs)
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.bincount(of, ends - starts, docs) / words
    out[:, 2] = _first_seen(h, of, docs) / words
    out[:, 3] = np.bincount(of, same, docs) / words
    out[:, 4] = per(_KIND[0][data]) / np.maximum(per(_KIND[1][data]), 1)
    out[:, 5] = per(_KIND[2][data]) / size
    for k in (3, 4, 5, 6):
        out[:, 3 + k] = per(_KIND[k][data]) / words
    out[:, 10] = (lines - _first_seen(pretok.span_hashes(data, ls, le), lof, docs)) / np.maximum(lines, 1) if len(ls) else 0
    out[:, 11] = per(data >= 0x80) / size
    out[:, 12] = np.bincount(of, letter[ends] == letter[starts], docs) / words
    return out


@dataclass
class Model:
    """edges: by feature; tables: by feature; pairs: (i, j, coarse edges i, coarse edges j, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best cut of ordered bins with gradient sums g and weights h; cut 0: none."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The value of each bin under a tree over ordered bins."""
    cut = _split(g, h)[1] if depth else 0
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, cell values) of the better tree that cuts one axis, then each side along the other."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        gt, ht = (g.T, h.T) if turn else (g, h)
        cut = _split(gt.sum(1), ht.sum(1))[1]
        if not cut:
            continue
        value, gain = np.zeros_like(gt), -_gain(gt.sum(), ht.sum())
        for part in (slice(0, cut), slice(cut, None)):
            gs, hs = gt[part].sum(0), ht[part].sum(0)
            value[part] = leaf = _tree(gs, hs, 1)
            gain += sum(_gain(gs[leaf == v].sum(), hs[leaf == v].sum()) for v in np.unique(leaf))
        if gain > best[0]:
            best = (float(gain), value.T if turn else value)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1) -> Model:
    """Fits rows x (features) to labels y (0 or 1)."""
    nf = x.shape[1] if x.ndim == 2 else len(FEATURES)
    mean = float(y.mean()) if len(y) else 0.5
    prior = float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    if not len(y) or mean in (0.0, 1.0):
        return Model(prior, [np.zeros(0)] * nf, [np.zeros(1)] * nf, [])
    cuts = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    edges = [cuts(x[:, f], bins) for f in range(nf)]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), prior)

    def grads() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(nf):
            r, w = grads()
            n = len(tables[f])
            step = rate * _tree(np.bincount(at[f], r, n), np.bincount(at[f], w, n))
            tables[f] += step
            z += step[at[f]]
    ce = [cuts(x[:, f], coarse) for f in range(nf)]
    ca = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(ce)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        r, w = grads()
        shape = (len(ce[i]) + 1, len(ce[j]) + 1)
        cell = ca[i] * shape[1] + ca[j]
        return np.bincount(cell, r, shape[0] * shape[1]).reshape(shape), np.bincount(cell, w, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_cross(*sums(i, j))[0], -i, -j) for i in range(nf) for j in range(i + 1, nf)), reverse=True)[:pairs]
    chosen = [[-i, -j, np.zeros((len(ce[-i]) + 1, len(ce[-j]) + 1))] for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, t in chosen:
            step = rate * _cross(*sums(i, j))[1]
            t += step
            z += step[ca[i], ca[j]]
    return Model(prior, edges, tables, [(i, j, ce[i], ce[j], t) for i, j, t in chosen])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out third, taken in the order of a hash of doc_id."""
    common.small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_y")).where(~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` ids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 1 << 20):
            x = features(*common.text_buffers(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2).cast(pa.int32())], ["doc_id", "x", "y"])

    # one row a doc_id, the same whatever the order of arrival
    seen = rows.mapInArrow(measure, "doc_id long, x binary, y int").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    got = sorted(seen.select("x", "y").collect(), key=lambda r: (bytes(r["x"]), r["y"]))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([min(max(r["y"], 0), 1) for r in got], float), **options)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the score of each whole text."""
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in common.slices(batches, "text", 1 << 20):
            s = m.score(features(*common.text_buffers(b.column(place))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def apply(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` predicted to be good."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever the columns are called
    return scored(rows, train(docs, labels, **options)).where("score >= 0.5").select("row.*")
