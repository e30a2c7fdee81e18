"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Weights. A shingle is five words; its weight is (1 + ln tf) (1 + ``lift`` idf / idf_max). Document frequencies are counted over
all documents in a count-min sketch of fixed size, so what is broadcast doesn't grow; its error is a fixed share of the number
of documents, and idf is cut off at that share, the same at every size. The lift is kept small so that shingles shared within a
large group of copies don't lose their weight merely because the group is large.

Candidates. Each text gets 64 ICWS samples, in 16 bands of 4: texts with a weighted Jaccard similarity of 0.8 share a band with
a probability of 0.9998. First each member of a band's bucket is verified against the bucket's most central text only, a star,
which settles the usual group of copies with one comparison a member. Where members of one bucket then still belong to different
components, these are compared in blocks of bounded size: pairs whose samples may reach the threshold (four standard deviations
below it at worst) are verified within the block, until their components are joined. So no pair is left out for sharing a bucket
with a stranger, and only links are emitted.

Verification is the exact weighted Jaccard similarity of the whole texts. Classes are connected components.

Defined cases: texts without words (null, empty, blank) stand alone, each a class of its own; fewer than five words make one
shingle; equal texts are one node (a 64-bit hash of the text), so copies are never expanded into pairs; a null doc_id gets its
class's least doc_id; repeated rows stay; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import common, components, pretok

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
CELLS = 1 << 18
LIFT, RESOLUTION = 0.2, 300
_SLICE = 8192
_FEW = 4096
_CACHED = 1 << 15

_C = np.uint64(0xD6E8FEB86659FD93)
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, tf) of the distinct shingles of texts data[off[i]:off[i + 1]], ordered by text, then hash."""
    starts, ends, n = pretok.words(data, off)
    h = pretok.span_hashes(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    key = np.zeros(len(of), np.uint64)
    stop = np.repeat(first[1:], count)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        key = key * _C + np.where(at + k < stop, padded[at + k], np.uint64(0x1234567))
    key = pretok.mix(key)
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    place = np.flatnonzero(new)
    return of[place], key[place], np.diff(np.append(place, len(of)))


def _cells(key: np.ndarray) -> list[np.ndarray]:
    return [((key * s) >> np.uint64(64 - 18)).astype(np.int64) for s in _SALT]


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(count-min sketch of document frequencies, 2 x CELLS; documents with words). Partial sketches meet in two groupings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((2, CELLS), np.int64), 0
        for b in common.slices(batches, "text", 1 << 20):
            of, key, _ = shingles(*common.text_buffers(b.column(0)))
            for row, c in zip(sketch, _cells(key), strict=True):
                row += np.bincount(c, minlength=CELLS)
            n += len(np.unique(of))
        if n:
            branch = TaskContext.get().partitionId() % 256  # the same again if the task is run again
            flat = sketch.reshape(-1, _SLICE)
            yield pa.RecordBatch.from_pydict({"slice": [*range(len(flat)), -1], "branch": [branch] * (len(flat) + 1), "counts": [*(zlib.compress(r.astype("<i8").tobytes(), 1) for r in flat), zlib.compress(np.array([n], "<i8").tobytes())]}, schema=schema)

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in f["counts"])
        return pd.DataFrame({"slice": f["slice"].iloc[:1], "branch": f["branch"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = pa.schema([("slice", pa.int32()), ("branch", pa.int32()), ("counts", pa.binary())])
    kind = "slice int, branch int, counts binary"
    part = docs.select("text").mapInArrow(count, kind).groupBy("slice", "branch").applyInPandas(add, kind)
    rows = part.groupBy("slice").applyInPandas(add, kind).collect()  # a fixed number of rows
    by = {r["slice"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), "<i8") for r in rows}
    if not by:
        return np.zeros((2, CELLS), np.int64), 0
    return np.concatenate([by[k] for k in range(2 * CELLS // _SLICE)]).reshape(2, CELLS), int(by[-1][0])


def idf_table(sketch: np.ndarray, n: int, lift: float = LIFT, resolution: int = RESOLUTION) -> np.ndarray:
    """The factor of each cell's idf, 2 x CELLS; a shingle takes the larger of its two."""
    if not n:
        return np.ones(sketch.shape, np.float32)
    df = np.clip(sketch - sketch.sum(1, keepdims=True) / CELLS, max(1.0, n / resolution), n)
    return (1 + lift * np.log(n / df) / np.log(resolution)).astype(np.float32)


def weights(key: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(key)
    return (1 + np.log(tf)).astype(np.float32) * np.maximum(idf[0][a], idf[1][b])


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms as tables, and one seed a sample."""
    x = np.linspace(0, 25, 200_001)
    cdf = 1 - np.exp(-x) * (1 + x)
    g = np.interp((np.arange(_FEW) + 0.5) / _FEW, cdf, x).astype(np.float32)
    return g, np.log(g), pretok.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


_GAMMA, _LOG_GAMMA, _SEEDS = _variates()


def signatures(of: np.ndarray, key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, 64 samples of each as uint32)."""
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    out = np.empty((len(head), BANDS * ROWS), np.uint32)
    ends = np.append(head, len(of))
    lo = 0
    while lo < len(head):  # as many texts as the processor's cache holds the shingles of, or one
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _CACHED, side="right")) - 1)
        at = slice(ends[lo], ends[hi])
        _sample(key[at], w[at], head[lo:hi] - ends[lo], out[lo:hi])
        lo = hi
    return of[head], out


def _sample(key: np.ndarray, w: np.ndarray, head: np.ndarray, out: np.ndarray) -> None:
    """The samples of texts whose shingles begin at ``head``, into ``out``."""
    size = np.diff(np.append(head, len(key)))
    log_w = np.log(w)
    for k, seed in enumerate(_SEEDS):
        h = (key ^ seed) * _C
        h ^= h >> np.uint64(32)
        h *= _C
        r = _GAMMA[(h >> np.uint64(52)).astype(np.int64)]
        beta = ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_w / r + beta)
        log_a = _LOG_GAMMA[((h >> np.uint64(40)) & np.uint64(_FEW - 1)).astype(np.int64)] - r * (t - beta + 1)
        low = np.minimum.reduceat(log_a, head)
        hit = np.flatnonzero(log_a == np.repeat(low, size))
        hit = hit[np.searchsorted(hit, head)]  # the least hash of equals: consistent between texts
        out[:, k] = (pretok.mix(key[hit] + t[hit].astype(np.int64).astype(np.uint64) * _SALT[0]) >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        h = pretok.mix(h * _C + sig[:, k::ROWS].astype(np.uint64))
    return pretok.mix(h + np.arange(BANDS, dtype=np.uint64) * _SALT[1]).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes ascending, weights)."""
    (ka, wa), (kb, wb) = a, b
    at = np.searchsorted(kb, ka)
    inside = at < len(kb)
    same = np.zeros(len(ka), bool)
    same[inside] = kb[at[inside]] == ka[inside]
    both = np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64)
    every = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both
    return float(both / every) if every > 0 else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` (a, b) that reach the threshold; ``texts``: (node, text), a row a node."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    rows = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = idf.value, (None, None)

        def known(text: str) -> tuple[np.ndarray, np.ndarray]:
            _, key, tf = shingles(*common.text_buffers(pa.array([text], pa.string())))
            return key, weights(key, tf, table)

        for x in batches:
            a, b, sim = x.column(0).to_pylist(), x.column(1).to_pylist(), []
            for i, node in enumerate(b):
                if node != last[0]:
                    last = node, known(x.column(3)[i].as_py())
                sim.append(similarity(known(x.column(2)[i].as_py()), last[1]))
            keep = np.array(sim) >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep]), pa.array(np.array(sim)[keep])], ["a", "b", "similarity"])
        common.trim()

    return rows.mapInArrow(run, "a long, b long, similarity double")


def _between(sig_least: int, idf, threshold: float):
    """Verified pairs of a bucket's block whose components differ. A pair is looked at in the first band that it shares, and
    only if its samples agree often enough; once two components are joined, no more of their pairs are looked at.

    Most blocks hold a few rows, so a block is read as the Arrow table that it comes as."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(f: pa.Table) -> pa.Table:
        bh, table = f["bh"][0].as_py(), idf.value
        nodes, labels, texts, odds = f["node"].to_numpy(), f["label"].to_numpy(), f["text"], f["odd"].to_numpy()
        # each node once, in order
        odd, other = (at[np.unique(nodes[at], return_index=True)[1]] for at in (np.flatnonzero(odds), np.flatnonzero(~odds)))
        sigs = f["sig"].to_pylist()
        mat = lambda at: np.frombuffer(b"".join([sigs[i] for i in at.tolist()]), np.uint32).reshape(len(at), -1)
        nx, ny = nodes[odd].tolist(), nodes[other].tolist()
        found, root, sets = [], {}, {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        def known(node: int, at: int) -> tuple[np.ndarray, np.ndarray]:
            if node not in sets:
                _, key, tf = shingles(*common.text_buffers(pa.array([texts[at].as_py()], pa.string())))
                sets[node] = key, weights(key, tf, table)
            return sets[node]

        if len(odd) and len(other):
            x, y, lx, ly = mat(odd), mat(other), labels[odd], labels[other]
            bx, by = band_hashes(x), band_hashes(y)
            here = int(np.flatnonzero(bx[0] == bh)[0])
            for i in range(len(odd)):
                same = (y == x[i]).sum(1)
                at = np.flatnonzero((same >= sig_least) & (ly != lx[i]) & ((by == bx[i]).argmax(1) == here))
                for j in at[np.argsort(-same[at], kind="stable")].tolist():
                    p, q = find(lx[i]), find(ly[j])
                    if p != q and (sim := similarity(known(nx[i], int(odd[i])), known(ny[j], int(other[j])))) >= threshold - 1e-9:
                        root[max(p, q)] = min(p, q)
                        found.append((nx[i], ny[j], sim))
                sets.pop(nx[i], None)
        if len(odd) + len(other) > 200:
            sets.clear()
            common.trim()
        return pa.Table.from_pydict({k: [r[i] for r in found] for i, k in enumerate(schema.names)}, schema)

    return run


def links(docs: DataFrame, threshold: float = THRESHOLD, block: int = 256, members: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, node or null), edges (a, b, similarity)): nodes are distinct texts, edges verified pairs that span the classes."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sketch, n = frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(sketch, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in common.slices(batches, "text", 1 << 20):
            of, key, tf = shingles(*common.text_buffers(x.column(2)))
            has, sig = signatures(of, key, weights(key, tf, idf.value))
            bands = band_hashes(sig)
            at = np.full(x.num_rows, -1)
            at[has] = np.arange(len(has))
            node = pa.array(np.asarray(x.column(1)), mask=at < 0)
            yield pa.RecordBatch.from_arrays(
                [x.column(0), node, pa.array([bands[i].tolist() if i >= 0 else None for i in at], pa.list_(pa.int64())), pa.array([sig[i].tobytes() if i >= 0 else None for i in at], pa.binary())],
                ["doc_id", "node", "bands", "sig"],
            )
        common.trim()

    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    rows = common.written(keyed.mapInArrow(sign, "doc_id long, node long, bands array<long>, sig binary"), "nd-rows")
    placed = common.written(rows.where("node is not null").select(F.explode("bands").alias("bh"), "node").distinct(), "nd-bands")
    buckets = common.written(placed.groupBy("bh").agg(F.count("*").alias("c")).where("c > 1"), "nd-buckets")
    inside = common.written(placed.join(buckets, "bh"), "nd-members")
    # a bucket's centre is the member that meets most others over all bands: the text that copies were made from, if it is there
    central = inside.groupBy("node").agg(F.sum("c").alias("meets"))
    reps = inside.join(central, "node").groupBy("bh").agg(F.max(F.struct("meets", "node")).alias("r")).select("bh", F.col("r.node").alias("rep"))
    inside = common.written(inside.select("bh", "node").join(common.written(reps, "nd-reps"), "bh"), "nd-centred")
    star = common.written(inside.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), "nd-star")

    # the text of each node that may be compared, taken from the row with its least doc_id
    ids = inside.select("node").distinct()
    at = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_d"))
    wanted = common.written(at.join(ids, "node", "left_semi").select(F.col("node").alias("_n"), "_d"), "nd-wanted")
    # merged at every size: the list of nodes has no proven bound, so it isn't left to be broadcast while it is small
    keyed = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    picked = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("node") == F.col("_n")))
    picked = picked.select("node", "text").dropDuplicates(["node"])
    texts = common.written(picked, "nd-texts")

    first = common.written(_verified(star, texts, idf, threshold), "nd-edges")
    label = components.components(first)
    seen = inside.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    seen = common.written(seen.select("bh", "node", "rep", "label"), "nd-labelled")
    # "odd" are the members outside the component of the bucket's centre
    main = seen.where("node = rep").select("bh", F.col("label").alias("main"))
    odd = seen.join(main, "bh").withColumn("odd", F.col("label") != F.col("main"))
    odd = common.written(odd.select("bh", "node", "label", "odd"), "nd-odd")
    mixed = odd.groupBy("bh").agg(F.count_if("odd").alias("n_odd"), F.count("*").alias("n_all")).where("n_odd > 0")
    mixed = common.written(mixed.select("bh", F.floor(F.col("n_odd") / block).cast("int").alias("ob"), F.floor(F.col("n_all") / members).cast("int").alias("mb")), "nd-mixed")
    some = odd.join(mixed, "bh")
    sigs = rows.where("node is not null").join(some.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig"))
    some = some.join(sigs, "node").join(texts, "node")
    hash_to = lambda k: F.pmod(F.xxhash64("node"), F.col(k) + 1).cast("int")
    asks = some.where("odd").withColumn("i", hash_to("ob")).withColumn("j", F.explode(F.sequence(F.lit(0), "mb")))
    gives = some.withColumn("odd", F.lit(False)).withColumn("j", hash_to("mb")).withColumn("i", F.explode(F.sequence(F.lit(0), "ob")))
    least = int(BANDS * ROWS * threshold - 4 * (BANDS * ROWS * threshold * (1 - threshold)) ** 0.5)
    blocks = asks.unionByName(gives).groupBy("bh", "i", "j")
    second = common.written(blocks.applyInArrow(_between(least, idf, threshold), "a long, b long, similarity double"), "nd-edges")
    return rows.select("doc_id", "node"), first.unionByName(second)


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size, links): class_id is the least doc_id of the class, links the document's verified partners
    among different texts that the search compared it with."""
    rows, edges = links(docs, **options)
    label = components.components(edges)
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_d"), F.count("*").alias("_c"))
    ids = common.written(ids.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "nd-ids")
    groups = common.written(ids.groupBy("label").agg(F.min("_d").alias("class_id"), F.sum("_c").alias("class_size")), "nd-classes")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    of = common.written(ids.select("node", "label").join(groups, "label").drop("label").join(ends, "node", "left"), "nd-of")
    out = rows.join(of, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one row with its least doc_id, and every row without words."""
    rows, edges = links(docs, **options)
    label = components.components(edges)
    ids = rows.where("node is not null").groupBy("node", "doc_id").agg(F.count("*").alias("_c"))
    ids = ids.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # nulls last, as a class's id is its least doc_id
    first = ids.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("_d"), F.col("node").alias("_n"), F.col("_c"))).alias("k"))
    keep = common.written(first.select("k._d", "k._n", "k._c"), "nd-keep")
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(common.SPACE)) == ""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever the columns are called
    every = docs.select("doc_id", blank.alias("blank"), F.xxhash64("text").alias("node"), row)
    mine = every.where("not blank").join(keep, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("node") == F.col("_n")))
    once = mine.where("_c = 1").select("row")
    # of equal rows the first that a task meets, then the first of these
    several = mine.where("_c > 1").groupBy("_d", "_n").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(several).unionByName(every.where("blank").select("row")).select("row.*")
