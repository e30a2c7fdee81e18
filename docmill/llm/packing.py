"""Best-fit packing by a grouping genetic algorithm on islands.

1. Texts become ids; a document longer than a sequence is cut into whole sequences and a rest. Whole sequences are done.
2. The other pieces are dealt into blocks of about ``block`` pieces. A block's packing is a chromosome whose genes are bins. Several
   islands evolve a block's packings apart: crossover puts whole well-filled bins of one parent into the other, removes the bins that
   hold a piece twice, and puts the displaced pieces where they fit best; mutation empties the worst bins likewise. After each round
   an island's elite migrates to the next island of the ring, by a join. A block whose best packing has as many bins as the lower bound of
   Martello and Toth is solved and evolves no further.
3. The least filled bins of all blocks, some 1/16 of them, are opened and dealt into new blocks, bin by bin, and packed again, until one
   block holds them all. A bin's own content takes part as a parent there, so that no level can need more sequences than the one before.

Nothing is larger than a block: pieces are dealt by row numbers, so equal documents or a hot doc_id spread like any rows, and a block's state is one row
of some tens of kilobytes. Levels shrink by their factor, so their number grows with the logarithm of the input.

Defined cases: a null or empty text is a piece with the end id alone; repeated rows and null doc_ids are packed like any; an empty table
gives no rows; other columns are ignored by ``pieces`` and kept by ``pack``. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import common, pretok

CAPACITY = 2048
END_ID = 0
BLOCK = 2048
_OPEN = 16  # one bin in so many is opened for the next level
_BITS = 20  # a block's bins have numbers below 2 ** _BITS


@lru_cache(1)
def _tokenizer(vocabulary: str):
    """(normal form of a text, a table of distinct matches, each encoded once while a worker keeps it)."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_str(vocabulary)
    model, alphabet = t.model, sorted(ByteLevel.alphabet())
    shown = {ord(ch): ch for ch in alphabet if ord(ch) < 256}  # visible bytes stand for themselves, the rest for later characters in order
    shown |= dict(zip((b for b in range(256) if b not in shown), (ch for ch in alphabet if ord(ch) >= 256), strict=True))

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [[x.id for x in model.tokenize(w.decode("latin-1").translate(shown))] for w in words]
        return np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64)

    return t.normalizer.normalize_str, pretok.WordTable(encode, 800_000)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids: little-endian u32]) of each text of ``docs``: its ids and the end id, cut at ``capacity``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, table = _tokenizer(vocabulary.value)
        for b in common.slices(batches, "text", 4 << 20):
            data, off = pretok.lowered(*common.text_buffers(b.column(1)), normal)
            starts, ends, per = pretok.word_runs(data, off)
            flat, lens = table.rows(data, starts, ends)
            edge = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per)])]
            flat = np.insert(flat, edge[1:], np.uint32(end_id))
            edge = edge + np.arange(len(edge))
            size = np.diff(edge)
            n = -(-size // capacity)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[of] - start, capacity)
            raw, lo = memoryview(flat.astype("<u4").tobytes()), 4 * (edge[of] + start)
            spans = list(zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True))
            cols = [b.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[i:j]) for i, j in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([bytes(raw[i:j]) for i, j in spans], pa.binary())] if with_ids else cols, names)
        common.trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def bound(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can be below: for each small size, pieces too large to go with it need a bin each."""
    if not len(sizes):
        return 0
    s = np.sort(sizes.astype(np.int64))
    half = int(np.searchsorted(s, capacity // 2, side="right"))
    before = np.concatenate([[0], np.cumsum(s)])
    least = np.unique(np.concatenate([[0], s[:half]]))
    alone = np.searchsorted(s, capacity - least, side="right")  # first piece that goes with none of size ``least``
    room = (alone - half) * capacity - (before[alone] - before[half])
    rest = before[half] - before[np.searchsorted(s[:half], least)]
    return int((len(s) - half + np.maximum(0, -(-(rest - room) // capacity))).max())


def best_fit(order: np.ndarray, sizes: list[int], into: np.ndarray, loads: list[int], capacity: int) -> None:
    """Puts the pieces ``order`` one by one into the fullest bin that has room, or a new one; changes ``into`` and ``loads``."""
    free = sorted((capacity - x) << _BITS | b for b, x in enumerate(loads) if x < capacity)
    for i in order.tolist():
        at = bisect_left(free, sizes[i] << _BITS)
        if at < len(free):
            b = free.pop(at) & ((1 << _BITS) - 1)
        else:
            b = len(loads)
            loads.append(0)
        loads[b] += sizes[i]
        into[i] = b
        if loads[b] < capacity:
            insort(free, (capacity - loads[b]) << _BITS | b)


def _close(into: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins numbered without gaps, their loads)."""
    bins, into = np.unique(into, return_inverse=True)
    return into.astype(np.int32), np.bincount(into, sizes, len(bins)).astype(np.int64)


def _place(into: np.ndarray, loose: np.ndarray, sizes: np.ndarray, plain: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The packing ``into`` with the pieces ``loose`` (a mask) taken out and put back, large ones first, where they fit best."""
    out, loads = into.copy(), np.zeros(0, np.int64)
    if not loose.all():
        out[~loose], loads = _close(into[~loose], sizes[~loose])
    order = np.flatnonzero(loose)
    held = loads.tolist()
    best_fit(order[np.argsort(-sizes[order], kind="stable")], plain, out, held, capacity)
    return _close(out, sizes)


def crossover(a: np.ndarray, b: np.ndarray, loads_b: np.ndarray, sizes: np.ndarray, plain: list[int], capacity: int, rng: np.random.Generator, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """A child of ``a`` that gets whole well-filled bins of ``b``: bins of ``a`` that hold a piece of them are removed, and what they held besides is put where it fits best."""
    full = np.argsort(-loads_b, kind="stable")[: max(1, len(loads_b) // 2)]
    take = np.zeros(len(loads_b), bool)
    take[rng.choice(full, max(1, int(share * len(loads_b))), replace=False) if len(full) > int(share * len(loads_b)) else full] = True
    given = take[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[given]] = True
    child = np.where(given, b + int(a.max()) + 1, a)
    return _place(child, hit[a] & ~given, sizes, plain, capacity)


def mutate(a: np.ndarray, loads: np.ndarray, sizes: np.ndarray, plain: list[int], capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``a`` with its worst bins and a few at random emptied, their pieces put where they fit best in a new order."""
    gone = np.zeros(len(loads), bool)
    gone[np.argsort(loads, kind="stable")[: int(rng.integers(1, 4))]] = True
    gone[rng.integers(0, len(loads), min(len(loads), 4))] = True
    out, held = a.copy(), np.zeros(0, np.int64)
    loose = gone[a]
    if not loose.all():
        out[~loose], held = _close(a[~loose], sizes[~loose])
    order, held = rng.permutation(np.flatnonzero(loose)), held.tolist()
    best_fit(order, plain, out, held, capacity)
    return _close(out, sizes)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, seed: int, size: int = 6) -> list[np.ndarray]:
    """The population after ``generations``, best first; short ones are filled up by best fit in decreasing and in shuffled order."""
    rng, plain, least = np.random.default_rng(seed), sizes.tolist(), bound(sizes, capacity)
    rank = lambda x: (len(x[1]), -float((x[1] / capacity) @ (x[1] / capacity)))
    alive = [_close(p, sizes) for p in population]
    down = np.argsort(-sizes, kind="stable")
    while len(alive) < size:
        if alive and min(len(x[1]) for x in alive) <= least:
            break  # a packing with as few bins as can be needs no rivals
        order = down if len(alive) == len(population) else np.argsort(-(sizes + rng.normal(0, capacity / 16, len(sizes))), kind="stable")
        into, loads = np.zeros(len(sizes), np.int32), []
        best_fit(order, plain, into, loads, capacity)
        alive.append(_close(into, sizes))
    alive.sort(key=rank)
    for _ in range(generations):
        if len(alive[0][1]) <= least or len(alive) < 2:
            break
        i, j = sorted(rng.choice(len(alive), 2, replace=False).tolist())
        child = crossover(alive[i][0], *alive[j], sizes, plain, capacity, rng)
        if rng.random() < 0.5:
            child = min(child, mutate(*child, sizes, plain, capacity, rng), key=rank)
        alive[-1] = min(alive[-1], child, key=rank)
        alive.sort(key=rank)
    return [x[0] for x in alive[:size]]


_STATE = "block long, island int, sizes array<int>, population array<array<int>>, bins int, fill double"


def _islands(blocks: DataFrame, capacity: int, islands: int, rounds: int, generations: int, seed: int, done: list[str]) -> DataFrame:
    """(block, best: array<int>, the bin of each of the block's pieces) of ``blocks`` (block, sizes, parent: array<int> or null)."""
    spark = blocks.sparkSession
    n = blocks.count() * islands
    parts = common.partitions_for(spark, n, 4)
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.when(F.col("parent").isNotNull(), F.array("parent")).alias("population"))

    def one_round(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                out = []
                for r in df.itertuples(index=False):
                    sizes = np.asarray(r.sizes, np.int64)
                    start = [] if r.population is None else [np.asarray(p, np.int32) for p in r.population]
                    alive = evolve(sizes, start, capacity, generations, hash((seed, int(r.block), int(r.island), number)) & 0x7FFFFFFF)
                    loads = np.bincount(alive[0], sizes) / capacity
                    out.append((r.block, r.island, r.sizes, alive, len(loads), float(loads @ loads)))
                yield pd.DataFrame(out, columns=["block", "island", "sizes", "population", "bins", "fill"])
            common.trim()

        return run

    for number in range(rounds):
        state = common.written(state.repartition(parts, "block", "island").select("block", "island", "sizes", "population").mapInPandas(one_round(number), _STATE), "pack-island", drop=done)
        if number < rounds - 1 and islands > 1:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("_elite"))
            state = state.join(elite, ["block", "island"]).withColumn("population", F.concat(F.array("_elite"), "population"))
    return state.groupBy("block").agg(F.min_by(F.col("population")[0], F.struct("bins", -F.col("fill"), "island")).alias("best"))


def _settled(blocks: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """(uid, size, bin, at, open) of each piece of ``blocks`` (block, uids, sizes, best): its place, and whether its bin is to be opened."""
    names = ["uid", "size", "bin", "at", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, uids, sizes, best in zip(b.column(0).to_pylist(), *(b.column(k) for k in (1, 2, 3)), strict=True):
                uid, size, into = (np.asarray(x.values) for x in (uids, sizes, best))
                order = np.argsort(into, kind="stable")
                upto = np.cumsum(size[order]) - size[order]
                loads = np.bincount(into, size)
                at = np.empty(len(size), np.int64)
                at[order] = upto - (np.cumsum(loads) - loads).astype(np.int64)[into[order]]
                opened = np.zeros(len(loads), bool)
                if not last:
                    opened[np.argsort(loads, kind="stable")[: 2 + len(loads) // _OPEN]] = True
                    opened &= loads < capacity
                number = (np.int64(level) << 56) | np.int64(block) << _BITS
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(size, pa.int32()), pa.array(number | into.astype(np.int64)), pa.array(at), pa.array(opened[into])], names)

    return blocks.select("block", "uids", "sizes", "best").mapInArrow(run, "uid long, size int, bin long, at long, open boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = 2, rounds: int = 2, generations: int = 24, seed: int = 7) -> DataFrame:
    """``items`` (with ``length``, 1 to ``capacity``) with sequence_id and offset: the pieces of a sequence lie end to end from 0.

    An own column of either name is replaced. A length outside the range is an error.
    """
    spark = items.sparkSession
    common.small_batches(spark)
    done: list[str] = []
    own = [c for c in items.columns if c not in ("sequence_id", "offset")]
    size = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("length outside 1 to the capacity: "), F.coalesce(F.col("length").cast("string"), F.lit("null"))))).cast("int")
    rows = common.written(items.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), size.alias("size"), F.monotonically_increasing_id().alias("uid")), "pack-rows")
    parts = []
    left = rows.where(F.col("size") < capacity).select("uid", "size", F.col("uid").alias("_deal"), F.lit(None).cast("long").alias("bin"))
    for level in range(64):
        n = left.count()
        if not n:
            break
        count = -(-n // block)
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "_deal"), F.lit(count)))
        # about ``block`` pieces a group; sorted, so that a repeated task sees the same order
        dealt = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uid", "size", "bin"))).alias("_p"))
        parent = F.transform("_p", lambda p: (F.array_position(F.array_distinct("_p.bin"), p["bin"]) - 1).cast("int")) if level else F.lit(None).cast("array<int>")
        blocks = common.written(dealt.select("block", F.col("_p.uid").alias("uids"), F.col("_p.size").alias("sizes"), parent.alias("parent")), "pack-blocks", drop=done)
        best = _islands(blocks, capacity, islands, rounds, generations, seed + level, done)
        placed = common.written(_settled(blocks.join(best, "block"), capacity, level, count == 1), "pack-placed")
        common.remove(spark, done)
        parts.append(placed.where("NOT open"))
        left = placed.where("open").select("uid", "size", F.col("bin").alias("_deal"), "bin")
        if count == 1:
            break
    out = rows.where(F.col("size") == capacity).select("row", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if parts:
        at = parts[0]
        for p in parts[1:]:
            at = at.unionByName(p)
        out = out.unionByName(rows.where(F.col("size") < capacity).join(at.select("uid", "bin", "at"), "uid").select("row", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
    return out.select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ``ids``: a sequence's pieces put together, at most a sequence's ids in a group."""
    pieces_of = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return pieces_of.select("sequence_id", F.aggregate("_p", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"))
