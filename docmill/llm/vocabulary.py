"""The distinct words of a corpus: counted, ranked by frequency, and packed with what was found of each into a bounded table.

Tasks count their own distinct words before anything is shuffled. The table holds the most frequent words that recur, never more
than its bound, so it may be broadcast; what it lacks is worked out where it is met. Words are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import common, pretok

#: Longer words are not held.
LONGEST = 128


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans data[start:end] as a binary array."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(pretok.take_rows(data, starts, size))])


def distinct_words(docs: DataFrame, split: Callable = pretok.bpe_tokens) -> DataFrame:
    """(word binary, n): every word that ``split`` finds in the texts and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            data, off = common.text_buffers(b.column(0))
            starts, ends, _ = split(data, off)
            if len(starts):
                codes, at = pretok.distinct(data, starts, ends)
                yield pa.RecordBatch.from_arrays([gather(data, starts[at], ends[at]), pa.array(np.bincount(codes, minlength=len(at)))], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int) -> tuple[DataFrame, int]:
    """((word) of the most frequent words that recur, how many): never more than ``most``.

    Words are ranked by classes of frequency (16 to a doubling), each split in 16 by a hash, so that few rows are collected to find
    the cut; whole classes are taken while they fit.
    """
    some = counted.where((F.col("n") > 1) & (F.length("word") <= LONGEST))
    some = some.withColumn("class", (F.floor(16 * F.log2("n")) * 16 + F.pmod(F.xxhash64("word"), F.lit(16))).cast("int"))
    held, least = 0, 1 << 30
    for r in some.groupBy("class").agg(F.count("*").alias("c")).orderBy(F.desc("class")).collect():  # at most 16 x 16 x 64 rows
        if held + r["c"] > most:
            break
        held, least = held + r["c"], r["class"]
    return some.where(F.col("class") >= least).select("word"), held


def packed(rows: DataFrame) -> list[np.ndarray]:
    """[hashes ascending, ends of words, bytes, ends of values, values] of rows (word, ids array<int>), some 30 bytes a word."""
    names = ["h", "size", "data", "n", "flat"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.text_buffers(b.column(0))
            ids = b.column(1)
            row = [pretok.span_hashes(data, off[:-1], off[1:]), np.diff(off).astype(np.uint8), data, np.diff(ids.offsets.to_numpy()).astype(np.uint8), ids.flatten().to_numpy().astype(np.uint32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names)

    parts = rows.select("word", "ids").mapInArrow(pack, ", ".join(f"{k} binary" for k in names)).collect()
    held = {k: [p[k] for p in parts] for k in names}
    del parts

    def taken(k: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in held.pop(k)] or [np.zeros(0, kind)])

    h = taken("h", np.uint64)
    order = np.unique(h, return_index=True)[1].astype(np.int32)  # of words with one hash the first is held
    out = [h[order]]
    for lengths, values, kind in (("size", "data", np.uint8), ("n", "flat", np.uint32)):
        size = taken(lengths, np.uint8)
        ends = np.cumsum(size, dtype=np.int64)
        out += [np.cumsum(size[order], dtype=np.int64), _reordered(taken(values, kind), ends - size, size, order)]
    del h, held
    common.trim()  # the driver keeps one copy
    return out


def _reordered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The runs flat[begin:begin + size] in ``order``, copied by ``step`` runs, as a copy's index takes eight bytes a value."""
    out, at = np.empty(int(size[order].sum(dtype=np.int64)), flat.dtype), 0
    for k in range(0, len(order), step):
        some = order[k : k + step]
        part = pretok.take_rows(flat, begin[some], size[some].astype(np.int64))
        out[at : at + len(part)] = part
        at += len(part)
    return out


def lookup(table: list[np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each word is held, the place of its first value, how many values) for words data[start:end]."""
    keys, stops, held, value_stops, _ = table
    known, place, rows = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if len(keys) and len(starts):
        h, size = pretok.span_hashes(data, starts, ends), ends - starts
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        begin = np.append(0, stops)[at]
        known = (keys[at] == h) & (stops[at] - begin == size)
        some = np.flatnonzero(known)
        known[some] = pretok.equal_spans(data, starts[some], held, begin[some], size[some])
        place[known] = np.append(0, value_stops)[at[known]]
        rows[known] = value_stops[at[known]] - place[known]
    return known, place, rows
