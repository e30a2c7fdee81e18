"""Token ids as wavelet matrices: one compressed, searchable file per shard of documents.

Form of an image: ``WMX2``, then little-endian u64 tokens, u32 planes, u32 documents, u64 bytes of the document part; that part,
zstd-compressed (document ids with a null mark, document lengths); then each plane, highest bit first: u64 zero count, the ones
before each block of ``BLOCK`` bits (u32), the end of each compressed block (u32), and the blocks, each zstd-compressed by itself.
A token is read by walking the planes, which unzips one block a plane; ``rank``, ``select``, ``count`` and ``occurrences`` walk them
likewise, so nothing but the file is needed, and no more than the blocks on the way is unzipped.

A shard is a stretch of the documents in ascending doc_id order with about ``shard_tokens`` ids, written as a Parquet file with
one row, as Spark's commit protocol keeps a lost executor from leaving half a shard and its writers reach any store that Spark reaches.

Defined cases: a null or empty text holds the end id alone; null doc_ids come first; rows that share a doc_id stand together, in any
number of shards; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import common, pretok

END_ID = 2
BLOCK = 1 << 15
_MAGIC = b"WMX2"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file image of ``ids``, the documents' ids one after the other."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    n, planes = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    about = squeeze(np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.asarray(lengths, "<i8").tobytes())
    parts = [_MAGIC, struct.pack("<QIIQ", n, planes, len(doc_ids), len(about)), about]
    row = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for shift in range(planes - 1, -1, -1):
        bits = (row & row.dtype.type(1 << shift)) != 0
        raw = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
        raw[: -(-n // 8)] = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(raw.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        packed = raw[: -(-n // 8)].tobytes()
        blocks = [squeeze(packed[i : i + BLOCK // 8]) for i in range(0, len(packed), BLOCK // 8)]
        parts.append(struct.pack("<Q", n - int(ones.sum())) + (np.cumsum(ones) - ones).astype("<u4").tobytes() + np.cumsum([len(b) for b in blocks], dtype=np.int64).astype("<u4").tobytes())
        parts += blocks
        row = np.concatenate([row[np.flatnonzero(~bits)], row[np.flatnonzero(bits)]])  # places: several times faster than a mask
    return b"".join(parts)


class WaveletMatrix:
    """Reads an image made by ``build``; blocks are unzipped when a query meets them, the last ``keep`` are kept."""

    def __init__(self, image: bytes, keep: int = 256):
        if image[:4] != _MAGIC:
            raise ValueError("not a wavelet-matrix image")
        import zstandard

        self.n, planes, self.docs, about = struct.unpack_from("<QIIQ", image, 4)
        self._unzip = zstandard.ZstdDecompressor().decompress
        self._image, self._about = memoryview(image), (28, 28 + about)
        at, blocks = 28 + about, -(-self.n // BLOCK)
        self.zeros, self.ranks, self._ends, self._at = [], [], [], []
        for _ in range(planes):
            self.zeros.append(struct.unpack_from("<Q", image, at)[0])
            self.ranks.append(np.frombuffer(image, "<u4", blocks, at + 8))
            self._ends.append(np.frombuffer(image, "<u4", blocks, at + 8 + 4 * blocks))
            self._at.append(at + 8 + 8 * blocks)
            at = self._at[-1] + (int(self._ends[-1][-1]) if blocks else 0)
        self._words = lru_cache(keep)(self._block)

    def _block(self, k: int, b: int) -> np.ndarray:
        """Block b of plane k as 64-bit words."""
        lo = int(self._ends[k][b - 1]) if b else 0
        raw = self._unzip(self._image[self._at[k] + lo : self._at[k] + int(self._ends[k][b])])
        return np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")

    @property
    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(document ids, lengths) in order."""
        raw, d = self._unzip(self._image[slice(*self._about)]), self.docs
        ids = np.frombuffer(raw, "<i8", d)
        return [None if z else int(i) for i, z in zip(ids, raw[8 * d : 9 * d], strict=True)], np.frombuffer(raw, "<i8", d, 9 * d)

    def _bit(self, k: int, i: int) -> int:
        return int(self._words(k, i // BLOCK)[i % BLOCK >> 6]) >> (i & 63) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        if i >= self.n:
            return self.n - self.zeros[k]
        b, i = divmod(i, BLOCK)
        words, full = self._words(k, b), i >> 6
        return int(self.ranks[k][b]) + int(np.bitwise_count(words[:full]).sum()) + ((int(words[full]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else 0)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(len(self.zeros)):
            one = self._bit(k, i)
            ones = self._ones(k, i)
            out, i = out << 1 | one, self.zeros[k] + ones if one else i - ones
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.zeros):
            return 0, 0
        for k in range(len(self.zeros)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (len(self.zeros) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token stands in places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    rank = count

    def select(self, token: int, j: int) -> int:
        """The place of the token's occurrence number j (from 0)."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        return self._up(token, lo + j)

    def _up(self, token: int, i: int) -> int:
        for k in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - k) & 1
            i = self._nth(k, one, i - self.zeros[k] if one else i)
        return i

    def _nth(self, k: int, one: int, j: int) -> int:
        """The place of bit ``one`` number j in plane k: halving over the blocks' ranks, then within the block."""
        ranks, lo, hi = self.ranks[k], 0, len(self.ranks[k])
        before = (lambda b: int(ranks[b])) if one else (lambda b: b * BLOCK - int(ranks[b]))
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= j else (lo, mid)
        words = self._words(k, lo)
        words = words if one else ~words
        j -= before(lo)
        upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        w = int(np.searchsorted(upto, j, side="right"))
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little")
        return lo * BLOCK + 64 * w + int(np.flatnonzero(bits)[j - (int(upto[w - 1]) if w else 0)])

    def occurrences(self, token: int) -> list[int]:
        """All places of the token, ascending."""
        lo, hi = self._range(token, 0, self.n)
        return sorted(self._up(token, i) for i in range(lo, hi))

    def decode(self) -> np.ndarray:
        """All tokens in order: planes are undone from the last to the first."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for k in range(len(self.zeros) - 1, -1, -1):
            raw = np.concatenate([self._block(k, b) for b in range(len(self.ranks[k]))] or [np.zeros(0, "<u8")])
            bits = np.unpackbits(raw.view(np.uint8), bitorder="little", count=self.n).astype(bool)
            up, z = np.empty(self.n, kind), self.zeros[k]
            up[np.flatnonzero(~bits)] = row[:z]
            up[np.flatnonzero(bits)] = row[z:] | kind(1 << (len(self.zeros) - 1 - k))
            row = up
        return row.astype(np.uint32)


@lru_cache(2)
def _tokenizer(vocabulary: str):
    """(the library's tokenizer, a table of distinct pre-tokens, each encoded once while a worker keeps it)."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_str(vocabulary)
    model, shown = t.model, {}
    for ch in sorted(ByteLevel.alphabet()):  # the byte that a shown character stands for: visible bytes stand for themselves
        shown[ch] = ord(ch) if ord(ch) < 256 else -1
    rest = iter(b for b in range(256) if b not in shown.values())
    table = {b: ch for ch, b in shown.items() if b >= 0} | {b: ch for ch, b in zip(sorted(c for c, b in shown.items() if b < 0), rest, strict=True)}

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [[x.id for x in model.tokenize(w.decode("latin-1").translate(table))] for w in words]
        return np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64)

    return t, pretok.WordTable(encode)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, range_bytes: int = 64 << 20, shard_tokens: int = 1 << 20, special_as_text: bool = True) -> None:
    """Encodes each text of ``docs`` (doc_id, text) and writes one image a shard, in ascending doc_id order, to ``path``.

    Rows are dealt into ranges of doc_id (rows that share one may be split further), each range is sorted and encoded by one task,
    which cuts it into shards of ``shard_tokens`` ids (and the rest of a shard's last document), so its memory doesn't depend on the input.
    ``special_as_text``: strings of special tokens in a text are ordinary text; if false they become the special tokens' ids.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = common.partitions_for(spark, size, range_bytes)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("image", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, table = _tokenizer(vocabulary.value)
        marks = [] if special_as_text else [t.content.encode() for t in library.get_added_tokens_decoder().values()]
        part, seg, held = TaskContext.get().partitionId(), 0, [[], [], []]  # ids, doc_ids, lengths

        def flush() -> pa.RecordBatch:
            nonlocal seg
            ids = np.concatenate(held[0])
            out = pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "n_tokens": len(ids), "image": build(ids, held[1], np.concatenate(held[2]))}], schema=schema)
            seg += 1
            for h in held:
                h.clear()
            return out

        tokens = 0
        for b in common.slices(batches, "text", 1 << 20):
            data, off = common.text_buffers(b.column(1))
            starts, ends, per = pretok.bpe_tokens(data, off)
            flat, lens = table.rows(data, starts, ends)
            edge = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per)])]  # each document's ids
            raw = data.tobytes() if marks else b""
            if any(m in raw for m in marks):
                rows = [flat[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
                for i in range(len(rows)):
                    if any(m in (text := raw[off[i] : off[i + 1]]) for m in marks):
                        rows[i] = np.array(library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                flat, edge = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            flat = np.insert(flat, edge[1:], np.uint32(end_id))
            edge = edge + np.arange(len(edge))
            docs_of, lo = b.column(0).to_pylist(), 0
            while lo < len(docs_of):
                hi = int(np.searchsorted(edge, edge[lo] + shard_tokens - tokens))
                full, hi = hi < len(edge), min(max(hi, lo + 1), len(docs_of))
                held[0].append(flat[edge[lo] : edge[hi]])
                held[1].extend(docs_of[lo:hi])
                held[2].append(np.diff(edge[lo : hi + 1]))
                tokens += int(edge[hi] - edge[lo])
                lo = hi
                if full:
                    yield flush()
                    tokens = 0
        if held[1]:
            yield flush()
        table.clear()

    # the last key tells apart rows that share a doc_id, so that they may be dealt to several tasks
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at")).repartitionByRange(n, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    images = rows.mapInArrow(encode, "part int, seg int, n_tokens long, image binary")
    images.write.option("compression", "uncompressed").option("maxRecordsPerFile", 1).parquet(path)


def _places(table: DataFrame) -> DataFrame:
    """(part, seg, shard, shard_start) of each image: its number and the ids before it. Images themselves aren't read."""
    # within each range by its place, and the ranges by prefix sums
    within = Window.partitionBy("part").orderBy("seg")
    sizes = table.select("part", "seg", "n_tokens").withColumn("_before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    ranges = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c"))
    tokens = common.prefix_offsets(ranges, "part", "n").select("part", F.col("offset").alias("_tokens"))
    shards = common.prefix_offsets(ranges, "part", "c").select("part", F.col("offset").alias("_shards"))
    at = sizes.join(tokens, "part").join(shards, "part")
    return at.select("part", "seg", (F.col("_shards") + F.col("seg")).alias("shard"), (F.col("_tokens") + F.col("_before")).alias("shard_start"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start, n_tokens, image): shards in order, the ids before each, and the image for ``WaveletMatrix``."""
    table = spark.read.parquet(path)
    return table.join(_places(table), ["part", "seg"]).select("shard", "shard_start", "n_tokens", "image")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids_crc32) of each document in the images at ``path``; start counts ids of all before it."""
    table = spark.read.parquet(path)
    names = ["part", "seg", "doc_id", "_start", "n_tokens", "ids_crc32"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = WaveletMatrix(image)
                raw = memoryview(m.decode().astype("<u4").tobytes())
                ids, lengths = m.documents
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
                same = lambda x: pa.array(np.full(len(ids), x, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(part), same(seg), pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names)

    docs = table.select("part", "seg", "image").mapInArrow(unpack, "part int, seg int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    return docs.join(_places(table), ["part", "seg"]).select("doc_id", "shard", (F.col("_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
