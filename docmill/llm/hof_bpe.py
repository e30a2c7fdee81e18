"""Byte-level BPE by ranked merges, folded with Spark's higher-order functions over distinct words.

1. Every text is cut by the byte-level pattern; each task counts its distinct pre-tokens, and one grouping counts them all.
2. ``fold``: ``aggregate`` folds merges over the array of a word's bytes: the pair of least rank (the leftmost of equals) is joined
   until no pair has a rank. Pieces are numbers and what a pair joins to is found by arithmetic, in two literals in the plan (``Merges``).
3. Words that recur are folded once and packed into a dictionary of at most ``dictionary_words`` words (the most frequent; the bound
   is what may be broadcast). A first pass over the texts writes the ids of the words it holds; the rest of a text's distinct words,
   chiefly those that occur once in the corpus, go beside the ids as an array, are folded by the same expression in the same
   stage, without a shuffle, and a second pass puts them in place.
4. Decoding concatenates the ids' binary pieces.

Words are told apart by their bytes: hashes only find what is then compared.

Defined cases: a null or empty text has no ids; a repeated row is encoded like any; a null doc_id stays; an empty table gives
no rows; other columns play no part; a pre-token of more than ``FOLD_BYTES`` bytes, for which the fold would take time in the square of
its length, is merged by the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import common, pretok, vocabulary

DICTIONARY_WORDS = 1_000_000
FOLD_BYTES = vocabulary.LONGEST
_BUCKETS = 1 << 14
_NONE = (1 << 31) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece of a file with lines of base64 piece and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """``ranks`` as arrays in which the fold finds what two neighbouring pieces join to, in two steps and by whole numbers.

    Pieces are numbered by rank. The pair (x, y) belongs to the bucket (x * ``a`` + y) mod the size of ``move``, and stands in ``pairs`` at
    (x * ``c`` + y + the bucket's move) modulo its size, as a number of three parts of ``bits`` bits: x, y and the piece that they join to.
    The first two are compared with the pair that is looked for, so what shares its place is never taken for it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        pieces = sorted(ranks, key=ranks.__getitem__)
        lone = [w for w in (bytes([b]) for b in range(256)) if w not in ranks]  # bytes without a rank may still be joined
        number = {w: i for i, w in enumerate(pieces + lone)}
        self.ids = [ranks[w] for w in pieces] + [_NONE] * len(lone)
        self.bytes = [number[bytes([b])] for b in range(256)]
        self.edge = len(number)  # stands before and after a word, and has no pairs
        self.bits = (self.edge + 1).bit_length()
        if self.bits > 20:
            raise ValueError("more than a million pieces")
        found = array("q")  # x, y, joined
        for w, joined in number.items():
            for i in range(1, len(w)):
                if (x := number.get(w[:i])) is not None and (y := number.get(w[i:])) is not None:
                    found.extend((x, y, joined))
        self._place(*np.frombuffer(found, np.int64).reshape(-1, 3).T)
        # pieces that no merges lead to: a word that equals one takes its rank nevertheless
        self.apart = {w: r for w, r in ranks.items() if len(w) > 1 and _merged(w, ranks) != [w]}

    def _place(self, x: np.ndarray, y: np.ndarray, joined: np.ndarray) -> None:
        """Finds each bucket's move, buckets of many pairs first; of those that clash in a round all but the first try again."""
        size = max(64, 1 << (5 * len(x) // 4).bit_length())
        rng = np.random.default_rng(1)
        done = False
        while not done:
            self.a, self.c = (int(k) | 1 for k in rng.integers(1 << 20, 1 << 30, 2))
            bucket, at = (x * self.a + y) % (size // 4), (x * self.c + y) % size
            self.move, taken = np.zeros(size // 4, np.int64), np.zeros(size, bool)
            many = np.bincount(bucket, minlength=size // 4)[bucket]
            for n in np.unique(many)[::-1].tolist():
                left = np.flatnonzero(many == n)
                for _ in range(2000):
                    if not len(left):
                        break
                    move = rng.integers(0, size, size // 4)
                    place = (at[left] + move[bucket[left]]) % size
                    fits = np.zeros(len(left), bool)
                    fits[np.unique(place, return_index=True)[1]] = True
                    bad = np.zeros(size // 4, bool)
                    bad[bucket[left[taken[place] | ~fits]]] = True
                    good = ~bad[bucket[left]]
                    self.move[bucket[left[good]]] = move[bucket[left[good]]]
                    taken[place[good]] = True
                    left = left[~good]
                done = not len(left)
                if not done:
                    break
            done = done or not len(x)
        self.pairs = np.full(size, (self.edge + 1) << 2 * self.bits)
        self.pairs[(at + self.move[bucket]) % size] = (x << self.bits | y) << self.bits | joined


def fold(word: str, merges: Merges) -> str:
    """SQL for the ids (array<int>) of the binary column ``word``; ``_with_merges`` binds the arrays ``move``, ``pairs`` and ``apart``.

    The state is one array: of each piece what it and the next join to (a number without a piece: nothing), then its own number.
    """
    bits, limit = merges.bits, 1 << merges.bits

    def element(x: str, y: str) -> str:
        move = f"get(move, CAST({x} * {merges.a}L + {y} & {len(merges.move) - 1}L AS INT))"
        place = f"get(pairs, CAST({x} * {merges.c}L + {y} + {move} & {len(merges.pairs) - 1}L AS INT))"
        return f"(shiftleft(least({place} ^ shiftleft(shiftleft({x}, {bits}) | {y}, {bits}), {limit}L), {bits}) | {x})"

    def own(i: str) -> str:
        return f"(s[{i}] & {limit - 1}L)"

    numbers = f"transform(split(decode({word}, 'ISO-8859-1'), ''), c -> get(array({', '.join(f'{k}L' for k in merges.bytes)}), ascii(c)))"
    start = f"flatten(array(array({merges.edge}L), {numbers}, array({merges.edge}L, {merges.edge}L)))"
    state = f"transform(array({start}), b -> transform(slice(b, 1, size(b) - 1), (x, i) -> {element('x', 'b[i + 1]')}))[0]"
    # the leftmost of the pairs that join to the piece of least rank; flatten, as concat takes far longer for short arrays
    at = f"CAST(array_position(transform(s, x -> shiftright(x, {bits})), shiftright(array_min(s), {bits})) AS INT)"
    new = f"shiftright(s[i - 1], {bits})"
    merge = f"flatten(array(slice(s, 1, i - 2), array({element(own('i - 2'), new)}, {element(new, own('i + 1'))}), slice(s, i + 2, size(s))))"
    step = f"CASE WHEN array_min(s) < {limit << bits}L THEN transform(array({at}), i -> {merge})[0] ELSE s END"
    pieces = f"aggregate(sequence(1, length({word})), {state}, (s, k) -> {step}, s -> transform(slice(s, 2, size(s) - 2), x -> CAST(x & {limit - 1}L AS INT)))"
    if merges.ids != list(range(len(merges.ids))):
        pieces = f"transform({pieces}, x -> get(array({', '.join(map(str, merges.ids))}), x))"
    if not merges.apart:
        return pieces
    bucket = f"get(apart, CAST(crc32(CAST(hex({word}) AS BINARY)) % {_BUCKETS} AS INT))"
    rank = f"nullif(substring_index(substring_index({bucket}, concat(',', hex({word}), '='), -1), ',', 1), '')"
    return f"CASE WHEN {rank} IS NULL THEN {pieces} ELSE array(CAST({rank} AS INT)) END"


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same rule for one word, with a heap of pairs: least rank first, then leftmost."""
    return [r] if (r := ranks.get(word)) is not None else [ranks[w] for w in _merged(word, ranks)]


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that merges leave of ``word``."""
    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != e or end[i] != j:
            continue
        end[i], alive[j], nxt[i] = e, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(word[prv[i] : e])) is not None:
            heapq.heappush(heap, (r, prv[i], e))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = nxt[i]
    return out


def _with_merges(merges: Merges, sql: str) -> Column:
    """``sql`` over the arrays of ``merges``, literals bound to lambda variables: the plan holds (and prints) them once."""

    def bound(name: str, literal: str, inner: str) -> str:  # constants: split once, when the plan is made
        return f"transform(array({literal}), {name} -> {inner})[0]"

    for name, row in (("move", merges.move), ("pairs", merges.pairs)):
        sql = bound(name, f"CAST(split('{','.join(map(str, row.tolist()))}', ',') AS ARRAY<BIGINT>)", sql)
    if merges.apart:
        rows = [[","] for _ in range(_BUCKETS)]
        for piece, rank in merges.apart.items():
            key = piece.hex().upper()
            rows[zlib.crc32(key.encode()) % _BUCKETS].append(f"{key}={rank},")
        sql = bound("apart", f"split('{'|'.join(''.join(r) for r in rows)}', '[|]')", sql)
    return F.expr(sql)


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``words`` with ``ids``: the fold in Spark's own functions."""
    return _encoded_words(words, Merges(ranks))


def _encoded_words(words: DataFrame, merges: Merges) -> DataFrame:
    return words.withColumn("ids", _with_merges(merges, fold("word", merges)))


def dictionary(docs: DataFrame, ranks: dict[bytes, int] | Merges, most: int = DICTIONARY_WORDS) -> list[np.ndarray]:
    """The ids of the most frequent recurring pre-tokens, folded in Spark and packed: never more than ``most`` words."""
    spark = docs.sparkSession
    done: list[str] = []
    chosen, held = vocabulary.frequent(common.written(vocabulary.distinct_words(docs), "bpe-words", drop=done), most)
    merges = ranks if isinstance(ranks, Merges) else Merges(ranks)
    folded = _encoded_words(chosen.repartition(common.partitions_for(spark, held, 20_000)), merges)
    out = vocabulary.packed(common.written(folded, "bpe-ids", drop=done))
    common.remove(spark, done)
    return out


_HOLE = np.uint32(1 << 31)


def _split(table: list[np.ndarray], ranks: dict[bytes, int], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(ids and holes, length of each word's ids, the words of the holes, how many of them each text has).

    What the dictionary lacks is a hole; each text numbers its own distinct words of that kind.
    """
    codes, first = pretok.distinct(data, starts, ends)
    at0, size = starts[first], (ends - starts)[first]
    known, place, rows = vocabulary.lookup(table, data, at0, ends[first])
    rows[~known] = 1
    flat = table[-1]
    for u in np.flatnonzero(~known & (size > FOLD_BYTES)).tolist():
        ids = merge_word(data[at0[u] : at0[u] + size[u]].tobytes(), ranks)
        place[u], rows[u], flat = len(flat), len(ids), np.concatenate([flat, np.array(ids, np.uint32)])
    hole = ~known & (size <= FOLD_BYTES)
    place[hole] = len(flat)
    out = pretok.take_rows(np.append(flat, _HOLE), place[codes], rows[codes])
    size_of = rows[codes]
    met = np.flatnonzero(hole[codes])
    text = np.repeat(np.arange(len(per)), per)[met]
    pairs, number = np.unique(text * len(first) + codes[met], return_inverse=True)
    count = np.bincount(pairs // max(len(first), 1), minlength=len(per))
    out[(np.cumsum(size_of) - size_of)[met]] = _HOLE + (number - (np.cumsum(count) - count)[text]).astype(np.uint32)
    word = first[pairs % max(len(first), 1)]
    return out, size_of, vocabulary.gather(data, starts[word], ends[word]), count


def _fill(flat: np.ndarray, of: np.ndarray, folded: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the holes filled, length of each place); ``of``: the text of each id, ``folded``: each text's list of folded words."""
    hole = flat >= _HOLE
    size = np.ones(len(flat), np.int64)
    at = np.flatnonzero(hole)
    if not len(at):
        return flat, size
    texts, words = folded.offsets.to_numpy().astype(np.int64), folded.values.offsets.to_numpy().astype(np.int64)
    row = texts[of[at]] + (flat[at] - _HOLE).astype(np.int64)
    source = np.concatenate([flat, folded.values.values.to_numpy().astype(np.uint32)])
    begin = np.arange(len(flat))
    begin[at], size[at] = len(flat) + words[row], words[row + 1] - words[row]
    return pretok.take_rows(source, begin, size), size


def encoded(docs: DataFrame, ranks_path: str, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids binary of little-endian u32, ids_sha256, decoded_sha256) of each text; see ``digests`` for less."""
    return _run(docs, ranks_path, most, True)


def digests(docs: DataFrame, ranks_path: str, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as ``encoded``, without the ids themselves."""
    return _run(docs, ranks_path, most, False)


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """``rows`` with ``decoded`` (binary): the concatenated pieces of its column ``ids``."""
    ranks = load_ranks(ranks_path)
    sent = rows.sparkSession.sparkContext.broadcast({r: p for p, r in ranks.items()})

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        piece = sent.value
        return ids.map(lambda x: None if x is None else b"".join(piece[i] for i in np.frombuffer(x, "<u4").tolist()))

    return rows.withColumn("decoded", run("ids"))


def _run(docs: DataFrame, ranks_path: str, most: int, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    common.short_plans(spark)
    ranks = load_ranks(ranks_path)
    sent_ranks = spark.sparkContext.broadcast(ranks)
    merges = Merges(ranks)
    common.trim()
    sent_words = spark.sparkContext.broadcast(dictionary(docs, merges, most))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = sent_words.value, sent_ranks.value
        for b in common.slices(batches, "text", 1 << 20):
            data, off = common.text_buffers(b.column(1))
            starts, ends, per = pretok.bpe_tokens(data, off)
            flat, size, words, count = _split(table, own, data, starts, ends, per) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(per), np.int64))
            edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per)])].tolist()
            raw = flat.astype("<u4").tobytes()
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[4 * i : 4 * j] for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), rare], ["doc_id", "part", "rare"])
        common.trim()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted((r, p) for p, r in sent_ranks.value.items())
        piece = [b""] * (pieces[-1][0] + 1 if pieces else 0)
        for r, p in pieces:
            piece[r] = p
        text = [b"%d" % i for i in range(len(piece))]
        for b in batches:
            parts = [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in parts], np.int64)
            flat, size = _fill(np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.repeat(np.arange(len(n)), n), b.column(2))
            edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])].tolist()
            ids, cols = flat.tolist(), [[], [], []]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                row = ids[i:j]
                cols[0].append(hashlib.sha256(b",".join([text[k] for k in row])).hexdigest())
                cols[1].append(hashlib.sha256(b"".join([piece[k] for k in row])).hexdigest())
                if with_ids:
                    cols[2].append(flat[i:j].astype("<u4").tobytes())
            out = [b.column(0), pa.array(np.diff(edge), pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(cols[2], pa.binary())] if with_ids else out, [*names, "ids"] if with_ids else names)

    # written, so that the workers of one pass are gone before those of the next start
    parts = common.written(docs.select("doc_id", "text").mapInArrow(split, "doc_id long, part binary, rare array<binary>"), "bpe-parts")
    folded = _with_merges(merges, f"transform(rare, w -> {fold('w', merges)})")
    more = ", ids binary" if with_ids else ""
    return parts.select("doc_id", "part", folded.alias("ids")).mapInArrow(finish, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
