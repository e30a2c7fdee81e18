"""Vectorised word splitting: the byte-level BPE pattern and plain white-space words, over whole Arrow batches.

The byte-level pattern is applied by rule rather than by a regular-expression engine: code points fall into four classes
(letter, number, white space, other), a token is a run of one class, a single U+0020 joins the run after it, the last
white-space character before a run stands apart from the white space before it, and a run that begins with an apostrophe
may give way to one of seven contractions. Tests hold the result against the pattern itself.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property, and the contractions of the pattern.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT = ("s", "t", "m", "d")
LONG = ("re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = WHITE
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _chunks(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the spans' runs of eight bytes as integers, zeros after a span's end; each run's place in its span; each span's first run)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = np.maximum((size + 7) >> 3, 1)
    head = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(head, n)
    value = at8[np.repeat(starts, n) + (k << 3)]
    bits = (np.minimum(np.repeat(size, n) - (k << 3), 8) << 3).astype(np.uint64)  # that belong to the span
    value &= np.where(bits >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
    return value, k, head


def _hash(value: np.ndarray, k: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(value + (k.astype(np.uint64) + np.uint64(1)) * _STEP), head) + size.astype(np.uint64) * _STEP)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: its runs of eight bytes are each mixed with their place, then added.

    A hash alone proves nothing: where identity matters, ``distinct`` and ``equal_spans`` compare the bytes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    return _hash(*_chunks(data, starts, size), size)


def equal_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at_a:at_a + size] and b[at_b:at_b + size] hold the same bytes, span by span."""
    if not len(size):
        return np.zeros(0, bool)
    va, _, head = _chunks(a, at_a, size)
    return np.logical_and.reduceat(va == _chunks(b, at_b, size)[0], head)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each span's distinct content, the first span of each number): equal numbers mean equal bytes.

    Spans are grouped by hash, then each is compared with its group's first; what differs is grouped by its bytes.
    """
    import pandas as pd

    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts
    value, k, head = _chunks(data, starts, size)
    codes, uniq = pd.factorize(_hash(value, k, head, size))
    codes = codes.astype(np.int64)
    first = np.empty(len(uniq), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    to = first[codes]
    same = size == size[to]
    if same.all():
        n = np.diff(np.append(head, len(value)))
        same &= np.logical_and.reduceat(value == value[np.arange(len(value)) + np.repeat(head[to] - head, n)], head)
    else:
        same[same] = equal_spans(data, starts[same], data, starts[to[same]], size[same])
    odd = np.flatnonzero(~same)
    if len(odd):
        more: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            w = data[starts[i] : ends[i]].tobytes()
            if w not in more:
                more[w] = len(first) + len(extra)
                extra.append(i)
            codes[i] = more[w]
        first = np.concatenate([first, np.array(extra, np.int64)])
    return codes, first


def bpe_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, tokens of each text) of the byte-level pattern's matches over texts data[off[i]:off[i+1]]."""
    docs = len(off) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(docs, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cps)
    cls = classes()[cps]
    first = np.searchsorted(at, off[:-1][off[:-1] < off[1:]])  # code point at which each non-empty text begins
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    cut = np.empty(n + 4, bool)
    cut[0] = True
    np.not_equal(cls[1:], cls[:-1], out=cut[1:n])
    cut[n:] = True
    cut[:n] |= head[:n]
    # the last white space before something else of the same text
    last = np.flatnonzero((cls[:-1] == WHITE) & (cls[1:] != WHITE) & ~head[1:n])
    cut[last] = True
    cut[last[cps[last] == 0x20] + 1] = False
    # contractions
    q = np.flatnonzero((cps == 0x27) & cut[:n])
    if len(q):
        pad = np.concatenate([cps, np.zeros(3, np.uint32)])
        edge = np.concatenate([head, np.ones(3, bool)])
        here = ~edge[q + 1]
        one = here & np.isin(pad[q + 1], [ord(c) for c in SHORT])
        two = np.zeros(len(q), bool)
        for a, b in LONG:
            two |= here & ~edge[q + 2] & (pad[q + 1] == ord(a)) & (pad[q + 2] == ord(b))
        cut[q[one | two] + 1] = False
        cut[q[one] + 2] = True
        cut[q[two] + 3] = True
    starts = np.flatnonzero(cut[:n])
    starts = at[starts]
    ends = np.append(starts[1:], len(data))
    per = np.diff(np.searchsorted(starts, off))
    return starts, ends, per


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, words of each text): maximal runs without U+0020 and U+0009 to U+000D."""
    docs = len(off) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(docs, np.int64)
    full = ~_BLANK[data]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begin[heads] |= full[heads]
    stop = np.ones(len(data), bool)
    stop[:-1] = ~full[1:]
    stop[heads[1:] - 1] = True
    stop &= full
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


class WordTable:
    """A growing map from a word's bytes to a row of integers, held in flat arrays; beyond ``limit`` words only those that were met again
    since the last time are kept, or none if they are more than half.

    ``encode`` gets the bytes of unknown distinct words and returns their rows. Forgetting costs repeated work, never results.
    """

    def __init__(self, encode, limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.again)
        if len(kept) > self.limit // 2:
            return self.clear()
        place = np.full(len(self.start), -1)
        place[kept] = np.arange(len(kept))
        self.row = {w: k for w, k in zip(self.row, place[np.fromiter(self.row.values(), np.int64, len(self.row))].tolist(), strict=True) if k >= 0}
        self.flat, self.size = take_rows(self.flat, self.start[kept], self.size[kept]), self.size[kept]
        self.start, self.again = np.cumsum(self.size) - self.size, np.zeros(len(kept), bool)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat integers, length of each word's row) for the words data[start:end], in order."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, first = distinct(data, starts, ends)
        if len(self.row) > self.limit:
            self._forget()
        raw = data.tobytes()
        words = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        at = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            done = [self.encode(fresh[k : k + 10_000]) for k in range(0, len(fresh), 10_000)]
            flat, size = (np.concatenate([x[j] for x in done]) for j in (0, 1))
            at[new] = len(self.start) + np.arange(len(new))
            self.row.update(zip(fresh, at[new].tolist(), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        at = at[codes]
        return take_rows(self.flat, self.start[at], self.size[at]), self.size[at]


def take_rows(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[begin:begin + size], one after the other."""
    return flat[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]


def lowered(data: np.ndarray, off: np.ndarray, normal) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts in lower case and composed form.

    Code points up to U+00FF are composed already and are put in lower case here; ``normal`` (str to str) is asked about texts that hold others.
    """
    if not len(data):
        return data, off
    far = np.flatnonzero(data >= 0xC4)  # the first byte of a code point beyond U+00FF
    if len(far):
        asked = set((np.searchsorted(off, far, side="right") - 1).tolist())
        raw = data.tobytes()
        texts = [normal(t.decode()).encode() if i in asked else t for i, t in enumerate(raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    tail = np.flatnonzero(out[:-1] == 0xC3) + 1
    at = tail[(out[tail] <= 0x9E) & (out[tail] != 0x97)]
    out[at] += 32
    return out, off


def word_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, matches of each text): contractions, runs of letters, single numbers, runs of other characters.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``; white space only parts the matches.
    """
    docs = len(off) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(docs, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cps)
    cls = classes()[cps]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, off[:-1][off[:-1] < off[1:]])] = True
    head[n] = True
    cut = np.ones(n + 4, bool)
    np.not_equal(cls[1:], cls[:-1], out=cut[1:n])
    cut[:n] |= head[:n] | (cls == NUMBER)
    q = np.flatnonzero((cps == 0x27) & cut[:n])
    if len(q):
        pad = np.concatenate([cps, np.zeros(3, np.uint32)])
        edge = np.concatenate([head, np.ones(3, bool)])
        here = ~edge[q + 1]
        one = here & np.isin(pad[q + 1], [ord(c) for c in SHORT])
        two = np.zeros(len(q), bool)
        for a, b in LONG:
            two |= here & ~edge[q + 2] & (pad[q + 1] == ord(a)) & (pad[q + 2] == ord(b))
        cut[q[one | two] + 1] = False
        cut[q[one] + 2] = True
        cut[q[two] + 3] = True
    first = np.flatnonzero(cut[:n])
    starts = at[first]
    ends = np.append(starts[1:], len(data))
    solid = cls[first] != WHITE
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.diff(np.searchsorted(starts, off))
