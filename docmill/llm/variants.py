"""Spelling variants: words grouped by one edit through two minimal acyclic automata.

1. ``words`` counts the runs of letters of all texts. Texts are split and damaged (a planted slip for measuring) in numpy batches, and each task
   counts its distinct words before anything is shuffled.
2. Two words one edit apart share the first half of either or, failing that, the second half. So a word looks for words of its length, one less and
   one more twice: in a forward automaton it walks its first half exactly and completes the rest with one error, and in a backward automaton, over
   reversed words, it does the same from its end. An automaton is minimal and acyclic, and its transitions carry counts, so that a path adds up to
   the number of its word (a perfect hash), by which paths to one word are told from paths to two.
3. Words and searches meet in cells, by length and the part that must be exact. A cell with many words is dealt into parts, and its searches into blocks that visit
   every part, so no task holds many more than ``PART`` words and three times as many searches, whatever a prefix's share of the vocabulary.
4. A search returns how many near words it found and the most frequent of them; what the forward automaton finds too isn't counted again by the backward one
   (a near word that starts with the searched word's first half is the forward one's). Sums and maxima over a word's searches give its form, and pointer jumping its root.

Words are bytes of Latin-1, one a code point, whose order is that of code points.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the slip's hash; repeated rows count each; ties go to the
smaller word; texts and words may be of any length; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import common, pretok, vocabulary

LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
PART = 20_000
_CELL = 10_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points as bytes, starts, ends, text of each run) of maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return data, z, z, z
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.where(cps < 256, cps, 0).astype(np.uint8)
    chars[(chars >= 65) & (chars <= 90)] += 32
    full = _LETTER[chars]
    heads = np.searchsorted(lead, off[:-1])  # first code point of each text
    begin, stop = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    stop[:-1] &= ~full[1:]
    some = heads[off[:-1] < off[1:]]
    begin[some] = full[some]
    edge = some[some > 0] - 1
    stop[edge] = full[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return chars, starts, ends, np.searchsorted(heads, starts, side="right") - 1


_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def crc_on(state: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each state's bytes followed by the UTF-8 bytes of its Latin-1 span: all spans go on by one character at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    c, at, size = state[order] ^ np.uint32(0xFFFFFFFF), starts[order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # spans of more than k characters come first
        ch = chars[at[:n] + k]
        wide = ch >= 0x80
        now = c[:n]
        if wide.any():
            w = np.flatnonzero(wide)
            now[w] = _CRC[(now[w] ^ (0xC0 | ch[w] >> 6)) & 0xFF] ^ now[w] >> np.uint32(8)
            ch = np.where(wide, 0x80 | ch & 0x3F, ch)
        c[:n] = _CRC[(now ^ ch) & 0xFF] ^ now >> np.uint32(8)
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with at least ``least_length`` code points and ``least_count`` occurrences.

    ``slip``: where it divides the crc32 of ``<doc_id>:<word>``, the word loses the code point at that number modulo its length; 0 for no slips.
    """
    common.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            chars, starts, ends, text = runs(*common.text_buffers(b.column(1)))
            keep = ends - starts >= least_length
            chars, starts, ends, text = chars, starts[keep], ends[keep], text[keep]
            if not len(starts):
                continue
            size = ends - starts
            lost = np.full(len(starts), -1)
            if slip:
                head = np.array([zlib.crc32(b"" if d is None else b"%d" % d) for d in b.column(0).to_pylist()], np.uint32)
                head = crc_on(head, np.frombuffer(b":", np.uint8), np.zeros(len(head), np.int64), np.ones(len(head), np.int64))
                h = crc_on(head[text], chars, starts, ends)
                hit = h % slip == 0
                lost[hit] = starts[hit] + (h[hit] % size[hit])
                whole = (lost < 0) | (size > least_length)
                starts, ends, lost, size = starts[whole], ends[whole], lost[whole], size[whole]
            # what is left of the slips stands after the characters
            cut = np.flatnonzero(lost >= 0)
            short = [np.concatenate([chars[s:x], chars[x + 1 : e]]) for s, e, x in zip(starts[cut].tolist(), ends[cut].tolist(), lost[cut].tolist(), strict=True)]
            upto = len(chars) + np.cumsum([0, *map(len, short)])
            starts[cut], ends[cut] = upto[:-1], upto[1:]
            chars = np.concatenate([chars, *short])
            codes, first = pretok.distinct(chars, starts, ends)
            yield pa.RecordBatch.from_arrays([vocabulary.gather(chars, starts[first], ends[first]), pa.array(np.bincount(codes, minlength=len(first)))], ["_w", "n"])
        common.trim()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "_w binary, n long")
    return found.groupBy("_w").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count).select(F.decode("_w", "ISO-8859-1").alias("word"), "n")


class Automaton:
    """The minimal acyclic automaton of sorted distinct words (bytes): state 0 is dead, ``start`` the first.

    Transitions stand in the order of (state, label). ``skip`` counts the words that come before a transition's own among those of its state, so the
    sum over a path is its word's number in sorted order.
    """

    def __init__(self, words: list[bytes]):
        parent, label, final, path, before = [0], [0], [False], [0], b""
        for w in words:
            k = 0
            most = min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del path[k + 1 :]
            for ch in w[k:]:
                parent.append(path[-1])
                label.append(ch)
                final.append(False)
                path.append(len(parent) - 1)
            final[path[-1]], before = True, w
        kids: dict[int, list[tuple[int, int]]] = {}
        known: dict[tuple, int] = {}
        self.final, self.size = [False], [0]
        state, target, skip = [], [], []
        for node in range(len(parent) - 1, -1, -1):  # a node's children come after it, the last one first
            own = tuple(reversed(kids.pop(node, ())))
            key = (final[node], own)
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.size)
                n = int(final[node])
                for ch, to in own:
                    state.append(at << 8 | ch)
                    target.append(to)
                    skip.append(n)
                    n += self.size[to]
                self.final.append(final[node])
                self.size.append(n)
            if node:
                kids.setdefault(parent[node], []).append((label[node], at))
        self.start = at
        self.key, self.target, self.skip = np.array(state, np.int64), np.array(target, np.int64), np.array(skip, np.int64)
        self.accepts = np.array(self.final)
        # keys rise with the state, as each state's transitions are added together in the order of labels
        self.first = np.searchsorted(self.key, np.arange(len(self.size) + 1) << 8)

    def step(self, at: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, what the path's number grows by); 0 where there is no transition."""
        if not len(self.key):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        want = at << 8 | label
        k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[k] == want
        return np.where(hit, self.target[k], 0), np.where(hit, self.skip[k], 0)

    def fan(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the state, transition) of all transitions of the states."""
        n = self.first[at + 1] - self.first[at]
        of = np.repeat(np.arange(len(at)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[at][of]

    def near(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, word's number), each pair once: words one edit from chars[start:start + size] that share its first ``exact`` characters.

        All searches advance together, a character at a time.
        """
        q = np.arange(len(starts))
        at, number = np.full(len(q), self.start, np.int64), np.zeros(len(q), np.int64)
        for k in range(int(exact.max()) if len(exact) else 0):
            go = exact[q] > k
            to, more = self.step(at[go], chars[starts[q[go]] + k])
            at[go], number[go] = to, number[go] + more
            alive = at > 0
            q, at, number = q[alive], at[alive], number[alive]
        pos = exact[q].astype(np.int64)
        found = []
        done = (np.zeros(0, np.int64),) * 4  # searches after their error: (search, state, number, position)
        while len(q) or len(done[0]):
            # those that have made their error go on exactly
            e_q, e_at, e_no, e_pos = done
            over = e_pos == sizes[e_q]
            end = over & self.accepts[e_at]
            found.append((e_q[end], e_no[end]))
            e_q, e_at, e_no, e_pos = (x[~over] for x in (e_q, e_at, e_no, e_pos))
            to, more = self.step(e_at, chars[starts[e_q] + e_pos])
            nxt = [(e_q[to > 0], to[to > 0], (e_no + more)[to > 0], e_pos[to > 0] + 1)]
            # those that haven't may make it here: a character more, another one, or one less
            of, t = self.fan(at)
            nxt.append((q[of], self.target[t], number[of] + self.skip[t], pos[of]))
            inside = pos < sizes[q]
            here = chars[starts[q] + np.minimum(pos, sizes[q] - 1)]
            other = inside[of] & ((self.key[t] & 255) != here[of])
            nxt.append((q[of][other], self.target[t][other], (number[of] + self.skip[t])[other], pos[of][other] + 1))
            nxt.append((q[inside], at[inside], number[inside], pos[inside] + 1))
            done = tuple(np.concatenate(x) for x in zip(*nxt, strict=True))
            to, more = self.step(at[inside], here[inside])
            live = to > 0
            q, at, number, pos = q[inside][live], to[live], (number[inside] + more)[live], pos[inside][live] + 1
        search, number = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        # several paths may lead to one word
        width = int(self.size[self.start]) + 1
        pairs = np.unique(search * width + number)
        return pairs // width, pairs % width


def search(held: list[bytes], asked: list[bytes], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``asked``, index in ``held``) of near pairs that share the first half of the asked word, or backward the second half and not the first."""
    turned = [w[::-1] for w in held] if backward else held
    order = sorted(range(len(held)), key=turned.__getitem__)
    a = Automaton([turned[i] for i in order])
    flat = [w[::-1] for w in asked] if backward else asked
    sizes = np.array([len(w) for w in flat], np.int64)
    exact = sizes - sizes // 2 if backward else sizes // 2
    q, number = a.near(np.frombuffer(b"".join(flat), np.uint8), np.cumsum(sizes) - sizes, sizes, exact)
    h = np.array(order, np.int64)[number]
    if backward:
        new = np.array([not held[j].startswith(asked[i][: len(asked[i]) // 2]) for i, j in zip(q.tolist(), h.tolist(), strict=True)], bool)
        q, h = q[new], h[new]
    return q, h


def _searches(counts: DataFrame, part: int) -> DataFrame:
    """``counts`` (_w, n) dealt into (cell, part, block, back) with _ask: words held by a cell's part, and those that search it.

    A word of length m is held under m and its first (backward: last) characters that any word one edit away with the same half must share.
    """
    size = F.length("_w")
    cells = max(1, -(-counts.count() // _CELL))

    def key(length, back: bool):
        # half of the shortest word that may ask, at least half of the shortest word there is; backward the longer half
        n = F.floor((length - 1 + int(back)) / 2).cast("int")
        part_of = F.substring(F.reverse("_t") if back else F.col("_t"), F.lit(1), n)
        return F.pmod(F.xxhash64(length, part_of, F.lit(back)), F.lit(cells))

    both = []
    base = counts.select("_w", "n", F.decode("_w", "ISO-8859-1").alias("_t"))
    for back in (False, True):
        holds = base.select("_w", "n", F.lit(back).alias("back"), F.lit(False).alias("_ask"), key(size, back).alias("cell"))
        asks = base.select("_w", "n", F.lit(back).alias("back"), F.lit(True).alias("_ask"), F.explode(F.array_distinct(F.array(*(key(size + d, back) for d in (-1, 0, 1))))).alias("cell"))
        both += [holds, asks]
    rows = both[0]
    for x in both[1:]:
        rows = rows.unionByName(x)
    rows = common.written(rows, "variant-rows")
    load = rows.groupBy("cell", "back").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("_ask") == ask, 1).otherwise(0)) / most)).cast("int").alias(k) for ask, k, most in ((False, "_parts", part), (True, "_blocks", 3 * part))))
    load = load.select(F.col("cell").alias("_c"), F.col("back").alias("_b"), "_parts", "_blocks")
    at = rows.join(load, (F.col("cell") == F.col("_c")) & (F.col("back") == F.col("_b")))
    own = lambda n: F.pmod(F.xxhash64("_w"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = at.where("NOT _ask").withColumn("part", own("_parts")).withColumn("block", every("_blocks"))
    asked = at.where("_ask").withColumn("block", own("_blocks")).withColumn("part", every("_parts"))
    return held.unionByName(asked).select("cell", "back", "part", "block", "_ask", "_w", "n")


def near(counts: DataFrame, pairs: bool = False, part: int = PART) -> DataFrame:
    """Near words of ``counts`` (_w: Latin-1 bytes, n): (_w, n_near, form, form_n), the number of near words and the most frequent one, ties to
    the smallest; with ``pairs`` (_w, form) for each pair instead, in either direction."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        held, asked = df[~df["_ask"]], df[df["_ask"]]
        empty = not len(held) or not len(asked)
        words, back = list(held["_w"]), bool(key[1])
        words_of = list(asked["_w"])
        q, h = (np.zeros(0, np.int64),) * 2 if empty else search(words, words_of, back)
        n = held["n"].to_numpy()
        if pairs:
            return pd.DataFrame({"_w": [words_of[i] for i in q], "n_near": 1, "form": [words[j] for j in h], "form_n": n[h] if len(h) else []})
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[h], -n[h], q)) if len(q) else np.zeros(0, np.int64)
        q, h = q[order], h[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        total = np.diff(np.append(first, len(q)))
        return pd.DataFrame({"_w": [words_of[i] for i in q[first]], "n_near": total, "form": [words[j] for j in h[first]], "form_n": n[h[first]] if len(first) else []})

    found = _searches(counts, part).groupBy("cell", "back", "part", "block").applyInPandas(run, "_w binary, n_near long, form binary, form_n long")
    if pairs:
        return found.select("_w", "form")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f")))
    return found.groupBy("_w").agg(F.sum("n_near").alias("n_near"), best.alias("_m")).select("_w", "n_near", F.col("_m.f").alias("form"), (-F.col("_m.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(_w, root) for ``links`` (_w, form): what following forms leads to. Paths halve each round; forms must not run in circles."""
    spark, old = links.sparkSession, []
    at = common.written(links.select("_w", F.col("form").alias("root")), "variant-roots", drop=old)
    for _ in range(64):
        on = at.select(F.col("_w").alias("_k"), F.col("root").alias("_to"))
        nxt = common.written(at.join(on, F.col("root") == F.col("_k"), "left").select("_w", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_on")), "variant-roots", drop=old)
        moved = nxt.where("_on").limit(1).count()
        gone, old = old[:-1], old[-1:]
        common.remove(spark, gone)
        at = nxt.select("_w", "root")
        if not moved:
            return at
    raise RuntimeError("forms run in circles")


def group(counted: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``counted`` (word, n; distinct words of Latin-1 letters): a word's form is its most frequent near word if that
    occurs at least ``ratio`` (2 or more) times as often."""
    counts = common.written(counted.select(F.encode("word", "ISO-8859-1").alias("_w"), "n"), "variant-words")
    found = common.written(near(counts, part=part), "variant-near")
    all_ = counts.join(found.select(F.col("_w").alias("_k"), "n_near", F.col("form").alias("_f"), F.col("form_n").alias("_n")), F.col("_w") == F.col("_k"), "left")
    often = F.col("_n") >= ratio * F.col("n")
    all_ = common.written(all_.select("_w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("_f")).alias("form"), F.when(often, F.col("_n")).alias("form_n")), "variant-forms")
    ends = roots(all_.where("form IS NOT NULL").select("_w", "form")).select(F.col("_w").alias("_k"), "root")
    out = all_.join(ends, F.col("_w") == F.col("_k"), "left")
    text = lambda c: F.decode(c, "ISO-8859-1")
    return out.select(text("_w").alias("word"), text("form").alias("form"), text(F.coalesce("root", "_w")).alias("root"), "n", "n_near", "form_n")
