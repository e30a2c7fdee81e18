"""Unigram token counts by dynamic programming shared over a trie.

A text's pre-tokens are its words, each led by the mark U+2581. Under a unigram vocabulary (piece, score) a word's best segmentation
maximises the sum of scores; its forward score at a place depends on the prefix before it alone, so it is computed once a
trie node, when a distinct word first reaches it. A terminal node stores the word's number of tokens.

The corpus' distinct words are counted, and those that recur (the most frequent, at most ``most``) are dealt to tasks by ranges, so that
words which share a prefix meet in one trie; their counts are packed and broadcast. A text's other words, chiefly those that occur
once, are inserted in the trie of the task that meets them. A trie is cleared beyond ``limit`` nodes, which costs repeated work only.
A word of more than ``LONG`` characters gets no nodes: its forward scores roll through an array as long as the longest piece, so that
memory beside the word itself doesn't grow with it.

The vocabulary's pieces come from a public tokenizer file, in order of id; their scores are those of Zipf's law over that order,
a fixed rule (no tokenizer is trained). A character that no piece matches scores ``penalty`` below the least score and costs one
token a byte, as with byte fallback.

Defined cases: a null or empty text has no words and no tokens; repeated rows are counted like any; a null doc_id stays; an empty
table gives no rows; other columns play no part; words of any length are scored whole; ties between segmentations go to the one whose last piece is longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm import common, pretok, vocabulary

MARK = "▁"
WORDS = 1_000_000
LONG = 4096


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """The logarithm of Zipf's law over the order of the pieces."""
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(i + 1) - total for i, p in reversed(list(enumerate(pieces)))}


def load_pieces(model: bytes) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in order of id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


class Trie:
    """Forward scores of prefixes: node 0 is the empty prefix; ``best`` and ``count`` are its best segmentation's score and tokens."""

    def __init__(self, scores: dict[str, float], penalty: float = 10.0, limit: int = 400_000):
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.least = min(scores.values(), default=0.0) - penalty
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count, self.terminal = [0.0], [0], {}

    def add(self, word: str) -> int:
        """Inserts a word; the tokens of its best segmentation, stored at its terminal node."""
        if len(word) > LONG:
            return self.rolled(word)
        if len(self.best) > self.limit:
            self.clear()
        child, best, count, scores = self.child, self.best, self.count, self.scores
        path, node = [0], 0
        for i, ch in enumerate(word):
            nxt = child.get((node, ch))
            if nxt is None:
                nxt = child[node, ch] = len(best)
                top, tokens = -math.inf, 0
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    s = scores.get(word[j : i + 1])
                    if s is not None and best[path[j]] + s > top:
                        top, tokens = best[path[j]] + s, count[path[j]] + 1
                if word[i] not in scores and best[node] + self.least > top:
                    top, tokens = best[node] + self.least, count[node] + len(ch.encode("utf-8", "replace"))
                best.append(top)
                count.append(tokens)
            node = nxt
            path.append(node)
        self.terminal[node] = count[node]
        return count[node]

    def rolled(self, word: str) -> int:
        """The tokens of a word's best segmentation, from the scores of its last prefixes alone."""
        scores, longest, size = self.scores, self.longest, self.longest + 1
        best, count = [0.0] * size, [0] * size
        for i, ch in enumerate(word):
            top, tokens = -math.inf, 0
            for j in range(max(0, i + 1 - longest), i + 1):
                s = scores.get(word[j : i + 1])
                if s is not None and best[j % size] + s > top:
                    top, tokens = best[j % size] + s, count[j % size] + 1
            if ch not in scores and best[i % size] + self.least > top:
                top, tokens = best[i % size] + self.least, count[i % size] + len(ch.encode("utf-8", "replace"))
            best[(i + 1) % size], count[(i + 1) % size] = top, tokens
        return count[len(word) % size]


def _scored(trie: Trie, words: list[bytes]) -> np.ndarray:
    """The tokens of each word; words are inserted in order, so that those which share a prefix meet it while it is fresh."""
    n = np.empty(len(words), np.int64)
    for i in sorted(range(len(words)), key=words.__getitem__):
        n[i] = trie.add(MARK + words[i].decode("utf-8", "replace"))
    return n


def dictionary(docs: DataFrame, sent_scores, most: int = WORDS) -> list[np.ndarray]:
    """The token counts of the most frequent recurring words, packed: never more than ``most`` words."""
    spark = docs.sparkSession
    done: list[str] = []
    chosen, held = vocabulary.frequent(common.written(vocabulary.distinct_words(docs, pretok.words), "trie-words", drop=done), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent_scores.value)
        for b in batches:
            n = _scored(trie, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1), pa.int32()), pa.array(n, pa.int32()))], ["word", "ids"])

    rows = chosen.repartitionByRange(common.partitions_for(spark, held, 50_000), "word").mapInArrow(run, "word binary, ids array<int>")
    out = vocabulary.packed(common.written(rows, "trie-counts", drop=done))
    common.remove(spark, done)
    return out


def counts(docs: DataFrame, model_path: str, most: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each whole text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(zipf_scores(load_pieces(Path(model_path).read_bytes())))
    sent_words = spark.sparkContext.broadcast(dictionary(docs, sent, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, table = Trie(sent.value), sent_words.value
        for b in common.slices(batches, "text", 1 << 20):
            data, off = common.text_buffers(b.column(1))
            starts, ends, per = pretok.words(data, off)
            codes, first = pretok.distinct(data, starts, ends)
            known, place, _ = vocabulary.lookup(table, data, starts[first], ends[first])
            n = np.zeros(len(first), np.int64)
            n[known] = table[-1][place[known]]
            raw, rest = data.tobytes(), np.flatnonzero(~known)
            n[rest] = _scored(trie, [raw[starts[i] : ends[i]] for i in first[rest].tolist()])
            upto = np.concatenate([[0], np.cumsum(n[codes])])[np.concatenate([[0], np.cumsum(per)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(per.astype(np.int64)), pa.array(np.diff(upto))], ["doc_id", "n_words", "n_tokens"])
        common.trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
