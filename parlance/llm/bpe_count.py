"""Counting BPE tokens by merging alone: a heap of adjacent pairs over a linked list of symbols.

A word of n bytes starts as n symbols; the adjacent pair of lowest rank (leftmost first) is merged until no pair has
a rank; the count is n less the merges. No token ids are emitted. Each distinct word is counted once per block, and
a bounded table of counts stays with the Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import pretoken
from parlance.llm.bpe_codec import vocabulary_bytes
from parlance.runtime import ship

LIMIT = 1024
#: Words whose counts a worker keeps (about 100 bytes each); beyond it starts afresh.
KEPT = 1_000_000

_BITS = 20


class Merges:
    """Ranks of the merges as {left << 20 | right: rank << 20 | result}, over symbols numbered as in the vocabulary."""

    def __init__(self, vocabulary: pretoken.Vocabulary):
        vocab = vocabulary.spec["vocab"]
        if len(vocab) >= 1 << _BITS:
            raise ValueError("vocabulary too large")
        self.symbol = [0] * 256
        for c, b in vocabulary.to_byte.items():
            self.symbol[b] = vocab[c]
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(vocabulary.spec["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocab[left] << _BITS | vocab[right], rank << _BITS | vocab[left + right])
        self.special = {t.encode() for t in vocabulary.special}
        self.counts: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        if word in self.special:
            return 1
        ranks, n = self.ranks, len(word)
        symbols = [self.symbol[b] for b in word]
        if n < 2:
            return n
        get = ranks.get
        heap = []
        for i in range(n - 1):
            r = get(symbols[i] << _BITS | symbols[i + 1])
            if r is not None:
                heap.append((r >> _BITS) << 32 | i)
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            r = get(symbols[i] << _BITS | symbols[j])
            if r is None or r >> _BITS != top >> 32:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = r & 0xFFFFF, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = get(symbols[i] << _BITS | symbols[k])
                if r is not None:
                    heappush(heap, (r >> _BITS) << 32 | i)
            h = before[i]
            if h >= 0:
                r = get(symbols[h] << _BITS | symbols[i])
                if r is not None:
                    heappush(heap, (r >> _BITS) << 32 | h)
        return left

    def table(self, words: list[bytes]) -> np.ndarray:
        counts, count = self.counts, self.count
        out = np.empty(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            c = counts.get(w)
            if c is None:
                c = count(w)
                if len(w) <= 64:
                    counts[w] = c
            out[i] = c
        if len(counts) > KEPT:
            counts.clear()
        return out


_merges: dict[int, Merges] = {}


def load(content: bytes) -> tuple[pretoken.Vocabulary, Merges]:
    key = hash(content)
    if key not in _merges:
        _merges.clear()
        _merges[key] = Merges(pretoken.load(content))
    return pretoken.load(content), _merges[key]


def counter(content: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, merges = load(content.value)
        for batch in batches:
            for i, j, words, index, at in pretoken.blocks(vocabulary, batch.column("text")):
                sums = np.zeros(len(index) + 1, dtype=np.int64)
                np.cumsum(merges.table(words.to_pylist())[index], out=sums[1:])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("n_bytes")[i:j], pa.array(np.diff(sums[at]))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the json file at path, without added special tokens; special
    strings within a text count one. A null text counts as empty, a null doc_id stays null, a very long text is a block of its
    own, whole. Repeated rows repeat; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    content = spark.sparkContext.broadcast(vocabulary_bytes(path))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = source.mapInArrow(counter(content), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
