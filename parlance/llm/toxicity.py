"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (DIMS of them) of its ASCII-lower-cased words stripped of ASCII signs at
their ends, of the beginnings of longer words (inflected forms share them), of its pairs of neighbours, and of its pairs
with one word between. Weights are learnt by FTRL-proximal,
which gives each coordinate its own rate and keeps those with little evidence at exactly zero (L1), so that the
model is a short list of weights: DIMS * 12 bytes at the very most, which is what is broadcast.

Learning takes at most about SAMPLE labelled texts and SAMPLE_BYTES of them (by a hash of the doc_id) in one task; the
sample is bounded, all texts are scored. The settings below are those of least log loss in a four-fold
cross-validation among the labels that may be learnt from (crc32 mod 5 not 0); see README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import textops
from parlance.runtime import ship

DIMS, SAMPLE, SAMPLE_BYTES, PASSES = 1 << 20, 12_000, 48 << 20, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
#: Lengths in bytes of the beginnings of words.
PREFIXES = (4, 5, 6, 8)
#: Index of the intercept in the learnt table.
INTERCEPT = -1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of all documents of data, in runs, and for each the document it belongs to (repeats included)."""
    starts, ends, words = textops.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(3):  # signs around a word
        starts = np.where((ends - starts > 1) & _SIGN[data[starts]], starts + 1, starts)
        ends = np.where((ends - starts > 1) & _SIGN[data[ends - 1]], ends - 1, ends)
    folded = _FOLD[data]
    h = textops.word_hashes(folded, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    found, where = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(textops.mixed(h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + h[gap:])[same])
            where.append(doc[gap:][same])
    for length in PREFIXES:
        longer = ends - starts > length
        found.append(textops.mixed(textops.word_hashes(folded, starts[longer], starts[longer] + length) + np.uint64(length)))
        where.append(doc[longer])
    index = np.concatenate(found) >> np.uint64(64 - DIMS.bit_length() + 1)
    return index.astype(np.int64), np.concatenate(where)


def train(examples: list[tuple[np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights (DIMS) and intercept from (distinct feature indexes, label), in the order given."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for _ in range(passes):
        for index, label in examples:
            at = np.append(index, DIMS)
            zi, ni = z[at], n[at]
            l1 = np.full(len(at), L1)
            l1[-1] = 0.0
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    l1 = np.full(DIMS + 1, L1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:DIMS], float(w[DIMS])


def trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (at, text, label) of one task to the non-zero weights (index, weight), the intercept at INTERCEPT."""
    rows: list[tuple[int, np.ndarray, int]] = []
    for batch in batches:
        data, offsets = textops.utf8(batch.column("text"))
        order, labels = batch.column("at").to_pylist(), batch.column("label").to_pylist()
        for i, j in textops.chunks(offsets):
            index, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            both = np.unique(doc * DIMS + index)
            cuts = np.searchsorted(both, np.arange(j - i + 1) * DIMS)
            rows += [(order[i + d], (both[cuts[d] : cuts[d + 1]] - d * DIMS).astype(np.int32), labels[i + d]) for d in range(j - i)]
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    w, b = train([(x, y) for _, x, y in rows]) if rows else (np.zeros(DIMS), 0.0)
    hit = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, INTERCEPT)), pa.array(np.append(w[hit], b))], names=["index", "weight"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept from docs (doc_id, text) and labels (doc_id, toxic); null labels, texts and doc_ids teach nothing.

    Where a doc_id has several labels, toxic wins; where it has several texts, each teaches. If there are more than `sample`
    labelled texts, or SAMPLE_BYTES of them, about as many are taken by a hash of doc_id; their labels, being so few,
    are broadcast. A very long text that is taken is learnt from whole. Other columns are not read. Without labelled texts
    all weights are 0.
    """
    ship(docs.sparkSession)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).withColumn("at", F.xxhash64(F.lit(seed), F.col("doc_id")))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")

    def taken(share: float) -> DataFrame:
        return known.filter(F.shiftrightunsigned("at", 33) < int(share * (1 << 31)))

    share = min(1.0, sample / max(known.count(), 1))
    size = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(taken(share)), "doc_id").agg(F.sum("size")).first()[0] or 0
    share *= min(1.0, SAMPLE_BYTES / max(size, 1))
    rows = texts.join(F.broadcast(taken(share)), "doc_id").select("at", "text", "label")
    table = rows.repartition(1).mapInArrow(trainer, "index long, weight double").toArrow()
    index, weight = table.column("index").to_numpy(), table.column("weight").to_numpy()
    weights = np.zeros(DIMS)
    weights[index[index >= 0]] = weight[index >= 0]
    return weights, float(weight[index == INTERCEPT].sum())


def scorer(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, intercept = model.value
        weights = np.zeros(DIMS)
        weights[index] = weight
        for batch in batches:
            data, offsets = textops.utf8(batch.column("text"))
            for i, j in textops.chunks(offsets):
                found, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                live = weights[found] != 0
                both = np.unique(doc[live] * DIMS + found[live])
                total = intercept + np.bincount(both // DIMS, weights=weights[both % DIMS], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score (0 to 1), predicted (1 from 0.5 on).

    A null or empty text has the intercept's score. Only the text decides; repeated rows give equal results, a null
    doc_id stays null, a text of any length is scored whole.
    """
    spark = docs.sparkSession
    ship(spark)
    weights, intercept = model
    hit = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((hit, weights[hit], intercept))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scorer(sent), "doc_id long, score double")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
