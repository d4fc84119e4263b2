"""Quality rules by host: failures of document rules, shrunk per host, joined back to the documents.

1.  Each text is measured once (Arrow batches, whole texts); what goes on is a few numbers per document.
2.  Failures are counted per host (here: per source) by partial aggregation, so a host of any size is a row per task.
3.  The hosts' failure rates have a Beta prior fitted to them by moments; a host's rate is its posterior mean, so
    that a host of few documents is not condemned by them. A host fails if its odds of a failure are, with some
    certainty (posterior mean less CERTAINTY standard deviations), more than ODDS times those of all documents.
4.  The host verdicts are joined back; a document is kept if it and its host pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import textops
from parlance.runtime import materialize, ship, small_or_shuffled

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
#: A host's odds of a failure may be ODDS times the pooled ones, judged CERTAINTY standard deviations below its mean.
ODDS, CERTAINTY = 4.0, 2.0
#: Bounds of the prior's weight in documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(hashes: np.ndarray, words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document, the words that lie in a window found twice or more in it."""
    where, n = textops.window_index(words, window)
    if not len(where):
        return np.zeros(len(n), dtype=np.int64)
    own = textops.mixed(textops.gram_hashes(hashes, window)[where] + np.repeat(np.arange(len(n)), n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(window):
        covered[where[again] + k] = True
    return _per_document(covered, words)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.utf8(batch.column("text"))
        for i, j in textops.chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, words = textops.words(part, at)
            chars = _per_document(~textops.SPACE[part] & ((part & 0xC0) != 0x80), at)
            repeats = repeated_words(textops.word_hashes(part, starts, ends), words)
            raw, twice = part.tobytes(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
                twice.append(len(lines) - len(set(lines)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], batch.column("host")[i:j], pa.array(np.diff(words)), pa.array(chars), pa.array(_per_document(_SYMBOL[part], at)), pa.array(twice, pa.int64()), pa.array(repeats)],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )


def host_rates(measured: DataFrame, odds: float = ODDS, certainty: float = CERTAINTY) -> DataFrame:
    """(host, documents, failures, rate, limit, passes) from (host, base_failed): rate is the posterior mean of the host's failure rate.

    The prior comes from two sums over the hosts, which are all that the driver sees.
    """
    hosts = materialize(measured.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures")), "host-counts")
    raw = F.col("failures") / F.col("documents")
    pooled = hosts.agg((F.sum("failures") / F.sum("documents")).alias("mean"), F.avg(raw).alias("one"), F.avg(raw * raw).alias("two")).first()
    mean = pooled["mean"] or 0.0
    spread = (pooled["two"] or 0.0) - 2 * mean * (pooled["one"] or 0.0) + mean * mean
    weight = min(MOST_PRIOR, max(LEAST_PRIOR, mean * (1 - mean) / spread - 1)) if spread > 0 else MOST_PRIOR
    limit = odds * mean / (1 - mean + odds * mean)
    n = F.col("documents") + weight
    rate = (F.col("failures") + mean * weight) / n
    lower = rate - certainty * F.sqrt(rate * (1 - rate) / (n + 1))
    return hosts.select("host", "documents", "failures", rate.alias("rate"), F.lit(limit).alias("limit"), (lower <= limit).alias("passes"))


def judge(docs: DataFrame, host: str = "source", odds: float = ODDS, certainty: float = CERTAINTY) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    Columns read: doc_id, text and `host`; others may have any name. A null text has no words (and so fails); documents
    with a null host share one; a null doc_id stays null. Repeated rows count as often as they are there. Texts of any
    length are measured whole. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    x = source.mapInArrow(measure, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    x = materialize(x.withColumn("base_failed", failed), "host-measured")
    rates = materialize(host_rates(x, odds, certainty), "host-rates").select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), F.col("passes").alias("_passes"))
    x = x.join(small_or_shuffled(rates), F.col("host").eqNullSafe(F.col("_host")))
    return x.withColumn("kept", ~F.col("base_failed") & F.col("_passes")).drop("_host", "_passes")
