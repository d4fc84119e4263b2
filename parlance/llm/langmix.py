"""Language identification as a mixture: EM over n-gram likelihoods, languages chosen by penalised likelihood.

Learning. Hashed byte n-grams of ASCII-lower-cased words (with a space to each side) are counted per language over
at most SAMPLE texts of each language, taken by a hash of the doc_id; smoothed logarithms of their shares are
the model, a row of buckets for each language, which is what is broadcast: MODEL_BYTES at most, as many languages share
fewer buckets.

Prediction. A document is a row of units of UNIT words, the last of which ends with the document. A unit's likelihood
under a language is the product of its n-grams'; EM estimates the proportions of the languages in the document, until
they move by less than TOLERANCE. The sets compared are the 1, 2, ... languages of the largest proportions, each
fitted by EM in turn; the set of greatest log-likelihood less PENALTY log(units) per language wins. Larger sets are tried
until each unit having its best language would not win. The largest language of that set is predicted; its score is its
proportion, smoothed by the number of units. All documents of a chunk are fitted together by array operations, in which
each is alone: its steps end when it has settled, whatever the others do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import textops
from parlance.runtime import packed, ship

#: Texts per language that are learnt from, most buckets of n-grams, length of the n-grams.
SAMPLE, BUCKETS, GRAM = 2000, 1 << 16, 4
#: Bytes of the model at most; with more than MODEL_BYTES / (4 * BUCKETS) languages each has fewer buckets.
MODEL_BYTES = 64 << 20
#: Most languages (distinct values of lang) that can be learnt: 2048 buckets each. More are refused.
LANGUAGES = 8192
#: Languages whose counts a learning task holds at once.
HELD = 64
UNIT, PENALTY, PRIOR = 4, 1.5, 0.05
#: EM ends when the proportions move by less than TOLERANCE in all; no document is known to need STEPS steps.
TOLERANCE, STEPS = 1e-6, 10_000
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[textops.SPACE] = 32


def buckets_for(languages: int) -> int:
    """Buckets a language: the most that MODEL_BYTES allow, a power of two."""
    return min(BUCKETS, 1 << ((MODEL_BYTES // (4 * max(languages, 1))).bit_length() - 1))


def _hashed(columns: Iterator[np.ndarray], n: int, size: int) -> np.ndarray:
    h = np.zeros(n, dtype=np.uint32)
    for x in columns:
        h = h * np.uint32(0x01000193) + x
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - size.bit_length() + 1)


def buckets(data: np.ndarray, offsets: np.ndarray, size: int = BUCKETS) -> np.ndarray:
    """A bucket for each byte position: that of the GRAM bytes that start there, spaces after the end of its document."""
    x = np.concatenate([_LOWER[data], np.full(GRAM - 1, 32, np.uint8)]).astype(np.uint32)
    n = len(data)
    out = _hashed((x[i : i + n] for i in range(GRAM)), n, size)
    for back in range(1, GRAM):  # the last positions of each document look past its end
        ends = offsets[1:][np.diff(offsets) >= back]
        out[ends - back] = _hashed((x[ends - back + i] if i < back else np.uint32(32) for i in range(GRAM)), len(ends), size)
    return out


def counter(size: int):
    """(lang, text) to (lang, bucket, n), summed over the task, or over as long as HELD languages are met."""

    def out(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            hit = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(own[hit])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = textops.utf8(batch.column("text"))
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if lang not in sums and len(sums) == HELD:
                    yield from out(sums)
                    sums = {}
                own = sums.setdefault(lang, np.zeros(size, dtype=np.int64))
                own += np.bincount(buckets(data[a:b], np.array([0, b - a]), size), minlength=size)
        yield from out(sums)

    return run


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages and the log shares of the buckets (languages x buckets), from docs (doc_id, text, lang).

    Rows with null text or lang teach nothing; rows with null doc_id are sampled as one. A language with more than
    `sample` rows is thinned by a hash of doc_id to about as many. The tables collected are bounded: a row per
    language (more than LANGUAGES are an error), and per language and bucket (MODEL_BYTES / 4 at most).
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 33).alias("_h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    size = buckets_for(len(sizes))
    if not sizes:
        return [], np.zeros((0, size), np.float32)
    limits = spark.createDataFrame([(lang, int(min(1.0, sample / n) * (1 << 31))) for lang, n in sizes.items()], "lang string, _limit long")
    taken = known.join(F.broadcast(limits), "lang").filter("_h < _limit").select("lang", "text")
    table = taken.mapInArrow(textops.released(counter(size)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    place = {x: i for i, x in enumerate(languages)}
    codes = table.column("lang").combine_chunks().dictionary_encode()
    row = np.array([place[x] for x in codes.dictionary.to_pylist()], dtype=np.int64)[codes.indices.to_numpy()]
    counts = np.full((len(languages), size), 0.5, dtype=np.float32)
    counts[row, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    for own in counts:
        own[:] = np.log(own / own.sum(dtype=np.float64))
    return languages, counts


def fit(likelihood: np.ndarray, peak: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for documents whose units are the next n[d] rows of likelihood (n > 0; a column for each language).

    Returns proportions (documents x languages) and log-likelihoods. A document whose proportions move by less than
    TOLERANCE has settled and leaves; what is left of the arrays is made smaller as half of their documents have.
    """
    docs, k = len(n), likelihood.shape[1]
    share = np.full((docs, k), 1.0 / k)
    live, rows, size = np.arange(docs), likelihood, n
    at = np.cumsum(size) - size
    doc = np.repeat(np.arange(docs), size)
    moving = np.full(docs, k > 1)
    for _ in range(STEPS):
        if not moving.any():
            break
        if 2 * moving.sum() <= len(moving):
            rows, live, size = rows[moving[doc]], live[moving], size[moving]
            at = np.cumsum(size) - size
            doc = np.repeat(np.arange(len(size)), size)
            moving = np.ones(len(size), dtype=bool)
        own = share[live]
        joint = rows * own[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(joint, at, axis=0) / size[:, None]
        moved = np.abs(new - own).sum(axis=1)
        share[live[moving]] = new[moving]
        moving &= moved >= TOLERANCE
    at = np.cumsum(n) - n
    total = np.maximum((likelihood * share[np.repeat(np.arange(docs), n)]).sum(axis=1), 1e-300)
    return share, np.add.reduceat(np.log(total) + peak, at)


def unit_logs(model: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of the units (units x languages) of all documents, and each document's number of units.

    A unit is the bytes from its first word to the next unit's, the last one's to the document's end.
    """
    starts, _, words = textops.words(data, offsets)
    n = -(-np.diff(words) // UNIT)
    some = np.flatnonzero(n)
    if not len(some):
        return np.zeros((0, len(model))), n
    m = n[some]
    at = np.cumsum(m) - m
    first = starts[np.repeat(words[:-1][some], m) + (np.arange(m.sum()) - np.repeat(at, m)) * UNIT]
    # a bound for each unit's start, and one for the end of each document
    place = np.arange(len(first)) + np.repeat(np.arange(len(some)), m)
    bounds = np.empty(len(first) + len(some), dtype=np.int64)
    bounds[place], bounds[np.cumsum(m + 1) - 1] = first, offsets[1:][some]
    gram = buckets(data, offsets, model.shape[1])
    logs = np.empty((len(first), len(model)))
    for i, own in enumerate(model):  # a language at a time, to keep the gathered table small
        logs[:, i] = np.add.reduceat(np.append(own[gram], np.float32(0)), bounds, dtype=np.float64)[place]
    return logs, n


def infer(model: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document of data: predicted language (-1 without words), score, and the proportions of the chosen set."""
    docs, k = len(offsets) - 1, len(model)
    best, score, shares = np.full(docs, -1), np.zeros(docs), np.zeros((docs, k))
    logs, n = unit_logs(model, data, offsets)
    some = np.flatnonzero(n)
    if not len(some) or not k:
        return best, score, shares
    n = n[some]
    peak = logs.max(axis=1)
    likelihood = np.exp(logs - peak[:, None])
    share, _ = fit(likelihood, peak, n)
    order = np.argsort(-share, axis=1, kind="stable")
    most = np.full(len(n), -np.inf)
    chosen = np.zeros_like(share)
    bound, doc = np.add.reduceat(peak, np.cumsum(n) - n), np.repeat(np.arange(len(n)), n)
    for size in range(1, k + 1):
        cost = PENALTY * size * np.log(n + 1.0)
        able = np.flatnonzero(bound - cost > most)
        if not len(able):
            break
        rows, m = np.isin(doc, able), n[able]
        columns = order[able, :size]
        own, value = fit(np.take_along_axis(likelihood[rows], np.repeat(columns, m, axis=0), axis=1), peak[rows], m)
        value = value - cost[able]
        better = value > most[able]
        won = able[better]
        most[won], chosen[won] = value[better], 0.0
        chosen[won[:, None], columns[better]] = own[better]
    best[some] = chosen.argmax(axis=1)
    score[some] = (chosen.max(axis=1) * n + PRIOR) / (n + PRIOR * k)
    shares[some] = chosen
    return best, score, shares


def judged(model: tuple[list[str], np.ndarray], text: pa.Array, letter: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows [i, j): the place of the predicted language (-1 if unknown), score and proportions."""
    languages, table = model
    data, offsets = textops.utf8(text)
    has = letter.to_numpy(zero_copy_only=False).astype(bool)
    for i, j in textops.chunks(offsets, max(1 << 16, textops.CHUNK * 4 // max(8, len(languages)))):
        best, score, shares = infer(table, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        best[~has[i:j]] = -1
        yield i, j, best, np.where(best >= 0, score, 0.0), shares


def predictor(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, _ = model.value
        for batch in batches:
            for i, j, best, score, shares in judged(model.value, batch.column("text"), batch.column("has_letter")):
                names = [languages[b] if b >= 0 else UNKNOWN for b in best.tolist()]
                mixture = [[(x, float(p)) for x, p in zip(languages, row) if p > 0] if b >= 0 else [] for b, row in zip(best.tolist(), shares)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(names, pa.string()), pa.array(score), pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "mixture"],
                )

    return run


def keeper(model: Broadcast, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row")
            for i, j, best, score, _ in judged(model.value, rows.field("text"), batch.column("has_letter")):
                yield batch.select(["_row"]).slice(i, j - i).filter(pa.array((best >= 0) & (score >= least)))

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score (0 to 1), mixture.

    lang_pred is 'und' with score 0 and an empty mixture if the text is null or has no letter, or if no language was
    learnt. Only the text decides, not its neighbours in a batch. A null doc_id stays null; a very long text is fitted
    whole, by one task; repeated rows give equal results; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter(F.col("text")).alias("has_letter"))
    return source.mapInArrow(predictor(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, mixture map<string, double>")


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) whose language is known: predicted, and at least `least` of the text.

    Rows whose text is null or has no letter go, as do all where no language can be learnt (an empty table stays
    empty). Repeated rows stay or go together. All columns are returned, whatever their names: rows pass through as they
    are, so nothing is shuffled.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs.filter(~held_out(F.col("doc_id")))))
    rows = packed(docs).withColumn("has_letter", has_letter(F.col("_row.text")))
    return rows.mapInArrow(textops.released(keeper(model, least)), T.StructType([T.StructField("_row", docs.schema)])).select("_row.*")
