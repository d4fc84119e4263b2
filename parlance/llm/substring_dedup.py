"""Removing passages of LENGTH words or more that an earlier document has: seed and extend on winnowed anchors.

A window is LENGTH consecutive words. Its anchor is the least of the hashes of its SEED-word grams (winnowing), so
two equal windows have equal anchors, and about one gram in LENGTH / 4 words is an anchor at all.

1.  Anchors of each document are joined on their value. Only anchors of two or more different documents go on;
    documents without such an anchor are done. Documents of one word sequence count once, as their smallest
    doc_id: the others are copies as a whole.
2.  From each shared anchor the match is extended to both sides, to all windows that contain it. These windows are
    equality-joined (anchor and a hash of the whole window, 128 bits), each against the smallest doc_id
    that has it, never pair by pair.
3.  A document's windows with a smaller owner are merged into maximal runs of words, which are cut out.

Joins are on hashes, not on documents: a passage in a third of all documents gives each of them one row per
window, partial aggregation folds it before the shuffle, and the join back is to one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import textops
from parlance.runtime import materialize, packed, ship

#: Words of a window, and of a gram that can be its anchor.
LENGTH, SEED = 50, 25


def _windows(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """starts, ends, word offsets; for all windows: anchor, whole hash, word position; windows of each document."""
    starts, ends, at = textops.words(data, offsets)
    hashes = textops.word_hashes(data, starts, ends)
    where, n = textops.window_index(at, length)
    if len(where) == 0:
        return starts, ends, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), where, n
    anchors = textops.sliding_min(textops.gram_hashes(hashes, seed, 1), length - seed + 1)[where]
    return starts, ends, at, anchors, textops.gram_hashes(hashes, length, 2)[where], where, n


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def scan(batches: Iterator[pa.RecordBatch], length: int = LENGTH, seed: int = SEED) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, tie) to (doc_id, tie, n_words, sha256 of the words joined by a space, anchors)."""
    for batch in batches:
        data, offsets = textops.utf8(batch.column("text"))
        for i, j in textops.chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, _, words, anchors, _, _, n = _windows(part, at, length, seed)
            new = np.ones(len(anchors), dtype=bool)
            new[1:] = anchors[1:] != anchors[:-1]
            ends = np.cumsum(n)
            new[(ends - n)[n > 0]] = True
            kept = np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])]
            raw = part.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], batch.column("tie")[i:j], pa.array(np.diff(words)), pa.array(shas), pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), _longs(anchors[new]))],
                names=["doc_id", "tie", "n_words", "sha", "anchors"],
            )


def extend(batches: Iterator[pa.RecordBatch], length: int = LENGTH, seed: int = SEED) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, anchors): to (anchor, window, doc_id) for every window whose anchor is listed, once a document."""
    for batch in batches:
        data, offsets = textops.utf8(batch.column("text"))
        lists = batch.column("anchors")
        for i, j in textops.chunks(offsets):
            _, _, _, anchors, whole, _, n = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, seed)
            ends = np.cumsum(n)
            found = []
            for d in range(i, j):
                mine = slice(ends[d - i] - n[d - i], ends[d - i])
                hit = np.isin(anchors[mine], lists[d].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                pairs = np.unique(np.stack([anchors[mine][hit], whole[mine][hit]]), axis=1)
                found.append((pairs, batch.column("doc_id")[d].as_py()))
            pairs = np.concatenate([p for p, _ in found], axis=1) if found else np.zeros((2, 0), np.uint64)
            ids = np.repeat(np.array([d for _, d in found], dtype=np.int64), [p.shape[1] for p, _ in found])
            if len(ids):
                yield pa.RecordBatch.from_arrays([_longs(np.ascontiguousarray(pairs[0])), _longs(np.ascontiguousarray(pairs[1])), pa.array(ids)], names=["anchor", "window", "doc_id"])


def cut(batches: Iterator[pa.RecordBatch], length: int = LENGTH, seed: int = SEED) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, tie, windows) to (doc_id, tie, n_removed, kept_text, spans): the listed windows are taken out.

    spans holds the maximal runs removed, as start and length in words.
    """
    for batch in batches:
        data, offsets = textops.utf8(batch.column("text"))
        lists = batch.column("windows")
        for i, j in textops.chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, at, _, whole, where, n = _windows(part, offsets[i : j + 1] - offsets[i], length, seed)
            edge = np.zeros(len(starts) + 1, dtype=np.int64)
            last = np.cumsum(n)
            for d in range(i, j):
                mine = slice(last[d - i] - n[d - i], last[d - i])
                hit = where[mine][np.isin(whole[mine], lists[d].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))]
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            raw = part.tobytes()
            removed, texts, spans = [], [], []
            for d in range(j - i):
                a, b = int(at[d]), int(at[d + 1])
                mine = gone[a:b]
                removed.append(int(mine.sum()))
                texts.append(b" ".join(raw[s:e] for s, e in zip(starts[a:b][~mine].tolist(), ends[a:b][~mine].tolist())).decode())
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turns[::2], turns[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], batch.column("tie")[i:j], pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                names=["doc_id", "tie", "n_removed", "kept_text", "spans"],
            )


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: all rows (doc_id, tie, n_words, sha, whole) and the rows cut in part (doc_id, tie, n_removed, kept_text, spans).

    tie is xxhash64(text); sha that of the words joined by one space. whole: a smaller doc_id has the same words
    (LENGTH at least), so all is removed. Rows in neither case stay as they are. A null or empty text has no words;
    a row with null doc_id is before and after none, so nothing is removed from it or for its sake; rows of one
    doc_id are not compared with each other. Columns other than doc_id and text are not read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    scanned = materialize(source.mapInArrow(textops.released(scan), "doc_id long, tie long, n_words long, sha string, anchors array<bigint>"), "repeat-anchors")
    # written first, so that the join's sides are dealt anew and a large group of copies can be split over tasks
    first = scanned.filter(f"n_words >= {LENGTH}").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("b")).filter("first_id < b").drop("b")
    first = materialize(first, "repeat-copies")
    rows = materialize(scanned.select("doc_id", "tie", "n_words", "sha").join(first, "sha", "left").withColumn("whole", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("first_id"), "repeat-rows")

    own = scanned.filter("doc_id IS NOT NULL AND size(anchors) > 0").select("doc_id", "sha", "anchors").join(rows.filter("NOT whole AND doc_id IS NOT NULL").select("doc_id", "sha").distinct(), ["doc_id", "sha"])
    seeds = own.select("doc_id", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    flagged = seeds.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    alone = rows.filter("NOT whole AND doc_id IS NOT NULL").select("doc_id", "tie").distinct()
    texts = source.join(flagged.join(alone, "doc_id"), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    texts = materialize(texts.select("doc_id", "tie", "text", "anchors"), "repeat-texts")

    windows = materialize(texts.select("doc_id", "text", "anchors").mapInArrow(textops.released(extend), "anchor long, window long, doc_id long"), "repeat-windows")
    owners = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("b")).filter("owner < b").drop("b")
    later = windows.join(owners, ["anchor", "window"]).filter("doc_id > owner").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    cuts = texts.select("doc_id", "tie", "text").join(later, "doc_id").select("doc_id", "text", "tie", "windows")
    schema = "doc_id long, tie long, n_removed long, kept_text string, spans array<struct<start: bigint, length: bigint>>"
    return rows, materialize(cuts.mapInArrow(textops.released(cut), schema).filter("n_removed > 0"), "repeat-cuts")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (null: whole or untouched).

    A null text has no words. A row with null doc_id loses nothing, and nothing is a repeat of it. Rows of one doc_id are not
    repeats of each other; equal rows get equal results. Texts of any length are compared whole; one text is one task's. An
    empty table gives an empty result. Other columns are not read.
    """
    rows, cuts = repeats(docs)
    cuts = cuts.select("doc_id", "tie", "n_removed", F.sha2("kept_text", 256).alias("kept_sha"), "spans")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(cuts, ["doc_id", "tie"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), none).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        "spans",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages. Rows of which something is cut have their kept words joined by one space
    (and n_chars counted anew); rows of which all is cut go; the others are untouched, null texts and rows with null doc_id
    among them. Equal rows are cut alike. All columns are returned, whatever their names."""
    rows, cuts = repeats(docs)
    change = rows.filter("whole").select("doc_id", "tie", F.lit(None).cast("string").alias("kept_text")).unionByName(cuts.select("doc_id", "tie", "kept_text"))
    change = change.dropDuplicates(["doc_id", "tie"]).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("kept_text").alias("_kept"), F.lit(True).alias("_cut"))
    x = packed(docs).withColumn("_t", F.xxhash64("_row.text"))
    x = x.join(change, (F.col("_row.doc_id") == change["_id"]) & (x["_t"] == change["_tie"]), "left").filter("_cut IS NULL OR length(_kept) > 0")
    x = x.select("_cut", F.col("_row").withField("text", F.when(F.col("_cut"), F.col("_kept")).otherwise(F.col("_row.text"))).alias("_row"))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("_cut"), F.length("_row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
        x = x.select(F.col("_row").withField("n_chars", chars).alias("_row"))
    return x.select("_row.*")
