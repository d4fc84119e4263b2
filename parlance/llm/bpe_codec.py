"""BPE encoding and decoding with a table of distinct words.

Texts are split into the pre-tokenizer's words; each distinct word of a block of documents is encoded once by the
tokenizers library; the ids are joined back by position through the word's place in the table, and decoded through
the id-to-piece table by another such join. Words repeat so much that the library sees a small part of them.

The tables belong to a block (pretoken.BLOCK bytes of text) of a task's documents and not to the corpus. One table for the
corpus was built and measured (see README): it has to move the distinct words of every block twice and the places of all
words once, which is more disk than a run may use. So there is no shuffle at all, memory is bounded by the block, and a lost
task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import pretoken, textops
from parlance.runtime import ship

#: Words whose ids are joined back at once (or those of one longer document).
JOINED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def vocabulary_bytes(path: str | None = None) -> bytes:
    with open(path or default_vocabulary(), "rb") as f:
        return f.read()


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[offsets[w] : offsets[w + 1]] for w in which, one after another, and their offsets."""
    lengths = np.diff(offsets)[which]
    out = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return values[np.repeat(offsets[which] - out[:-1], lengths) + np.arange(out[-1])], out


def encode_words(vocabulary: pretoken.Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids of each distinct word, one after another, and their offsets."""
    texts = [w.decode() for w in words.to_pylist()]
    encode = getattr(vocabulary.tokenizer, "encode_batch_fast", vocabulary.tokenizer.encode_batch)
    ids, lengths = [], []
    for i in range(0, len(texts), 20_000):
        found = [e.ids for e in encode(texts[i : i + 20_000], add_special_tokens=False)]
        lengths += map(len, found)
        ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), offsets


def decode(pieces: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of each list of ids, made valid UTF-8 as the library does (maximal bad parts become U+FFFD)."""
    joined = pieces.take(pa.array(ids.astype(np.int32)))
    _, at, data = joined.buffers()
    at = np.frombuffer(at, dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    raw = memoryview(data)[: int(at[-1])].tobytes() if data is not None else b""
    ends = at[offsets].tolist()
    out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
    try:
        raw.decode()
    except UnicodeDecodeError:
        out = [x.decode(errors="replace").encode() for x in out]
    return out


def rows(batch: pa.RecordBatch, pieces: pa.Array, ids: np.ndarray, ends: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    """The result rows of some documents, from their ids and the offsets of these."""
    raw = ids.astype("<u4", copy=False).tobytes()
    shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    texts = decode(pieces, ids, ends)
    columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(ends)), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
    if with_ids:
        columns |= {"tie": batch.column("tie"), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))), "decoded": pa.array([x.decode() for x in texts], pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encoder(content: Broadcast, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pretoken.load(content.value)
        pieces = pa.array(vocabulary.pieces_by_id(), pa.large_binary())
        for batch in batches:
            for i, j, words, index, at in pretoken.blocks(vocabulary, batch.column("text")):
                table, offsets = encode_words(vocabulary, words)
                for a, b in textops.chunks(at, JOINED):
                    ids, places = gather(table, offsets, index[at[a] : at[b]])
                    ends = places[at[a : b + 1] - at[a]]
                    yield rows(batch.slice(i + a, b - a), pieces, ids, ends, with_ids)

    return run


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: also tie, ids, decoded.

    path: a byte-level BPE json file, the 50k one of public_tokenizers by default; its contents are broadcast (a
    few MB, whatever the data). No special tokens are added; their strings in a text give their ids. A null text
    counts as empty and has no ids. Rows are independent: repeated rows give repeated results, and a null doc_id stays
    null. A very long text is a block of its own, whole. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    content = spark.sparkContext.broadcast(vocabulary_bytes(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tie long, ids array<int>, decoded string" * with_ids
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"] + [F.xxhash64("text").alias("tie")] * with_ids
    return docs.select(*columns).mapInArrow(textops.released(encoder(content, with_ids)), schema)
