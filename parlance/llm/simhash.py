"""SimHash near-duplicates: deletion-variant signatures, equality join, verification, connected components.

1.  A document's fingerprint is the bitwise majority of XXH64 over its shingles (Arrow batches, whole texts).
2.  Equal fingerprints are one node, named by their smallest doc_id, so a group of copies of any size is one row.
3.  Two fingerprints that differ in at most 4 bits, cut into 3 segments, have a segment that differs in at most one.
    Each fingerprint is indexed under each segment with each one of its bits as a wildcard (64 keys), and
    under the segment as it is (3 keys). Equal keys are joined and verified within the join. Of the keys
    that a pair has in common only the first counts, so a pair is made once.
4.  Components by contraction to least neighbours with pointer jumping, each round a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import textops
from parlance.runtime import materialize, packed, ship

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: (first bit, bits) of the segments: more than MAX_BITS / 2 of them, so that one differs in at most one bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text; 0 without words. The plain form, one document at a time."""
    words = text.lower().split()
    if not words:
        return 0
    found = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return int(_majority(np.array([xxhash.xxh64_intdigest(x, seed) for x in found], dtype=np.uint64)))


def _spread() -> np.ndarray:
    """For each byte value, its bits in the eight bytes of a 64-bit number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).reshape(256)


_SPREAD = _spread()


def _majority(hashes: np.ndarray) -> np.uint64:
    """The number whose bits are set in over half of the hashes. Counts run in byte lanes, 255 hashes at a time."""
    n = len(hashes)
    parts = np.arange(0, n, 255)
    octets = hashes.view(np.uint8).reshape(n, 8)
    counts = np.empty(64, dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, k]], parts)
        counts[8 * k : 8 * k + 8] = lanes.view(np.uint8).reshape(len(parts), 8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]


def scan(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, seed: int = SEED) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, fp): fp as a signed 64-bit number. A text that repeats the one before is not hashed again."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        data, offsets = textops.utf8(batch.column("text"))
        out = np.zeros(len(batch), dtype=np.uint64)
        seen: dict[bytes, int] = {}
        at = offsets.tolist()
        for d in range(len(batch)):
            text = data[at[d] : at[d + 1]].tobytes()
            key = text if len(text) < 64 else xxhash.xxh3_128_digest(text)
            if key in seen:
                out[d] = seen[key]
                continue
            words = text.lower().split()
            if words:
                joined = b" ".join(words)
                lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                ends = np.cumsum(lengths + 1) - 1
                starts = ends - lengths
                k = max(1, len(words) - shingle + 1)
                first, last = starts[:k].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
                out[d] = _majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), dtype=np.uint64, count=k))
            seen[key] = out[d]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def index(fingerprints: DataFrame) -> DataFrame:
    """(fp) to (key, fp): for each segment, the segment itself and each of its one-wildcard variants.

    key = number of the (segment, wildcard) in the high half, the segment's bits without the wildcard's below.
    """
    keys = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        keys.append(segment.bitwiseOR(F.lit((64 + first) << 32)))
        for bit in range(bits):
            keys.append(segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit))).bitwiseOR(F.lit((first + bit) << 32)))
    return fingerprints.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints that differ in at most max_bits bits, once each."""
    x, y = index(fingerprints), index(fingerprints)
    x, y = x.select(F.col("fp").alias("a"), "key"), y.select(F.col("fp").alias("b"), F.col("key").alias("_key"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    number = F.shiftright("key", 32)
    first_key = None
    for first, bits in reversed(SEGMENTS):
        own = diff.bitwiseAND(_long(((1 << bits) - 1) << first))
        count = F.bit_count(own)
        # the lowest set bit's place is the number of ones below it
        place = F.bit_count((own - 1).bitwiseAND(F.bitwise_not(own)))
        rest = F.lit(-1) if first_key is None else first_key
        first_key = F.when(count == 0, F.lit(64 + first)).when(count == 1, place).otherwise(rest)
    fits = (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & (F.bit_count(diff) <= max_bits) & (number == first_key)
    # by a shuffle: the planner takes the 67 keys of a row for one, and would broadcast millions of rows as a few MB
    return x.join(y.hint("merge"), fits).select("a", "b")


def components(edges: DataFrame, name: str = "simhash", most: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): component is the least node reachable.

    Each round points every node at its least neighbour (or itself), follows the pointers four steps, and
    contracts: edges are rewritten to what their ends point at, those within a node and repeated ones go. The edges of a
    dense group vanish in the first round, and sorted chains shrink to a quarter in each. The pointers of the rounds,
    followed one after another, lead to the component; the least node of one is never moved.
    """
    edges = materialize(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    label: DataFrame | None = None
    for _ in range(most):
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u").alias("to")), F.struct(F.col("v").alias("node"), F.col("u").alias("to")))).alias("e")).select("e.*")
        point = ends.groupBy("node").agg(F.min("to").alias("to"))
        for _ in range(2):
            point = materialize(point, f"{name}-pointers")
            step = point.select(F.col("node").alias("_at"), F.col("to").alias("_next"))
            point = point.join(step, F.col("to") == F.col("_at")).select("node", F.col("_next").alias("to"))
        point = materialize(point, f"{name}-pointers")
        to = lambda c: point.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
        if label is None:
            label = point.select("node", F.col("to").alias("component"))
        else:
            label = label.join(point.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = materialize(label, f"{name}-labels")
        moved = edges.join(to("u"), "u").join(to("v"), "v").filter("_u <> _v")
        edges = materialize(moved.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct(), f"{name}-edges")
        if edges.isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {most} rounds")


def cluster(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp (signed long), component_id, n_links.

    component_id is the smallest doc_id reachable over links, itself included; n_links counts the other
    distinct fingerprints linked to the row's. A null text counts as empty; texts without words have
    fingerprint zero, linked like any other. A row with null doc_id takes part, but is never the smallest
    (a group of such rows only has component_id null). Repeated rows stay. Other columns are not read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(source.mapInArrow(textops.released(scan), "doc_id long, fp long"), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    pairs = materialize(links(nodes.select("fp"), max_bits), "simhash-links")
    name = nodes.select("fp", F.coalesce("node", F.lit((1 << 63) - 1)).alias("node"))
    u = name.select(F.col("fp").alias("a"), F.col("node").alias("u"))
    v = name.select(F.col("fp").alias("b"), F.col("node").alias("v"))
    edges = pairs.join(u, "a").join(v, "b").select("u", "v")
    found = components(edges)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    per_print = nodes.join(found, "node", "left").join(degree, "fp", "left")
    per_print = materialize(per_print.select("fp", F.coalesce("component", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "simhash-components")
    return prints.join(per_print, "fp").select("doc_id", "fp", F.expr("nullif(component_id, 9223372036854775807)").alias("component_id"), "n_links")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay when one document of each component does: that of the smallest doc_id.

    Of repeated rows with that doc_id the one with the least text hash stays; rows with null doc_id go where
    another row of their component stays, else all but one go.
    """
    keep = cluster(docs, max_bits).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    x = packed(docs).join(keep, F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("_row.text")))
    return x.withColumn("_r", rank).filter("_r = 1").select("_row.*")
