"""Substring and SimHash dedup, BPE, Ogg and quality rules against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import bpe_codec, bpe_count, host_rules, ogg, pretoken, simhash, substring_dedup, textops
from parlance.runtime import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_cut(rows, length=50):
    """(doc_id, text) to (n_words, n_removed, kept sha256) by comparing all windows."""
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(a, b):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_repeats_equal_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, 5)
            w += [r.choice(vocabulary) for _ in range(r.randint(0, 40))] + p[a : len(p) - r.randint(0, 5)]
        rows.append((r.choice([d, d, d // 2, None]) if d % 9 == 0 else d, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(500 + d, " ".join(passages[4])) for d in range(30)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, plain_cut(rows))


def test_repeats_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    same(substring_dedup.remove_repeats(odd_docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), plain_cut(rows))
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert substring_dedup.deduplicated(no_docs).columns == no_docs.columns
    left = {(r["doc_id"], r["text"]) for r in substring_dedup.deduplicated(odd_docs).collect()}
    assert (1, rows[0][1]) in left and not any(d == 6 for d, _ in left)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_clusters_equal_brute_force(spark, odd_docs):
    r = random.Random(2)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(r.randint(1, 400))] for _ in range(25)]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for d in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{d}"
        rows.append((1000 + d, " ".join(w).replace("w1", "W1") if d % 3 else " ".join(w)))
    got = simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(x["doc_id"], x["fp"] & (2**64 - 1), x["component_id"]) for x in got.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    same(got, [(d, p, c) for (d, _), p, c in zip(rows, prints, plain_components([d for d, _ in rows], prints))])


def test_links_of_close_fingerprints(spark):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for k in range(7):
            q = p
            for b in r.sample(range(64), k):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted(x)) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want and len(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()) == len(want)


def test_links_are_not_broadcast(spark):
    """The index has 67 rows a fingerprint, of which the planner knows nothing: a small table of fingerprints is a large index."""
    prints = materialize(spark.range(5000).select(F.xxhash64("id").alias("fp")), "test-prints")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(1, 40) if x != 7] + [(300, 201), (201, 250)]
    got = {x["node"]: x["component"] for x in simhash.components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert all(got[x] == 100 for x in range(100, 161)) and all(got[x] == 1 for x in range(1, 40)) and got[300] == got[250] == 201


def test_representatives(odd_docs, no_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and simhash.representatives(no_docs).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 6 not in ids and 11 not in ids and 1 in ids and 5 in ids


ALPHABET = ["a", "B", "'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", " ", "　", "1", "٣", "é", "ß", "漢", "!", "'s", "<|endoftext|>", "<|endof", "😀", "́", "_", "-", "\x85", "\x1c", "²", "\U0001e900", "​"]


def test_bpe_equals_the_library(spark, odd_docs, no_docs):
    r = random.Random(4)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["ab" * 5000, "!" * 3000, None]
    rows = list(enumerate(texts)) + [(x["doc_id"], x["text"]) for x in odd_docs.collect()]
    tokenizer = pretoken.load(bpe_codec.vocabulary_bytes()).tokenizer
    want = [e.ids for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe_codec.encode_decode(df).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    same(got, [(d, len(i), sha(np.array(i, dtype="<u4").tobytes()), sha(tokenizer.decode(i, skip_special_tokens=False).encode())) for (d, _), i in zip(rows, want)])
    counted = bpe_count.count_tokens(df, limit=3).collect()
    same(counted, [(d, len((t or "").encode()), len(i), len(i) > 3) for (d, t), i in zip(rows, want)])
    assert bpe_codec.encode_decode(no_docs, with_ids=True).count() == 0 and bpe_count.count_tokens(no_docs).count() == 0


def plain_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == plain_crc(data)


@pytest.mark.parametrize("lengths", [[0], [1], [254], [255], [256], [255 * 255], [255 * 255 - 1], [255 * 255 + 1], [70_000, 0, 3], [200_000]])
def test_ogg_packets_round_trip(lengths):
    r = random.Random(6)
    packets, end = [(b"head", 0)], 0
    for n in lengths:
        end += n + 1
        packets.append((r.randbytes(n), end))
    other = [(b"other", 0), (b"x" * 100_000, 5)]
    data = ogg.multiplex([(11, packets), (12, other)])
    streams = ogg.demultiplex(data)
    assert streams[11].packets == [p for p, _ in packets] and streams[12].packets == [p for p, _ in other]
    assert [g for g in streams[11].granules if g is not None][-1] == end


def test_ogg_damage_is_found():
    data = ogg.store(ogg.padded(b"some text " * 1000))
    assert ogg.load(data).payload == ogg.padded(b"some text " * 1000)
    for at in (5, 30, 200, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.load(bytes(bad))
    for bad in (data[:-1], data[:100], data[300:], data + data):
        with pytest.raises(ogg.OggError):
            ogg.load(bad)


def test_media_columns(odd_docs, no_docs):
    got = ogg.media_columns(odd_docs, with_media=True).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    want = []
    for t in texts:
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] for r in got)
    assert ogg.media_columns(no_docs).count() == 0


def plain_measure(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd_docs, no_docs):
    r = random.Random(7)
    rows = [(x["doc_id"], x["source"], x["text"]) for x in odd_docs.collect() if x["doc_id"] not in (5, 6)]
    for d in range(300):
        n = r.choice([5, 60, 90])
        text = "".join(r.choice(["ab", "c#", "é", "d|"]) + r.choice([" ", " ", "\n"]) for _ in range(n))
        rows.append((100 + d, "bad" if d % 3 == 0 else "good", text if d % 3 == 0 else " ".join(f"u{r.randint(0, 900)}" for _ in range(80))))
    rows += [(900 + d, "bad", " ".join(f"v{d}x{i}" for i in range(70))) for d in range(3)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    want = []
    for d, s, t in rows:
        m = plain_measure(t)
        want.append((d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same([tuple(x[c] for c in names) for x in got], want)
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert not any(kept[900 + d] for d in range(3)) and any(kept[100 + d] for d in range(300) if d % 3)
    assert not any(x["kept"] for x in got if x["base_failed"])
    assert host_rules.judge(no_docs).count() == 0 and host_rules.judge(odd_docs).count() == odd_docs.count()


def test_hashes_do_not_depend_on_place():
    texts = ["one two  three", "", " two three one two three ", "x"]
    data, offsets = textops.utf8(pa.array(texts + [None]))
    starts, ends, words = textops.words(data, offsets)
    h = textops.word_hashes(data, starts, ends)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in t.split()] and np.diff(words).tolist() == [3, 0, 5, 1, 0]
    by = {}
    for w, x in zip(found, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    x = np.array([5, 3, 9, 1, 7, 2], dtype=np.uint64)
    for w in range(1, 7):
        assert textops.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(6 - w + 1)]
