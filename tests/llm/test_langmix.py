"""Language mixtures against a plain EM, one document at a time; neighbours, many languages, odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import langmix, textops

LETTERS = ["abcd", "efgh", "ijkl", "mnopé"]


def said(r, k, n):
    return " ".join("".join(r.choice(LETTERS[k]) for _ in range(r.randint(2, 7))) for _ in range(n))


def flat(rows):
    return textops.utf8(pa.array(rows, pa.string()))


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    counts = np.full((4, langmix.BUCKETS), 0.5)
    for k in range(4):
        data, offsets = flat([said(r, k, 3000)])
        counts[k] += np.bincount(langmix.buckets(data, offsets), minlength=langmix.BUCKETS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def plain_bucket(four):
    h = 0
    for b in four:
        h = (h * 0x01000193 + (b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\v\f\r" else b)) % (1 << 32)
    h ^= h >> 15
    return (h * 0x2C1B3C6D) % (1 << 32) >> 16


def plain_em(units, columns):
    share = [1 / len(columns)] * len(columns)
    for _ in range(langmix.STEPS if len(columns) > 1 else 0):
        new = [0.0] * len(columns)
        for u in units:
            joint = [s * math.exp(u[c] - max(u)) for s, c in zip(share, columns)]
            for i, j in enumerate(joint):
                new[i] += j / sum(joint) / len(units)
        moved, share = sum(abs(a - b) for a, b in zip(share, new)), new
        if moved < langmix.TOLERANCE:
            break
    return share, sum(max(u) + math.log(sum(s * math.exp(u[c] - max(u)) for s, c in zip(share, columns))) for u in units)


def plain_infer(model, text):
    raw = text.encode()
    starts = [i for i in range(len(raw)) if raw[i : i + 1].strip() and (i == 0 or not raw[i - 1 : i].strip())]
    if not starts:
        return -1, 0.0, [0.0] * len(model)
    bounds = starts[:: langmix.UNIT] + [len(raw)]
    padded = raw + b"   "
    units = [[sum(float(own[plain_bucket(padded[i : i + 4])]) for i in range(a, b)) for own in model] for a, b in zip(bounds, bounds[1:])]
    share, _ = plain_em(units, range(len(model)))
    order = sorted(range(len(model)), key=lambda k: -share[k])
    found = []
    for size in range(1, len(model) + 1):
        own, value = plain_em(units, order[:size])
        found.append((value - langmix.PENALTY * size * math.log(len(units) + 1), dict(zip(order[:size], own))))
    chosen = max(found, key=lambda x: x[0])[1]
    shares = [chosen.get(k, 0.0) for k in range(len(model))]
    best = shares.index(max(shares))
    return best, (shares[best] * len(units) + langmix.PRIOR) / (len(units) + langmix.PRIOR * len(model)), shares


def texts():
    r = random.Random(2)
    out = [" ".join(said(r, k, r.randint(1, 40)) for k in r.sample(range(4), r.randint(1, 4))) for _ in range(60)]
    out += [" " * r.randint(1, 9) + x for x in out[:20]] + [x + "\n\t " for x in out[20:30]]
    return out + ["", "  ", "\n", "a", " a ", said(r, 0, 5) + " " + said(r, 3, 4), said(r, 1, 9), "    " + said(r, 2, 20), said(r, 0, 3000)]


def test_equal_to_a_plain_em(model):
    rows = texts()
    best, score, shares = langmix.infer(model, *flat(rows))
    for t, b, s, own in zip(rows[:-1], best, score, shares):
        want = plain_infer(model, t)
        assert b == want[0] and s == pytest.approx(want[1], abs=1e-4) and own == pytest.approx(want[2], abs=1e-4)


def test_neighbours_do_not_matter(model):
    rows = texts()
    alone = [langmix.infer(model, *flat([t])) for t in rows]
    r = random.Random(3)
    for _ in range(5):
        order = r.sample(range(len(rows)), len(rows))
        best, score, shares = langmix.infer(model, *flat([rows[i] for i in order]))
        for place, i in enumerate(order):
            assert (best[place], score[place]) == (alone[i][0][0], alone[i][1][0]) and (shares[place] == alone[i][2][0]).all()


def test_a_thousand_languages(spark):
    r = random.Random(4)
    rows = []
    for k in range(1000):
        alphabet = r.sample([chr(c) for c in range(0x3041, 0x3090)], 6)
        for d in range(3):
            rows.append((3 * k + d, " ".join("".join(r.choice(alphabet) for _ in range(4)) for _ in range(40)), f"l{k:04}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, table = langmix.learn(df)
    assert languages == [f"l{k:04}" for k in range(1000)] and table.nbytes <= langmix.MODEL_BYTES
    few = df.filter("doc_id % 30 = 0")
    got = {x["doc_id"]: x["lang_pred"] for x in langmix.predict(few, (languages, table)).collect()}
    assert sum(got[d] == k for d, _, k in rows if d in got) >= 0.97 * len(got) and len(got) == 100


def test_sampling_bounds_a_language(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") < 3900, "a").otherwise("b").alias("lang"))
    _, many = langmix.learn(df, sample=100)
    _, whole = langmix.learn(df)
    assert many.shape == whole.shape and not np.array_equal(many[0], whole[0]) and np.array_equal(many[1], whole[1])


def test_odd_rows(odd_docs, no_docs):
    assert langmix.accepted(no_docs).count() == 0 and langmix.accepted(no_docs).columns == no_docs.columns
    kept = langmix.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and {2, 3, 4, 12}.isdisjoint(x["doc_id"] for x in kept.collect())
    both = odd_docs.filter("doc_id = 8")
    assert kept.filter("doc_id = 8").count() in (0, both.count())
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert langmix.accepted(unknown).count() == 0
