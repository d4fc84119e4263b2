"""Model operators do the whole job: documents of many languages."""

import random

import numpy as np
import pytest

from parlance.llm import langmix, textops, toxicity


def test_documents_of_four_and_more_languages():
    import pyarrow as pa

    r = random.Random(6)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    said = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(3, 8))) for _ in range(n))
    flat = lambda rows: textops.utf8(pa.array(rows, pa.string()))
    counts = np.full((6, langmix.BUCKETS), 0.5)
    for k in range(6):
        data, offsets = flat([said(k, 4000)])
        counts[k] += np.bincount(langmix.buckets(data, offsets), minlength=langmix.BUCKETS)
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    mixes = [[0], [0, 1, 2], [0, 1, 2, 3], [5, 4, 3, 2, 1, 0], [2, 4]]
    data, offsets = flat([" ".join(said(k, 80) for k in mix) for mix in mixes])
    best, score, shares = langmix.infer(model, data, offsets)
    for mix, b, s, share in zip(mixes, best, score, shares):
        assert set(np.flatnonzero(share)) == set(mix) and b in mix
        assert s == pytest.approx(1 / len(mix), abs=0.03) and share[mix] == pytest.approx([1 / len(mix)] * len(mix), abs=0.03)


def plain_ftrl(examples, passes):
    """One coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i, l1):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    l1 = lambda i: 0.0 if i == "b" else toxicity.L1
    for _ in range(passes):
        for index, label in examples:
            at = [*index.tolist(), "b"]
            w = {i: weight(i, l1(i)) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i, l1(i)) for i in z}


def test_ftrl_equals_a_plain_loop():
    r = random.Random(7)
    examples = []
    for _ in range(400):
        label = int(r.random() < 0.3)
        index = {r.randrange(200) for _ in range(12)} | ({r.choice([500, 501])} if label else set())
        examples.append((np.array(sorted(index), dtype=np.int32), label))
    weights, intercept = toxicity.train(examples, 3)
    want = plain_ftrl(examples, 3)
    assert intercept == pytest.approx(want.pop("b")) and np.count_nonzero(weights) == sum(w != 0 for w in want.values()) > 1
    assert all(weights[i] == pytest.approx(w) for i, w in want.items())


def test_learning_is_bounded_in_rows_and_bytes(spark, odd_docs, monkeypatch):
    r = random.Random(8)
    rows = [(d, " ".join(["vile" if d % 2 else "kind"] + [f"w{r.randrange(99)}" for _ in range(30)])) for d in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(d, d % 2, "x", 9) for d in range(500)], "doc_id long, toxic int, text string, at int")
    seen = []
    train = toxicity.trainer

    def spy(batches):
        n = 0
        for batch in batches:
            n += batch.num_rows
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([toxicity.INTERCEPT]), pa.array([float(n)])], names=["index", "weight"])

    monkeypatch.setattr(toxicity, "trainer", spy)
    for sample, size in ((12_000, 1 << 26), (100, 1 << 26), (12_000, 20_000)):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", size)
        seen.append(toxicity.learn(docs, marks, sample=sample)[1])
    assert seen[0] == 500 and 60 < seen[1] < 140 and 0 < sum(len(t) for _, t in rows) * seen[2] / 500 < 30_000
    monkeypatch.setattr(toxicity, "trainer", train)
    twice = spark.createDataFrame([(8, 0), (8, 1), (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    weights, _ = toxicity.learn(odd_docs, twice)  # clashing columns, repeated rows, null labels
    assert weights.shape == (toxicity.DIMS,)
