"""Frames, tokens over time, boxes and moved words."""

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import frames


def test_runs_alone_and_votes(spark):
    rows = [(1, "a", f) for f in [*range(0, 12), 20, 21]] + [(1, "b", f) for f in [5, 6, 30]]
    df = spark.createDataFrame(rows, "k long, who string, frame long")
    got = sorted((x["who"], x["first"], x["last"]) for x in frames.alone(df, ["k"], "who").collect())
    assert got == [("a", 0, 4), ("a", 7, 11), ("a", 20, 21)]
    votes = df.withColumn("vote", F.when(F.col("who") == "b", 2).otherwise(1)).withColumn("crowd", F.lit(1))
    got = sorted((x["who"], x["first"], x["last"]) for x in frames.voted_turns(votes, ["k"], "who", "vote", "crowd", 2, 1).collect())
    assert got == [("a", 0, 11), ("a", 20, 21), ("b", 5, 6)]


def test_masks(spark):
    masks = [([0] * 8 + [1] * 4, True, (8, 11, 4)), ([0] * 7 + [1] * 5, False, (7, 11, 5)), ([0] * 12, False, (-1, -1, 0)), ([1], False, (0, 0, 1))]
    df = spark.createDataFrame(masks, "m array<int>, new boolean, span struct<a: int, b: int, c: int>")
    for x in df.select("*", frames.new_voice_at_end(F.col("m"), 4).alias("n"), frames.span_of(F.col("m")).alias("s")).collect():
        assert x["n"] == x["new"] and tuple(x["s"]) == tuple(x["span"])


def test_powerset_text_and_lines():
    assert frames.powerset(3, 2) == [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [1, 0, 1], [0, 1, 1]]
    assert frames.greedy_text([0, 1, 1, 0, 1, 2, 2], [0.9, 0.5, 0.1, 0.9, 0.7, 0.6, 0.2], "ab") == ("aab", (0.5 + 0.7 + 0.6) / 3)
    assert frames.text_lines([(12, 1, 5, 10), (0, 0, 10, 10), (0, 30, 5, 10), (60, 0, 5, 10)]) == [(0, 0, 17, 11), (0, 30, 5, 10), (60, 0, 5, 10)]


def test_resampling_keeps_slow_waves():
    x = np.sin(np.arange(4800) / 4800 * 2 * np.pi * 5)
    y = frames.resampled(x, 48_000, 16_000)
    assert len(y) == 1600 and abs(np.max(y[200:]) - 1) < 0.05 and len(frames.resampled(x, 8000, 8000)) == 4800
    up = frames.resampled([0.0, 1.0, 2.0], 1, 2)
    assert np.allclose(up[:5], [0, 0.5, 1, 1.5, 2])


def test_moved_words():
    w = lambda t, a: {"text": t, "start": a, "end": a + 1}
    left, right = [w("a", 0), w("b", 1), w("c", 2)], [w("d", 3), w("e", 4)]
    assert [[x["text"] for x in s] for s in frames.words_moved(left, right, 2.2, 5)[:2]] == [["a", "b"], ["c", "d", "e"]]
    assert [[x["text"] for x in s] for s in frames.words_moved(left, right, 3.9, 5)[:2]] == [["a", "b", "c", "d"], ["e"]]
    assert frames.words_moved(left, right, 0.1, 5)[2] == 2 and frames.words_moved(left, right, 0.1, 0.2)[2] == 0
