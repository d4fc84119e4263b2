"""Time-line joins against nested loops on random rows."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import attribution, joins, scoring, sequence


def spans(r, n, long=3000):
    return [(r.randint(0, 2), i, a := r.randint(0, 20_000), a + r.randint(1, long)) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    a, b = spans(r, 60), spans(r, 80)
    left = spark.createDataFrame(a, "session_id long, pos long, start_ms long, end_ms long")
    right = spark.createDataFrame(b, "session_id long, turn_pos long, r_start_ms long, r_end_ms long")
    return a, b, left, right


@pytest.mark.parametrize("bin_ms", [None, 500, 4000])
def test_interval_join(tables, bin_ms):
    a, b, left, right = tables
    got = sorted((x["pos"], x["turn_pos"], x["overlap_ms"]) for x in joins.interval_join(left, right, ["session_id"], bin_ms).collect())
    want = sorted((p, q, min(e, f) - max(s, t)) for k, p, s, e in a for m, q, t, f in b if k == m and s < f and t < e)
    assert got == want


def test_semi_and_left(tables):
    a, b, left, right = tables
    hit = {p for k, p, s, e in a for m, _, t, f in b if k == m and s < f and t < e}
    assert {x["pos"] for x in joins.interval_join(left, right, ["session_id"], how="left_semi").collect()} == hit
    assert {x["pos"] for x in joins.interval_join(left, right, ["session_id"], how="left").collect()} == {p for _, p, _, _ in a}


@pytest.mark.parametrize("bin_ms", [300, 100_000])
def test_point_join_is_half_open(spark, tables, bin_ms):
    a, _, left, _ = tables
    points = [(k, i, t) for k, i, s, e in a for t in (s, e, s - 1)]
    df = spark.createDataFrame(points, "session_id long, i long, at long")
    got = sorted((x["i"], x["at"], x["pos"]) for x in joins.point_join(df, left, ["session_id"], "at", bin_ms=bin_ms).collect())
    assert got == sorted((i, t, p) for k, i, t in points for m, p, s, e in a if k == m and s <= t < e)


def test_asof_join_with_ties_blanks_and_tolerance(spark):
    r = random.Random(2)
    left = [(r.randint(0, 1), i, r.randint(0, 300)) for i in range(80)]
    right = [(r.randint(0, 1), i, r.randint(0, 300), r.choice(["x", "y", None])) for i in range(60)]
    got = joins.asof_join(spark.createDataFrame(left, "k long, i long, t long"), spark.createDataFrame(right, "k long, j long, u long, v string"), ["k"], "t", "u", ["j"], ["j", "v"], 40)
    got = {x["i"]: (x["j"], x["v"]) for x in got.collect()}
    for k, i, t in left:
        best = max(((u, j, v) for m, j, u, v in right if m == k and u <= t), default=None, key=lambda x: x[:2])
        assert got[i] == ((best[1], best[2]) if best and t - best[0] <= 40 else (None, None))


def test_nearest_join(spark, tables):
    a, _, left, _ = tables
    points = [(k, t) for k in range(3) for t in range(0, 25_000, 317)]
    df = spark.createDataFrame(points, "session_id long, at long")
    got = {(x["session_id"], x["at"]): (x["distance_ms"], x["pos"]) for x in joins.nearest_join(df, left, ["session_id"], "at", ["at"], 400, ["pos"], order=["pos"]).collect()}
    for k, t in points:
        best = min(((max(s - t, t - e, 0), p) for m, p, s, e in a if m == k and max(s - t, t - e, 0) <= 400), default=(None, None))
        assert got[k, t] == best


def test_attribution_first_turn_wins_ties(spark):
    lines = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 200, 300), (1, 2, 900, 950)], "session_id long, pos long, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 5, 7, 0, 50), (1, 6, 8, 50, 100), (1, 7, 9, 250, 260), (1, 8, 9, 950, 990)], "session_id long, turn_pos long, cluster int, start_ms long, end_ms long")
    got = {x["pos"]: (x["turn_pos"], x["cluster"], x["overlap_ms"]) for x in attribution.attribute_lines(lines, turns).collect()}
    assert got == {0: (5, 7, 50), 1: (7, 9, 10), 2: (-1, -1, 0)}


def test_top_name_ties(spark):
    votes = spark.createDataFrame([(1, "Bo", 5), (1, "Ann", 5), (1, "Cy", 4), (1, "Amy", 5)], "k long, name string, n long")
    assert attribution.top_name(votes, ["k"], "name", "n").first()["name"] == "Amy"


def test_absorb_small_speakers(spark):
    rows = [(1, 0, "A", 50, 0, 1000), (1, 1, "x", 1, 1500, 1600), (1, 2, "B", 50, 6000, 7000), (1, 3, "y", 1, 9500, 9600), (1, 4, "A", 5, 20_000, 21_000), (1, 5, "z", 1, 99_000, 99_100)]
    df = spark.createDataFrame(rows, "session_id long, pos long, speaker string, n_words long, start_ms long, end_ms long")
    got = {x["pos"]: x["new_speaker"] for x in attribution.absorb_small_speakers(df, 10).collect()}
    assert got == {0: "A", 1: "A", 2: "B", 3: "A", 4: "A", 5: "A"}


def test_absorb_runs(spark):
    rows = [(1, 0, 0, 1, 1, 0, 100, "a"), (1, 0, 1, 2, 2, 100, 900, "b c"), (1, 0, 2, 3, 1, 900, 1000, "d"), (1, 0, 3, 2, 1, 1000, 1900, "e"), (1, 0, 4, 1, 1, 1900, 3000, "f")]
    df = spark.createDataFrame(rows, "session_id long, pos long, run long, cluster int, n_words long, start_ms long, end_ms long, text string")
    got = [(x["run"], x["cluster"], x["text"], x["start_ms"], x["end_ms"]) for x in attribution.absorb_runs(df).orderBy("run").collect()]
    assert got == [(0, 2, "a b c d e", 0, 1900), (1, 1, "f", 1900, 3000)]


def test_islands_and_thinning(spark):
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 4, 5, 9, 10, 16, 30])], "k long, t long, i long")
    x = sequence.islands(df, ["k"], ["t"], F.col("t") - F.lag("t").over(Window.partitionBy("k").orderBy("t")) > 4)
    assert [r["island"] for r in x.orderBy("t").collect()] == [0, 0, 0, 0, 0, 1, 2]
    assert sequence.thin([0, 4, 5, 9, 10, 16, 30], 5) == [True, False, True, False, True, True, True]
    assert [r["t"] for r in sequence.every_nth(df, ["k"], ["t"], 3).orderBy("t").collect()] == [0, 9, 30]
    assert [r["t"] for r in sequence.evenly_thinned(df, ["k"], ["t"], 3).orderBy("t").collect()] == [0, 5, 10]
    assert df.agg(sequence.nearest_rank("t", 0.5).alias("m")).first()["m"] == 9


def test_speaker_scores_of_long_turns_make_few_rows(spark):
    """Frame by frame in plain Python; a turn of a year is some stretches, not 315 million frames."""
    r = random.Random(8)
    spans = lambda names: [(s, r.choice(names), a := r.randint(-900, 20_000), a + r.choice([0, 50, 700, 5000])) for s in range(6) for _ in range(9)]
    ref, hyp = [(*x, i) for i, x in enumerate(spans(["A", "B", "C"]))], spans([0, 1, 2])
    frames = lambda a, b: range(max(a // 100, 0), b // 100)
    want = {}
    for s in range(6):
        own = sorted((x for x in ref if x[0] == s), key=lambda x: (x[2], x[4]))
        out = {f for p, x in zip(own, own[1:]) if p[1] != x[1] for f in range((x[2] - 250) // 100, max((x[2] - 250) // 100 + 1, (x[2] + 250) // 100))}
        at = {(f, x[1]) for x in own for f in frames(x[2], x[3]) if f not in out}
        h = {(f, x[1]) for x in hyp if x[0] == s for f in frames(x[2], x[3])}
        both = [(f, a, b) for f, a in at for g, b in h if f == g]
        score = lambda p: len({f for f, a, b in both if p[b] == a})
        best = max(itertools.permutations("ABC"), key=lambda p: sum(p[b] == a for _, a, b in both))
        if both:
            want[s] = (len({f for f, _, _ in both}), score(best), sum(n > 1 for n in Counter(f for f, _ in h).values()))
    year = 365 * 86_400_000
    ref, hyp, want[9] = [*ref, (9, "A", 0, year, 0)], [*hyp, (9, 1, 0, year), (9, 2, year // 2, year)], (year // 100, year // 100, year // 200)
    got = scoring.speaker_score(spark.createDataFrame(ref, "session_id long, ref string, start_ms long, end_ms long, pos long"), spark.createDataFrame(hyp, "session_id long, hyp long, start_ms long, end_ms long"), "pos").collect()
    assert {x["session_id"]: (x["scored"], x["correct"], x["overlap"]) for x in got} == want
