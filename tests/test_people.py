"""Clustering by chains against the plain rule, the tracker's merges and names, rooms, and joins of near names, against brute force."""

import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F

from parlance.functions import labels
from parlance.operators import clustering, live, names


def plain_linkage(d, threshold):
    """Always the closest two clusters."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        height, a, b = min((max(d[i][j] for i in x for j in y), p, q) for (p, x), (q, y) in itertools.combinations(enumerate(groups), 2))
        if height > threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_chains_find_complete_linkage():
    r = np.random.default_rng(1)
    for k in range(30):
        x = r.normal(size=(int(r.integers(1, 25)), 5)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tiles = [None if r.random() < 0.5 else str(r.integers(3)) for _ in x] if k % 2 else None
        d = (1 - x @ x.T).astype(float)
        for i, j in itertools.permutations(range(len(x)), 2):
            if tiles and tiles[i] and tiles[j] and tiles[i] != tiles[j]:
                d[i, j] = 2.0
        for threshold in (0.3, 0.8, 1.4):
            got = clustering.complete_linkage(x, threshold, tiles=tiles)
            assert {frozenset(i for i, c in enumerate(got) if c == g) for g in set(got)} == plain_linkage(d, threshold)
        assert len(set(clustering.complete_linkage(x, 0.0, clusters=3))) == min(3, len(x))


def test_rooms_are_clustered_by_themselves():
    x = np.array([[1, 0], [1, 0], [0.8, 0.6], [1, 0], [0.8, 0.6]], dtype=np.float32)
    tiles = ["Ann", None, None, "Room 1", "Room 1"]
    assert clustering.rooms_apart(x, 0.3, 0.1, tiles, [False, False, False, True, True]) == [0, 0, 0, 1, 2]
    assert clustering.rooms_apart(x, 0.1, 0.3, tiles, [False, False, False, True, True]) == [0, 0, 1, 2, 2]
    heard = clustering.heard_under([0, 0, 1, 2, 2], tiles)
    assert heard == {0: {"Ann"}, 1: set(), 2: {"Room 1"}} and clustering.tiles_conflict(heard[0], heard[2]) and not clustering.tiles_conflict(heard[0], heard[1])


def test_merges_in_order():
    x = np.array([[1, 0], [0, 1], [0.9, 0.1], [0.1, 0.9], [0.7, 0.7]])
    assert clustering.merge_in_order(x, 0.95) == [0, 1, 0, 1, 4] and clustering.merge_in_order(x, 0.7) == [0, 1, 0, 1, 0]


def test_tracker_merges_and_names():
    t = clustering.Tracker()
    a, b = [1.0, 0, 0], [0, 1.0, 0]
    assert t.assign(a, 3000, 0) == (0, "new") and t.assign(b, 3000, 10_000) == (1, "new") and t.counts() == (2, 2)
    assert t.name_recent("Natalia Ram…", 11_000, 2000) and t.label(1) == "Person 2 (Natalia Ram…)"
    assert t.assign(a, 3000, 20_000) == (0, "confident") and not t.name_recent("Natalia Ramirez", 99_000, 2000)
    assert t.name_recent("Natalia Ramirez", 21_000, 2000)  # the two are one, and the longer name stays
    assert t.canonical(0) == 1 and t.counts() == (1, 0) and t.label(0) == t.label(1) == "Person 2 (Natalia Ramirez)" and t.last == 1
    assert t.name_recent("Natalia", 21_000, 2000) and t.label(0) == "Person 2 (Natalia Ramirez)"
    assert np.allclose(t.speakers[1].mean, [2 / 3, 1 / 3, 0])
    t = clustering.Tracker()
    t.assign([1, 0], 3000, 0)
    assert t.assign([0.55, 0.83], 3000, 2000) == (0, "sticky") and t.assign([0.55, 0.83], 3000, 9000) == (1, "new")
    assert t.assign([-1, 0.1], 500, 20_000) == (1, "short") and t.assign([-1, 0.1], 500, 40_000) == (2, "new")


def test_near_names_lose_no_pair(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 26)))

    def edited(w):
        w = list(w)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w) + 1) : r.randrange(len(w) + 1)] = r.choice(["", "x", "é"])
        return "".join(w) or "a"

    left = sorted({word() for _ in range(250)})
    right = sorted({edited(r.choice(left)) for _ in range(250)} | {w[: r.randint(1, len(w))] for w in left})
    a = spark.createDataFrame([(w, w) for w in left], "a string, a_key string")
    b = spark.createDataFrame([(w, w) for w in right], "b string, b_key string")
    every = a.crossJoin(b)
    want = every.filter(labels.same_name(F.col("a_key"), F.col("b_key"))).select("a", "b")
    assert sorted(map(tuple, names.alike_pairs(a, b).select("a", "b").collect())) == sorted(map(tuple, want.collect()))
    want = every.filter(F.levenshtein("a", "b") <= labels.snap_limit(F.col("a"), F.col("b"))).select("a", "b")
    got = names.snapped_pairs(a.select(F.col("a").alias("name")), b.select(F.col("b").alias("invitee")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cuts_at_changes(spark):
    lines = spark.createDataFrame([(1, 0, 0, 5000), (1, 1, 6000, 6500)], "session_id long, pos long, start_ms long, end_ms long")
    changes = spark.createDataFrame([(1, t) for t in (100, 450, 700, 860, 4590, 4601, 6250)], "session_id long, t long")
    assert sorted((x["pos"], x["t"]) for x in live.cut_at_changes(lines, changes).collect()) == [(0, 450), (0, 860), (0, 4590)]


def plain_merges(x, labels, least, allowed):
    out = list(labels)
    while True:
        names = sorted(set(out))
        sums = {c: sum(v for v, l in zip(x, out) if l == c) for c in names}
        like = lambda a, b: float(sums[a] @ sums[b] / np.linalg.norm(sums[a]) / np.linalg.norm(sums[b]))
        pairs = [(-like(a, b), a, b) for a in names for b in names if a < b and like(a, b) >= least and allowed(a, b)]
        if not pairs:
            return clustering.compact(out)
        _, a, b = min(pairs)
        out = [a if c == b else c for c in out]


def test_centroids_merge_as_in_plain_python_and_in_time():
    r = np.random.default_rng(4)
    for k in range(20):
        x, labels = r.normal(size=(40, 3)), r.integers(0, 25, 40).tolist()
        for allowed in (lambda a, b: True, lambda a, b: (a + b) % 3 > 0):
            assert clustering.merge_by_centroid(x, labels, 0.1 * (k % 8), allowed) == plain_merges(x, labels, 0.1 * (k % 8), allowed)
    began = time.process_time()
    assert len(set(clustering.merge_by_centroid(r.normal(size=(2500, 64)), range(2500), 0.3))) < 2500
    assert time.process_time() - began < 60
