"""Words, labels, clocks, vectors, signals, matchings, clusterings and state machines on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import labels, signal, text, timefmt, vectors
from parlance.operators import clustering, matching
from parlance.sources import sessions, transcripts
from parlance.streaming.states import KeepOnChange, LevelGate, MeetingDetector, NameLog, RevisionMerge, TurnBuilder


@pytest.mark.parametrize(
    "said, words",
    [
        ("It costs thirty three dollars, um, ok?", "it costs 33 dollars okay"),
        ("a hundred and thirty of Q3 on the 15th", "130 of q 3 on the 15"),
        ("twenty twenty six or nineteen ninety", "2026 or 1990"),
        ("2.5% of 1,000 end.next", "2.5 percent of 1000 end next"),
        ("two hundred and five thousand first, second", "205000 first second"),
        ("two point five and don't", "2.5 and don't"),
        ("a dog and a hundred", "a dog and 100"),
        ("", ""),
    ],
)
def test_normalizer(said, words):
    assert text.normalize_words(said) == words.split()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_alignment_is_least_and_ordered():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        pairs = text.alignment(a, b)
        used = [p for p in pairs if p >= 0]
        assert used == sorted(set(used)) and len(pairs) == len(b)
        assert text.word_distance(a, b) == plain_distance(a, b)
        inside = [(h["ref_from"], h["ref_to"], h["hyp_from"], h["hyp_to"]) for h in text.diff_hunks(a, b)]
        i = j = 0
        for ra, rb, ha, hb in [*inside, (len(a), len(a), len(b), len(b))]:
            assert a[i:ra] == b[j:ha]
            i, j = rb, hb
    assert text.error_counts(["a"], ["b", "a"]) == {"ref_words": 1, "substitutions": 0, "deletions": 0, "insertions": 1}
    assert text.error_rate(text.error_counts([], ["x"])) == 1.0 and text.error_rate(text.error_counts([], [])) == 0.0


def test_hunk_kinds_and_terms():
    assert text.hunk_kind(["a"] * 8, []) == "long run" and text.hunk_kind(["any", "one"], ["anyone"]) == "split/join"
    assert text.hunk_kind(["the"], ["a", "of"]) == "small words" and text.hunk_kind(["walked"], ["walking"]) == "word form"
    assert text.hunk_kind(["cat"], ["dog"]) == "meaningful"
    assert text.term_hits("the big cat and the big dog".split(), "the big cat and a big dog".split(), ["the big", "big dog", "no"]) == {"the big": (2, 1), "big dog": (1, 1)}
    assert text.locate("a b c a b d".split(), ["a"], ["b"], ["d"], 0.0) == (4, 5) and text.locate(["a"], [], ["z"], [], 0) is None


def test_words_in_time():
    w = text.spread_words("ab c def", 0.0, 1.0)
    assert [x["start"] for x in w] == [0.0, 0.333, 0.556] and w[-1]["end"] == 1.0
    got = text.words_from_tokens([" he", "llo", ",", " you", " ", "!"], [0.0, 0.1, 0.2, 0.5, 0.6, 0.7], 1.0)
    assert [(x["word"], x["start"], x["end"]) for x in got] == [("hello,", 0.0, 0.5), ("you!", 0.5, 1.0)]


def test_labels(spark):
    rows = [("You", "mic", ""), ("Ann Lee", "given", "Ann Lee"), ("Person 3 (Bo)", "named", "Bo"), ("Person 3 (Bo?)", "placeholder", ""), ("Person 3", "placeholder", ""), ("Oslo Room (8)", "room", "Oslo Room (8)"), ("New speaker", "placeholder", ""), ("Roomy", "given", "Roomy")]
    df = spark.createDataFrame(rows, "l string, kind string, name string")
    for r in df.withColumn("k", labels.label_kind(F.col("l"))).withColumn("n", labels.label_person(F.col("l"))).collect():
        assert (r["k"], r["n"]) == (r["kind"], r["name"]), r["l"]
    pairs = [("natalia rami", "natalia ramirez", True), ("ortiz", "ortlz", True), ("bob", "bobby", False), ("ann", "ann", True), ("maria", "mario x", False)]
    got = spark.createDataFrame(pairs, "a string, b string, same boolean").select("*", labels.same_name(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["got"] == r["same"] for r in got)
    outcomes = [("mic", "", "A", "kept-mic"), ("given", "Ann", "Ann Lee", "agree"), ("given", "Ann", "Bo", "kept-given"), ("named", "Natalia Rami", "Natalia Ramirez", "spelling"), ("named", "Bo Ek", "Oslo Room", "kept-room"), ("named", "Bo Ek", "Cy", "replace"), ("placeholder", "", "Cy", "fill")]
    got = spark.createDataFrame(outcomes, "k string, c string, p string, o string").select("o", labels.outcome(F.col("k"), F.col("c"), F.col("p")).alias("got")).collect()
    assert all(r["o"] == r["got"] for r in got)


def test_clocks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(timefmt.timestamp_rounded(F.lit(3661.5))) == "01:01:02" and one(timefmt.timestamp_floored(F.lit(3661.9))) == "01:01:01"
    assert one(timefmt.srt_timestamp(F.lit(3661999))) == "01:01:01,999" and one(timefmt.clock(F.lit(75))) == "1:15" and one(timefmt.clock(F.lit(3675))) == "1:01:15"
    assert one(timefmt.parse_clock(F.lit("1:01:15"))) == 3675 and one(timefmt.parse_clock(F.lit("x"))) is None
    assert one(timefmt.duration(F.lit(3723))) == "1h02m03s" and one(timefmt.duration(F.lit(3))) == "3s"
    assert [one(timefmt.parse_duration(F.lit(t))) for t in ("10m", "1h5m", "90s", "250ms", "x")] == [600.0, 3900.0, 90.0, 0.25, None]


def test_vectors_and_signals(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], 1), ([0.0, 0.0], [1.0, 0.0], 1), ([1.0], [1.0, 2.0], 2)], "a array<double>, b array<double>, k int")
    got = [r["c"] for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [pytest.approx(0.96), 0.0, 0.0]
    assert [r["s"] for r in df.select(vectors.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [24.0, 0.0, -2.0]
    total = {r["k"]: (r["sum"], r["n"]) for r in vectors.vector_sum(df, ["k"], "b").collect()}
    assert total == {1: ([5.0, 3.0], 2), 2: ([1.0, 2.0], 1)}
    x = [math.sin(i / 3) + 0.5 for i in range(50)]
    s = spark.createDataFrame([(x,)], "x array<double>")
    rc = 1 / (2 * math.pi * 80)
    k = rc / (rc + 1 / 8000)
    high = [x[0]]
    for i in range(1, 50):
        high.append(k * (high[-1] + x[i] - x[i - 1]))
    row = s.select(signal.high_pass(F.col("x"), 8000, 80.0).alias("h"), signal.remove_dc(F.col("x")).alias("d"), signal.normalize_peak(F.col("x")).alias("n"), signal.level_db(F.col("x")).alias("l"), signal.noise_gate(F.col("x"), -6.0).alias("g")).first()
    assert row["h"] == pytest.approx(high) and sum(row["d"]) == pytest.approx(0, abs=1e-9) and max(map(abs, row["n"])) == 1.0
    assert row["l"] == pytest.approx(20 * math.log10(math.sqrt(sum(v * v for v in x) / 50))) and row["g"] == [v if abs(v) >= 10**-0.3 else 0.0 for v in x]
    assert spark.range(1).select(signal.chunk_starts(F.lit(25), 10, 4).alias("c")).first()["c"] == [0, 4, 8, 12, 16]


def test_matching():
    r = random.Random(2)
    for _ in range(150):
        n, m = r.randint(1, 5), r.randint(1, 5)
        w = [[r.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = matching.max_weight_matching(w)
        best = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(max(n, m))))
        assert sum(w[i][j] for i, j in enumerate(got) if j >= 0) == best and len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
    assert matching.greedy_pairs([(1, 2), (1, 3), (4, 2), (4, 3)]) == [(1, 2), (4, 3)] and matching.max_weight_matching([]) == []


def test_clustering():
    r = np.random.default_rng(7)
    for k in range(1, 5):
        centres = np.eye(8)[:k]
        who = [i % k for i in range(24)]
        x = np.array([centres[w] + r.normal(0, 0.08, 8) for w in who])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert clustering.complete_linkage(x, 0.5) == who and clustering.complete_linkage(x, 0.0, clusters=k) == who
    x = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert clustering.complete_linkage(x, 1.5, tiles=["a", "b", None]) in ([0, 1, 0], [0, 1, 1])
    assert clustering.merge_by_centroid(x, [0, 1, 2], 0.9) == [0, 0, 1] and clustering.merge_by_centroid(x, [0, 1, 2], 0.9, lambda a, b: False) == [0, 1, 2]
    assert clustering.absorb_small(x, [0, 1, 2], [9, 1, 9], 5) == [0, 0, 1]
    assert clustering.stable_labels([1, 2, 3, 4], [0, 0, 1, 2], {1: 5, 2: 5, 3: 5}, 9) == ({0: 5, 1: 9, 2: 10}, 11)
    t = clustering.Tracker()
    seen = [t.assign(v, d, at) for v, d, at in [([1, 0], 3000, 0), ([0.9, 0.1], 3000, 1), ([0, 1], 500, 2), ([0, 1], 3000, 3), ([0.5, 0.8], 3000, 4), ([0, 0], 1, 5)]]
    assert seen == [(0, "new"), (0, "confident"), (0, "short"), (1, "new"), (1, "confident"), (1, "empty")] and t.peek([1, 0.1]) == 0


def test_state_machines():
    m = RevisionMerge()
    for status, want in [("live", "live"), ("", ""), ("live", ""), ("removed", None), ("live", "live"), ("pending", "pending")]:
        row = m.step({"status": status})
        assert (row and row["status"]) == want
    g = LevelGate(-60.0, 10.0)
    assert [g.step(x) for x in [-70, *[-20] * 8, -31, -30, -29]] == [False, *[True] * 8, False, True, True]
    b = TurnBuilder()
    out = b.step("mic", 0, 1000) + b.step("mic", 1500, 3000) + b.step("monitor", 3000, 3500) + b.step("mic", 3600, 4000) + b.step("mic", 9000, 9500) + b.step("monitor", 9600, 12_000) + b.flush()
    assert [(t["source"], t["start_ms"], t["end_ms"], t["parts"], t["cut"]) for t in out] == [("mic", 0, 4000, 3, "pause"), ("mic", 9000, 9500, 1, "other side spoke"), ("monitor", 3000, 3500, 1, "pause"), ("monitor", 9600, 12_000, 1, "end")]
    d = MeetingDetector(2000)
    assert [d.step(*x) for x in [(0, [5], [5]), (1000, [5], [5]), (1500, [6], [6]), (3000, [5], []), (5000, [5], [5]), (6000, [], [5]), (7000, [], [])]] == [[], [], [], [], [("start", 5)], [], [("stop", 5)]]
    n = NameLog(lambda a, b: a[:3] == b[:3])
    assert [n.step(x) for x in ["Ann", "Anna", "", "Bo", "Ann"]] == [False, False, False, True, True]
    k = KeepOnChange(10)
    assert [k.step(t, v) for t, v in [(0, "a"), (5, "a"), (6, "b"), (15, "b"), (16, "b")]] == [True, False, True, False, True]


def test_transcript_source(spark):
    doc = "Weekly\nAnn Lee  0:05\nHello there\nagain\n\nBo  0:05\nHi\nAnn Lee 1:02\nNot loose?\nCy 2:00\nmore words\n"
    turns = transcripts.parse_transcript(spark.createDataFrame([("f", doc)], "path string, value string"))
    got = [(r["speaker"], r["start"], r["text"]) for r in turns.orderBy("turn").collect()]
    assert got == [("Ann Lee", 5, "Hello there again"), ("Bo", 5, "Hi"), ("Ann Lee", 62, "Not loose? Cy 2:00 more words")]
    ends = {r["turn"]: (r["end"], r["overlapping"]) for r in transcripts.turn_ends(turns, media_end=100.0).collect()}
    assert ends[0] == (62.0, True) and ends[1][0] == pytest.approx(6.4) and ends[2] == (100.0, False)


def test_session_files(spark, tmp_path):
    rows = [("abc1", "One", None, 5.0, None, [("s1", "A", None, None, "mic", "hi", 0.0, 1.0, "", None)]), ("abd2", "Two", None, 6.0, None, [])]
    df = spark.createDataFrame(rows, T.StructType(sessions.SESSION.fields[:-1]))
    sessions.write_sessions(df, f"{tmp_path}/s")
    (tmp_path / "s" / "bad.json").write_text("{ not json")
    found = sessions.read_sessions(spark, f"{tmp_path}/s")
    assert [r["id"] for r in found.collect()] == ["abc1", "abd2"] and sessions.segments(found).first()["text"] == "hi"
    assert [r["id"] for r in sessions.resolve_id(found, "abc").collect()] == ["abc1"]
    with pytest.raises(Exception, match="several sessions"):
        sessions.resolve_id(found, "ab").collect()
    (tmp_path / "t.json").write_text('{"writer": "w", "turns": [{"speaker": "A", "offset": 9, "text": "x"}, {"speaker": " ", "offset": 1, "text": "y"}, {"speaker": "B", "offset": -1, "text": "z"}, {"speaker": "C", "offset": 2, "text": "u"}]}')
    assert [r["speaker"] for r in sessions.read_external(spark, f"{tmp_path}/t.json", ["w"]).orderBy("n").collect()] == ["C", "A"]
    assert sessions.read_external(spark, f"{tmp_path}/t.json", ["other"]).count() == 0
    (tmp_path / "c.json").write_text('{"writer": "w", "organizer": {"name": "Ann  Lee"}, "invitees": [{"name": "ANN LEE"}, {"name": "Bo"}, {"name": " "}]}')
    assert [r["name"] for r in sessions.read_invitees(spark, f"{tmp_path}/c.json", ["w"]).orderBy("pos").collect()] == ["Ann Lee", "Bo"]
    (tmp_path / "l.jsonl").write_text('{"id": 1, "stage": "ok"}\nbroken\n{"id": 2}\n')
    assert sorted(r["id"] for r in sessions.read_looks(spark, f"{tmp_path}/l.jsonl").collect()) == [1, 2]
