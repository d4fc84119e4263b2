"""Streams equal batches; names from windows; scores against plain loops."""

import random

from pyspark.sql import functions as F

from parlance.operators import names, scoring
from parlance.streaming import jobs
from parlance.streaming.states import LevelGate, RevisionMerge


def stream_of(spark, rows, schema, folder, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, folder, mode):
    return jobs.run_to_end(stream, f"{folder}/out", f"{folder}/state", mode)


def test_revisions(spark, tmp_path):
    r = random.Random(1)
    rows = [(s % 3, s % 5, s, r.choice(["live", "pending", "", "removed"]), f"S{r.randint(0, 3)}") for s in range(200)]
    got = run(jobs.merge_revisions(stream_of(spark, rows, jobs.MERGED, str(tmp_path))), tmp_path, "update")
    last = {(x["session_id"], x["seg_id"]): (x["status"], x["seq"]) for x in got.groupBy("session_id", "seg_id").agg(F.max(F.struct("batch_id", "status", "seq")).alias("l")).select("session_id", "seg_id", "l.*").collect()}
    want = {}
    for a, b, s, status, speaker in rows:
        want.setdefault((a, b), RevisionMerge()).step({"seq": s, "status": status, "speaker": speaker})
    assert last == {k: (m.row["status"], m.row["seq"]) if m.row else ("removed", -1) for k, m in want.items()}


def test_gate(spark, tmp_path):
    r = random.Random(2)
    rows = [(i % 2, i, r.uniform(-60, 0)) for i in range(120)]
    got = run(jobs.gate_levels(stream_of(spark, rows, "session_id long, event_id long, level double", str(tmp_path)), -50.0, 10.0), tmp_path, "append")
    gates = {0: LevelGate(-50.0, 10.0), 1: LevelGate(-50.0, 10.0)}
    assert {x["event_id"]: x["passed"] for x in got.collect()} == {i: gates[k].step(v) for k, i, v in rows}


def test_windows_sessions_and_duplicates(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "click") for i in range(0, 50, 5)] + [(5, "2024-01-01 00:05:00", 1, "click"), (99, "2024-01-02 00:00:00", 0, "end")]
    events = lambda d: stream_of(spark, rows, "event_id long, t string, user_id long, event_type string", f"{tmp_path}/{d}", 1).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    counts = run(jobs.window_counts(events("a"), "20 minutes"), f"{tmp_path}/a", "append").filter("event_type = 'click'")
    assert sorted(x["n"] for x in counts.collect()) == [2, 4, 5]
    sliding = run(jobs.window_counts(events("d"), "20 minutes", "10 minutes"), f"{tmp_path}/d", "append").filter("event_type = 'click'")
    assert sliding.agg(F.sum("n")).first()[0] == 22
    stretches = run(jobs.session_counts(events("b"), "12 minutes"), f"{tmp_path}/b", "append").filter("n > 1")
    assert {(x["user_id"], x["n"]) for x in stretches.collect()} == {(0, 5), (1, 6)}
    once = run(jobs.deduplicated(events("c"), ["event_id"]), f"{tmp_path}/c", "append")
    assert once.count() == 11


def test_stream_join(spark, tmp_path):
    lines = stream_of(spark, [(1, 0, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 00:01:00")], "session_id long, pos long, ts string", f"{tmp_path}/l", 1)
    hints = stream_of(spark, [(1, "Ann", "2024-01-01 00:00:03"), (1, "Bo", "2024-01-01 00:01:09"), (2, "Cy", "2024-01-01 00:00:01")], "session_id long, name string, hint_ts string", f"{tmp_path}/h", 1)
    got = run(jobs.hints_with_lines(lines, hints), tmp_path, "append").collect()
    assert [(x["pos"], x["name"]) for x in got] == [(0, "Ann")]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    windows = {"Microsoft Teams — Planning sync | Microsoft Teams": "Planning sync", "Microsoft Teams — Meeting compact view | Meeting join | Kick off | Pinned window | Microsoft Teams": "Kick off", "zoom.us — Zoom Meeting": "", "Browser — Planning": "", "Microsoft Teams": "", "Microsoft Teams — Chat | Bo": "", "Teams — Kai Moreno": "Kai Moreno"}
    assert {w: one(names.meeting_name(F.lit(w))) for w in windows} == windows
    fine = {"Ann Lee": True, "ill": False, "E": False, "Voice isolation": False, "ake control people": False, "View Chat Ann Lee": True, "Imogen": True}
    assert {n: one(names.plausible(F.lit(n))) for n in fine} == fine
    assert [names.cleaned(n) for n in ("Devin Dobro Priv", "Priya Desai fo", "Alex Kim •.• x", "lAlex Kim", "Mute", "Ann Lee Muted")] == ["Devin Dobro", "Priya Desai", "Alex Kim", "Alex Kim", "Mute", "Ann Lee"]
    assert one(names.contains_script(F.lit("ab こ"), F.lit("ja"))) and not one(names.contains_script(F.lit("ab"), F.lit("hi"))) and one(names.contains_script(F.lit("ab"), F.lit("en")))


def test_captured_turns(spark):
    turns = spark.createDataFrame([(1, 0, "A", "a b a c", 0, 1000), (1, 1, "B", "x y z", 5000, 6000), (1, 2, "C", "q", 50_000, 51_000)], "session_id long, turn_pos long, speaker string, text string, start_ms long, end_ms long")
    lines = spark.createDataFrame([(1, 0, "h1", "a q", 0, 500), (1, 1, "h2", "b a a", 500, 1000), (1, 2, "h3", "x w", 5000, 6000)], "session_id long, pos long, label string, line_text string, r_start_ms long, r_end_ms long")
    got = {x["turn_pos"]: (x["hits"], x["found"], x["label"]) for x in scoring.turns_captured(turns, lines, 100).collect()}
    assert got == {0: (3, True, "h2"), 1: (1, False, None), 2: (0, False, None)}


def test_change_points_and_labels(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([-1, -2, -1, 3, 4, 2])] + [(2, i, v) for i, v in enumerate([5, 1])], "k long, i long, v long")
    assert [(x["k"], x["at"], x["gain"]) for x in scoring.change_point(df, ["k"], "i", "v").collect()] == [(1, 3, 13)]
    shown = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 30, "b"), (1, 40, "a")], "k long, t long, label string")
    x = scoring.first_and_final(shown, ["k"], "t", "label").first()
    assert (x["first"], x["final"], x["changes"], x["span"]) == ("a", "a", 2, 30)


def test_picks(spark):
    df = spark.createDataFrame([(1, i) for i in range(11)] + [(2, i) for i in range(3)], "k long, i long")
    got = names.evenly_picked(df, ["k"], ["i"], 5)
    assert [x["i"] for x in got.filter("k = 1").orderBy("i").collect()] == [0, 2, 5, 7, 10] and got.filter("k = 2").count() == 3
