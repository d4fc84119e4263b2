"""Tables in folders, settings, and session files that are deleted, too long, or named by a calendar."""

import json
import uuid

import pytest
from pyspark.sql import types as T

from parlance.plans import store
from parlance.sources import sessions, settings, stores


def test_tables_in_folders(spark, tmp_path):
    path = f"{tmp_path}/profiles"
    df = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string")
    stores.replace_table(df, path)
    watched = stores.Watched(spark, path)
    assert [x.count() if i == 0 else x for i, x in enumerate(watched.read())] == [2, True] and not watched.read()[1]
    copy = stores.backup(spark, path, "20260101")
    stores.replace_table(spark.read.parquet(path).filter("id = 1"), path)
    table, changed = watched.read()
    assert changed and table.count() == 1 and spark.read.parquet(copy).count() == 2
    assert sorted(x.name for x in tmp_path.iterdir()) == ["profiles", "profiles.20260101.bak"]


def test_results_are_computed_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    parts = [uuid.uuid4().hex, json.dumps({"threshold": 0.5})]
    assert [stores.cached(spark, parts, build).count() for _ in range(3)] == [3, 3, 3] and len(calls) == 1
    assert stores.cached(spark, [*parts, "other"], build).count() == 3 and len(calls) == 2


DEFAULTS = {"meeting.threshold": 0.65, "meeting.margin": 0.0, "output.timeout": 5, "languages": ["en"], "hotkey.a": "F1", "hotkey.b": "F2", "two_pass": False}
RULES = [settings.within("meeting.threshold", 0, 1, open_low=True), settings.within("output.timeout", 0), settings.each_of("languages", ["en", "bn"]), settings.differ("hotkey.a", "hotkey.b"), settings.one_of("two_pass", [True, False])]


def test_settings(tmp_path):
    path = f"{tmp_path}/settings.toml"
    assert settings.load(path, DEFAULTS) == DEFAULTS
    watch = settings.Watch(path)
    (tmp_path / "settings.toml").write_text('languages = ["en", "xx"]\nunknown = 1\n[meeting]\nthreshold = 1.5\n[hotkey]\na = "F2"\n')
    found = settings.load(path, DEFAULTS)
    assert watch.changed() and not watch.changed() and "unknown" not in found and found["output.timeout"] == 5
    assert settings.problems(found, RULES) == ["meeting.threshold must be at most 1", "languages: xx is not known", "hotkey.a and hotkey.b must differ"]
    assert settings.problems(DEFAULTS, RULES) == [] and settings.problems(DEFAULTS | {"meeting.threshold": 0, "languages": []}, RULES) == ["meeting.threshold must be above 0", "languages must not be empty"]
    odd = DEFAULTS | {"hotkey.a": 'a "quoted"\\ key\n'}
    settings.save(path, odd)
    assert settings.load(path, DEFAULTS) == odd and watch.changed()
    actions = {"meeting": "cluster again", "hotkey": "bind keys", "languages": "load models", "meeting.threshold": "cluster again"}
    assert settings.plan(DEFAULTS, odd | {"meeting.threshold": 0.5}, actions) == ["cluster again", "bind keys"] and settings.plan(DEFAULTS, DEFAULTS, actions) == []


def test_named_runs():
    base, trial = {"threshold": 0.65, "margin": 0.0, "two_pass": False}, {"threshold": 0.5, "margin": 0.15, "two_pass": True}
    groups = {"threshold": ["threshold"], "sticky": ["margin"], "two-pass": ["two_pass"]}
    runs = settings.variants(["ablation"], base, trial, groups)
    assert len(runs) == 8 and runs["default"] == base and runs["experimental"] == trial
    assert runs["+sticky"] == base | {"margin": 0.15} and runs["-two-pass"] == trial | {"two_pass": False}
    assert settings.described(runs["+two-pass"]) == "margin 0, threshold 0.65, two_pass"
    with pytest.raises(ValueError, match="unknown run"):
        settings.variants(["+nothing"], base, trial, groups)


def test_sessions_are_deleted_by_prefix(spark, tmp_path):
    rows = [(i, i.upper(), None, 5.0, None, []) for i in ("abc1", "abd2", "x")]
    sessions.write_sessions(spark.createDataFrame(rows, T.StructType(sessions.SESSION.fields[:-1])), f"{tmp_path}/s")
    assert sessions.delete_session(spark, f"{tmp_path}/s", "abd") == "abd2" and sessions.delete_session(spark, f"{tmp_path}/s", "abd") is None
    assert sorted(r["id"] for r in sessions.read_sessions(spark, f"{tmp_path}/s").collect()) == ["abc1", "x"]


def test_files_too_long_are_left_out_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "MOST_TURNS", 3)
    turn = {"speaker": "A\u0007 " + "b" * 300, "offset": 1, "text": "x"}
    for n in (3, 4):
        (tmp_path / f"{n}.json").write_text(json.dumps({"writer": "w", "turns": [turn] * n}))
    got = sessions.read_external(spark, f"{tmp_path}/*.json", ["w"]).collect()
    assert len(got) == 3 and all(r["path"].endswith("3.json") and r["speaker"] == "A " + "b" * 198 for r in got)


def test_subjects_and_spots(spark, tmp_path):
    for session, calendar, title in (("a", {"writer": "w", "subject": " Plan\n A "}, {"writer": "w", "title": "no"}), ("b", {"writer": "x", "subject": "no"}, {"writer": "w", "title": "Talk"}), ("c", {"writer": "w", "subject": ""}, {"writer": "x", "title": "no"})):
        folder = tmp_path / f"session={session}"
        folder.mkdir()
        (folder / "calendar.json").write_text(json.dumps(calendar))
        (folder / "title.json").write_text(json.dumps(title))
    assert {r["session"]: r["subject"] for r in sessions.read_subjects(spark, str(tmp_path), ["w"]).collect()} == {"a": "Plan A", "b": "Talk"}
    (tmp_path / "spots.jsonl").write_text('{"words": "so be it", "pos": 0.5}\nbroken\n{"before": "x"}\n')
    assert [r["words"] for r in sessions.read_spots(spark, f"{tmp_path}/spots.jsonl").collect()] == ["so be it"]


def test_subjects_are_not_a_file_a_session(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    rows = [(i, 0, "user", f"text {i}") for i in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in/conversations.parquet"))
    monkeypatch.setattr(store, "_folder", lambda spark: str(tmp_path / "written"))
    got = {x["session"]: x["subject"] for x in store.session_subjects(spark, str(tmp_path / "in")).collect()}
    title = lambda i: (f"T{i} " * 150)[:300].strip()
    want = {str(i): f"Plan of {i}" if i % 3 == 0 and i % 7 != 6 else title(i) for i in range(400) if i % 3 == 0 and i % 7 != 6 or i % 5}
    assert got == want and len(list((tmp_path / "written").rglob("*.json"))) < 100
