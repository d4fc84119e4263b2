"""Queries and operators do the whole job: long lines, long sessions, whole documents, any number of languages."""

import hashlib
import random

import pytest

from parlance.functions import text
from parlance.plans import scores, texts
from parlance.plans.views import load


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def costs(a, b):
    """The whole table of edit costs."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, new[-1] + 1))
        rows.append(new)
    return rows


def traced(a, b):
    """The alignment by the whole table, with the ties of text.alignment."""
    cost, out, i, j = costs(a, b), [-1] * len(b), len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out[j] = i
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def test_alignment_over_blocks(monkeypatch):
    monkeypatch.setattr(text, "BLOCK", 4)
    r = random.Random(11)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 21))] for _ in range(2))
        assert text.alignment(a, b) == traced(a, b)


def test_word_distance_of_whole_lines(spark, tmp_path):
    r = random.Random(12)
    lines = [[r.choice("abcdefg") for _ in range(n)] for n in (40, 300, 9, 8, 25)]
    lines.append(lines[-1][:20] + ["other"] * 5)  # unlike the line before past word 20 only
    data = table(spark, tmp_path, "conversations", [(1, k, "user", " ".join(x)) for k, x in enumerate(lines)], "conv_id long, turn long, role string, text string")
    want = {k: costs(a, b)[-1][-1] for k, (a, b) in enumerate(zip(lines, [*lines[1:], []]))}
    assert want[4] == 5
    assert {x["pos"]: x["edits"] for x in texts.word_distance(spark, data).collect()} == want


def test_labels_of_long_sessions(spark, tmp_path):
    r = random.Random(13)
    rows = [(c, k, r.choice(["user", "assistant", "system"]), " ".join(["w"] * r.randint(1, 90))) for c, n in ((1, 40), (2, 3), (3, 12)) for k in range(n)]
    data = table(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    lines, turns = load(spark, data, "segments").collect(), load(spark, data, "turns").collect()
    want = {}
    for s in lines:
        own = [t for t in turns if t["session_id"] == s["session_id"]]
        end = max(x["end_ms"] for x in [*own, *(x for x in lines if x["session_id"] == s["session_id"])])
        shown = []
        for cut in range(20_000, max(end + 20_000, 20_001), 20_000):
            known = [t for t in own if t["start_ms"] <= cut]
            if s["start_ms"] <= cut and known:
                shown.append((cut, min(known, key=lambda t: (abs(t["start_ms"] - s["start_ms"]), -t["turn_pos"] if cut >= 100_000 else t["turn_pos"]))["cluster"]))
        want[s["session_id"], s["pos"]] = (shown[0][1], shown[-1][1], sum(a[1] != b[1] for a, b in zip(shown, shown[1:])), shown[-1][0] - shown[0][0])
    assert any(s["start_ms"] > 240_000 for s in lines)
    assert {(x["session_id"], x["pos"]): (x["first"], x["final"], x["changes"], x["span"]) for x in scores.first_and_final_labels(spark, data).collect()} == want


def test_whole_documents_are_normalized_and_aligned(spark, tmp_path):
    r = random.Random(14)
    body = lambda n: [r.choice("bcdefghj") + r.choice("bcd") for _ in range(n)]
    docs = [(1, body(700), "en"), (2, body(650), "en"), (3, body(30), "de"), (4, [], "de"), (6, body(9), "de")]
    data = table(spark, tmp_path, "documents", [(d, " ".join(w) + ".", k) for d, w, k in docs] + [(7, None, "de")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: (x["n_words"], x["digest"]) for x in texts.normalize_words_full(spark, data).collect()}
    assert got == {d: (len(w), hashlib.md5(" ".join(w).encode()).hexdigest()) for d, w, _ in [*docs, (7, [], "de")]}
    edits = {x["doc_id"]: (x["ref_words"], x["substitutions"] + x["deletions"] + x["insertions"]) for x in texts.word_errors(spark, data).collect()}
    assert edits == {1: (700, costs(docs[0][1], docs[1][1])[-1][-1]), 3: (30, 30), 6: (9, 9)}
    hunks = texts.diff_hunks(spark, data).groupBy("lang").sum("ref_words", "hyp_words").collect()
    same = sum(p >= 0 and docs[0][1][p] == w for p, w in zip(traced(docs[0][1], docs[1][1]), docs[1][1]))
    assert {tuple(x) for x in hunks} == {("en", 700 - same, 650 - same), ("de", 39, 0)}
