"""Mixing, link propagation, language mixtures, toxicity and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import langmix, linkrank, mixing, toxicity


def plain_targets(sizes, weights, budget=1.5, cap=2.0):
    """Water filling, round by round."""
    left, open_, out = budget * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def plain_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (won[i] + 0.5), -i))
        won[best] += 1
    return won


def test_quotas_are_the_highest_quotients(spark):
    r = random.Random(1)
    rows = [(g, i, float(r.choice([0, 1, 5, 50, 700]) * r.random()), 97) for g in range(6) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "g long, i long, votes double, seats long")
    got = {(x["g"], x["i"]): x["n"] for x in mixing.quotas(df, ["g"], "votes", "seats", [F.col("i")], "n").collect()}
    for g in range(6):
        mine = [x for x in rows if x[0] == g]
        want = plain_quotients([x[2] for x in mine], 97) if any(x[2] for x in mine) else [0] * len(mine)
        assert [got[g, x[1]] for x in mine] == want


def test_mix_of_sources(spark):
    r = random.Random(2)
    rows = [(d, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "b", "c", None, "é", "z"])) for d in range(3000)]
    rows += [(5000 + d, " ".join(["w"] * 40), "hot") for d in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_docs=500).collect()
    names = sorted({s for _, _, s in rows if s}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for n, size in zip(names, sizes):
        mine = [x for x in got if x["source"] == n]
        assert mine[0]["source_size"] == size and abs(mine[0]["target"] - want[n]) < 1e-6
        assert abs(sum(x["taken"] for x in mine) - want[n]) <= 0.01 * want[n] + 20
    assert all(x["taken"] <= 2 * x["size"] for x in got) and len(got) == len(rows)
    again = mixing.mix(df.repartition(7), shard_docs=500).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)


def test_mix_of_odd_rows(odd_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_texts(no_docs).count() == 0
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    texts = mixing.mixed_texts(odd_docs)
    assert texts.columns == odd_docs.columns
    rows = texts.collect()
    assert all(r["n_chars"] == len(r["text"]) and r["text"].split() for r in rows)
    plan = {}
    for x in got:
        plan.setdefault(x["doc_id"], []).append(x["taken"])
    words = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(words.get(d, 0) == t[0] for d, t in plan.items() if len(t) == 1)


def page(url, *links):
    return url, "".join(f'<a href="{x}">x</a>' for x in links)


def rule_cases():
    cases = {
        "http://com/": "com/", "https://a.com/x": "com/", "https://Example.COM/en/1": "example.com/en/", "https://x.example.com/en/1": "example.com/en/",
        "https://www.example.com/en/1": "www.example.com/en/", "https://b.www.example.com/en/?q": "www.example.com/en/", "https://www.example.com/de/": "com/",
        "https://a.net/es/1": "net/es/", "https://a.net/en/": None, "https://a.com": None, "https://a.com?x": None, "https://badcom/": None, "nothing": None,
    }
    verdicts = dict((r, v) for v, r in linkrank.RULES)
    return cases, verdicts


def test_rules_by_either_way(spark):
    cases, verdicts = rule_cases()
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    x = df.select("url", linkrank.host_of(F.col("url")).alias("host"), linkrank.path_of(F.col("url")).alias("path"))
    one = {r["url"]: (r["rule"], r["rule_verdict"]) for r in linkrank.rule_columns(x, linkrank.RULES).collect()}
    keys = linkrank.apply_rules(x.select("host", "path").distinct(), linkrank.RULES)
    two = {r["url"]: (r["rule"], r["rule_verdict"]) for r in x.join(keys, ["host", "path"]).collect()}
    assert one == two
    for u, rule in cases.items():
        assert one[u] == (rule, verdicts.get(rule)), u
    assert one[None] == (None, None)


def sentences(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def test_language_mixtures(spark, odd_docs, no_docs):
    r = random.Random(4)
    kinds = {"aa": "abcde", "bb": "efghi", "cc": "mnopé"}
    rows = [(d, sentences(r, kinds[k], r.randint(3, 60)), k) for d, k in enumerate(r.choice(list(kinds)) for _ in range(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langmix.learn(df.filter(~langmix.held_out(F.col("doc_id"))))
    got = {x["doc_id"]: x for x in langmix.predict(df, model).collect()}
    assert sum(got[d]["lang_pred"] == k for d, _, k in rows) >= 0.98 * len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    half = spark.createDataFrame([(1, sentences(r, kinds["aa"], 120) + " " + sentences(r, kinds["cc"], 60)), (2, None), (3, " 12 !!"), (4, "")], "doc_id long, text string")
    found = {x["doc_id"]: x for x in langmix.predict(half, model).collect()}
    assert found[1]["lang_pred"] == "aa" and set(found[1]["mixture"]) == {"aa", "cc"} and found[1]["mixture"]["cc"] == pytest.approx(1 / 3, abs=0.06)
    assert all(found[d]["lang_pred"] == "und" and found[d]["score"] == 0 for d in (2, 3, 4))
    assert langmix.learn(no_docs)[0] == [] and langmix.predict(no_docs, model).count() == 0
    kept = langmix.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and {2, 3, 4}.isdisjoint(r["doc_id"] for r in kept.collect())
    alone = langmix.predict(df.limit(1), model).first()
    assert alone["mixture"] == got[alone["doc_id"]]["mixture"]  # neighbours in a batch do not matter


def test_toxicity(spark, odd_docs, no_docs):
    r = random.Random(5)
    rows, labels = [], []
    for d in range(600):
        toxic = int(r.random() < 0.3)
        words = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 60))]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Vile!", "nasty", "(rotten)"]))
        rows.append((d, " ".join(words)))
        labels.append((d, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks.filter(~toxicity.held_out(F.col("doc_id"))))
    assert 0 < (model[0] != 0).sum() < 200
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(docs, model).collect()}
    wrong = sum(got[d] != y for d, y in labels)
    assert wrong <= 6
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= x["score"] <= 1 for x in odd)
    assert toxicity.score(no_docs, model).count() == 0
    empty = toxicity.learn(no_docs, marks)
    assert not (empty[0] != 0).any()
