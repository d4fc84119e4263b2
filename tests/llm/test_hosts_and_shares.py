"""Host verdicts that decide, and quotas with a most, through the queries, their SQL and plain versions."""

import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parlance.llm import host_rules, mixing, oracles, queries


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{folder}/documents.parquet")


def sql(folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return db.execute(oracles.ORACLES[name]).df()


def same(spark, folder, name):
    got = queries.queries()[name](spark, str(folder)).toPandas()
    want = sql(folder, name)
    plain = lambda v: "" if pd.isna(v) else str(round(float(v), 6)) if isinstance(v, (int, float, np.number)) else str(v)
    key = lambda df: sorted(tuple(map(plain, x)) for x in df[sorted(want.columns)].itertuples(index=False))
    assert key(got) == key(want)
    return got


def test_hosts_that_fail(spark, tmp_path):
    r = random.Random(1)
    good = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    share = {"fine": 0.1, "fine2": 0.12, "fine3": 0.08, "bad": 0.7, "small": 1.0, None: 0.1}
    rows = []
    for host, part in share.items():
        for _ in range(2 if host == "small" else 150):
            rows.append((len(rows), "too short" if r.random() < part else good(), host))
    write(spark, tmp_path, rows)
    got = same(spark, tmp_path, "op10_host_rules").set_index("doc_id")
    for d, text, host in rows:
        assert got.kept[d] == (text != "too short" and host != "bad")


def test_one_host_or_all_failing(spark, odd_docs, no_docs):
    one = spark.createDataFrame([(1, "x", "a"), (2, "y", "a")], "doc_id long, text string, source string")
    assert [x["kept"] for x in host_rules.judge(one).collect()] == [False, False]
    clean = one.select("doc_id", F.expr("array_join(transform(sequence(1, 60), i -> concat('w', i)), ' ')").alias("text"), "source")
    assert [x["kept"] for x in host_rules.judge(clean).collect()] == [True, True]
    assert host_rules.judge(no_docs).count() == 0 and host_rules.judge(odd_docs).count() == odd_docs.count()


def test_quotas_with_a_most(spark):
    r = random.Random(2)
    rows = []
    for g in range(8):
        sizes = [r.choice([0, 3, 64, 500, 501, 4000]) for _ in range(r.randint(1, 12))]
        most = [2 * -(-s // 64) for s in sizes]
        seats = min(sum(most), round(2 * sum(sizes) / 64))
        rows += [(g, i, s, seats, m) for i, (s, m) in enumerate(zip(sizes, most))]
    df = spark.createDataFrame(rows, "g long, i long, votes long, seats long, most long")
    got = {(x["g"], x["i"]): x["n"] for x in mixing.quotas(df, ["g"], "votes", "seats", [F.col("i")], "n", "most").collect()}
    for g in range(8):
        mine = [x for x in rows if x[0] == g]
        won = [0] * len(mine)
        for _ in range(mine[0][3]):
            best = max((i for i in range(len(mine)) if won[i] < mine[i][4]), key=lambda i: (mine[i][2] / (won[i] + 0.5), -i))
            won[best] += 1
        assert [got[g, i] for i in range(len(mine))] == won


def test_rows_without_or_of_one_doc_id_are_spread(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([None, 7, d]), " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 90))), r.choice(["a", "b", None])) for d in range(3000)]
    rows = list(dict.fromkeys(rows))
    write(spark, tmp_path, rows)
    got = same(spark, tmp_path, "op1_source_mix")
    for source in got.source.unique():
        mine = got[got.source.isna()] if pd.isna(source) else got[got.source == source]
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= 0.01 * mine.target.iloc[0] + 64
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").filter("doc_id IS NULL")
    spot = table.select(F.pmod(mixing.seeded(F.lit("s"), F.col("doc_id"), F.md5("text")), F.lit(8)).alias("shard")).groupBy("shard").count().collect()
    assert len(spot) == 8
