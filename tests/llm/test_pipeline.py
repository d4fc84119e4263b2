"""The pipeline's stages against plain versions on a small table."""

import random

import corpus_pipeline
from parlance.llm import queries
from tests.llm.test_text_operators import plain_components, plain_cut, plain_fingerprint


def write(spark, folder):
    r = random.Random(8)
    kinds = {"aa": "abcde", "bb": "fghij"}
    word = lambda k: "".join(r.choice(kinds[k]) for _ in range(r.randint(3, 9)))
    passage = " ".join(word("aa") for _ in range(60))
    rows = []
    for d in range(240):
        k = r.choice(["aa", "bb"])
        text = " ".join(word(k) for _ in range(r.randint(20, 120)))
        if d % 11 == 0:
            text = text + " " + passage
        if d % 13 == 0 and d:
            text = rows[d // 2][1]
        if d % 17 == 0:
            text = r.choice(["", "12 34 !!", None])
        rows.append((d, text, k if d % 5 else None, f"s{d % 4}", len(text or "")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen.append(docs.collect())
    language, near, cut, mixed, tokens = seen
    bare = {d for d, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in language} == {d for d, *_ in rows} - bare
    prints = [plain_fingerprint(r["text"]) for r in language]
    least = plain_components([r["doc_id"] for r in language], prints)
    assert {r["doc_id"] for r in near} == set(least) and len(near) == len(set(least))
    want = {d: (n, gone) for d, n, gone, _ in plain_cut([(r["doc_id"], r["text"]) for r in near])}
    assert {r["doc_id"] for r in cut} == {d for d, (n, gone) in want.items() if n > gone}
    for r in cut:
        assert len(r["text"].split()) == want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])
    assert any(gone for _, gone in want.values())
    size = sum(len(r["text"].split()) for r in cut)
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * size) < 0.02 * size
    assert len(tokens) == len(mixed) and corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r["doc_id"] for r in got}
    # rows without letters go, copies go, rows without a doc_id stay if nothing repeats them; clashing columns do not matter
    assert {2, 3, 4, 6, 12}.isdisjoint(kept) and {1, 5} & kept and all(r["n_tokens"] > 0 for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(queries.oracle_sql()) < set(names)
