"""Queries on voice fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.vectors import cosine, dot, norm, vector_sum
from parlance.operators import clustering, voices
from parlance.plans.views import duckdb, load
from parlance.runtime import ship


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids by label, of even fingerprints (profiles): as many rows as there are people."""
    return voices.centroids(load(spark, sf_dir, "fingerprints").filter("vec_id % 2 = 0"), ["label"])


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = voices.centroids(load(spark, sf_dir, "fingerprints"), ["label"])
    return x.select("label", "n", F.posexplode("centroid").alias("i", "x")).select("label", "n", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


def knn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile nearest to each odd fingerprint."""
    best = _ranking(spark, sf_dir).filter("place = 1")
    return best.select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir).select("label", F.col("centroid").alias("p_centroid"))
    odd = load(spark, sf_dir, "fingerprints").filter("vec_id % 2 = 1").select("vec_id", F.col("embedding").alias("v_centroid"))
    return voices.ranked(odd, people, "vec_id", "label")


def knn_top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches at 0.2 or over with a lead of 0.05."""
    found = voices.accepted(voices.top_two(_ranking(spark, sf_dir), "vec_id", "label"), 0.2, 0.05)
    return found.select("vec_id", "label", F.round("similarity", 5).alias("similarity"), F.round("second", 5).alias("second"))


def look_alike_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = voices.centroids(load(spark, sf_dir, "fingerprints"), ["label"])
    apart = spark.createDataFrame([(1, 0), (3, 4)], "a int, b int")
    return voices.look_alikes(people, "label", -0.05, apart).select("a", "b", F.round("similarity", 5).alias("similarity"))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each session's part of a profile to the rest of it."""
    f = load(spark, sf_dir, "fingerprints")
    own = vector_sum(f, ["label", "session_id"], "embedding", "own", "n")
    total = vector_sum(f, ["label"], "embedding", "total", "all_n")
    rest = F.zip_with("total", "own", lambda a, b: a - b)
    return own.join(total, "label").select("label", "session_id", "n", F.round(cosine(F.col("own"), rest), 5).alias("agreement"))


def absorb_by_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of labels with fewer than fifty go to the nearest label with as many."""
    f = load(spark, sf_dir, "fingerprints")
    people = voices.centroids(f, ["label"])
    large = people.filter("n >= 50").select(F.col("label").alias("to_label"), F.col("centroid").alias("p_centroid"))
    small = f.join(people.filter("n < 50").select("label"), "label", "left_semi").select("vec_id", "label", F.col("embedding").alias("v_centroid"))
    best = voices.ranked(small, large, "vec_id", "to_label").filter("place = 1").select("vec_id", "to_label")
    return small.select("vec_id", "label").join(best, "vec_id")


def similarity_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms and neighbours' cosines and dot products, rounded."""
    f = load(spark, sf_dir, "fingerprints").select("vec_id", "embedding")
    g = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return f.join(g, "vec_id").select("vec_id", F.round(norm(F.col("embedding")), 4).alias("norm"), F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"), F.round(dot(F.col("embedding"), F.col("other")), 5).alias("dot"))


def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each session's fingerprints; fingerprints of different tiles stay apart."""
    ship(spark)
    f = load(spark, sf_dir, "fingerprints").select("session_id", "vec_id", "tile", "embedding")
    return clustering.per_session(f, "session_id", "vec_id", "embedding", lambda x, pdf: clustering.complete_linkage(x, 0.9, 0, pdf["tile"].tolist()))


def merge_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    f = load(spark, sf_dir, "fingerprints").select("session_id", "vec_id", "embedding")
    return clustering.per_session(f, "session_id", "vec_id", "embedding", lambda x, pdf: clustering.merge_by_centroid(x, clustering.complete_linkage(x, 0.7), 0.3))


def stable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasting ids of a second clustering by what it shares with the first."""
    ship(spark)
    f = load(spark, sf_dir, "fingerprints").select("session_id", "vec_id", "embedding")

    def label(x, pdf):
        first = clustering.complete_linkage(x, 0.8)
        second = clustering.complete_linkage(x, 0.95)
        ids = pdf["vec_id"].tolist()
        names, _ = clustering.stable_labels(ids, second, dict(zip(ids, first)), max(first) + 1)
        return [names[c] for c in second]

    return clustering.per_session(f, "session_id", "vec_id", "embedding", label)


def online_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers assigned one fingerprint after another."""
    ship(spark)
    f = load(spark, sf_dir, "fingerprints").select("session_id", "vec_id", "embedding")

    def label(x, pdf):
        t = clustering.Tracker()
        return [t.assign(v, 1000 + 500 * (i % 4), int(i) * 200)[0] for v, i in zip(x, pdf["vec_id"])]

    return clustering.per_session(f, "session_id", "vec_id", "embedding", label)


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "fingerprints")
    return f.groupBy(F.concat(F.lit("L"), F.col("label").cast("string")).alias("name"), "session_id").agg(F.count(F.lit(1)).alias("n"))


def profile_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contributions(spark, sf_dir)
    old = c.filter("session_id < 6").select("name", "session_id", F.lit(99).cast("long").alias("n"))
    forgotten = spark.createDataFrame([("L3",)], "name string")
    return voices.learn(old, c.filter("session_id >= 4"), forgotten, 4)


def profile_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voices.forget(_contributions(spark, sf_dir), spark.createDataFrame([("L1",), ("L7",)], "name string"))


def profile_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = spark.createDataFrame([("L1", 3, "L2"), ("L5", 0, "New")], "name string, session_id bigint, to_name string")
    return voices.move(_contributions(spark, sf_dir), moved)


def profile_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voices.rename(_contributions(spark, sf_dir), spark.createDataFrame([("L2", "Ann"), ("L4", "Bo")], "name string, new_name string"))


def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the clustering scored end to end: each session is clustered at each pair of threshold and stride, scored by how many
    fingerprints are in a cluster with the label that most of it has, less what clusters cost; and the worst of a setting's neighbours."""
    ship(spark)
    grid = spark.createDataFrame([(t, k) for t in range(60, 121, 10) for k in (1, 2)], "threshold long, stride long")
    f = load(spark, sf_dir, "fingerprints").select("session_id", "vec_id", "label", "embedding")
    ranked = F.row_number().over(Window.partitionBy("session_id").orderBy("vec_id")) - 1
    x = f.withColumn("_r", ranked).join(F.broadcast(grid), F.col("_r") % F.col("stride") == 0).drop("_r")

    def label(v, pdf):
        return clustering.complete_linkage(v, pdf["threshold"].iloc[0] / 100)

    c = clustering.per_session(x.withColumn("run", F.concat_ws("/", "session_id", "threshold", "stride")), "run", "vec_id", "embedding", label)
    pure = c.groupBy("threshold", "stride", "session_id", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    pure = pure.groupBy("threshold", "stride", "session_id", "cluster").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    score = pure.groupBy("threshold", "stride").agg(F.sum("best").alias("right"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"))
    score = score.withColumn("score", F.round((F.col("right") - F.col("clusters")) / F.col("rows"), 6))
    n = score.select(F.col("threshold").alias("t2"), F.col("stride").alias("k2"), F.col("score").alias("s2"))
    near = (F.abs(F.col("threshold") - F.col("t2")) / 10 + F.abs(F.col("stride") - F.col("k2"))) == 1
    return score.join(F.broadcast(n), near, "left").groupBy("threshold", "stride", "right", "rows", "clusters", "score").agg(F.min("s2").alias("worst"))


QUERIES = [cluster_sweep, centroids, knn_top1, knn_top2_margin, look_alike_pairs, leave_one_out, absorb_by_voice, similarity_sentinels, complete_linkage, merge_centroids, stable_labels, online_tracker, profile_learn, profile_forget, profile_move, profile_rename]

_SUM = "(SELECT label, i, SUM(x) AS s FROM {vector_parts} v WHERE @ GROUP BY label, i)"
_UNIT = "(SELECT a.label, a.i, a.s / b.n AS x FROM " + _SUM + " a JOIN (SELECT label, sqrt(SUM(s * s)) AS n FROM " + _SUM + " s GROUP BY label) b ON a.label = b.label)"
_EVEN, _ALL = _UNIT.replace("@", "vec_id % 2 = 0"), _UNIT.replace("@", "true")
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM (SELECT v.vec_id, p.label, SUM(v.x * p.x) AS sim FROM {{vector_parts}} v JOIN {_EVEN} p ON v.i = p.i WHERE v.vec_id % 2 = 1 GROUP BY v.vec_id, p.label) r)"
_CONTRIB = "(SELECT 'L' || CAST(label AS VARCHAR) AS name, session_id, CAST(count(*) AS BIGINT) AS n FROM {fingerprints} f GROUP BY 1, 2)"
_SQL = {
    "centroids": f"SELECT c.label, n, i, round(x, 5) AS x FROM {_ALL} c JOIN (SELECT label, CAST(count(*) AS BIGINT) AS n FROM {{embeddings}} GROUP BY 1) k ON c.label = k.label",
    "knn_top1": f"SELECT vec_id, label, round(sim, 5) AS similarity FROM {_RANKED} r WHERE rn = 1",
    "knn_top2_margin": f"SELECT a.vec_id, a.label, round(a.sim, 5) AS similarity, round(b.sim, 5) AS second FROM {_RANKED} a JOIN {_RANKED} b ON a.vec_id = b.vec_id AND a.rn = 1 AND b.rn = 2 WHERE a.sim >= 0.2 AND a.sim - b.sim >= 0.05",
    "look_alike_pairs": f"WITH c AS (SELECT * FROM {_ALL} c) SELECT a.label AS a, b.label AS b, round(SUM(a.x * b.x), 5) AS similarity FROM c a JOIN c b ON a.i = b.i AND a.label < b.label WHERE NOT (a.label = 0 AND b.label = 1) AND NOT (a.label = 3 AND b.label = 4) GROUP BY a.label, b.label HAVING SUM(a.x * b.x) >= -0.05",
    "leave_one_out": """WITH o AS (SELECT label, vec_id % 10 AS session_id, i, SUM(x) AS s, CAST(count(*) AS BIGINT) AS n FROM {vector_parts} v GROUP BY 1, 2, 3), t AS (SELECT label, i, SUM(s) AS s FROM o GROUP BY 1, 2)
        SELECT label, session_id, n, round(CASE WHEN q > 0 THEN d / q ELSE 0 END, 5) AS agreement FROM (SELECT o.label, session_id, max(o.n) AS n, SUM(o.s * (t.s - o.s)) AS d, sqrt(SUM(o.s * o.s)) * sqrt(SUM((t.s - o.s) * (t.s - o.s))) AS q FROM o JOIN t ON o.label = t.label AND o.i = t.i GROUP BY o.label, session_id) x""",
    "absorb_by_voice": f"""WITH n AS (SELECT label, count(*) AS n FROM {{embeddings}} GROUP BY 1), c AS (SELECT * FROM {_ALL} c WHERE label IN (SELECT label FROM n WHERE n >= 50))
        SELECT vec_id, label, to_label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, to_label) AS rn FROM (SELECT v.vec_id, v.label, c.label AS to_label, SUM(v.x * c.x) AS sim FROM {{vector_parts}} v JOIN c ON v.i = c.i WHERE v.label IN (SELECT label FROM n WHERE n < 50) GROUP BY 1, 2, 3) a) b WHERE rn = 1""",
    "similarity_sentinels": "SELECT a.vec_id, round(sqrt(SUM(a.x * a.x)), 4) AS norm, round(SUM(a.x * b.x) / (sqrt(SUM(a.x * a.x)) * sqrt(SUM(b.x * b.x))), 5) AS cosine, round(SUM(a.x * b.x), 5) AS dot FROM {vector_parts} a JOIN {vector_parts} b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id",
    "profile_learn": f"WITH c AS (SELECT * FROM {_CONTRIB} c), f AS (SELECT * FROM c WHERE session_id >= 4 AND n >= 4 AND name <> 'L3') SELECT name, session_id, CAST(99 AS BIGINT) AS n FROM c WHERE session_id < 6 AND NOT EXISTS (SELECT 1 FROM f WHERE f.name = c.name AND f.session_id = c.session_id) UNION ALL SELECT name, session_id, n FROM f",
    "profile_forget": f"SELECT name, session_id, n FROM {_CONTRIB} c WHERE name NOT IN ('L1', 'L7')",
    "profile_move": f"SELECT CASE WHEN name = 'L1' AND session_id = 3 THEN 'L2' WHEN name = 'L5' AND session_id = 0 THEN 'New' ELSE name END AS name, session_id, CAST(SUM(n) AS BIGINT) AS n FROM {_CONTRIB} c GROUP BY 1, 2",
    "profile_rename": f"SELECT CASE name WHEN 'L2' THEN 'Ann' WHEN 'L4' THEN 'Bo' ELSE name END AS name, session_id, n, CASE WHEN name IN ('L2', 'L4') THEN name END AS alias FROM {_CONTRIB} c",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
