"""Queries on voice profiles as a store: finding, forgetting, rejecting, deciding between voice and window, and what to ask about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import labels
from parlance.functions.vectors import dot
from parlance.operators import clustering, voices
from parlance.plans.live import _same
from parlance.plans.vectors import _ALL, _CONTRIB, _EVEN, _RANKED, _contributions, _people, _ranking
from parlance.plans.views import duckdb, load
from parlance.runtime import read_table, ship

DAY = 86_400_000


def last_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "event_ms").select(F.concat("event_type", (F.col("user_id") % 9).cast("string")).alias("name"), F.col("t").alias("at"))
    return voices.last_heard(e)


def forget_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What profiles have left, and which meetings are excluded, after meetings were forgotten for some and one started over."""
    c = _contributions(spark, sf_dir)
    none = c.select("name", "session_id").limit(0)
    kept, excluded = voices.forget_meetings(c, none, c.filter("session_id = 3 AND name IN ('L1', 'L2')"))
    kept, excluded = voices.start_over(kept, excluded, spark.createDataFrame([("L4",)], "name string"))
    x = kept.select("name", "session_id", "n", F.lit(False).alias("excluded"))
    return x.unionByName(excluded.select("name", "session_id", F.lit(None).cast("long").alias("n"), F.lit(True).alias("excluded")))


def remove_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs known to be apart, and profiles, that are left when some are removed."""
    c = _contributions(spark, sf_dir).select("name").distinct()
    apart = c.select(F.col("name").alias("a"), F.concat(F.lit("L"), (F.expr("substring(name, 2)").cast("int") + 3).cast("string")).alias("b"))
    profiles, left = voices.remove(c, apart, spark.createDataFrame([("L2",), ("L6",)], "name string"))
    return profiles.select("name", F.lit("").alias("other")).unionByName(left.select(F.col("a").alias("name"), F.col("b").alias("other")))


def find_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by name: exact names and aliases first, then names that are alike; the profile of the lowest number wins."""
    p = read_table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("number"))
    profiles = p.select(F.col("p_name").alias("profile"), "number", F.explode(F.array(F.col("p_name"), F.expr("substring(p_name, 3)"))).alias("alias"))
    wanted = read_table(spark, sf_dir, "part").select(F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(left(p_name, length(p_name) - 2)) WHEN 2 THEN substring(p_name, 3) ELSE concat(left(p_name, 2), 'q', substring(p_name, 4)) END").alias("name")).distinct()
    return voices.find(wanted, profiles)


_FIND = f"""WITH p AS (SELECT p_name AS profile, min(p_partkey) AS number FROM {{part}} WHERE p_partkey % 3 = 0 GROUP BY 1),
    a AS (SELECT profile, number, profile AS alias FROM p UNION SELECT profile, number, substring(profile, 3) FROM p),
    w AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(left(p_name, length(p_name) - 2)) WHEN 2 THEN substring(p_name, 3) ELSE left(p_name, 2) || 'q' || substring(p_name, 4) END AS name FROM {{part}}),
    e AS (SELECT w.name, min(struct_pack(n := number, p := profile)) AS e FROM w JOIN a ON w.name = a.alias GROUP BY 1),
    f AS (SELECT w.name, min(struct_pack(n := number, p := profile)) AS f FROM w JOIN a ON {_same('trim(w.name)', 'trim(a.alias)')} WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name = w.name) GROUP BY 1)
    SELECT w.name, coalesce(e.e.p, f.f.p) AS profile, CASE WHEN e.e IS NOT NULL THEN 'exact' WHEN f.f IS NOT NULL THEN 'alike' END AS how FROM w LEFT JOIN e ON e.name = w.name LEFT JOIN f ON f.name = w.name"""


def unrejected_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best profiles of odd fingerprints, but for those at least as like a fingerprint that was rejected for the profile."""
    f = load(spark, sf_dir, "fingerprints")
    best = _ranking(spark, sf_dir).filter("place = 1").select(F.col("vec_id").alias("voice"), F.col("label").alias("profile"), F.round("similarity", 6).alias("similarity"))
    m = best.join(f.select(F.col("vec_id").alias("voice"), F.col("embedding").alias("v_centroid")), "voice")
    rejected = f.filter("vec_id % 25 = 8").select(F.col("label").alias("profile"), F.col("embedding").alias("r_centroid"))
    return voices.unrejected(m, rejected).select("voice", "profile")


def voice_or_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What voices make of the names that the window gives the labels of a session: window, voice, doubt or open."""
    f = load(spark, sf_dir, "fingerprints")
    mine = voices.centroids(f.filter("vec_id % 2 = 1"), ["session_id", "label"])
    speakers = mine.select("session_id", F.col("label").alias("speaker"), F.expr("CASE label % 4 WHEN 0 THEN concat('Speaker L', label) WHEN 1 THEN concat('Speaker L', (label + session_id) % 7) WHEN 2 THEN '' ELSE concat('Guest ', label) END").alias("window"))
    people = _people(spark, sf_dir).select("label", F.col("centroid").alias("p_centroid"))
    key = F.struct("session_id", "label")
    ranking = voices.ranked(mine.select(key.alias("v"), F.col("centroid").alias("v_centroid")), people, "v", "label")
    best = voices.top_two(ranking, "v", "label").select("v.session_id", F.col("v.label").alias("speaker"), F.concat(F.lit("Speaker L"), F.col("label").cast("string")).alias("name"), F.round("similarity", 6).alias("similarity"), F.round("second", 6).alias("second"))
    sure = best.filter("similarity >= 0.15 AND similarity - second >= 0.05")
    known = people.filter("label < 6").select(F.concat(F.lit("Speaker L"), F.col("label").cast("string")).alias("name"))
    return voices.called(speakers.withColumn("by_window", F.col("window") != ""), sure, best, known, 0.2)


_VOICE = f"""
    WITH q AS (SELECT vec_id % 10 AS session_id, label, i, SUM(x) AS s FROM {{vector_parts}} v WHERE vec_id % 2 = 1 GROUP BY 1, 2, 3),
    u AS (SELECT q.*, s / sqrt(SUM(s * s) OVER (PARTITION BY session_id, label)) AS x FROM q),
    r AS (SELECT u.session_id, u.label AS speaker, 'Speaker L' || p.label AS name, p.label, round(SUM(u.x * p.x), 6) AS sim, SUM(u.x * p.x) AS exact FROM u JOIN {_EVEN} p ON u.i = p.i GROUP BY 1, 2, 3, 4),
    b AS (SELECT session_id, speaker, name, sim, lead(sim) OVER w AS second, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY session_id, speaker ORDER BY exact DESC, label)),
    l AS (SELECT * FROM b WHERE place = 1), m AS (SELECT * FROM l WHERE sim >= 0.15 AND sim - second >= 0.05),
    s AS (SELECT DISTINCT session_id, label AS speaker, CASE label % 4 WHEN 0 THEN 'Speaker L' || label WHEN 1 THEN 'Speaker L' || ((label + session_id) % 7) WHEN 2 THEN '' ELSE 'Guest ' || label END AS "window" FROM q),
    k AS (SELECT DISTINCT 'Speaker L' || label AS name FROM {_EVEN} p WHERE label < 6),
    x AS (SELECT s.*, s."window" <> '' AS by_window, m.name AS mn, l.name AS ln, s."window" IN (SELECT name FROM k) AS knows,
        m.name IS NOT NULL AND NOT {_same('s."window"', 'm.name')} AS other, l.sim >= 0.2 AND NOT {_same('s."window"', 'l.name')} AS unlike
      FROM s LEFT JOIN m ON m.session_id = s.session_id AND m.speaker = s.speaker LEFT JOIN l ON l.session_id = s.session_id AND l.speaker = s.speaker),
    v AS (SELECT *, CASE WHEN by_window AND other AND knows THEN 'voice' WHEN by_window AND (other OR unlike AND knows) THEN 'doubt' WHEN by_window THEN 'window' END AS verdict FROM x),
    t AS (SELECT session_id, CASE verdict WHEN 'voice' THEN mn ELSE "window" END AS name FROM v WHERE by_window)
    SELECT session_id, speaker, "window", coalesce(verdict, CASE WHEN free THEN 'voice' ELSE 'open' END) AS verdict,
      CASE verdict WHEN 'voice' THEN mn WHEN 'window' THEN "window" WHEN 'doubt' THEN CASE WHEN other THEN mn ELSE ln END ELSE CASE WHEN free THEN mn END END AS name
    FROM (SELECT v.*, mn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = v.session_id AND {_same('t.name', 'v.mn')}) AS free FROM v) z"""


def voices_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the sessions of the last fourteen days that nobody named and that speak for half a minute, and those that a voice
    named and that speak for three seconds: the time, and a clip of eight seconds of the longest line."""
    s = load(spark, sf_dir, "segments").withColumn("label", F.expr("CASE speaker WHEN 'S0' THEN 'Person 1' WHEN 'S1' THEN 'Person 2 (Ann)' ELSE 'Person 3 (Room 4)' END"))
    made = s.groupBy("session_id").agg((F.col("session_id") % 40 * DAY).alias("created"))
    newest = made.agg(F.max("created").alias("_now"))
    recent = made.join(F.broadcast(newest)).filter(F.col("created") >= F.col("_now") - 14 * DAY).select("session_id", "created")
    kind = F.when(F.col("label") == "Person 2 (Ann)", "named").when(labels.is_unnamed(F.col("label")), "unknown")
    x = s.join(recent, "session_id").withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("d", F.col("end_ms") - F.col("start_ms"))
    x = x.groupBy("session_id", "created", "label", "kind").agg(F.sum("d").alias("ms"), F.max(F.struct("d", (-F.col("pos")).alias("p"), "start_ms", "end_ms")).alias("_l"))
    x = x.filter("ms >= CASE kind WHEN 'named' THEN 3000 ELSE 30000 END")
    return x.select("session_id", "created", "label", "kind", "ms", F.col("_l.start_ms").alias("clip_start"), F.least("_l.end_ms", F.col("_l.start_ms") + 8000).alias("clip_end"))


def merged_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each session merged, in order, into the first one before that they are alike, and the numbers they get."""
    ship(spark)
    c = voices.centroids(load(spark, sf_dir, "fingerprints"), ["session_id", "label"]).select("session_id", F.col("label").cast("long").alias("label"), "centroid")

    def label(x, pdf):
        ids = pdf["label"].tolist()
        return [ids[k] for k in clustering.merge_in_order(x, 0.12)]

    return clustering.per_session(c, "session_id", "label", "centroid", label, "into")


_MERGED = """
    WITH RECURSIVE q AS (SELECT vec_id % 10 AS session_id, label, i, SUM(x) AS s FROM {vector_parts} v GROUP BY 1, 2, 3),
    u AS (SELECT q.*, s / sqrt(SUM(s * s) OVER (PARTITION BY session_id, label)) AS x FROM q),
    a AS (SELECT a.session_id, a.label, b.label AS other FROM u a JOIN u b ON a.session_id = b.session_id AND a.i = b.i AND b.label < a.label GROUP BY 1, 2, 3 HAVING round(SUM(a.x * b.x), 6) >= 0.12),
    n AS (SELECT session_id, label, row_number() OVER (PARTITION BY session_id ORDER BY label) AS place, coalesce((SELECT list(other ORDER BY other) FROM a WHERE a.session_id = d.session_id AND a.label = d.label), []) AS alike FROM (SELECT DISTINCT session_id, label FROM q) d),
    w AS (SELECT session_id, 0 AS place, CAST(NULL AS INT) AS label, CAST(NULL AS INT) AS into_, CAST([] AS INT[]) AS leaders FROM (SELECT DISTINCT session_id FROM n) z
      UNION ALL SELECT n.session_id, n.place, n.label, coalesce(list_filter(n.alike, lambda o: list_contains(w.leaders, o))[1], n.label),
        CASE WHEN len(list_filter(n.alike, lambda o: list_contains(w.leaders, o))) = 0 THEN list_append(w.leaders, n.label) ELSE w.leaders END
      FROM w JOIN n ON n.session_id = w.session_id AND n.place = w.place + 1)
    SELECT session_id, CAST(label AS BIGINT) AS label, CAST(into_ AS BIGINT) AS into FROM w WHERE place > 0"""


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as it is read: each profile's fingerprints, meetings, and the likeness of its parts to the whole, recomputed from sums."""
    f = load(spark, sf_dir, "fingerprints")
    whole = voices.centroids(f, ["label"]).select("label", F.col("centroid").alias("_c"), "n")
    parts = voices.centroids(f, ["label", "session_id"]).select("label", "session_id", F.col("centroid").alias("_p"))
    return parts.join(whole, "label").groupBy("label").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("meetings"), F.round(F.min(dot(F.col("_p"), F.col("_c"))), 4).alias("least"))


QUERIES = [last_heard, forget_meeting, remove_profiles, find_profile, unrejected_matches, voice_or_window, voices_to_ask, merged_speakers, profile_table]

_SQL = {
    "last_heard": "SELECT event_type || CAST(user_id % 9 AS VARCHAR) AS name, max(t) AS at FROM {event_ms} e GROUP BY 1",
    "forget_meeting": f"""WITH c AS (SELECT * FROM {_CONTRIB} c), f AS (SELECT name, session_id FROM c WHERE session_id = 3 AND name IN ('L1', 'L2') OR name = 'L4')
        SELECT name, session_id, n, false AS excluded FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.name = c.name AND f.session_id = c.session_id) UNION ALL SELECT name, session_id, NULL, true FROM f""",
    "remove_profiles": "WITH p AS (SELECT DISTINCT label FROM {embeddings} e) SELECT 'L' || label AS name, '' AS other FROM p WHERE label NOT IN (2, 6) UNION ALL SELECT 'L' || label, 'L' || (label + 3) FROM p WHERE label NOT IN (2, 6) AND label + 3 NOT IN (2, 6)",
    "find_profile": _FIND,
    "unrejected_matches": f"""WITH b AS (SELECT vec_id, label, round(sim, 6) AS sim FROM {_RANKED} r WHERE rn = 1),
        j AS (SELECT b.vec_id FROM b JOIN {{vector_parts}} v ON v.vec_id = b.vec_id JOIN {{vector_parts}} r ON r.vec_id % 25 = 8 AND r.label = b.label AND r.i = v.i GROUP BY b.vec_id, b.sim, r.vec_id HAVING SUM(v.x * r.x) >= b.sim)
        SELECT vec_id AS voice, label AS profile FROM b WHERE vec_id NOT IN (SELECT vec_id FROM j)""",
    "voice_or_window": _VOICE,
    "voices_to_ask": """WITH s AS (SELECT *, CASE speaker WHEN 'S0' THEN 'Person 1' WHEN 'S1' THEN 'Person 2 (Ann)' ELSE 'Person 3 (Room 4)' END AS label, session_id % 40 * 86400000 AS created, end_ms - start_ms AS d FROM {segments} s),
        g AS (SELECT session_id, created, label, CASE speaker WHEN 'S1' THEN 'named' ELSE 'unknown' END AS kind, CAST(SUM(d) AS BIGINT) AS ms, first(start_ms ORDER BY d DESC, pos) AS a, first(end_ms ORDER BY d DESC, pos) AS b
          FROM s WHERE created >= (SELECT max(created) FROM s) - 14 * 86400000 GROUP BY 1, 2, 3, 4)
        SELECT session_id, created, label, kind, ms, a AS clip_start, least(b, a + 8000) AS clip_end FROM g WHERE ms >= CASE kind WHEN 'named' THEN 3000 ELSE 30000 END""",
    "merged_speakers": _MERGED,
    "profile_table": f"""WITH q AS (SELECT label, vec_id % 10 AS session_id, i, SUM(x) AS s FROM {{vector_parts}} v GROUP BY 1, 2, 3), u AS (SELECT q.*, s / sqrt(SUM(s * s) OVER (PARTITION BY label, session_id)) AS x FROM q),
        d AS (SELECT u.label, u.session_id, SUM(u.x * c.x) AS sim FROM u JOIN {_ALL} c ON c.label = u.label AND c.i = u.i GROUP BY 1, 2)
        SELECT d.label, (SELECT count(*) FROM {{embeddings}} e WHERE e.label = d.label) AS n, CAST(count(*) AS BIGINT) AS meetings, round(min(sim), 4) AS least FROM d GROUP BY 1""",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
