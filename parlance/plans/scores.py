"""Queries on scores, names and changes: grids with collars, captured turns, lookups by time, titles, renames, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import labels, text
from parlance.operators import frames, joins, names, scoring, voices
from parlance.operators.matching import match_groups
from parlance.plans import timeline, vectors
from parlance.plans.views import duckdb, load
from parlance.runtime import read_table, ship


def speaker_score_collar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames scored and right, without those 250 ms around speaker changes."""
    ship(spark)
    ref = load(spark, sf_dir, "segments").select("session_id", "pos", F.col("speaker").alias("ref"), "start_ms", "end_ms")
    hyp = load(spark, sf_dir, "turns").select("session_id", F.col("cluster").alias("hyp"), "start_ms", "end_ms")
    return scoring.speaker_score(ref, hyp, "pos")


def turns_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found again, by words, among the lines of the copy that is 37 s late, and the label they have there."""
    s = load(spark, sf_dir, "segments")
    turns = s.select("session_id", F.col("pos").alias("turn_pos"), "speaker", F.lower("text").alias("text"), "start_ms", "end_ms")
    lines = s.select("session_id", "pos", F.col("role").alias("label"), F.lower("text").alias("line_text"), (F.col("start_ms") + 37_000).alias("r_start_ms"), (F.col("end_ms") + 37_000).alias("r_end_ms"))
    return scoring.turns_captured(turns, lines, 5000)


def annotated_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share a start on a grid of 30 s: the longest runs on, the others cut in."""
    s = load(spark, sf_dir, "segments").withColumn("at", F.floor(F.col("start_ms") / 30_000) * 30_000)
    w = Window.partitionBy("session_id", "at")
    x = s.withColumn("group_size", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("n_words").desc(), "pos")).cast("long"))
    return x.filter("group_size > 1").select("session_id", "pos", "at", "group_size", F.when(F.col("place") == 1, "main").otherwise("interjection").alias("part"), "n_words")


def speaker_at_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each turn's start plus ten seconds, the speaker of the latest line that has begun and goes on (or begun a minute before)."""
    points = load(spark, sf_dir, "turns").select("session_id", "turn_pos", (F.col("start_ms") + 10_000).alias("at"))
    lines = load(spark, sf_dir, "segments").select("session_id", "speaker", F.col("start_ms").alias("s"), (F.col("end_ms") + 1).alias("e"))
    hit = joins.point_join(points, lines, ["session_id"], "at", ("s", "e"))
    best = hit.groupBy("session_id", "turn_pos").agg(F.max_by("speaker", "s").alias("speaker"))
    return points.join(best, ["session_id", "turn_pos"], "left")


def hint_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of a user, in order of id, in the eight hours after each view."""
    e = load(spark, sf_dir, "event_ms")
    views = e.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("session_id"), "t", (F.col("t") + 28_800_001).alias("until"))
    reads = e.filter("event_type <> 'view'").select(F.col("user_id").alias("session_id"), F.col("t").alias("at"), "event_id", "event_type")
    hit = joins.point_join(reads, views, ["session_id"], "at", ("t", "until"), 28_800_000)
    return hit.groupBy("view_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("name"), F.count(F.lit(1)).alias("n"))


def meeting_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the most frequent event type, the first seen on ties."""
    e = load(spark, sf_dir, "event_ms").withColumn("day", F.floor(F.col("t") / 86_400_000))
    return names.most_frequent(e, ["user_id", "day"], "event_type", "t")


def pick_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hundred pages as windows front to back: the first accepted, not compact if there is one, and how many were passed by."""
    owner, title = "CASE WHEN page_id % 5 = 0 THEN 'Browser' ELSE 'Teams' END", "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Chat | x' WHEN 2 THEN 'Window' ELSE 'Planning' END"
    w = read_table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 20).alias("screen"), F.expr(owner).alias("owner"), F.expr(title).alias("title"), (F.col("page_id") % 8 == 3).alias("compact"))
    w = w.withColumn("verdict", labels.window_verdict(F.col("owner"), F.col("title"), F.col("page_id")))
    fine = F.when(F.col("verdict") == "accepted", F.struct("compact", "page_id"))
    counts = [F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("untitled", "chat", "generic", "other")]
    return w.groupBy("screen").agg(F.min(fine).alias("_p"), *counts).select("screen", F.col("_p.page_id").alias("picked"), "untitled", "chat", "generic", "other")


def provisional_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by precedence: attributed cluster, else name read at the start, else a doubtful speaker, else new."""
    a = timeline.attribute_lines(spark, sf_dir)
    s = load(spark, sf_dir, "segments").select("session_id", "pos", "speaker", "n_words")
    x = s.join(a, ["session_id", "pos"])
    label = F.coalesce(F.when(F.col("cluster") >= 0, labels.person_label((F.col("cluster") + 1).cast("int"), F.lit(""))), F.when(F.col("n_words") > 25, F.col("speaker")), F.when(F.col("n_words") > 18, F.concat("speaker", F.lit("?"))), F.lit("New speaker"))
    return x.select("session_id", "pos", label.alias("label"), labels.is_provisional(label).alias("provisional"))


def first_and_final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each line by the turns known every 20 s until its session ends: the first shown, the last, and the changes.

    The nearest known turn is the last that starts up to the line's start or, once it is known, the first that starts after it, so
    a label can change only then, or where the later turn begins to win ties (at 100 s); no line meets all turns of its session.
    """
    grid = lambda c: F.greatest(F.ceil(F.col(c) / 20_000), F.lit(1)) * 20_000
    s = load(spark, sf_dir, "segments").select("session_id", "pos", "start_ms", grid("start_ms").alias("own"), grid("end_ms").alias("to"))
    t = load(spark, sf_dir, "turns").select("session_id", "turn_pos", "cluster", F.col("start_ms").alias("t_start"), grid("start_ms").alias("known"), F.greatest(grid("start_ms"), grid("end_ms")).alias("to"))
    start = t.groupBy("session_id", F.col("t_start").alias("at"), "known").agg(F.min(F.struct("turn_pos", "cluster")).alias("a"), F.max(F.struct("turn_pos", "cluster")).alias("b")).withColumn("turn", F.struct("at", "known", "a", "b"))
    both = s.drop("to").withColumn("at", F.col("start_ms")).unionByName(start.select("session_id", "at", "turn"), allowMissingColumns=True)
    running = lambda *by: F.last("turn", ignorenulls=True).over(Window.partitionBy("session_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = both.withColumn("before", running("at", F.col("pos").asc_nulls_first())).withColumn("after", running(F.col("at").desc(), F.col("pos").asc_nulls_last())).filter("pos IS NOT NULL")
    beside = near.select("session_id", "pos", "start_ms", "own", F.explode(F.array("before", "after")).alias("t")).filter("t IS NOT NULL")
    d = F.abs(F.col("t.at") - F.col("start_ms"))
    pairs = beside.select("session_id", "pos", F.greatest("own", "t.known").alias("cut"), F.struct(d.alias("d"), F.col("t.a.turn_pos").alias("o"), F.col("t.a.cluster").alias("cluster")).alias("early"), F.struct(d.alias("d"), (-F.col("t.b.turn_pos")).alias("o"), F.col("t.b.cluster").alias("cluster")).alias("late"))
    last = s.select("session_id", "to").unionByName(t.select("session_id", "to")).groupBy("session_id").agg(F.max("to").alias("to"))
    marks = s.drop("to").join(last, "session_id").select("session_id", "pos", "own", "to", F.explode(F.array(F.lit(100_000).cast("long"), F.col("to"))).alias("cut")).filter("cut BETWEEN own AND to").select("session_id", "pos", "cut")
    at = pairs.unionByName(marks, allowMissingColumns=True).groupBy("session_id", "pos", "cut").agg(F.min("early").alias("early"), F.min("late").alias("late"))
    w = Window.partitionBy("session_id", "pos").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = at.select("session_id", "pos", "cut", F.when(F.col("cut") >= 100_000, F.min("late").over(w)["cluster"]).otherwise(F.min("early").over(w)["cluster"]).cast("long").alias("label"))
    return scoring.first_and_final(shown.filter("label IS NOT NULL"), ["session_id", "pos"], "cut", "label")


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the values of a user, less fifty, turn from low to high."""
    e = load(spark, sf_dir, "event_ms").withColumn("v", F.round(F.col("value") * 100).cast("long") - 5000)
    return scoring.change_point(e, ["user_id"], "event_id", "v")


def profiles_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "fingerprints")
    p = f.groupBy(F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 7).cast("string")).alias("name"), "session_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("vec_id") % 31 == 0).alias("confirmed"), F.max(F.col("vec_id") % 17 == 0).alias("by_user"))
    return names.in_use(p).select("name", "n", "meetings")


def match_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices (odd fingerprints of a session and label) matched to profiles (even ones) one to one, most alike first."""
    ship(spark)
    f = load(spark, sf_dir, "fingerprints")
    v = voices.centroids(f.filter("vec_id % 2 = 1"), ["session_id", "label"]).select("session_id", F.col("label").alias("voice"), F.col("centroid").alias("v_centroid"))
    p = vectors._people(spark, sf_dir).select("label", F.col("centroid").alias("p_centroid"))
    pairs = v.withColumn("key", F.struct("session_id", "voice")).crossJoin(p).withColumn("similarity", F.round(voices.dot(F.col("v_centroid"), F.col("p_centroid")), 6))
    return match_groups(pairs.filter("similarity >= 0.1").select("session_id", "voice", "label", "similarity"), ["session_id"], "voice", "label", "similarity", best=False)


def script_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other text where it is in its language's script."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.element_at(F.array(F.lit("नमस्ते"), F.lit("hello"), F.lit(" "), F.lit("こんにちは")), (F.col("doc_id") % 4 + 1).cast("int")).alias("other"), F.element_at(F.array(F.lit("hi"), F.lit("ja"), F.lit("en")), (F.col("doc_id") % 3 + 1).cast("int")).alias("code"))
    chosen = names.validated(F.col("lang"), F.col("other"), F.col("code"))
    return d.select("doc_id", chosen.alias("chosen"))


def clean_read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as read with overlay scraps after them, cleaned, and whether they can be names."""
    ship(spark)
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.element_at(F.array(F.lit(" Priv"), F.lit(" fo"), F.lit(" •.•"), F.lit(""), F.lit(" Muted")), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("raw"))
    clean = names.cleaned_udf("raw")
    return p.select("p_partkey", clean.alias("name")).withColumn("fine", names.plausible(F.col("name")))


def rename_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "segments").select("session_id", "pos", "speaker", F.lit("").alias("live_speaker"))
    table = spark.createDataFrame([("S0", "Ann"), ("S2", "Bo")], "label string, new_label string")
    return names.renamed(s, table)


def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.versions(load(spark, sf_dir, "segments"), "session_id", ["pos", "speaker", "text"])


def swap_if_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of those sessions whose lines are as they were read."""
    s = load(spark, sf_dir, "segments")
    read = names.versions(s, "session_id", ["pos", "speaker"])
    now = names.versions(s.withColumn("speaker", F.when((F.col("session_id") % 3 == 0) & (F.col("pos") == 0), F.lit("Ann")).otherwise(F.col("speaker"))), "session_id", ["pos", "speaker"])
    updates = s.select("session_id").distinct().withColumn("title", F.lit("new"))
    return names.unchanged_updates(updates, read, now, "session_id")


def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose label differs from the one shown before, and only those."""
    old = load(spark, sf_dir, "segments").select("session_id", "pos", "speaker")
    new = timeline.absorb_small(spark, sf_dir).select("session_id", "pos", F.col("new_speaker").alias("speaker"))
    return new.join(old, ["session_id", "pos", "speaker"], "left_anti")


def replay_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last revision of each line, in order of first appearance, removed ones left out."""
    e = load(spark, sf_dir, "segment_events").join(load(spark, sf_dir, "event_ms").select("user_id", F.col("event_id"), "t").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 20).alias("seg_id"), "t").groupBy("session_id", "seg_id").agg(F.min("t").alias("born")), ["session_id", "seg_id"])
    last = e.groupBy("session_id", "seg_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("speaker", "seq").alias("speaker"), F.min("born").alias("born")).filter("status <> 'removed'")
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("born", "seg_id")).cast("long"))


def quiet_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a user has been quiet at the end: time since the last value over ten."""
    e = load(spark, sf_dir, "event_ms")
    return e.groupBy("user_id").agg((F.max("t") - F.max(F.when(F.col("value") > 10, F.col("t")))).alias("quiet_ms"))


def tiles_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events of each user, first and last among them, evenly between."""
    e = load(spark, sf_dir, "event_ms").select("user_id", "event_id", "t")
    return names.evenly_picked(e, ["user_id"], ["t", "event_id"], 5)


def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line beside the external spans that overlap it: ? without any, ! if one begins within it under another name."""
    s = load(spark, sf_dir, "segments").select("session_id", "pos", "role", "start_ms", "end_ms")
    spans = load(spark, sf_dir, "ext_spans").select("session_id", "name", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    x = joins.interval_join(s, spans, ["session_id"], how="left")
    mine = F.when(F.col("role") == "user", "N0").when(F.col("role") == "assistant", "N1").otherwise("N2")
    wrong = (F.col("name") != mine) & (F.col("r_start_ms") >= F.col("start_ms")) & (F.col("r_start_ms") < F.col("end_ms"))
    mark = F.when(F.count("name") == 0, "?").when(F.bool_or(F.coalesce(wrong, F.lit(False))), "!").otherwise("")
    return x.groupBy("session_id", "pos").agg(mark.alias("mark"), F.count("name").alias("n"))


def speaker_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common time of speakers and roles, greedily paired."""
    ship(spark)
    a = load(spark, sf_dir, "segments").select("session_id", "speaker", "start_ms", "end_ms")
    b = load(spark, sf_dir, "turns").select("session_id", "cluster", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    n = joins.interval_join(a, b, ["session_id"], 600_000).groupBy("session_id", "speaker", "cluster").agg(F.sum("overlap_ms").alias("ms"))
    paired = match_groups(n, ["session_id"], "speaker", "cluster", "ms", best=False).groupBy("session_id").agg(F.sum("ms").alias("agreed"))
    return n.groupBy("session_id").agg(F.sum("ms").alias("total")).join(paired, "session_id")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, cluster, frame): who is active in each tenth of a second."""
    return scoring.grid(load(spark, sf_dir, "turns"), "cluster", "cluster").select("session_id", F.col("cluster").cast("long"), "frame")


def alone_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which one cluster alone is active."""
    return frames.alone(_active(spark, sf_dir), ["session_id"], "cluster")


def voted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by votes of three shifted looks at the same activity, one speaker a frame."""
    a = _active(spark, sf_dir)
    votes = a.select("session_id", "cluster", F.explode(F.array(F.col("frame"), F.col("frame") + 3, F.col("frame") + 7)).alias("frame")).groupBy("session_id", "frame", "cluster").agg(F.count(F.lit(1)).alias("votes"))
    return frames.voted_turns(votes.withColumn("crowd", F.lit(1)), ["session_id"], "cluster", "votes", "crowd", 5, 13)


def speaker_attributed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of each speaker's words in order against those of the role matched with the speaker."""
    ship(spark)
    s = load(spark, sf_dir, "segments").select("session_id", "pos", "speaker", "role", F.split(F.lower("text"), " ").alias("w"))
    said = lambda label, out: s.groupBy("session_id", F.col(label).alias(out)).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])).alias(f"{out}_words"))
    pairs = match_groups(s.groupBy("session_id", "role", "speaker").agg(F.sum(F.size("w")).cast("long").alias("n")), ["session_id"], "role", "speaker", "n")
    x = said("speaker", "ref").join(pairs.select("session_id", F.col("speaker").alias("ref"), "role"), ["session_id", "ref"], "left").join(said("role", "hyp").withColumnRenamed("hyp", "role"), ["session_id", "role"], "left")
    c = text.error_counts_udf("ref_words", F.coalesce("hyp_words", F.array().cast("array<string>")))
    return x.select("session_id", F.col("ref").alias("speaker"), c.alias("c")).select("session_id", "speaker", "c.*")


def word_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the right speaker by length of line, and in all: those whose cluster is the one most words of the speaker have."""
    words = timeline.split_words_by_turn(spark, sf_dir).select("session_id", "pos", "cluster", "n_words")
    s = load(spark, sf_dir, "segments").select("session_id", "pos", "role", F.col("n_words").alias("line_words"))
    x = words.join(s, ["session_id", "pos"])
    own = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    right = F.sum(F.when(F.col("cluster") == own, F.col("n_words")).otherwise(0))
    return x.rollup(labels.turn_bucket(F.col("line_words")).alias("bucket")).agg(F.grouping_id().cast("long").alias("is_total"), F.sum("n_words").alias("words"), right.cast("long").alias("right"), F.sum(F.when(F.col("cluster") < 0, F.col("n_words")).otherwise(0)).cast("long").alias("unlabeled"))


QUERIES = [alone_ranges, voted_turns, speaker_attributed_errors, word_accuracy, speaker_score_collar, turns_captured, annotated_overlaps, speaker_at_latest, hint_during, meeting_titles, pick_window, provisional_labels, first_and_final_labels, change_points, profiles_in_use, match_profiles, script_validation, clean_read_names, rename_lines, session_versions, swap_if_unchanged, label_changes, replay_revisions, quiet_for, tiles_picked, spot_check, speaker_agreement]

_REFS = "(SELECT DISTINCT session_id, speaker AS ref, unnest(range(start_ms // 100, end_ms // 100)) AS f FROM {segments} s)"
_COLLAR = "(SELECT DISTINCT session_id, unnest(range(CAST(floor((start_ms - 250) / 100) AS BIGINT), greatest(CAST(floor((start_ms + 250) / 100) AS BIGINT), CAST(floor((start_ms - 250) / 100) AS BIGINT) + 1))) AS f FROM (SELECT *, lag(speaker) OVER (PARTITION BY session_id ORDER BY start_ms, pos) AS p FROM {segments} s) a WHERE p <> speaker)"
_HYPS = "(SELECT DISTINCT session_id, cluster AS hyp, unnest(range(start_ms // 100, end_ms // 100)) AS f FROM {turns} t)"
_RUNS = "SELECT session_id, cluster, min(f) AS first, max(f) AS last FROM (SELECT *, f - row_number() OVER (PARTITION BY session_id, cluster ORDER BY f) AS g FROM {x}) r GROUP BY session_id, cluster, g"
_ALONE = f"(SELECT *, count(*) OVER (PARTITION BY session_id, cluster) AS t FROM (SELECT session_id, f, CAST(min(hyp) AS BIGINT) AS cluster FROM {_HYPS} h GROUP BY 1, 2 HAVING count(*) = 1) a QUALIFY t >= 10)"
_VOTED = f"(SELECT session_id, f, cluster FROM (SELECT session_id, f, cluster, row_number() OVER (PARTITION BY session_id, f ORDER BY count(*) DESC, cluster) AS rn FROM (SELECT session_id, CAST(hyp AS BIGINT) AS cluster, unnest([f, f + 3, f + 7]) AS f FROM {_HYPS} h) a GROUP BY session_id, f, cluster) b WHERE rn = 1)"
_PERMUTATIONS = ["012", "021", "102", "120", "201", "210"]
GREEDY = """
    WITH RECURSIVE @PAIRS,
    g AS (SELECT @BY, 0 AS k, CAST([] AS @L[]) AS l, CAST([] AS @R[]) AS r, CAST(NULL AS @L) AS a, CAST(NULL AS @R) AS b, CAST(NULL AS @W) AS w FROM (SELECT DISTINCT @BY FROM p) u
      UNION ALL SELECT g.@BY, k + 1, list_append(g.l, x.a), list_append(g.r, x.b), x.a, x.b, x.w FROM g JOIN LATERAL (SELECT a, b, w FROM p WHERE p.@BY = g.@BY AND NOT list_contains(g.l, p.a) AND NOT list_contains(g.r, p.b) ORDER BY w DESC, a, b LIMIT 1) x ON true)
    """


def _greedy(pairs: str, left: str, right: str, weight: str, result: str, by: str = "session_id") -> str:
    """Pairs p (by, a, b, w) taken greedily by weight, then a, then b; the result reads g, whose first rows have a null."""
    return GREEDY.replace("@PAIRS", pairs).replace("@BY", by).replace("@L", left).replace("@R", right).replace("@W", weight) + result


_SQL = {
    "turns_captured": """WITH w AS (SELECT session_id, pos, word, count(*) AS n FROM (SELECT session_id, pos, unnest(string_split(lower(text), ' ')) AS word FROM {segments} s) a GROUP BY 1, 2, 3),
        near AS (SELECT t.session_id, t.pos AS turn_pos, l.pos, l.role FROM {segments} t JOIN {segments} l ON l.session_id = t.session_id AND l.end_ms + 37000 >= t.start_ms - 5000 AND l.start_ms + 37000 <= t.end_ms + 5000),
        one AS (SELECT n.session_id, n.turn_pos, n.pos, n.role, a.word, a.n AS want, b.n AS have FROM near n JOIN w a ON a.session_id = n.session_id AND a.pos = n.turn_pos JOIN w b ON b.session_id = n.session_id AND b.pos = n.pos AND b.word = a.word),
        hits AS (SELECT session_id, turn_pos, SUM(least(want, have)) AS hits FROM (SELECT session_id, turn_pos, word, max(want) AS want, SUM(have) AS have FROM one GROUP BY 1, 2, 3) a GROUP BY 1, 2),
        best AS (SELECT session_id, turn_pos, first(role ORDER BY h DESC, pos) AS role FROM (SELECT session_id, turn_pos, pos, role, SUM(least(want, have)) AS h FROM one GROUP BY 1, 2, 3, 4) a GROUP BY 1, 2)
        SELECT s.session_id, s.pos AS turn_pos, CAST(coalesce(hits, 0) AS BIGINT) AS hits, coalesce(2 * hits >= s.n_words, false) AS found, CASE WHEN 2 * hits >= s.n_words THEN b.role END AS label
        FROM {segments} s LEFT JOIN hits h ON h.session_id = s.session_id AND h.turn_pos = s.pos LEFT JOIN best b ON b.session_id = s.session_id AND b.turn_pos = s.pos""",
    "speaker_agreement": _greedy("p AS (SELECT s.session_id, s.speaker AS a, t.cluster AS b, CAST(SUM(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS BIGINT) AS w FROM {segments} s JOIN {turns} t ON t.session_id = s.session_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms GROUP BY 1, 2, 3)",
        "VARCHAR", "INT", "BIGINT", "SELECT g.session_id, CAST((SELECT SUM(w) FROM p WHERE p.session_id = g.session_id) AS BIGINT) AS total, CAST(SUM(w) AS BIGINT) AS agreed FROM g WHERE a IS NOT NULL GROUP BY 1"),
    "match_profiles": _greedy(f"""q AS (SELECT vec_id % 10 AS session_id, label, i, SUM(x) AS s FROM {{vector_parts}} v WHERE vec_id % 2 = 1 GROUP BY 1, 2, 3),
        u AS (SELECT q.*, s / sqrt(SUM(s * s) OVER (PARTITION BY session_id, label)) AS x FROM q), c AS (SELECT u.session_id, u.label AS a, e.label AS b, round(SUM(u.x * e.x), 6) AS w FROM u JOIN {vectors._EVEN} e ON e.i = u.i GROUP BY 1, 2, 3),
        p AS (SELECT * FROM c WHERE w >= 0.1)""", "INT", "INT", "DOUBLE", "SELECT session_id, a AS voice, b AS label, w AS similarity FROM g WHERE a IS NOT NULL"),
    "first_and_final_labels": """WITH s AS (SELECT *, greatest(ceil(start_ms / 20000), 1) * 20000 AS own, greatest(ceil(end_ms / 20000), 1) * 20000 AS until FROM {segments} g), t AS (SELECT *, greatest(ceil(greatest(start_ms, end_ms) / 20000), 1) * 20000 AS until FROM {turns} g),
        e AS (SELECT session_id, max(until) AS until FROM (SELECT session_id, until FROM s UNION ALL SELECT session_id, until FROM t) a GROUP BY 1),
        c AS (SELECT s.session_id, s.pos, s.start_ms, unnest(range(CAST(s.own AS BIGINT), CAST(e.until AS BIGINT) + 1, 20000)) AS cut FROM s JOIN e ON e.session_id = s.session_id),
        l AS (SELECT c.session_id, c.pos, c.cut, first(t.cluster ORDER BY abs(t.start_ms - c.start_ms), CASE WHEN cut >= 100000 THEN -t.turn_pos ELSE t.turn_pos END, t.cluster) AS label FROM c JOIN t ON t.session_id = c.session_id AND t.start_ms <= c.cut GROUP BY 1, 2, 3),
        p AS (SELECT *, lag(label) OVER (PARTITION BY session_id, pos ORDER BY cut) AS before FROM l)
        SELECT session_id, pos, CAST(arg_min(label, cut) AS BIGINT) AS first, CAST(arg_max(label, cut) AS BIGINT) AS final, CAST(count(CASE WHEN before <> label THEN 1 END) AS BIGINT) AS changes, max(cut) - min(cut) AS span FROM p GROUP BY 1, 2""",
    "clean_read_names": """WITH RECURSIVE r AS (SELECT p_partkey, list_filter(string_split(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || [' Priv', ' fo', ' •.•', '', ' Muted'][p_partkey % 5 + 1], ' '), lambda w: w <> '') AS ws, false AS done FROM {part}
          UNION ALL SELECT p_partkey, ws[:-2], noise FROM (SELECT *, len(list_filter(['privacy', 'muted', 'mute', 'recording', 'live'], lambda n: n = lower(ws[-1]) OR strlen(ws[-1]) >= 3 AND starts_with(n, lower(ws[-1])))) > 0 AS noise FROM r WHERE NOT done AND len(ws) >= 2) a
            WHERE noise OR strlen(ws[-1]) <= 2 AND ws[-1] = lower(ws[-1]) OR NOT regexp_matches(ws[-1], '\\p{L}')),
        f AS (SELECT p_partkey, arg_min(ws, len(ws)) AS ws FROM r GROUP BY 1),
        u AS (SELECT *, len(list_filter(ws, lambda w: list_contains(['take', 'control', 'annotate', 'pop', 'out', 'chat', 'people', 'raise', 'react', 'view', 'notes', 'apps', 'more', 'camera', 'mic', 'share', 'leave'], lower(w)))) AS ui FROM f)
        SELECT p_partkey, array_to_string(ws, ' ') AS name, length(regexp_replace(array_to_string(ws, ' '), '[^\\p{L}]', '', 'g')) >= 2 AND (ui < 2 OR 2 * ui <= len(ws)) AS fine FROM u""",
    "alone_ranges": _RUNS.replace("{x}", _ALONE + " a"),
    "voted_turns": f"SELECT session_id, cluster, min(f) AS first, max(f) AS last FROM (SELECT *, SUM(n) OVER (PARTITION BY session_id, cluster ORDER BY f) AS i FROM (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY session_id, cluster ORDER BY f) - 1 <= 5 THEN 0 ELSE 1 END AS n FROM {_VOTED} v) a) b GROUP BY session_id, cluster, i HAVING max(f) - min(f) + 1 > 13",
    "word_accuracy": "SELECT bucket, CAST(grouping(bucket) AS BIGINT) AS is_total, CAST(SUM(w) AS BIGINT) AS words, CAST(SUM(CASE WHEN cluster = own THEN w ELSE 0 END) AS BIGINT) AS \"right\", CAST(SUM(CASE WHEN cluster < 0 THEN w ELSE 0 END) AS BIGINT) AS unlabeled FROM (SELECT x.cluster, x.n_words AS w, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS own, CASE WHEN s.n_words <= 3 THEN '1-3' WHEN s.n_words <= 15 THEN '4-15' WHEN s.n_words <= 60 THEN '16-60' ELSE '61+' END AS bucket FROM (" + timeline.SPLIT + ") x JOIN {segments} s ON s.session_id = x.session_id AND s.pos = x.pos) y GROUP BY ROLLUP (bucket)",
    "speaker_score_collar": f"""WITH b AS (SELECT r.session_id, r.f, r.ref, h.hyp FROM {_REFS} r JOIN {_HYPS} h ON r.session_id = h.session_id AND r.f = h.f WHERE NOT EXISTS (SELECT 1 FROM {_COLLAR} c WHERE c.session_id = r.session_id AND c.f = r.f)),
        m AS (SELECT session_id, p, count(*) AS n FROM b, (SELECT unnest({_PERMUTATIONS}) AS p) q WHERE ref = 'S' || p[hyp + 1] GROUP BY 1, 2), k AS (SELECT session_id, arg_max(p, n) AS p FROM m GROUP BY 1),
        s AS (SELECT b.session_id, CAST(count(DISTINCT f) AS BIGINT) AS scored, CAST(count(DISTINCT CASE WHEN ref = 'S' || k.p[hyp + 1] THEN f END) AS BIGINT) AS correct FROM b LEFT JOIN k ON b.session_id = k.session_id GROUP BY 1),
        o AS (SELECT session_id, CAST(count(*) AS BIGINT) AS overlap FROM (SELECT session_id, f FROM {_HYPS} h GROUP BY 1, 2 HAVING count(*) >= 2) x GROUP BY 1) SELECT s.*, coalesce(overlap, 0) AS overlap FROM s LEFT JOIN o ON s.session_id = o.session_id""",
    "annotated_overlaps": "SELECT session_id, pos, at_ms AS \"at\", group_size, CASE WHEN place = 1 THEN 'main' ELSE 'interjection' END AS part, n_words FROM (SELECT *, count(*) OVER (PARTITION BY session_id, at_ms) AS group_size, row_number() OVER (PARTITION BY session_id, at_ms ORDER BY n_words DESC, pos) AS place FROM (SELECT *, start_ms // 30000 * 30000 AS at_ms FROM {segments} s) a) b WHERE group_size > 1",
    "speaker_at_latest": 'SELECT p.session_id, p.turn_pos, p.start_ms + 10000 AS "at", l.speaker FROM {turns} p LEFT JOIN LATERAL (SELECT speaker FROM {segments} s WHERE s.session_id = p.session_id AND s.start_ms <= p.start_ms + 10000 AND p.start_ms + 10000 <= s.end_ms ORDER BY s.start_ms DESC LIMIT 1) l ON true',
    "hint_during": "SELECT v.event_id AS view_id, max(r.event_id) AS event_id, arg_max(r.event_type, r.event_id) AS name, CAST(count(*) AS BIGINT) AS n FROM {event_ms} v JOIN {event_ms} r ON v.user_id = r.user_id AND v.event_type = 'view' AND r.event_type <> 'view' AND r.t BETWEEN v.t AND v.t + 28800000 GROUP BY 1",
    "meeting_titles": "SELECT user_id, day, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, first) AS rn FROM (SELECT user_id, t // 86400000 AS day, event_type, CAST(count(*) AS BIGINT) AS n, min(t) AS first FROM {event_ms} e GROUP BY 1, 2, 3) a) b WHERE rn = 1",
    "pick_window": """SELECT page_id // 20 AS screen, coalesce(min(CASE WHEN v = 'accepted' AND NOT compact THEN page_id END), min(CASE WHEN v = 'accepted' THEN page_id END)) AS picked, CAST(count(CASE WHEN v = 'untitled' THEN 1 END) AS BIGINT) AS untitled, CAST(count(CASE WHEN v = 'chat' THEN 1 END) AS BIGINT) AS chat, CAST(count(CASE WHEN v = 'generic' THEN 1 END) AS BIGINT) AS generic, CAST(count(CASE WHEN v = 'other' THEN 1 END) AS BIGINT) AS other
        FROM (SELECT page_id, page_id % 8 = 3 AS compact, CASE WHEN page_id % 5 = 0 THEN 'other' WHEN page_id % 4 = 0 THEN 'untitled' WHEN page_id % 4 = 1 THEN 'chat' WHEN page_id % 4 = 2 THEN 'generic' ELSE 'accepted' END AS v FROM {pages}) x GROUP BY 1""",
    "provisional_labels": f"SELECT session_id, pos, label, label = 'New speaker' OR suffix(label, '?') AS provisional FROM (SELECT session_id, pos, CASE WHEN cluster >= 0 THEN 'Person ' || (cluster + 1) WHEN n_words > 25 THEN speaker WHEN n_words > 18 THEN speaker || '?' ELSE 'New speaker' END AS label FROM {timeline.ATTRIBUTED} a) b",
    "change_points": "SELECT user_id, event_id AS \"at\", gain FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, r) AS best FROM (SELECT user_id, event_id, CAST(2 * SUM(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - SUM(v) OVER (PARTITION BY user_id) AS BIGINT) AS gain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, CAST(round(value * 100) AS BIGINT) - 5000 AS v FROM {event_ms} e) a) b) c WHERE best = 1 AND r > 1 AND r < n",
    "profiles_in_use": "SELECT 'L' || label || '-' || vec_id % 7 AS name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT session_id) AS BIGINT) AS meetings FROM {fingerprints} f GROUP BY 1 HAVING count(*) >= 8 AND (bool_or(vec_id % 31 = 0) OR count(DISTINCT session_id) >= 2 OR bool_or(vec_id % 17 = 0))",
    "script_validation": "SELECT doc_id, CASE WHEN trim(other) <> '' AND (CASE doc_id % 3 WHEN 0 THEN doc_id % 4 = 0 WHEN 1 THEN doc_id % 4 = 3 ELSE true END) THEN other ELSE lang END AS chosen FROM (SELECT doc_id, lang, ['नमस्ते', 'hello', ' ', 'こんにちは'][doc_id % 4 + 1] AS other FROM {documents}) d",
    "rename_lines": "SELECT session_id, pos, CASE speaker WHEN 'S0' THEN 'Ann' WHEN 'S2' THEN 'Bo' ELSE speaker END AS speaker, CASE WHEN speaker IN ('S0', 'S2') THEN speaker ELSE '' END AS live_speaker FROM {segments} s",
    "session_versions": "SELECT session_id, substring(sha256(string_agg(pos || chr(31) || speaker || chr(31) || text, chr(30) ORDER BY pos)), 1, 24) AS version FROM {segments} s GROUP BY 1",
    "swap_if_unchanged": "SELECT DISTINCT session_id, 'new' AS title FROM {segments} s WHERE session_id % 3 <> 0",
    "label_changes": "SELECT session_id, pos, new_speaker AS speaker FROM (" + timeline._SQL["absorb_small"] + ") x WHERE new_speaker <> speaker",
    "replay_revisions": "SELECT session_id, seg_id, status, speaker, born, row_number() OVER (PARTITION BY session_id ORDER BY born, seg_id) AS place FROM (SELECT e.session_id, e.seg_id, arg_max(status, seq) AS status, arg_max(speaker, seq) AS speaker, min(b.born) AS born FROM {segment_events} e JOIN (SELECT user_id AS session_id, event_id % 20 AS seg_id, min(t) AS born FROM {event_ms} e GROUP BY 1, 2) b ON e.session_id = b.session_id AND e.seg_id = b.seg_id GROUP BY 1, 2) x WHERE status <> 'removed'",
    "quiet_for": "SELECT user_id, max(t) - max(CASE WHEN value > 10 THEN t END) AS quiet_ms FROM {event_ms} e GROUP BY 1",
    "tiles_picked": "SELECT user_id, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS m FROM {event_ms} e) x WHERE m <= 5 OR r IN (0, (m - 1) // 4, 2 * (m - 1) // 4, 3 * (m - 1) // 4, m - 1)",
    "spot_check": "SELECT s.session_id, s.pos, CASE WHEN count(e.name) = 0 THEN '?' WHEN bool_or(e.name <> CASE role WHEN 'user' THEN 'N0' WHEN 'assistant' THEN 'N1' ELSE 'N2' END AND e.start_ms >= s.start_ms AND e.start_ms < s.end_ms) THEN '!' ELSE '' END AS mark, CAST(count(e.name) AS BIGINT) AS n FROM {segments} s LEFT JOIN {ext_spans} e ON s.session_id = e.session_id AND s.start_ms < e.end_ms AND e.start_ms < s.end_ms GROUP BY 1, 2",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
