"""Queries on time lines: joins of lines, turns, names and events; runs, windows and scores by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import labels
from parlance.operators import alignment, attribution, joins, matching, sequence
from parlance.plans.views import duckdb, expand, load
from parlance.runtime import ship

ALIGN = """
    WITH shifts AS (SELECT CAST(s AS BIGINT) * 1000 AS shift FROM range(-300, 301) r(s)),
    lines AS (SELECT session_id, role AS speaker, start_ms, end_ms FROM {segments} s),
    ov AS (
      SELECT g.session_id, h.shift, g.speaker, t.name,
        CAST(SUM(least(g.end_ms, t.end_ms + h.shift) - greatest(g.start_ms, t.start_ms + h.shift)) AS BIGINT) AS ms
      FROM lines g JOIN {ext_spans} t ON g.session_id = t.session_id
        JOIN shifts h ON t.start_ms + h.shift < g.end_ms AND g.start_ms < t.end_ms + h.shift
      GROUP BY g.session_id, h.shift, g.speaker, t.name),
    agree AS (
      SELECT session_id, shift, CAST(SUM(best) AS BIGINT) AS agreement
      FROM (SELECT session_id, shift, speaker, MAX(ms) AS best FROM ov GROUP BY session_id, shift, speaker) b GROUP BY session_id, shift),
    pick AS (
      SELECT session_id, shift FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY agreement DESC, abs(shift), shift DESC) AS rn FROM agree) p WHERE rn = 1),
    ranked AS (
      SELECT o.session_id, p.shift, o.speaker, o.name, o.ms,
        CAST(SUM(o.ms) OVER (PARTITION BY o.session_id, o.speaker) AS BIGINT) AS total_ms,
        coalesce(lead(o.ms) OVER (PARTITION BY o.session_id, o.speaker ORDER BY o.ms DESC, o.name), 0) AS second_ms,
        row_number() OVER (PARTITION BY o.session_id, o.speaker ORDER BY o.ms DESC, o.name) AS rn
      FROM ov o JOIN pick p ON o.session_id = p.session_id AND o.shift = p.shift),
    first AS (SELECT session_id, shift, speaker, name, ms, total_ms,
      CASE WHEN ms < 30000 THEN 'too little overlap' WHEN ms * 10 < total_ms * 6 THEN 'no clear majority' WHEN ms < 2 * second_ms THEN 'runner-up too close' ELSE 'proposed' END AS why
      FROM ranked WHERE rn = 1)
    SELECT session_id, shift, speaker, name, ms, total_ms,
      CASE WHEN why = 'proposed' AND ms * 10 < total_ms * 8 AND COUNT(*) OVER (PARTITION BY session_id, name, why) > 1 THEN 'name of several labels' ELSE why END AS outcome
    FROM first"""


def align_external_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock shift of an external transcript, up to five minutes, by exhaustive search, then a name for each label."""
    lines = load(spark, sf_dir, "segments").select("session_id", F.col("role").alias("speaker"), "start_ms", "end_ms")
    spans = load(spark, sf_dir, "ext_spans").select("session_id", "name", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    return alignment.named_labels(alignment.shifted_overlaps(lines, spans, 300), 300).drop("at_edge")


def segments_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "segments").select("session_id", "pos", "speaker", "n_words", "start_ms", "end_ms")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of one speaker, blank ones left out."""
    lines = load(spark, sf_dir, "segments").filter("trim(text) <> ''")
    runs = sequence.islands(lines, ["session_id"], ["start_ms", "pos"], sequence.changed("speaker", ["session_id"], ["start_ms", "pos"]), "paragraph")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "pos", "text"))), lambda s: s["text"]), " ")
    return runs.groupBy("session_id", "paragraph").agg(F.min("speaker").alias("speaker"), F.count(F.lit(1)).alias("n_lines"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"))


def next_later_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read lasts until the next strictly later one, an hour at most."""
    x = sequence.next_later(load(spark, sf_dir, "hints"), ["session_id"], "t")
    return x.select("session_id", "event_id", "name", "t", F.least(F.col("t") + 3_600_000, F.coalesce("next_at", F.col("t") + 3_600_000)).alias("end_ms"))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "segments").withColumn("live", F.lit(""))
    x = attribution.attribute_lines(lines, load(spark, sf_dir, "turns"))
    for c in ("turn_pos", "cluster"):
        x = x.withColumn(c, F.when(labels.diarizable(F.col("source"), F.col("live")), F.col(c)).otherwise(-1))
    return x


def attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("session_id", "pos", F.col("turn_pos").cast("long"), F.col("cluster").cast("long"))


ATTRIBUTED = """(SELECT s.session_id, s.pos, s.speaker, s.role, s.n_words, s.start_ms, s.end_ms,
      CAST(CASE WHEN s.source <> 'mic' THEN coalesce(b.turn_pos, -1) ELSE -1 END AS BIGINT) AS turn_pos, CAST(CASE WHEN s.source <> 'mic' THEN coalesce(b.cluster, -1) ELSE -1 END AS BIGINT) AS cluster
    FROM {segments} s LEFT JOIN (SELECT * FROM (
      SELECT g.session_id, g.pos, t.turn_pos, t.cluster, row_number() OVER (PARTITION BY g.session_id, g.pos ORDER BY least(g.end_ms, t.end_ms) - greatest(g.start_ms, t.start_ms) DESC, t.turn_pos) AS rn
      FROM {segments} g JOIN {turns} t ON g.session_id = t.session_id AND g.start_ms < t.end_ms AND t.start_ms < g.end_ms) x WHERE rn = 1) b
    ON s.session_id = b.session_id AND s.pos = b.pos)"""


def label_top_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster the speaker name with most line time."""
    votes = _attributed(spark, sf_dir).filter("cluster >= 0").groupBy("session_id", "cluster", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return attribution.top_name(votes, ["session_id", "cluster"], "speaker", "ms").select("session_id", F.col("cluster").cast("long"), F.col("speaker").alias("name"), "ms")


def split_words_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = attribution.words_by_turn(load(spark, sf_dir, "words"), load(spark, sf_dir, "turns"))
    return attribution.word_runs(words).select("session_id", "pos", "run", F.col("cluster").cast("long"), "n_words", "start_ms", "end_ms", "text")


SPLIT = """
    WITH hit AS (SELECT w.session_id, w.pos, w.w_pos, t.cluster, row_number() OVER (PARTITION BY w.session_id, w.pos, w.w_pos ORDER BY t.end_ms - t.start_ms, t.turn_pos) AS rn
      FROM {words} w JOIN {turns} t ON w.session_id = t.session_id AND t.start_ms <= w.start_ms + least(100, (w.end_ms - w.start_ms) // 2) AND w.start_ms + least(100, (w.end_ms - w.start_ms) // 2) < t.end_ms),
    named AS (SELECT w.*, coalesce(last_value(h.cluster IGNORE NULLS) OVER (PARTITION BY w.session_id, w.pos ORDER BY w.w_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(h.cluster IGNORE NULLS) OVER (PARTITION BY w.session_id, w.pos ORDER BY w.w_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS cluster
      FROM {words} w LEFT JOIN hit h ON h.rn = 1 AND w.session_id = h.session_id AND w.pos = h.pos AND w.w_pos = h.w_pos),
    flagged AS (SELECT *, CASE WHEN cluster <> lag(cluster) OVER (PARTITION BY session_id, pos ORDER BY w_pos) THEN 1 ELSE 0 END AS f FROM named),
    runs AS (SELECT *, CAST(SUM(f) OVER (PARTITION BY session_id, pos ORDER BY w_pos) AS BIGINT) AS run FROM flagged)
    SELECT session_id, pos, run, CAST(min(cluster) AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY w_pos) AS text
    FROM runs GROUP BY session_id, pos, run"""


def split_words_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As split_words_by_turn, with short runs absorbed in order."""
    ship(spark)
    return attribution.absorb_runs(split_words_by_turn(spark, sf_dir), 1500)


def speakers_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters active at the start of each line and a second later."""
    points = load(spark, sf_dir, "segments").select("session_id", "pos", F.explode(F.array(F.col("start_ms"), F.col("start_ms") + 1000)).alias("at"))
    spans = load(spark, sf_dir, "turns").select("session_id", "cluster", "start_ms", "end_ms")
    hit = joins.point_join(points, spans, ["session_id"], "at", how="left")
    found = F.sort_array(F.collect_set("cluster"))
    return hit.groupBy("session_id", "pos", "at").agg(F.array_join(found.cast("array<string>"), ",").alias("clusters"), F.size(found).cast("long").alias("n"))


def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of the same user within a day before each purchase."""
    e = load(spark, sf_dir, "event_ms")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("click_t"), F.col("event_id").alias("click_id"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    return joins.asof_join(buys, clicks, ["user_id"], "t", "click_t", ["click_id"], ["click_id", "click_t"], 86_400_000)


def asof_tolerance_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile shown at each view: the last read, ten minutes late, valid for six hours; an error blanks the answer."""
    e = load(spark, sf_dir, "event_ms")
    reads = e.filter("event_type <> 'view'").select("user_id", (F.col("t") - 600_000).alias("r_t"), F.col("event_id").alias("r_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("tile"))
    return joins.asof_join(e.filter("event_type = 'view'").select("event_id", "user_id", "t"), reads, ["user_id"], "t", "r_t", ["r_id"], ["tile"], 21_600_000)


def sole_hint_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one name read within twelve hours after a view; none if names differ or an error comes between."""
    e = load(spark, sf_dir, "event_ms")
    lines = e.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("session_id"), "t", (F.col("t") + 1).alias("from_ms"), (F.col("t") + 43_200_001).alias("to_ms"))
    reads = e.filter("event_type <> 'view'").select(F.col("user_id").alias("session_id"), F.col("t").alias("at"), "event_type")
    hit = joins.point_join(reads, lines.select("session_id", "event_id", "from_ms", "to_ms"), ["session_id"], "at", ("from_ms", "to_ms"), 43_200_000)
    sole = hit.groupBy("event_id").agg(F.when((F.countDistinct("event_type") == 1) & ~F.bool_or(F.col("event_type") == "error"), F.min("event_type")).alias("name"))
    return lines.select("event_id", "session_id", "t").join(sole, "event_id", "left")


def nearest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest turn within ten seconds of a point five seconds after each external span's end."""
    spans = load(spark, sf_dir, "ext_spans")
    points = spans.select("session_id", (F.col("end_ms") - 32_000).alias("at")).distinct()
    return joins.nearest_join(points, load(spark, sf_dir, "turns"), ["session_id"], "at", ["at"], 10_000, ["turn_pos", "cluster"], order=["turn_pos"]).select("session_id", "at", "turn_pos", F.col("cluster").cast("long"), "distance_ms")


def absorb_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "segments").select("session_id", "pos", "speaker", "n_words", "start_ms", "end_ms")
    return attribution.absorb_small_speakers(lines, 40).select("session_id", "pos", "speaker", "new_speaker")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read half a second into a line, while exactly one cluster is active, in buckets of five seconds."""
    lines = load(spark, sf_dir, "segments").select("session_id", "pos", "speaker", (F.col("start_ms") + 500).alias("at"))
    hit = joins.point_join(lines, load(spark, sf_dir, "turns").select("session_id", "cluster", "start_ms", "end_ms"), ["session_id"], "at")
    alone = hit.groupBy("session_id", "pos", "speaker", "at").agg(F.countDistinct("cluster").alias("_n"), F.min("cluster").alias("cluster")).filter("_n = 1")
    return alone.select("session_id", "cluster", F.col("speaker").alias("name"), F.floor(F.col("at") / 5000).alias("bucket"))


READS = """(SELECT l.session_id, min(t.cluster) AS cluster, l.speaker AS name, CAST(floor((l.start_ms + 500) / 5000) AS BIGINT) AS bucket
    FROM {segments} l JOIN {turns} t ON l.session_id = t.session_id AND t.start_ms <= l.start_ms + 500 AND l.start_ms + 500 < t.end_ms
    GROUP BY l.session_id, l.pos, l.speaker, l.start_ms HAVING count(DISTINCT t.cluster) = 1)"""
VOTES = """(SELECT session_id, cluster, name, n, total FROM (SELECT *, CAST(SUM(n) OVER (PARTITION BY session_id, cluster) AS BIGINT) AS total, row_number() OVER (PARTITION BY session_id, cluster ORDER BY n DESC, name) AS rn
    FROM (SELECT session_id, CAST(cluster AS BIGINT) AS cluster, name, CAST(count(DISTINCT bucket) AS BIGINT) AS n FROM {reads} r GROUP BY session_id, cluster, name) a) b WHERE rn = 1 AND n >= 1 AND n * 2 >= total)""".replace("{reads}", READS)


def name_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.decide_names(_reads(spark, sf_dir), ["session_id", "cluster"], 1, (1, 2)).select("session_id", F.col("cluster").cast("long"), "name", "n", "total")


def name_votes_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters without a name take the one name of the session that no cluster has, if they are the only such cluster."""
    named = name_votes(spark, sf_dir)
    clusters = load(spark, sf_dir, "turns").select("session_id", F.col("cluster").cast("long")).distinct()
    names = load(spark, sf_dir, "segments").select("session_id", F.col("speaker").alias("name")).distinct()
    open_clusters = clusters.join(named, ["session_id", "cluster"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.min("cluster").alias("cluster")).filter("_n = 1")
    free = names.join(named, ["session_id", "name"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("_m"), F.min("name").alias("name")).filter("_m = 1")
    late = open_clusters.join(free, "session_id").select("session_id", "cluster", "name", F.lit("elimination").alias("how"))
    return named.select("session_id", "cluster", "name", F.lit("votes").alias("how")).unionByName(late)


def tile_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the tile shown at most views, if at two thirds of them at least."""
    shown = asof_tolerance_blank(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000))
    n = shown.groupBy("user_id", "day", "tile").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id", "day")
    x = n.withColumn("total", F.sum("n").over(w)).filter("tile IS NOT NULL")
    x = x.withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), "tile"))).filter("_r = 1 AND n * 3 >= total * 2")
    return x.select("user_id", "day", "tile", "n", "total")


BLANKED = """(SELECT v.event_id, v.user_id, v.t, CASE WHEN v.t - r.r_t <= 21600000 THEN r.tile END AS tile FROM (SELECT * FROM {event_ms} e WHERE event_type = 'view') v LEFT JOIN LATERAL
    (SELECT e.t - 600000 AS r_t, CASE WHEN event_type <> 'error' THEN event_type END AS tile FROM {event_ms} e WHERE e.user_id = v.user_id AND e.event_type <> 'view' AND e.t - 600000 <= v.t ORDER BY e.t DESC, e.event_id DESC LIMIT 1) r ON true)"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events closer than twelve hours make one stretch."""
    e = load(spark, sf_dir, "event_ms")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    x = sequence.islands(e, ["user_id"], ["t", "event_id"], F.col("t") - F.lag("t").over(w) > 43_200_000, "stretch")
    return x.groupBy("user_id", "stretch").agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and largest values per hour and type."""
    e = load(spark, sf_dir, "event_ms")
    return e.groupBy((F.floor(F.col("t") / 3_600_000) * 3_600_000).alias("window_ms"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of six hours that start every two."""
    e = load(spark, sf_dir, "event_ms")
    last = F.floor(F.col("t") / 7_200_000)
    x = e.withColumn("k", F.explode(F.sequence(last - 2, last)))
    return x.groupBy((F.col("k") * 7_200_000).alias("window_ms")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def overlap_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.contingency(load(spark, sf_dir, "segments"), load(spark, sf_dir, "turns"), "speaker", "cluster").select("session_id", F.col("hyp").cast("long"), "ref", "frames")


CONTINGENCY = """(SELECT session_id, CAST(hyp AS BIGINT) AS hyp, ref, CAST(count(*) AS BIGINT) AS frames FROM
    (SELECT DISTINCT a.session_id, b.cluster AS hyp, a.speaker AS ref, a.f FROM
      (SELECT DISTINCT session_id, speaker, unnest(range(CAST(floor(start_ms / 100) AS BIGINT), CAST(floor(end_ms / 100) AS BIGINT))) AS f FROM {segments} s) a
      JOIN (SELECT DISTINCT session_id, cluster, unnest(range(CAST(floor(start_ms / 100) AS BIGINT), CAST(floor(end_ms / 100) AS BIGINT))) AS f FROM {turns} t) b ON a.session_id = b.session_id AND a.f = b.f) x GROUP BY session_id, hyp, ref)"""


def purity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = overlap_contingency(spark, sf_dir)
    best_h = c.groupBy("session_id", "hyp").agg(F.max("frames").alias("m")).groupBy("session_id").agg(F.sum("m").alias("pure"))
    best_r = c.groupBy("session_id", "ref").agg(F.max("frames").alias("m")).groupBy("session_id").agg(F.sum("m").alias("covered"))
    total = c.groupBy("session_id").agg(F.sum("frames").alias("total"))
    return total.join(best_h, "session_id").join(best_r, "session_id").select("session_id", "total", F.round(F.col("pure") / F.col("total"), 6).alias("purity"), F.round(F.col("covered") / F.col("total"), 6).alias("coverage"))


def speaker_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of matched speakers under the one-to-one mapping of most frames."""
    ship(spark)
    c = overlap_contingency(spark, sf_dir)
    matched = matching.match_groups(c, ["session_id"], "hyp", "ref", "frames").groupBy("session_id").agg(F.sum("frames").alias("correct"))
    return c.groupBy("session_id").agg(F.sum("frames").alias("scored")).join(matched, "session_id")


CONFUSION = """SELECT session_id, CAST(total AS BIGINT) AS scored, CAST(greatest(a00 + a11 + a22, a00 + a12 + a21, a01 + a10 + a22, a01 + a12 + a20, a02 + a10 + a21, a02 + a11 + a20) AS BIGINT) AS correct FROM (
    SELECT session_id, SUM(frames) AS total, """ + ", ".join(f"coalesce(SUM(CASE WHEN hyp = {h} AND ref = 'S{r}' THEN frames END), 0) AS a{h}{r}" for h in range(3) for r in range(3)) + f" FROM {CONTINGENCY} c GROUP BY session_id) m"


def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines heard: an external span overlaps what the line's words can take, give or take half a second."""
    lines = load(spark, sf_dir, "segments")
    lines = lines.withColumn("from_ms", F.col("start_ms") - 500).withColumn("to_ms", F.least("end_ms", F.col("start_ms") + F.greatest(F.lit(1000), F.col("n_words") * 400)) + 500)
    spans = load(spark, sf_dir, "ext_spans").select("session_id", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    heard = joins.interval_join(lines, spans, ["session_id"], how="left_semi", left_span=("from_ms", "to_ms")).groupBy("session_id").agg(F.count(F.lit(1)).alias("heard"), F.sum("n_words").alias("heard_words"))
    every = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("n_words").alias("words"))
    return every.join(heard, "session_id", "left").fillna(0, ["heard", "heard_words"])


def quick_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines between lines of others, and whether the attributed cluster is that of most of the speaker's time."""
    x = _attributed(spark, sf_dir).select("session_id", "pos", F.col("role").alias("speaker"), "n_words", "start_ms", "end_ms", "cluster")
    w = Window.partitionBy("session_id").orderBy("start_ms", "pos")
    x = x.withColumn("_b", F.lag("speaker").over(w)).withColumn("_a", F.lead("speaker").over(w))
    quick = x.filter("n_words <= 20 AND end_ms - start_ms <= 9000 AND _b <> speaker AND _a <> speaker")
    return quick.select("session_id", "pos", "speaker", "n_words", (F.col("cluster") >= 0).alias("found"))


def turn_buckets_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, words and attributed lines by length of line and overall."""
    x = _attributed(spark, sf_dir).withColumn("bucket", labels.turn_bucket(F.col("n_words")))
    return x.rollup("bucket").agg(F.grouping("bucket").cast("long").alias("is_total"), F.count(F.lit(1)).alias("lines"), F.sum("n_words").alias("words"), F.sum((F.col("cluster") >= 0).cast("long")).alias("attributed"))


def min_gap_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads at least six hours after the last kept one."""
    ship(spark)
    return sequence.min_gap_thin(load(spark, sf_dir, "hints").select("session_id", "event_id", "t"), ["session_id"], "t", "event_id", 21_600_000)


THIN = """
    WITH RECURSIVE h AS (SELECT session_id, event_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS rn FROM {hints} x),
    walk AS (SELECT session_id, event_id, t, rn, t AS kept, true AS keep FROM h WHERE rn = 1
      UNION ALL SELECT h.session_id, h.event_id, h.t, h.rn, CASE WHEN h.t - w.kept >= 21600000 THEN h.t ELSE w.kept END, h.t - w.kept >= 21600000 FROM walk w JOIN h ON h.session_id = w.session_id AND h.rn = w.rn + 1)
    SELECT session_id, event_id, t FROM walk WHERE keep"""

QUERIES = [align_external_names, segments_timeline, paragraphs, next_later_spans, attribute_lines, label_top_name, split_words_by_turn, split_words_absorbed, speakers_at, asof_last_click, asof_tolerance_blank, sole_hint_window, nearest_turn, absorb_small, name_votes, name_votes_elimination, tile_majority, event_sessions, tumbling_counts, sliding_counts, overlap_contingency, purity_coverage, speaker_confusion, detection_score, quick_exchanges, turn_buckets_rollup, min_gap_thin]

_SQL = {
    "align_external_names": ALIGN,
    "segments_timeline": "SELECT session_id, pos, speaker, n_words, start_ms, end_ms FROM {segments} s",
    "paragraphs": """SELECT session_id, paragraph, min(speaker) AS speaker, CAST(count(*) AS BIGINT) AS n_lines, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, pos) AS text FROM
        (SELECT *, CAST(SUM(f) OVER (PARTITION BY session_id ORDER BY start_ms, pos) AS BIGINT) - 1 AS paragraph FROM
        (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY session_id ORDER BY start_ms, pos) THEN 0 ELSE 1 END AS f FROM {segments} s WHERE trim(text) <> '') a) b GROUP BY session_id, paragraph""",
    "next_later_spans": "SELECT session_id, event_id, name, t, least(t + 3600000, coalesce((SELECT min(o.t) FROM {hints} o WHERE o.session_id = h.session_id AND o.t > h.t), t + 3600000)) AS end_ms FROM {hints} h",
    "attribute_lines": f"SELECT session_id, pos, turn_pos, cluster FROM {ATTRIBUTED} a",
    "label_top_name": f"SELECT session_id, cluster, speaker AS name, ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, cluster ORDER BY ms DESC, length(speaker) DESC, speaker) AS rn FROM (SELECT session_id, cluster, speaker, CAST(SUM(end_ms - start_ms) AS BIGINT) AS ms FROM {ATTRIBUTED} a WHERE cluster >= 0 GROUP BY session_id, cluster, speaker) b) c WHERE rn = 1",
    "split_words_by_turn": SPLIT,
    "speakers_at": """SELECT p.session_id, p.pos, p.at, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c), '') AS clusters, CAST(count(c) AS BIGINT) AS n FROM
        (SELECT DISTINCT p.session_id, p.pos, p.at, t.cluster AS c FROM (SELECT session_id, pos, unnest([start_ms, start_ms + 1000]) AS at FROM {segments} s) p LEFT JOIN {turns} t ON p.session_id = t.session_id AND t.start_ms <= p.at AND p.at < t.end_ms) p GROUP BY p.session_id, p.pos, p.at""",
    "asof_last_click": """SELECT b.event_id, b.user_id, b.t, CASE WHEN b.t - c.t <= 86400000 THEN c.event_id END AS click_id, CASE WHEN b.t - c.t <= 86400000 THEN c.t END AS click_t
        FROM (SELECT * FROM {event_ms} e WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM {event_ms} e WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.t >= c.t""",
    "asof_tolerance_blank": f"SELECT * FROM {BLANKED} b",
    "sole_hint_window": """SELECT v.event_id, v.user_id AS session_id, v.t, CASE WHEN count(DISTINCT r.event_type) = 1 AND NOT bool_or(r.event_type = 'error') THEN min(r.event_type) END AS name
        FROM (SELECT * FROM {event_ms} e WHERE event_type = 'view') v LEFT JOIN {event_ms} r ON r.user_id = v.user_id AND r.event_type <> 'view' AND r.t >= v.t + 1 AND r.t <= v.t + 43200000 GROUP BY v.event_id, v.user_id, v.t""",
    "nearest_turn": """SELECT p.session_id, p.at, x.turn_pos, CAST(x.cluster AS BIGINT) AS cluster, x.d AS distance_ms FROM (SELECT DISTINCT session_id, end_ms - 32000 AS at FROM {ext_spans} e) p LEFT JOIN LATERAL
        (SELECT turn_pos, cluster, greatest(t.start_ms - p.at, p.at - t.end_ms, 0) AS d FROM {turns} t WHERE t.session_id = p.session_id AND greatest(t.start_ms - p.at, p.at - t.end_ms, 0) <= 10000 ORDER BY 3, 1 LIMIT 1) x ON true""",
    "absorb_small": """WITH l AS (SELECT *, SUM(n_words) OVER (PARTITION BY session_id, speaker) < 40 AS small FROM {segments} s)
        SELECT l.session_id, l.pos, l.speaker, CASE WHEN NOT small THEN l.speaker WHEN l.start_ms - p.end_ms < 2000 THEN p.speaker ELSE coalesce(n.speaker, p.speaker, l.speaker) END AS new_speaker FROM l
        LEFT JOIN LATERAL (SELECT speaker, end_ms FROM l k WHERE k.session_id = l.session_id AND NOT k.small AND (k.start_ms < l.start_ms OR k.start_ms = l.start_ms AND k.pos < l.pos) ORDER BY start_ms DESC, pos DESC LIMIT 1) p ON true
        LEFT JOIN LATERAL (SELECT speaker FROM l k WHERE k.session_id = l.session_id AND NOT k.small AND (k.start_ms > l.start_ms OR k.start_ms = l.start_ms AND k.pos > l.pos) ORDER BY start_ms, pos LIMIT 1) n ON true""",
    "name_votes": f"SELECT * FROM {VOTES} v",
    "name_votes_elimination": f"""WITH v AS (SELECT * FROM {VOTES} v), o AS (SELECT session_id, min(cluster) AS cluster FROM (SELECT DISTINCT session_id, CAST(cluster AS BIGINT) AS cluster FROM {{turns}} t) c
        WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.session_id = c.session_id AND v.cluster = c.cluster) GROUP BY session_id HAVING count(*) = 1),
        f AS (SELECT session_id, min(speaker) AS name FROM (SELECT DISTINCT session_id, speaker FROM {{segments}} s) n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.session_id = n.session_id AND v.name = n.speaker) GROUP BY session_id HAVING count(*) = 1)
        SELECT session_id, cluster, name, 'votes' AS how FROM v UNION ALL SELECT o.session_id, o.cluster, f.name, 'elimination' FROM o JOIN f ON o.session_id = f.session_id""",
    "tile_majority": f"""SELECT user_id, day, tile, n, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, tile) AS rn FROM
        (SELECT *, CAST(SUM(n) OVER (PARTITION BY user_id, day) AS BIGINT) AS total FROM (SELECT user_id, CAST(floor(t / 86400000) AS BIGINT) AS day, tile, CAST(count(*) AS BIGINT) AS n FROM {BLANKED} b GROUP BY ALL) c) d WHERE tile IS NOT NULL) e WHERE rn = 1 AND n * 3 >= total * 2""",
    "event_sessions": """SELECT user_id, stretch, min(t) AS start_ms, max(t) AS end_ms, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CAST(SUM(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) - 1 AS stretch FROM
        (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 43200000 THEN 0 ELSE 1 END AS f FROM {event_ms} e) a) b GROUP BY user_id, stretch""",
    "tumbling_counts": "SELECT CAST(floor(t / 3600000) AS BIGINT) * 3600000 AS window_ms, event_type, CAST(count(*) AS BIGINT) AS n, round(SUM(value), 4) AS total, max(value) AS largest FROM {event_ms} e GROUP BY 1, 2",
    "sliding_counts": "SELECT k * 7200000 AS window_ms, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM (SELECT user_id, CAST(floor(t / 7200000) AS BIGINT) - unnest([0, 1, 2]) AS k FROM {event_ms} e) x GROUP BY k",
    "overlap_contingency": f"SELECT * FROM {CONTINGENCY} c",
    "purity_coverage": f"""WITH c AS (SELECT * FROM {CONTINGENCY} c) SELECT t.session_id, t.total, round(h.pure / t.total, 6) AS purity, round(r.covered / t.total, 6) AS coverage FROM (SELECT session_id, CAST(SUM(frames) AS BIGINT) AS total FROM c GROUP BY 1) t
        JOIN (SELECT session_id, SUM(m) AS pure FROM (SELECT session_id, hyp, max(frames) AS m FROM c GROUP BY 1, 2) x GROUP BY 1) h ON t.session_id = h.session_id JOIN (SELECT session_id, SUM(m) AS covered FROM (SELECT session_id, ref, max(frames) AS m FROM c GROUP BY 1, 2) x GROUP BY 1) r ON t.session_id = r.session_id""",
    "speaker_confusion": CONFUSION,
    "detection_score": """SELECT session_id, CAST(count(*) AS BIGINT) AS lines, CAST(SUM(n_words) AS BIGINT) AS words, CAST(count(CASE WHEN heard THEN 1 END) AS BIGINT) AS heard, CAST(coalesce(SUM(CASE WHEN heard THEN n_words END), 0) AS BIGINT) AS heard_words FROM
        (SELECT l.*, EXISTS (SELECT 1 FROM {ext_spans} e WHERE e.session_id = l.session_id AND e.start_ms < least(l.end_ms, l.start_ms + greatest(1000, l.n_words * 400)) + 500 AND l.start_ms - 500 < e.end_ms) AS heard FROM {segments} l) x GROUP BY session_id""",
    "quick_exchanges": f"SELECT session_id, pos, role AS speaker, n_words, cluster >= 0 AS found FROM (SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY start_ms, pos) AS b, lead(role) OVER (PARTITION BY session_id ORDER BY start_ms, pos) AS a FROM {ATTRIBUTED} x) y WHERE n_words <= 20 AND end_ms - start_ms <= 9000 AND b <> role AND a <> role",
    "turn_buckets_rollup": f"""SELECT bucket, CAST(grouping(bucket) AS BIGINT) AS is_total, CAST(count(*) AS BIGINT) AS lines, CAST(SUM(n_words) AS BIGINT) AS words, CAST(count(CASE WHEN cluster >= 0 THEN 1 END) AS BIGINT) AS attributed FROM
        (SELECT *, CASE WHEN n_words <= 3 THEN '1-3' WHEN n_words <= 15 THEN '4-15' WHEN n_words <= 60 THEN '16-60' ELSE '61+' END AS bucket FROM {ATTRIBUTED} a) b GROUP BY ROLLUP (bucket)""",
    "min_gap_thin": THIN,
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
