"""Queries on labels while a session goes on, on plans of renames, and on looks at the meeting window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import labels
from parlance.operators import attribution, joins, live, scoring
from parlance.plans import timeline
from parlance.plans.views import duckdb, load

#: Lines of this many ms count as short here, as few lines of the tables have two words.
SHORT = 12_000


def _same(a: str, b: str) -> str:
    """same_name in SQL, for names that are alike only if equal or cut short."""
    a, b = f"lower({a})", f"lower({b})"
    return f"({a} = {b} OR (least(strlen({a}), strlen({b})) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))) OR (least(strlen({a}), strlen({b})) >= 5 AND levenshtein({a}, {b}) <= greatest(1, greatest(strlen({a}), strlen({b})) // 8)))"


def short_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines of others that the window names alone, with the label of the one speaker of that name."""
    return live.short_line_labels(load(spark, sf_dir, "segments"), load(spark, sf_dir, "looks"), load(spark, sf_dir, "people"), SHORT)


SOLE = f"""(SELECT session_id, pos, arg_min(CASE WHEN name <> '' THEN name END, t * 1000 + look_id) AS name FROM
    (SELECT s.session_id, s.pos, l.t, l.look_id, l.name, l.several, first_value(nullif(l.name, '') IGNORE NULLS) OVER (PARTITION BY s.session_id, s.pos ORDER BY l.t, l.look_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f
      FROM {{segments}} s JOIN {{looks}} l ON s.session_id = l.session_id AND l.t BETWEEN s.start_ms - 250 AND s.end_ms + 250
      WHERE s.source = 'monitor' AND s.end_ms - s.start_ms <= {SHORT} AND (l.name <> '' OR l.several)) a
    GROUP BY 1, 2 HAVING bool_and(coalesce(name <> '' AND {_same('f', 'name')}, false)))"""
CARRIED = f"""SELECT n.session_id, n.pos, min(p.label) AS label FROM {SOLE} n JOIN {{people}} p ON p.session_id = n.session_id AND p.name <> '' AND {_same('n.name', 'p.name')} GROUP BY 1, 2 HAVING count(DISTINCT p.label) = 1"""


def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of lines with turns known up to half of each session: by turn, by the window, by what the live label has meant, or new."""
    s, people = load(spark, sf_dir, "segments"), load(spark, sf_dir, "people")
    a = timeline.attribute_lines(spark, sf_dir).filter("cluster >= 0").select("session_id", "pos", "cluster")
    half = s.groupBy("session_id").agg(F.expr("max(end_ms) div 2").alias("through"))
    named = people.select("session_id", F.col("cluster").cast("long"), labels.person_label(F.col("cluster") + 1, F.col("name")).alias("placed"))
    x = s.join(half, "session_id").withColumn("live", F.concat(F.lit("Person "), F.substring("speaker", 2, 9), F.when(F.col("speaker") == "S1", " (Dee)").otherwise("")))
    x = x.join(a.join(named, ["session_id", "cluster"]), ["session_id", "pos"], "left").withColumn("placed", F.when(F.col("end_ms") <= F.col("through"), F.col("placed")))
    votes = x.filter("placed IS NOT NULL").groupBy("session_id", "live", "placed").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    mapped = attribution.top_name(votes, ["session_id", "live"], "placed", "ms").select("session_id", "live", F.col("placed").alias("mapped"))
    hints = live.last_name(s, load(spark, sf_dir, "looks"))
    hinted = live.label_named(hints.withColumnRenamed("hint", "name"), people).select("session_id", "pos", F.col("label").alias("_label"))
    hinted = hinted.join(people.select("session_id", F.col("label").alias("_label"), labels.person_label(F.col("cluster") + 1, F.col("name")).alias("hinted")), ["session_id", "_label"]).drop("_label")
    x = x.join(mapped, ["session_id", "live"], "left").join(hints, ["session_id", "pos"], "left").join(hinted, ["session_id", "pos"], "left")
    label = live.provisional(F.col("placed"), F.col("mapped"), F.col("hinted"), F.col("hint"), F.col("live"), F.col("session_id") % 7 == 0)
    return x.filter(labels.diarizable(F.col("source"), F.col("live"))).select("session_id", "pos", label.alias("label"))


_CASCADE = f"""
    WITH p AS (SELECT session_id, cluster, label, name, label || CASE WHEN name = '' THEN '' ELSE ' (' || name || ')' END AS full_label FROM {{people}} q),
    x AS (SELECT s.session_id, s.pos, s.source, s.start_ms, s.end_ms, 'Person ' || substring(s.speaker, 2) || CASE s.speaker WHEN 'S1' THEN ' (Dee)' ELSE '' END AS live,
        CASE WHEN s.end_ms <= max(s.end_ms) OVER (PARTITION BY s.session_id) // 2 THEN p.full_label END AS placed
      FROM {{segments}} s LEFT JOIN {timeline.ATTRIBUTED} a ON a.session_id = s.session_id AND a.pos = s.pos AND a.cluster >= 0 LEFT JOIN p ON p.session_id = s.session_id AND p.cluster = a.cluster),
    m AS (SELECT session_id, live, placed AS mapped FROM (SELECT *, row_number() OVER (PARTITION BY session_id, live ORDER BY ms DESC, placed) AS r FROM
      (SELECT session_id, live, placed, SUM(end_ms - start_ms) AS ms FROM x WHERE placed IS NOT NULL GROUP BY 1, 2, 3) a) b WHERE r = 1),
    h AS (SELECT s.session_id, s.pos, arg_max(l.name, l.t * 1000 + l.look_id) AS hint FROM {{segments}} s JOIN {{looks}} l ON l.session_id = s.session_id AND l.t BETWEEN s.start_ms AND s.end_ms AND l.name <> '' GROUP BY 1, 2),
    i AS (SELECT h.session_id, h.pos, min(p.full_label) AS hinted FROM h JOIN p ON p.session_id = h.session_id AND p.name <> '' AND {_same('h.hint', 'p.name')} GROUP BY 1, 2 HAVING count(*) = 1),
    b AS (SELECT x.*, h.hint, coalesce(i.hinted, m.mapped, CASE WHEN x.live LIKE '%(Dee)' THEN 'New speaker (Dee)' ELSE 'New speaker' END) AS base FROM x
      LEFT JOIN m ON m.session_id = x.session_id AND m.live = x.live LEFT JOIN h ON h.session_id = x.session_id AND h.pos = x.pos LEFT JOIN i ON i.session_id = x.session_id AND i.pos = x.pos)
    SELECT session_id, pos, coalesce(placed, CASE WHEN hint IS NULL OR regexp_matches(base, '^Person \\d+ \\(.+\\)$') OR session_id % 7 = 0 THEN base WHEN base = 'New speaker' THEN hint || '?' ELSE base || ' (' || hint || '?)' END) AS label
    FROM b WHERE source <> 'mic'"""


def final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a session: lines get the label of their turn, short ones that of the window, and speakers of few words are absorbed."""
    s, people = load(spark, sf_dir, "segments"), load(spark, sf_dir, "people")
    a = timeline.attribute_lines(spark, sf_dir)
    short = short_line_labels(spark, sf_dir).withColumnRenamed("label", "short")
    x = s.drop("speaker").join(a, ["session_id", "pos"]).join(people.select("session_id", F.col("cluster").cast("long"), "label"), ["session_id", "cluster"], "left").join(short, ["session_id", "pos"], "left")
    x = x.withColumn("speaker", F.when(F.col("source") == "mic", "You").otherwise(F.coalesce("short", "label", F.lit(labels.NEW_SPEAKER))))
    return attribution.absorb_small_speakers(x.select("session_id", "pos", "speaker", "n_words", "start_ms", "end_ms"), 40).select("session_id", "pos", "speaker", "new_speaker")


def needs_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.needs_names(load(spark, sf_dir, "turns"), load(spark, sf_dir, "people"))


def planned_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What external names would make of each label: a new label, or why there is none."""
    s = load(spark, sf_dir, "segments").withColumn("label", F.expr("CASE speaker WHEN 'S0' THEN 'Person 1' WHEN 'S1' THEN CASE WHEN session_id % 3 = 0 THEN 'Person 1 (N0)' ELSE 'Bob' END ELSE 'Speaker' END"))
    present = s.select("session_id", "label").distinct()
    order = s.groupBy("session_id", "label").agg(F.min("pos").alias("first")).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("first")).cast("long"))
    x = order.withColumn("proposed", F.expr("CASE WHEN label = 'Person 1' THEN 'N0' WHEN session_id % 4 = 0 THEN 'N0' ELSE 'N' || CAST(place AS STRING) END")).withColumn("changes", ~((F.col("label") == "Bob") & (F.col("session_id") % 2 == 0)))
    return live.planned_renames(x.drop("first"), present)


_RENAMES = """
    WITH s AS (SELECT session_id, pos, CASE speaker WHEN 'S0' THEN 'Person 1' WHEN 'S1' THEN CASE WHEN session_id % 3 = 0 THEN 'Person 1 (N0)' ELSE 'Bob' END ELSE 'Speaker' END AS label FROM {segments} s),
    o AS (SELECT session_id, label, row_number() OVER (PARTITION BY session_id ORDER BY min(pos)) AS place FROM s GROUP BY 1, 2),
    x AS (SELECT *, CASE WHEN label = 'Person 1' THEN 'N0' WHEN session_id % 4 = 0 THEN 'N0' ELSE 'N' || place END AS proposed, NOT (label = 'Bob' AND session_id % 2 = 0) AS changes FROM o),
    n AS (SELECT *, CASE WHEN changes THEN 'Person ' || (CASE WHEN prefix(label, 'Person') THEN 1 ELSE coalesce((SELECT max(1) FROM o q WHERE q.session_id = x.session_id AND prefix(q.label, 'Person')), 0)
        + (SELECT count(*) FROM x y WHERE y.session_id = x.session_id AND y.place <= x.place AND y.changes AND NOT prefix(y.label, 'Person')) END) || ' (' || proposed || ')' END AS new FROM x),
    b AS (SELECT n.*, EXISTS (SELECT 1 FROM o WHERE o.session_id = n.session_id AND o.label = n.new) OR EXISTS (SELECT 1 FROM n m WHERE m.session_id = n.session_id AND m.new = n.new AND m.place < n.place) AS blocked FROM n)
    SELECT session_id, place, label, proposed, changes, CASE WHEN changes AND new <> label AND NOT blocked THEN new END AS new_label,
      CASE WHEN changes AND new = label THEN 'agree' WHEN changes AND blocked THEN 'new label already in use' END AS reason FROM b"""


def windowed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words labelled by the window of four seconds around them whose middle is nearest, windows starting every two and a half seconds
    of a line (every seventh missing), and whether that changes the line's label."""
    s = load(spark, sf_dir, "segments")
    windows = s.select("session_id", "pos", "role", F.explode(F.sequence(F.col("start_ms"), F.col("end_ms"), F.lit(2500).cast("long"))).alias("w_start")).filter("w_start % 7 <> 0")
    windows = windows.select("session_id", "pos", "w_start", (F.col("w_start") + 4000).alias("w_end"), F.concat("role", (F.expr("w_start div 2500") % 2).cast("string")).alias("w_label"))
    words = load(spark, sf_dir, "words").join(s.select("session_id", "pos", F.col("role").alias("label")), ["session_id", "pos"])
    x = live.nearest_window(words, windows, ["session_id", "pos"])
    return x.groupBy("session_id", "pos").agg(F.count(F.lit(1)).alias("words"), F.sum((F.col("label") != F.col("windowed")).cast("long")).alias("relabeled"), F.sum(F.endswith("windowed", F.lit("1")).cast("long")).alias("odd"))


_WINDOWED = """
    WITH w AS (SELECT session_id, pos, w_start, w_start + 4000 AS w_end, role || CAST(w_start // 2500 % 2 AS VARCHAR) AS w_label FROM (SELECT session_id, pos, role, unnest(range(start_ms, end_ms + 1, 2500)) AS w_start FROM {segments} s) a WHERE w_start % 7 <> 0),
    x AS (SELECT d.session_id, d.pos, d.w_pos, s.role AS label, (SELECT w_label FROM w WHERE w.session_id = d.session_id AND w.pos = d.pos AND (d.start_ms + d.end_ms) // 2 BETWEEN w_start AND w_end ORDER BY abs(2 * ((d.start_ms + d.end_ms) // 2) - w_start - w_end), w_start LIMIT 1) AS windowed
      FROM {words} d JOIN {segments} s ON s.session_id = d.session_id AND s.pos = d.pos)
    SELECT session_id, pos, CAST(count(*) AS BIGINT) AS words, CAST(count(CASE WHEN windowed <> label THEN 1 END) AS BIGINT) AS relabeled, CAST(count(CASE WHEN suffix(coalesce(windowed, label), '1') THEN 1 END) AS BIGINT) AS odd FROM x GROUP BY 1, 2"""


def highlight_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of others cut where the window's name changes, pieces of four seconds at least."""
    looks = load(spark, sf_dir, "looks").filter("name <> ''")
    w = Window.partitionBy("session_id").orderBy("t", "look_id")
    changes = looks.withColumn("_p", F.lag("name").over(w)).filter("_p <> name").select("session_id", F.explode(F.array(F.col("t"), F.col("t") + 3000, F.col("t") + 9000)).alias("t"))
    lines = load(spark, sf_dir, "segments").filter("source = 'monitor'")
    return live.cut_at_changes(lines, changes, 4000)


_CUTS = """
    WITH RECURSIVE c AS (SELECT DISTINCT session_id, t + unnest([0, 3000, 9000]) AS t FROM (SELECT *, lag(name) OVER (PARTITION BY session_id ORDER BY t, look_id) AS p FROM {looks} l WHERE name <> '') a WHERE p <> name),
    r AS (SELECT session_id, pos, end_ms, start_ms AS t, 0 AS k FROM {segments} s WHERE source = 'monitor'
      UNION ALL SELECT r.session_id, r.pos, r.end_ms, min(c.t), r.k + 1 FROM r JOIN c ON c.session_id = r.session_id AND c.t - r.t >= 4000 AND r.end_ms - c.t >= 4000 GROUP BY r.session_id, r.pos, r.end_ms, r.k)
    SELECT session_id, pos, t FROM r WHERE k > 0"""


def reference_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much later the words of a recording are than the turns of its reference: the middle of the differences at each turn's first word."""
    words = load(spark, sf_dir, "words").groupBy("session_id", "pos").agg(F.min(F.struct("w_pos", "start_ms"))["start_ms"].alias("heard"))
    turns = load(spark, sf_dir, "ext_spans").join(load(spark, sf_dir, "turns").select("session_id", F.col("turn_pos").alias("pos"), (F.col("start_ms") + 37_000).alias("start_ms")), ["session_id", "start_ms"])
    d = words.join(turns, ["session_id", "pos"]).select("session_id", (F.col("heard") - F.col("start_ms")).alias("d"))
    return scoring.middle(d, ["session_id"], "d").withColumnRenamed("d", "offset_ms")


def sliced_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that start in the second half minute, from its beginning and cut at its end, two seconds later."""
    t = load(spark, sf_dir, "turns").select("session_id", "turn_pos", "start_ms", "end_ms")
    return scoring.shifted(scoring.sliced(t, 30_000, 60_000), 2000)


def hint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read against the speakers of the reference at that time: looks and disagreements per minute, the eight worst minutes of all."""
    looks = load(spark, sf_dir, "looks").filter("name <> ''").withColumn("at", F.col("t") + 20_000)
    spans = load(spark, sf_dir, "turns").select("session_id", F.expr("CASE cluster WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Kimura' ELSE 'Cleo' END").alias("who"), "start_ms", "end_ms")
    hit = joins.point_join(looks, spans, ["session_id"], "at")
    x = hit.groupBy("session_id", "look_id", "at").agg(F.bool_or(F.col("who") == F.col("name")).alias("right"))
    per = x.groupBy(F.expr("at div 60000").alias("minute")).agg(F.count(F.lit(1)).alias("looks"), F.sum((~F.col("right")).cast("long")).alias("wrong"))
    return per.orderBy(F.col("wrong").desc(), "minute").limit(8)


def confused_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a name read and another one speaking, most frequent first: the ten topmost."""
    looks = load(spark, sf_dir, "looks").filter("name <> ''").withColumn("at", F.col("t") + 20_000)
    spans = load(spark, sf_dir, "turns").select("session_id", F.expr("CASE cluster WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Kimura' ELSE 'Cleo' END").alias("who"), "start_ms", "end_ms")
    x = joins.point_join(looks, spans, ["session_id"], "at").select("session_id", "look_id", "name", "who").distinct()
    right = x.filter("name = who").select("session_id", "look_id")
    n = x.join(right, ["session_id", "look_id"], "left_anti").groupBy("name", "who").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "name", "who").limit(10)


QUERIES = [short_line_labels, label_cascade, final_labels, needs_names, planned_renames, windowed_labels, highlight_cuts, reference_offset, sliced_reference, hint_report, confused_names]

_HEARD = "(SELECT l.session_id, l.look_id, l.t + 20000 AS heard, l.name, CASE t.cluster WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Kimura' ELSE 'Cleo' END AS who FROM {looks} l JOIN {turns} t ON t.session_id = l.session_id AND l.t + 20000 >= t.start_ms AND l.t + 20000 < t.end_ms WHERE l.name <> '')"
_SQL = {
    "short_line_labels": CARRIED,
    "label_cascade": _CASCADE,
    "final_labels": f"""WITH x AS (SELECT a.session_id, a.pos, a.n_words, a.start_ms, a.end_ms, CASE WHEN a.role = 'user' THEN 'You' ELSE coalesce(q.label, p.label, 'New speaker') END AS speaker
        FROM {timeline.ATTRIBUTED} a LEFT JOIN {{people}} p ON p.session_id = a.session_id AND p.cluster = a.cluster LEFT JOIN ({CARRIED}) q ON q.session_id = a.session_id AND q.pos = a.pos)
        """ + timeline._SQL["absorb_small"].replace("WITH l AS", ", l AS").replace("{segments} s", "x"),
    "needs_names": "SELECT session_id, bool_or(recent AND nobody) AS needs FROM (SELECT t.session_id, t.end_ms >= max(t.end_ms) OVER (PARTITION BY t.session_id) - 60000 AS recent, NOT EXISTS (SELECT 1 FROM {people} p WHERE p.session_id = t.session_id AND p.cluster = t.cluster AND p.name <> '') AS nobody FROM {turns} t) a GROUP BY 1",
    "planned_renames": _RENAMES,
    "windowed_labels": _WINDOWED,
    "highlight_cuts": _CUTS,
    "reference_offset": "SELECT session_id, list_sort(list(d))[len(list(d)) // 2 + 1] AS offset_ms FROM (SELECT t.session_id, w.start_ms - t.start_ms - 37000 AS d FROM {turns} t JOIN {words} w ON w.session_id = t.session_id AND w.pos = t.turn_pos AND w.w_pos = 0) a GROUP BY 1",
    "sliced_reference": "SELECT session_id, turn_pos, start_ms - 28000 AS start_ms, least(end_ms, 60000) - 28000 AS end_ms FROM {turns} t WHERE start_ms >= 30000 AND start_ms < 60000",
    "hint_report": f"SELECT heard // 60000 AS minute, CAST(count(*) AS BIGINT) AS looks, CAST(count(CASE WHEN NOT ok THEN 1 END) AS BIGINT) AS wrong FROM (SELECT session_id, look_id, min(heard) AS heard, bool_or(name = who) AS ok FROM {_HEARD} h GROUP BY 1, 2) a GROUP BY 1 ORDER BY wrong DESC, minute LIMIT 8",
    "confused_names": f"SELECT name, who, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT session_id, look_id, name, who FROM {_HEARD} h WHERE NOT EXISTS (SELECT 1 FROM {_HEARD} g WHERE g.session_id = h.session_id AND g.look_id = h.look_id AND g.name = g.who)) a GROUP BY 1, 2 ORDER BY n DESC, name, who LIMIT 10",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
