"""Queries on streams of samples, on words in time, on signals, and on what is seen in frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import signal, timefmt
from parlance.operators import audio, frames
from parlance.plans.views import duckdb, load


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks of samples."""
    return load(spark, sf_dir, "event_ms").select("user_id", "event_id", "t", (F.floor("value") * 7 + 1).alias("samples"))


def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.fixed_windows(_chunks(spark, sf_dir), ["user_id"], ["t", "event_id"], "samples", 512).select("event_id", "windows", "held")


def recluster_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's windows, of 64 samples, are clustered again: every ten, less often from the sixtieth on."""
    n = _chunks(spark, sf_dir).groupBy("user_id").agg(F.floor(F.sum("samples") / 64).alias("windows"))
    return n.select("user_id", "windows", F.explode(audio.recluster_times(F.col("windows"), 10, 60)).alias("at"))


def live_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which word a line first shows, with a second and a half of sound, and how often it changes after that."""
    w = load(spark, sf_dir, "words").withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    return audio.partials(w, ["session_id", "pos"], "w_pos", "ms", 1500)


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of lines in a second pass, counted."""
    s = load(spark, sf_dir, "segments")
    second = F.when(F.col("pos") % 5 == 0, F.lit(" ")).when(F.col("pos") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    what = audio.refined(F.col("n_words") > 20, F.col("text"), second)
    return s.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n"))


def dictation_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a dictation of a session's short lines stops for ten seconds without one."""
    return audio.silent_stop(load(spark, sf_dir, "segments").filter("n_words < 60"), ["session_id"], 10_000)


def spread_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = audio.spread_words(load(spark, sf_dir, "segments"), ["session_id", "pos"])
    return x.select("session_id", "pos", "w_pos", "word", "start_ms", "end_ms")


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut into tokens of three letters and put together again, commas as tokens of their own."""
    w = load(spark, sf_dir, "words").filter("pos < 4")
    cut = F.transform(F.sequence(F.lit(0), F.expr("(length(word) - 1) div 3")), lambda i: F.concat(F.when(i == 0, " ").otherwise(""), F.substring("word", i * 3 + 1, F.lit(3))))
    parts = F.when(F.col("w_pos") % 4 == 3, F.concat(cut, F.array(F.lit(" ,"), F.lit(" ")))).otherwise(cut)
    t = w.select("session_id", "pos", "start_ms", "w_pos", F.posexplode(parts).alias("i", "token")).withColumn("t_pos", F.col("w_pos") * 1000 + F.col("i"))
    return audio.token_words(t.select("session_id", "pos", "t_pos", "token", "start_ms"), ["session_id", "pos"])


def even_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words spread evenly over their line."""
    s = load(spark, sf_dir, "segments").filter("pos < 3")
    m = audio.middles(F.split(F.lower("text"), " "), F.col("start_ms"), F.col("end_ms"))
    return s.select("session_id", "pos", F.posexplode(m).alias("i", "m")).select("session_id", "pos", F.col("i").cast("long").alias("i"), "m.word", F.round("m.at", 3).alias("at"))


def session_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events since the first one of their user less an hour, without a quarter of a second, in whole and as lengths of samples."""
    e = load(spark, sf_dir, "event_ms").withColumn("created", F.min("t").over(Window.partitionBy("user_id")) + 3_600_000)
    ms = audio.session_ms(F.col("t"), F.col("created"), -500)
    return e.select("event_id", ms.alias("ms"), audio.unpadded(ms).alias("unpadded"), F.round(audio.seconds(F.col("value") * 1000), 6).alias("seconds"))


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of windows of ten seconds every four over each line."""
    s = load(spark, sf_dir, "segments")
    return s.select("session_id", "pos", F.explode(signal.chunk_starts(F.col("end_ms") - F.col("start_ms"), 10_000, 4000)).alias("at"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long lines should take by their words, and lengths said as texts, read back."""
    s = load(spark, sf_dir, "segments")
    text = F.concat(F.when(F.col("pos") % 3 > 0, F.concat((F.col("n_words") % 5).cast("string"), F.lit("m"))).otherwise(""), (F.col("n_words") % 90).cast("string"), F.element_at(F.array(F.lit("s"), F.lit("ms"), F.lit("x")), (F.col("pos") % 3 + 1).cast("int")))
    return s.select("session_id", "pos", timefmt.estimated_ms(F.col("n_words")).alias("estimate"), text.alias("said"), F.round(timefmt.parse_duration(text), 3).alias("seconds"))


def filtered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of a user through the high pass, the low pass and the whole chain."""
    e = load(spark, sf_dir, "event_ms").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))), lambda s: s["value"]).alias("x"))
    last = lambda a: F.round(F.element_at(a, -1), 5)
    x = F.col("x")
    chain = signal.pipeline(x, 1000, -20.0)
    return e.select("user_id", last(signal.high_pass(x, 1000, 80.0)).alias("high"), last(signal.low_pass(x, 1000, 80.0)).alias("low"), last(chain).alias("chain"), F.size(F.filter(chain, lambda v: v != 0)).cast("long").alias("kept"))


_FILTERED = """
    WITH RECURSIVE v AS (SELECT user_id, list(value ORDER BY t, event_id) AS x FROM {event_ms} e GROUP BY 1),
    d AS (SELECT user_id, x, list_transform(x, lambda a: a - list_sum(x) / len(x)) AS c, (1 / (2 * pi() * 80)) / (1 / (2 * pi() * 80) + 0.001) AS k FROM v),
    r AS (SELECT user_id, x, c, k, 1 AS i, CAST(x[1] AS DOUBLE) AS high, x[1] * (1 - k) AS low, [CAST(c[1] AS DOUBLE)] AS flat FROM d
      UNION ALL SELECT user_id, x, c, k, i + 1, k * (high + x[i + 1] - x[i]), low + (1 - k) * (x[i + 1] - low), list_append(flat, k * (flat[i] + c[i + 1] - c[i])) FROM r WHERE i < len(x)),
    f AS (SELECT user_id, high, low, list_transform(flat, lambda y: y / list_max(list_transform(flat, lambda z: abs(z)))) AS n FROM r WHERE i = len(x))
    SELECT user_id, round(high, 5) AS high, round(low, 5) AS low, round(CASE WHEN abs(n[len(n)]) >= 0.1 THEN n[len(n)] ELSE 0 END, 5) AS chain, CAST(len(list_filter(n, lambda y: abs(y) >= 0.1)) AS BIGINT) AS kept FROM f"""


def speaker_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of a user in steps: first and last active one, how many, and whether a voice is new at the end."""
    e = load(spark, sf_dir, "event_ms").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))), lambda s: (s["value"] > 45).cast("int")).alias("m"))
    span = frames.span_of(F.col("m"))
    return e.select("user_id", span["first"].cast("long").alias("first"), span["last"].cast("long").alias("last"), span["active"].cast("long").alias("active"), frames.new_voice_at_end(F.col("m"), 4).alias("fresh"))


def speaker_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four speakers each class means, at most three at once."""
    rows = [(k, "".join(map(str, x))) for k, x in enumerate(frames.powerset(4, 3))]
    return spark.createDataFrame(rows, "class bigint, active string")


def greedy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as classes over time: the text without blanks and repeats, and its mean value."""
    e = load(spark, sf_dir, "event_ms").withColumn("c", F.floor(F.col("value") / 30))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    kept = e.withColumn("_p", F.lag("c").over(w)).filter("c > 0 AND (_p IS NULL OR _p <> c)")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "c"))), lambda s: F.substring(F.lit("abcdefghij"), s["c"].cast("int"), F.lit(1))), "")
    return kept.groupBy("user_id").agg(text.alias("text"), F.round(F.avg("value"), 4).alias("mean"))


def look_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon to look at the window again after each look."""
    looks = load(spark, sf_dir, "looks").filter("name <> ''").select("session_id", "look_id", "t", "name").dropDuplicates(["session_id", "t"])
    return audio.polling(looks, ["session_id"], "t", "name", 15_000, 500, 2000).select("session_id", "t", "wait")


def frame_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of eight by eight: the signature of two by two cells, and its difference from the frame before."""
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("long"))
    f = load(spark, sf_dir, "fingerprints").select("vec_id", audio.grid_signature(px, 8, 8, 2, 2, 2).alias("sig"))
    g = f.select((F.col("vec_id") + 1).alias("vec_id"), F.col("sig").alias("before"))
    return f.join(g, "vec_id", "left").select("vec_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"), F.round(audio.signature_difference(F.col("sig"), F.col("before")), 4).alias("difference"))


def lit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as tiles: whose is lit."""
    e = load(spark, sf_dir, "event_ms").select("user_id", F.floor(F.col("t") / 86_400_000).alias("day"), "event_id", F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("name"), F.floor("value").alias("highlight"))
    return audio.lit_tile(e, ["user_id", "day"], "event_id", 80)


def same_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of events beside the next one's of the user: the same tile or not, and whether a label fits into them."""
    box = F.struct((F.col("event_id") % 40).alias("x"), (F.col("event_id") % 23).alias("y"), (60 + F.floor("value") % 9).alias("width"), (30 + F.floor("value") % 11).alias("height"))
    e = load(spark, sf_dir, "event_ms").withColumn("a", box)
    e = e.withColumn("b", F.lead("a").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).filter("b IS NOT NULL")
    return e.select("event_id", audio.same_box(F.col("a"), F.col("b")).alias("same"), (F.col("a.height") >= 35).alias("fits"))


QUERIES = [sample_windows, recluster_schedule, live_partials, second_pass, dictation_stop, spread_words, token_words, even_words, session_clock, window_starts, line_lengths, filtered_values, speaker_masks, speaker_classes, greedy_text, look_again, frame_signatures, lit_tiles, same_tiles]

_CHUNKS = "(SELECT user_id, event_id, t, CAST(floor(value) AS BIGINT) * 7 + 1 AS samples FROM {event_ms} e)"
_BOX = "(SELECT *, event_id % 40 AS x, event_id % 23 AS y, 60 + CAST(floor(value) AS BIGINT) % 9 AS w, 30 + CAST(floor(value) AS BIGINT) % 11 AS h FROM {event_ms} e)"
_SIG = "(SELECT vec_id, [" + ", ".join("(" + " + ".join(f"p[{(y * 4 + b * 2) * 8 + x * 4 + a * 2 + 1}]" for b in range(2) for a in range(2)) + ") // 4" for y in range(2) for x in range(2)) + "] AS sig FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 100) AS BIGINT)) AS p FROM {embeddings}) q)"
_SQL = {
    "sample_windows": f"SELECT event_id, total // 512 - (total - samples) // 512 AS windows, total % 512 AS held FROM (SELECT *, CAST(SUM(samples) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS total FROM {_CHUNKS} c) a",
    "recluster_schedule": f"""WITH RECURSIVE n AS (SELECT user_id, CAST(SUM(samples) AS BIGINT) // 64 AS windows FROM {_CHUNKS} c GROUP BY 1),
        r AS (SELECT user_id, windows, CAST(0 AS BIGINT) AS at FROM n UNION ALL
          SELECT user_id, windows, (SELECT min(k) FROM range(1, 3000) g(k) WHERE k > r.at AND k <= r.windows AND k - r.at >= greatest(10.0, 10.0 * k * k / 3600)) FROM r WHERE EXISTS (SELECT 1 FROM range(1, 3000) g(k) WHERE k > r.at AND k <= r.windows AND k - r.at >= greatest(10.0, 10.0 * k * k / 3600)))
        SELECT user_id, windows, r.at FROM r WHERE r.at > 0""",
    "live_partials": "SELECT session_id, pos, min(w_pos) AS first, CAST(count(*) - 1 AS BIGINT) AS updates FROM (SELECT *, SUM(end_ms - start_ms) OVER (PARTITION BY session_id, pos ORDER BY w_pos) AS ms FROM {words} w) a WHERE ms >= 1500 GROUP BY 1, 2",
    "second_pass": "SELECT CASE WHEN pos % 5 = 0 THEN CASE WHEN n_words > 20 THEN 'removed' ELSE 'nothing' END WHEN pos % 3 = 0 AND upper(text) <> text THEN 'replaced' ELSE 'kept' END AS what, CAST(count(*) AS BIGINT) AS n FROM {segments} s GROUP BY 1",
    "dictation_stop": """WITH l AS (SELECT session_id, end_ms FROM {segments} s WHERE n_words < 60), g AS (SELECT session_id, min(end_ms) AS e FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.session_id = l.session_id AND m.end_ms > l.end_ms AND m.end_ms <= l.end_ms + 10000) GROUP BY 1)
        SELECT g.session_id, e + 10000 AS stop, (SELECT count(*) FROM l WHERE l.session_id = g.session_id AND end_ms <= e) AS heard FROM g""",
    "spread_words": """WITH x AS (SELECT session_id, pos, start_ms, end_ms, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM {segments} s) a),
        y AS (SELECT *, CAST(list_sum(list_transform(ws, lambda w: length(w) + 1)) AS BIGINT) AS n, CAST(list_sum(list_transform(ws[1:i], lambda w: length(w) + 1)) AS BIGINT) AS b FROM x)
        SELECT session_id, pos, CAST(i - 1 AS BIGINT) AS w_pos, ws[i] AS word, start_ms + (end_ms - start_ms) * (b - length(ws[i]) - 1) // n AS start_ms, start_ms + (end_ms - start_ms) * b // n AS end_ms FROM y""",
    "token_words": "SELECT session_id, pos, w_pos, word || CASE WHEN w_pos % 4 = 3 THEN ',' ELSE '' END AS word, start_ms FROM {words} w WHERE pos < 4",
    "even_words": "SELECT session_id, pos, CAST(i - 1 AS BIGINT) AS i, ws[i] AS word, round(start_ms + (end_ms - start_ms) * (i - 0.5) / len(ws), 3) AS at FROM (SELECT *, string_split(lower(text), ' ') AS ws, unnest(range(1, n_words + 1)) AS i FROM {segments} s WHERE pos < 3) a",
    "session_clock": "SELECT event_id, ms, greatest(ms - 250, 0) AS unpadded, round(value * 1000 / 16000, 6) AS seconds FROM (SELECT *, greatest(t - min(t) OVER (PARTITION BY user_id) - 3600500, 0) AS ms FROM {event_ms} e) a",
    "window_starts": "SELECT session_id, pos, k * 4000 AS at FROM {segments} s, range(0, 1000) r(k) WHERE k = 0 OR k * 4000 - 4000 + 10000 < end_ms - start_ms",
    "line_lengths": """SELECT session_id, pos, n_words * 400 + 1000 AS estimate, said, CASE WHEN suffix(said, 'x') THEN NULL ELSE round(coalesce(TRY_CAST(nullif(regexp_extract(said, '^(\\d+)m[0-9]', 1), '') AS DOUBLE), 0) * 60 + n_words % 90 * CASE WHEN suffix(said, 'ms') THEN 0.001 ELSE 1 END, 3) END AS seconds
        FROM (SELECT *, CASE WHEN pos % 3 > 0 THEN (n_words % 5) || 'm' ELSE '' END || (n_words % 90) || ['s', 'ms', 'x'][pos % 3 + 1] AS said FROM {segments} s) a""",
    "filtered_values": _FILTERED,
    "speaker_masks": """WITH m AS (SELECT user_id, list(CASE WHEN value > 45 THEN 1 ELSE 0 END ORDER BY t, event_id) AS m FROM {event_ms} e GROUP BY 1), n AS (SELECT *, len(m) AS n FROM m)
        SELECT user_id, CAST(coalesce(list_position(m, 1), 0) - 1 AS BIGINT) AS first, CAST(CASE WHEN list_contains(m, 1) THEN n - list_position(list_reverse(m), 1) ELSE -1 END AS BIGINT) AS last, CAST(list_sum(m) AS BIGINT) AS active,
          n >= 12 AND list_sum(m[n - 3:n]) >= 1 AND list_sum(m[n - 11:n - 4]) = 0 AS fresh FROM n""",
    "speaker_classes": "SELECT row_number() OVER (ORDER BY a + b + c + d, 1 - a, 1 - b, 1 - c, 1 - d) - 1 AS class, a || '' || b || c || d AS active FROM range(2) x(a), range(2) y(b), range(2) z(c), range(2) w(d) WHERE a + b + c + d <= 3",
    "greedy_text": "SELECT user_id, string_agg(substring('abcdefghij', CAST(c AS INT), 1), '' ORDER BY t, event_id) AS text, round(avg(value), 4) AS mean FROM (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM (SELECT *, CAST(floor(value / 30) AS BIGINT) AS c FROM {event_ms} e) a) b WHERE c > 0 AND p IS DISTINCT FROM c GROUP BY 1",
    "look_again": """WITH l AS (SELECT session_id, t, min(name) AS name, lag(min(name)) OVER (PARTITION BY session_id ORDER BY t) AS p FROM {looks} l WHERE name <> '' GROUP BY 1, 2)
        SELECT session_id, t, CAST(CASE WHEN t - (SELECT max(m.t) FROM l m WHERE m.session_id = l.session_id AND m.t <= l.t AND m.p <> m.name) <= 15000 THEN 500 ELSE 2000 END AS BIGINT) AS wait FROM l""",
    "frame_signatures": f"WITH s AS (SELECT * FROM {_SIG} s) SELECT a.vec_id, array_to_string(a.sig, ',') AS sig, round(CASE WHEN b.sig IS NULL THEN 255.0 ELSE list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: abs(z[1] - z[2]))) / 4 END, 4) AS difference FROM s a LEFT JOIN s b ON b.vec_id = a.vec_id - 1",
    "lit_tiles": """SELECT user_id, day, CASE WHEN max(h) >= 80 THEN 'highlight' WHEN count(*) = 1 THEN 'speaker view' ELSE 'no match' END AS stage, CASE WHEN max(h) >= 80 THEN first(name ORDER BY h DESC, event_id) WHEN count(*) = 1 THEN min(name) END AS name
        FROM (SELECT user_id, CAST(floor(t / 86400000) AS BIGINT) AS day, event_id, event_type || (event_id % 10) AS name, floor(value) AS h FROM {event_ms} e) a GROUP BY 1, 2""",
    "same_tiles": f"""SELECT event_id, abs(x + w // 2 - x2 - w2 // 2) <= 8 AND abs(y + h // 2 - y2 - h2 // 2) <= 8 AND abs(w - w2) <= greatest(4, w // 10) AND abs(h - h2) <= greatest(4, h // 10) AS same, h >= 35 AS fits
        FROM (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(w) OVER o AS w2, lead(h) OVER o AS h2 FROM {_BOX} b WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) a WHERE x2 IS NOT NULL""",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
