"""Queries on sessions as files and tables: saving and reading, ids, external transcripts, calendars, logs, the live feed, names and settings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import labels
from parlance.operators import names
from parlance.plans.live import _same
from parlance.plans.views import duckdb, load
from parlance.runtime import read_table, shared_dir
from parlance.sources import sessions, transcripts

WRITERS = ["calendar app"]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/parlance/store-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the conversations, saved as sessions."""
    w = load(spark, sf_dir, "words").groupBy("session_id", "pos").agg(F.sort_array(F.collect_list(F.struct("w_pos", F.col("word").alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end")))).alias("_w"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    s = load(spark, sf_dir, "segments").join(w, ["session_id", "pos"])
    seg = F.struct(F.col("pos"), F.concat(F.lit("seg-"), text("pos")).alias("id"), "speaker", none.alias("live_speaker"), none.alias("shown_speaker"), "source", "text", (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), F.lit("").alias("status"), F.transform("_w", lambda x: x.dropFields("w_pos")).alias("words"))
    x = s.groupBy("session_id").agg(F.sort_array(F.collect_list(seg)).alias("_s"), F.max("end_ms").alias("_end"))
    x = x.select(F.concat(F.lit("s"), text("session_id")).alias("id"), F.concat(F.lit("Talk "), text("session_id")).alias("title"), F.timestamp_seconds(F.col("session_id") * 3600).alias("created_at"), (F.col("_end") / 1000).alias("duration"), F.lit("zoom").alias("platform"), F.transform("_s", lambda x: x.dropFields("pos")).alias("segments"))
    folder = _folder(spark)
    sessions.write_sessions(x, folder)
    return folder


def saved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as files and read again: lines, words, lengths."""
    found = sessions.read_sessions(spark, _saved(spark, sf_dir))
    lines = sessions.segments(found).groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.max("end_time") * 1000).cast("long").alias("end_ms"), F.max(F.struct("pos", "text"))["text"].alias("last"))
    words = sessions.words(found).groupBy("session_id").agg(F.count(F.lit(1)).alias("words"), F.round(F.max(F.col("end") - F.col("start")) * 1000).cast("long").alias("longest"))
    return found.select(F.col("id").alias("session_id"), "title", F.round(F.col("duration") * 1000).cast("long").alias("duration_ms")).join(lines, "session_id").join(words, "session_id")


def resolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by their beginnings."""
    ids = load(spark, sf_dir, "segments").select(F.col("session_id").cast("string").alias("id")).distinct()
    asked = ids.select(F.explode(F.array(F.col("id"), F.expr("left(id, 2)"), F.concat("id", F.lit("x")), F.expr("left(id, 1)"))).alias("prefix")).distinct()
    return sessions.resolve_ids(ids, asked)


def external_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External transcripts, a file a session, read as turns: those without a speaker or with an impossible time left out."""
    t = load(spark, sf_dir, "turns").withColumn("speaker", F.expr("CASE WHEN turn_pos % 7 = 3 THEN ' ' ELSE concat(' N', cluster, '\\t ', 'x') END")).withColumn("offset", F.expr("CASE WHEN turn_pos % 5 = 4 THEN -1.0D WHEN turn_pos % 11 = 10 THEN 90000.0D ELSE (start_ms - 2000 * turn_pos) / 1000 END"))
    turn = F.struct("turn_pos", "speaker", "offset", F.concat(F.lit("t"), F.col("turn_pos").cast("string")).alias("text"))
    x = t.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda r: r.dropFields("turn_pos")).alias("turns"))
    x = x.select("session_id", F.when(F.col("session_id") % 6 == 5, "other").otherwise(WRITERS[0]).alias("writer"), F.lit("meeting").alias("source"), "turns")
    folder = _folder(spark)
    x.withColumn("session", F.col("session_id")).drop("session_id").write.partitionBy("session").json(folder)
    found = sessions.read_external(spark, f"{folder}/*", WRITERS)
    return found.select(F.regexp_extract("path", r"session=(\d+)", 1).cast("long").alias("session_id"), F.col("n").cast("long").alias("n"), "speaker", "offset", "text")


def calendar_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizers and invitees of calendar entries, each once, in order."""
    c = read_table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("k"), F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("  "), (F.col("c_custkey") % 3).cast("string"), F.lit(" ")).alias("name"))
    person = F.struct("k", "name", F.lit("").alias("email"))
    x = c.groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(person)), lambda p: p.dropFields("k")).alias("people"))
    x = x.select(F.col("c_nationkey").alias("session"), F.when(F.col("c_nationkey") % 4 == 3, "other").otherwise(WRITERS[0]).alias("writer"), F.element_at("people", 1).alias("organizer"), F.slice("people", 2, 2000).alias("invitees"))
    folder = _folder(spark)
    x.write.partitionBy("session").json(folder)
    found = sessions.read_invitees(spark, f"{folder}/*", WRITERS)
    w = Window.partitionBy("path").orderBy("pos")
    return found.select(F.regexp_extract("path", r"session=(\d+)", 1).cast("long").alias("session_id"), F.row_number().over(w).cast("long").alias("place"), "name")


def session_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sessions are called: by the calendar, else by a generated title."""
    s = load(spark, sf_dir, "segments").groupBy("session_id").agg(F.min(F.struct("pos", "text"))["text"].alias("text"))
    writer = F.when(F.col("session_id") % 7 == 6, "other").otherwise(WRITERS[0])
    folder = _folder(spark)
    entries = s.select(F.col("session_id").alias("session"), writer.alias("writer"), F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("  Plan\n of "), F.col("session_id").cast("string"))).otherwise(" ").alias("subject"))
    given = s.filter("session_id % 5 <> 0").select(F.col("session_id").alias("session"), F.lit(WRITERS[0]).alias("writer"), F.repeat(F.concat(F.lit("T"), F.col("session_id").cast("string"), F.lit(" ")), 150).alias("title"))
    for name, table in (("calendar", entries), ("title", given)):
        # a folder a kind, with the session in the rows: a folder a session would be as many files as there are sessions
        table.withColumn("session", F.col("session").cast("string")).withColumn("kind", F.lit(name)).write.mode("append").partitionBy("kind").json(folder)
    x = spark.read.schema("session string, writer string, subject string, title string").option("basePath", folder).json(f"{folder}/kind=*")
    return sessions.subjects(x, WRITERS)


def looks_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of looks written in two parts, with lines that are no JSON, read again and counted by stage."""
    e = load(spark, sf_dir, "event_ms").select(F.col("event_id").alias("id"), F.timestamp_millis("t").alias("time"), F.col("event_type").alias("stage"), F.concat(F.lit("N"), (F.col("user_id") % 5).cast("string")).alias("name"))
    folder = _folder(spark)
    for half in (0, 1):
        sessions.write_looks(e.filter(F.col("id") % 2 == half), folder)
    e.filter("id % 50 = 0").select(F.lit('{"id": broken').alias("value")).write.mode("append").text(folder)
    return sessions.read_looks(spark, folder).groupBy("stage", "name").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def parsed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as a transcript with clocks, and read back: turns, how long they last, and where several begin at once."""
    s = load(spark, sf_dir, "segments").withColumn("s", F.expr("start_ms div 1000 div 15 * 15"))
    clock = F.format_string("%d:%02d", F.floor(F.col("s") / 60), F.col("s") % 60)
    line = F.concat(F.lit("Speaker "), F.col("speaker"), F.lit("   "), clock, F.lit("\n"), F.col("text"), F.lit("\n\n"))
    docs = s.groupBy("session_id").agg(F.concat(F.lit("Title\n\n"), transcripts.ordered_text(["pos"], line, "")).alias("value"))
    turns = transcripts.turn_ends(transcripts.parse_transcript(docs.withColumnRenamed("session_id", "path")))
    return turns.select(F.col("path").alias("session_id"), "turn", "speaker", "start", F.round("end", 3).alias("end"), "overlapping", F.length("text").cast("long").alias("chars"))


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followers are told after each event: the version of the line that the session then holds, so that a late partial does
    not take it back; a removal as it is given."""
    e = load(spark, sf_dir, "segment_events")
    w = Window.partitionBy("session_id", "seg_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = e.withColumn("_life", F.sum((F.col("status") == "removed").cast("long")).over(w) - (F.col("status") == "removed").cast("long"))
    life = Window.partitionBy("session_id", "seg_id", "_life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max(F.when(F.col("status") != "removed", F.struct(labels.status_rank(F.col("status")).alias("rank"), "seq", "status", "speaker"))).over(life)
    shown = F.when(F.col("status") == "removed", F.col("seq")).otherwise(held["seq"])
    return x.select("session_id", "seg_id", "seq", shown.alias("shows"), F.when(F.col("status") == "removed", "removed").otherwise(held["status"]).alias("as"))


def relabelled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a saved session computed anew: seconds with a name before and after, and lines that change; given names stay."""
    s = load(spark, sf_dir, "segments").filter("source = 'monitor'").withColumn("old", F.expr("CASE speaker WHEN 'S0' THEN 'Ann' WHEN 'S1' THEN 'Person 2' ELSE 'Person 3 (Bo)' END"))
    x = s.withColumn("new", F.when(labels.given_name(F.col("old")) != "", F.col("old")).otherwise(F.expr("CASE WHEN pos % 4 < 2 THEN 'Person 1 (Cy)' WHEN pos % 4 = 2 THEN 'Person 2' ELSE old END")))
    named = lambda c: F.sum(F.when(labels.speaker_name(F.col(c)) != "", F.col("end_ms") - F.col("start_ms")).otherwise(0)).cast("long")
    return x.groupBy("session_id").agg(named("old").alias("before_ms"), named("new").alias("after_ms"), F.sum((F.col("old") != F.col("new")).cast("long")).alias("changed"))


def taught_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels teach a profile at the end of a session: those that name a person for sure, and that no voice disputes, with eight
    lines at least; and under which name."""
    s = load(spark, sf_dir, "segments").withColumn("label", F.expr("CASE (pos + session_id) % 6 WHEN 0 THEN 'You' WHEN 1 THEN 'Person 1 (Ann)' WHEN 2 THEN 'Person 2' WHEN 3 THEN 'Bo?' WHEN 4 THEN 'Cy' ELSE 'Person 4 (Room 2)' END"))
    disputed = s.filter("session_id % 4 = 0").select("session_id", F.lit("Person 1 (Ann)").alias("label")).distinct()
    x = s.withColumn("name", labels.speaker_name(F.col("label"))).filter("name <> ''").join(disputed, ["session_id", "label"], "left_anti")
    return x.groupBy("session_id", "label", "name").agg(F.count(F.lit(1)).alias("lines")).filter("lines >= 2")


def corrected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice names that users changed: dropped, and held against the profile unless the new name is the same person's."""
    v = load(spark, sf_dir, "people").filter("name <> ''").select("session_id", "label", F.col("name").alias("voice"))
    fixes = v.filter("session_id % 2 = 0").select("session_id", "label", F.expr("CASE session_id % 3 WHEN 0 THEN voice WHEN 1 THEN upper(left(voice, 5)) ELSE 'Dee' END").alias("given"))
    x = v.join(fixes, ["session_id", "label"], "left")
    same = labels.same_name(labels.normalized_name(F.col("voice")), labels.normalized_name(F.col("given")))
    return x.select("session_id", "label", F.when(F.col("given").isNull(), F.col("voice")).alias("voice"), F.coalesce(~same, F.lit(False)).alias("rejected"))


def model_for(setting: Column, lang: Column, known: list[str], english: str) -> Column:
    """The model that a setting means for a language: its own if it is known, else automatic: the English one for English or no
    language, and the first for others."""
    return F.when(setting.isin(known), setting).when(F.coalesce(lang, F.lit("")).isin("", "en"), english).otherwise(known[0])


def models_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that settings need for the languages of documents, each once, in order of first appearance."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(F.lit("auto"), F.lit("wide"), F.lit("gone"))).alias("setting"))
    x = d.select("setting", "doc_id", model_for(F.col("setting"), F.col("lang"), ["base", "wide", "fine"], "fine").alias("model"))
    first = x.groupBy("setting", "model").agg(F.min("doc_id").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("setting").orderBy("first")).cast("long"))


def call_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of calls: who they are titled for, the meeting they are titled for, and whether the toolbar is that of a call of two."""
    p = read_table(spark, sf_dir, "pages").select("page_id")
    kind = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("page_id") % len(options) + 1).cast("int"))
    window = F.concat(kind(["Microsoft Teams — ", "Notes — ", "", "zoom.us — "]), kind(["Alex Kim", "Meeting join | Plan A", "Calendar | x", " ", "Microsoft Teams", "Zoom Meeting"]), kind([" | Microsoft Teams", "", " | Pinned window | Microsoft Teams"]))
    toolbar = kind(["Hold Transfer", "Hold", "dial pad Consult", "HOLD on, dial pad", "Leave"])
    x = p.select("page_id", window.alias("window"), toolbar.alias("toolbar"))
    return x.select("page_id", names.called_person(F.col("window")).alias("person"), names.meeting_name(F.col("window")).alias("meeting"), names.call_toolbar(F.col("toolbar")).alias("call"))


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels say: live label, person, kind, shares, titles; and which two names are one person's."""
    s = load(spark, sf_dir, "segments").select("session_id", "pos")
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (by % len(options) + 1).cast("int"))
    k = F.col("session_id") * 7 + F.col("pos")
    x = s.withColumn("a", pick(_A, k)).withColumn("b", pick(_B, F.floor(k / len(_A)) + F.col("pos")))
    norm = labels.normalized_name
    return x.select(
        "session_id", "pos", labels.live_label(F.when(F.col("pos") % 2 == 0, F.lit("")).otherwise(F.col("b")), F.col("a")).alias("live"), labels.speaker_name(F.col("a")).alias("person"),
        norm(F.col("a")).alias("plain"), labels.same_name(norm(F.col("a")), norm(F.col("b"))).alias("same"), labels.same_name_loose(F.col("a"), F.col("b")).alias("loose"), sessions.clean_name(F.col("b"), 7).alias("clean"),
        F.split(F.trim("b"), r"\s+")[0].alias("first"), labels.share_bucket((F.col("pos") % 11) / 10).alias("share"), labels.default_title(F.timestamp_seconds(k * 100_000)).alias("title"),
    )


#: Labels and names that meet each other in label_texts.
_A = ["Ann Lee", "Person 3 (Natalia Ram…)", "Person 2", "You", "Room 5 (8)", "natalia ram…", "Person 1 (Bo?)", " Bo ", "New speaker", "Christopher"]
_B = ["ann lee", "Natalia Ramirez", "Bo  Kim", "Kristopher", "Ann", "Room 5", "  Al\tB  c "]

QUERIES = [saved_sessions, resolved_ids, external_turns, calendar_people, session_subjects, looks_log, parsed_transcripts, live_feed, relabelled_sessions, taught_voices, corrected_names, models_needed, call_names, label_texts]


def _pick(options: list[str], by: str) -> str:
    return "[" + ", ".join("'" + o.replace("\t", "' || chr(9) || '") + "'" for o in options) + f"][({by}) % {len(options)} + 1]"


_NORM = lambda c: f"lower(trim(regexp_replace(trim({c}), '[….\"''`,:;!? ]+$', '')))"
_GIVEN = lambda c: f"(trim({c}) NOT IN ('', 'You') AND NOT starts_with(trim({c}), 'Person ') AND NOT starts_with(trim({c}), 'New speaker') AND NOT suffix(trim({c}), '?') AND NOT suffix(trim({c}), '?)') AND NOT regexp_matches(lower({c}), '(^|[^\\p{{L}}])rooms?([^\\p{{L}}]|$)'))"
_SQL = {
    "saved_sessions": """SELECT 's' || session_id AS session_id, 'Talk ' || session_id AS title, max(end_ms) AS duration_ms, CAST(count(DISTINCT pos) AS BIGINT) AS lines, max(end_ms) AS end_ms, arg_max(text, pos) AS last, CAST(SUM(n_words) AS BIGINT) AS words,
        (SELECT max(w.end_ms - w.start_ms) FROM {words} w WHERE w.session_id = s.session_id) AS longest FROM {segments} s GROUP BY session_id""",
    "resolved_ids": """WITH i AS (SELECT DISTINCT CAST(session_id AS VARCHAR) AS id FROM {segments} s), p AS (SELECT DISTINCT unnest([id, left(id, 2), id || 'x', left(id, 1)]) AS prefix FROM i),
        x AS (SELECT prefix, count(id) AS n, min(id) AS one, bool_or(id = prefix) AS exact FROM p LEFT JOIN i ON starts_with(id, prefix) GROUP BY 1)
        SELECT prefix, CASE WHEN exact THEN prefix WHEN n = 1 THEN one END AS id, CASE WHEN exact OR n = 1 THEN 'one' WHEN n = 0 THEN 'none' ELSE 'several' END AS found FROM x""",
    "external_turns": """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY "offset", turn_pos) AS n, 'N' || cluster || ' x' AS speaker, "offset", 't' || turn_pos AS text
        FROM (SELECT *, (start_ms - 2000 * turn_pos) / 1000 AS "offset" FROM {turns} t WHERE session_id % 6 <> 5 AND turn_pos % 7 <> 3 AND turn_pos % 5 <> 4 AND turn_pos % 11 <> 10) a WHERE "offset" BETWEEN 0 AND 86400""",
    "calendar_people": """SELECT CAST(n AS BIGINT) AS session_id, row_number() OVER (PARTITION BY n ORDER BY k) AS place, name FROM (SELECT c_nationkey AS n, min(c_custkey) AS k, arg_min(CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || ' ' || (c_custkey % 3), c_custkey) AS name
        FROM customer WHERE c_nationkey % 4 <> 3 GROUP BY c_nationkey, lower(c_mktsegment), c_custkey % 3) a""",
    "session_subjects": """SELECT CAST(session_id AS VARCHAR) AS session, CASE WHEN session_id % 3 = 0 AND session_id % 7 <> 6 THEN 'Plan of ' || session_id ELSE trim(left(repeat('T' || session_id || ' ', 150), 300)) END AS subject FROM (SELECT DISTINCT session_id FROM {segments} s) a
        WHERE session_id % 3 = 0 AND session_id % 7 <> 6 OR session_id % 5 <> 0""",
    "looks_log": "SELECT event_type AS stage, 'N' || (user_id % 5) AS name, CAST(count(*) AS BIGINT) AS n, max(event_id) AS last FROM {events} GROUP BY 1, 2",
    "parsed_transcripts": """WITH s AS (SELECT *, start_ms // 15000 * 15 AS s, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM {segments} g),
        x AS (SELECT *, count(*) OVER (PARTITION BY session_id, s) AS n, row_number() OVER (PARTITION BY session_id, s ORDER BY w DESC, pos) AS r, (SELECT min(o.s) FROM s o WHERE o.session_id = s.session_id AND o.s > s.s) AS next FROM s)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS turn, 'Speaker ' || speaker AS speaker, s AS start, round(CAST(CASE WHEN r > 1 OR next IS NULL THEN s + w / 2.5 + 1 ELSE next END AS DOUBLE), 3) AS "end", n > 1 AS overlapping, length(trim(text)) AS chars FROM x""",
    "live_feed": """WITH e AS (SELECT *, CASE status WHEN 'live' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END AS rank, (SELECT coalesce(max(r.seq), 0) FROM {segment_events} r WHERE r.session_id = e.session_id AND r.seg_id = e.seg_id AND r.status = 'removed' AND r.seq < e.seq) AS born FROM {segment_events} e)
        SELECT session_id, seg_id, seq, CASE WHEN status = 'removed' THEN seq ELSE h.q END AS shows, CASE WHEN status = 'removed' THEN 'removed' ELSE h.s END AS "as" FROM e LEFT JOIN LATERAL
          (SELECT k.seq AS q, k.status AS s FROM e k WHERE k.session_id = e.session_id AND k.seg_id = e.seg_id AND k.seq > e.born AND k.seq <= e.seq AND k.status <> 'removed' ORDER BY k.rank DESC, k.seq DESC LIMIT 1) h ON true""",
    "relabelled_sessions": """WITH x AS (SELECT *, end_ms - start_ms AS d, CASE speaker WHEN 'S0' THEN 'Ann' WHEN 'S1' THEN 'Person 2' ELSE 'Person 3 (Bo)' END AS old FROM {segments} s WHERE source = 'monitor'),
        y AS (SELECT *, CASE WHEN old = 'Ann' THEN old WHEN pos % 4 < 2 THEN 'Person 1 (Cy)' WHEN pos % 4 = 2 THEN 'Person 2' ELSE old END AS new FROM x)
        SELECT session_id, CAST(SUM(CASE WHEN old <> 'Person 2' THEN d ELSE 0 END) AS BIGINT) AS before_ms, CAST(SUM(CASE WHEN new <> 'Person 2' THEN d ELSE 0 END) AS BIGINT) AS after_ms, CAST(count(CASE WHEN old <> new THEN 1 END) AS BIGINT) AS changed FROM y GROUP BY 1""",
    "taught_voices": """SELECT session_id, CASE k WHEN 1 THEN 'Person 1 (Ann)' ELSE 'Cy' END AS label, CASE k WHEN 1 THEN 'Ann' ELSE 'Cy' END AS name, CAST(count(*) AS BIGINT) AS lines FROM (SELECT session_id, (pos + session_id) % 6 AS k FROM {segments} s) a
        WHERE k = 4 OR k = 1 AND session_id % 4 <> 0 GROUP BY session_id, k HAVING count(*) >= 2""",
    "corrected_names": f"""SELECT session_id, label, CASE WHEN g IS NULL THEN name END AS voice, coalesce(NOT {_same('name', 'g')}, false) AS rejected
        FROM (SELECT *, CASE WHEN session_id % 2 = 0 THEN CASE session_id % 3 WHEN 0 THEN name WHEN 1 THEN upper(left(name, 5)) ELSE 'Dee' END END AS g FROM {{people}} p WHERE name <> '') a""",
    "models_needed": """SELECT setting, model, min(doc_id) AS first, row_number() OVER (PARTITION BY setting ORDER BY min(doc_id)) AS place FROM (SELECT doc_id, setting, CASE WHEN setting = 'wide' THEN 'wide' WHEN coalesce(lang, '') IN ('', 'en') THEN 'fine' ELSE 'base' END AS model
        FROM documents, (SELECT unnest(['auto', 'wide', 'gone']) AS setting) s) a GROUP BY 1, 2""",
    "call_names": """WITH x AS (SELECT page_id, ['Microsoft Teams — ', 'Notes — ', '', 'zoom.us — '][page_id % 4 + 1] AS app, ['Alex Kim', 'Meeting join | Plan A', 'Calendar | x', ' ', 'Microsoft Teams', 'Zoom Meeting'][page_id % 6 + 1] AS t, [' | Microsoft Teams', '', ' | Pinned window | Microsoft Teams'][page_id % 3 + 1] AS e,
          page_id % 5 IN (0, 3) AS call FROM pages),
        y AS (SELECT *, trim(regexp_replace(trim(t || e), '\\| Microsoft Teams$', '')) AS p FROM x)
        SELECT page_id, CASE WHEN p = '' OR contains(p, '|') OR lower(p) = 'microsoft teams' THEN '' ELSE p END AS person, CASE WHEN app IN ('', 'Notes — ') OR t IN ('Calendar | x', ' ', 'Microsoft Teams', 'Zoom Meeting') THEN '' ELSE replace(t, 'Meeting join | ', '') END AS meeting, call FROM y""",
    "label_texts": f"""WITH x AS (SELECT session_id, pos, k, {_pick(_A, 'k')} AS a, {_pick(_B, f'k // {len(_A)} + pos')} AS b FROM (SELECT *, session_id * 7 + pos AS k FROM {{segments}} s) y),
        z AS (SELECT *, lower(trim(replace(a, chr(9), ' '))) AS la, lower(trim(replace(b, chr(9), ' '))) AS lb FROM x)
        SELECT session_id, pos, CASE WHEN pos % 2 = 0 THEN a ELSE b END AS live, CASE WHEN {_GIVEN('a')} THEN trim(a) WHEN a = 'Person 3 (Natalia Ram…)' THEN 'Natalia Ram…' ELSE '' END AS person, {_NORM('a')} AS plain, {_same(_NORM('a'), _NORM('b'))} AS same,
          la = lb OR {_same(_NORM('a'), _NORM('b'))} OR (string_split_regex(la, '\\s+')[1] = string_split_regex(lb, '\\s+')[1] AND (NOT contains(la, ' ') OR NOT contains(lb, ' '))) AS loose,
          trim(left(trim(regexp_replace(replace(b, chr(9), ' '), '\\s+', ' ', 'g')), 7)) AS clean, string_split_regex(trim(replace(b, chr(9), ' ')), '\\s+')[1] AS first,
          CASE pos % 11 WHEN 10 THEN '>=0.95' WHEN 9 THEN '>=0.9' WHEN 8 THEN '>=0.8' WHEN 7 THEN '>=0.7' ELSE '<0.7' END AS share, 'Meeting ' || strftime(make_timestamp(k * 100000 * 1000000), '%Y-%m-%d %H:%M') AS title FROM z""",
}
ORACLES = {k: duckdb(v) for k, v in _SQL.items()}
