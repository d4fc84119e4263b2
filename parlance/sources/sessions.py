"""Session files: JSON documents with nested lines, look logs, external transcripts, calendars; reading, listing, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
SEGMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("live_speaker", T.StringType()),
        T.StructField("shown_speaker", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("end_time", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("words", T.ArrayType(WORD)),
    ]
)
SESSION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("platform", T.StringType()),
        T.StructField("segments", T.ArrayType(SEGMENT)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
LOOK = T.StructType([T.StructField("id", T.LongType()), T.StructField("time", T.TimestampType()), T.StructField("stage", T.StringType()), T.StructField("name", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("window", T.StringType())])
TURN = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("offset", T.DoubleType()), T.StructField("text", T.StringType())])
EXTERNAL = T.StructType([T.StructField("writer", T.StringType()), T.StructField("source", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType()), T.StructField("turns", T.ArrayType(TURN))])
PERSON = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])
CALENDAR = T.StructType([T.StructField("writer", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("organizer", PERSON), T.StructField("invitees", T.ArrayType(PERSON))])

#: Most turns of an external transcript and invitees of a calendar entry; offsets beyond a day are dropped.
MOST_TURNS, MOST_INVITEES, MOST_OFFSET = 100_000, 2000, 86_400.0


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions below path, newest first (a sort by ranges, which readers that do not need it lose to the optimizer); unreadable
    files are left out."""
    x = spark.read.schema(SESSION).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return x.filter(F.col("id").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record").orderBy(F.col("created_at").desc_nulls_last(), "id")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """One folder a session; Spark's commit protocol makes it all or nothing."""
    sessions.withColumn("session", F.col("id")).write.mode("overwrite").partitionBy("session").json(path)


def resolve_ids(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes (prefix) with `id` and `found`: the id (of ids (id)) that is the prefix, else the only one that begins with it ('one');
    null for 'none' and 'several'. Ids are joined by their beginnings, so no prefix meets all of them."""
    heads = ids.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1))), lambda n: F.substring("id", 1, n))).alias("prefix"))
    x = prefixes.join(heads, "prefix", "left").groupBy("prefix").agg(F.count("id").alias("_n"), F.min("id").alias("_one"), F.max((F.col("id") == F.col("prefix")).cast("int")).alias("_exact"))
    found = F.when((F.col("_exact") == 1) | (F.col("_n") == 1), "one").when(F.col("_n") == 0, "none").otherwise("several")
    return x.select("prefix", F.when(F.col("_exact") == 1, F.col("prefix")).when(F.col("_n") == 1, F.col("_one")).alias("id"), found.alias("found"))


def resolve_id(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session of this id, or the only one that begins so; several matches raise an error when run, none give no rows."""
    hit = resolve_ids(sessions.select("id"), sessions.sparkSession.createDataFrame([(prefix,)], "prefix string")).filter("found <> 'none'")
    fine = F.when(F.col("found") == "one", F.col("id")).otherwise(F.raise_error(F.lit(f"several sessions begin with {prefix}")))
    return sessions.join(F.broadcast(hit.select(fine.alias("id"))), "id")


def delete_session(spark: SparkSession, path: str, prefix: str) -> str | None:
    """Deletes the folder of the session of this id, or of the only one that begins so; its id, None if there is none."""
    hit = resolve_id(read_sessions(spark, path), prefix).select("id").first()
    if hit is None:
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/session={hit['id']}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return hit["id"]


def segments(sessions: DataFrame) -> DataFrame:
    """A row per line, in order of start."""
    x = sessions.select(F.col("id").alias("session_id"), F.posexplode("segments").alias("pos", "s"))
    return x.select("session_id", "pos", "s.*")


def words(sessions: DataFrame) -> DataFrame:
    x = segments(sessions).select("session_id", "id", F.posexplode("words").alias("w_pos", "w"))
    return x.select("session_id", "id", "w_pos", "w.*")


def read_looks(spark: SparkSession, path: str) -> DataFrame:
    """A log of looks, one JSON object a line; malformed lines are left out."""
    return spark.read.schema(LOOK).option("mode", "DROPMALFORMED").json(path).filter("id IS NOT NULL")


def write_looks(looks: DataFrame, path: str) -> None:
    """Looks added to a log, one JSON object a line."""
    looks.write.mode("append").json(path)


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Places in a transcript to listen to, one JSON object a line; malformed lines are left out."""
    return spark.read.schema("before string, words string, after string, pos double").option("mode", "DROPMALFORMED").json(path).filter("words IS NOT NULL")


def read_external(spark: SparkSession, path: str, writers: list[str]) -> DataFrame:
    """Turns of external transcripts of known writers: (path, pos, speaker, offset, text, n), n in order of offset.

    Speakers are cleaned. Turns without one, or with an offset that is no number, negative or beyond a day, are dropped. A file
    of more than MOST_TURNS turns is not one of a meeting and is left out whole.
    """
    x = spark.read.schema(EXTERNAL).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    x = x.filter(F.col("writer").isin(writers) & (F.size("turns") <= MOST_TURNS)).select("path", F.posexplode("turns").alias("pos", "t")).select("path", "pos", clean_name(F.col("t.speaker"), 200).alias("speaker"), "t.offset", "t.text")
    fine = (F.col("speaker") != "") & ~F.isnan("offset") & (F.col("offset") >= 0) & (F.col("offset") <= MOST_OFFSET)
    return x.filter(fine).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("offset", "pos")))


def distinct_names(names: DataFrame, by: list[str], pos: str, name: str) -> DataFrame:
    """First of each name regardless of case."""
    w = Window.partitionBy(*by, F.lower(name)).orderBy(pos)
    return names.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def read_invitees(spark: SparkSession, path: str, writers: list[str]) -> DataFrame:
    """(path, pos, name): organizer and invitees, cleaned, each once."""
    x = spark.read.schema(CALENDAR).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path")).filter(F.col("writer").isin(writers))
    people = F.slice(F.concat(F.array("organizer"), F.coalesce("invitees", F.array().cast(T.ArrayType(PERSON)))), 1, MOST_INVITEES)
    rows = x.select("path", F.posexplode(people).alias("pos", "p")).select("path", "pos", clean_name(F.col("p.name")).alias("name")).filter("name <> ''")
    return distinct_names(rows, ["path"], "pos", "name")


def clean_name(name: Column, limit: int = 100) -> Column:
    """White space to single spaces, unprintable characters out, at most `limit` characters, trimmed."""
    return F.trim(F.substring(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"[\p{C}]", ""), 1, limit))


def subjects(entries: DataFrame, writers: list[str], limit: int = 300) -> DataFrame:
    """(session, subject) of entries (session, kind, writer, subject, title): what a session is called by its 'calendar' entry, else by its
    'title' entry, both of known writers only; one line, at most `limit` characters."""
    one_line = lambda c: F.trim(F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, limit))
    text = F.when(F.col("kind") == "calendar", one_line(F.col("subject"))).otherwise(one_line(F.col("title")))
    found = entries.withColumn("_s", text).filter(F.col("writer").isin(writers) & (F.col("_s") != ""))
    return found.groupBy("session").agg(F.min(F.struct("kind", "_s"))["_s"].alias("subject"))


def read_subjects(spark: SparkSession, path: str, writers: list[str]) -> DataFrame:
    """subjects() of the calendar.json and title.json files below folders session=<id>."""
    x = spark.read.schema("writer string, subject string, title string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{calendar,title}*.json").json(path)
    file = F.col("_metadata.file_path")
    return subjects(x.withColumn("session", F.regexp_extract(file, r"session=([^/]+)/", 1)).withColumn("kind", F.regexp_extract(file, r"/(calendar|title)[^/]*$", 1)), writers)
