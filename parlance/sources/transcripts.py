"""Line-oriented transcripts as a source, and text exports as sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.timefmt import duration, parse_clock, srt_timestamp, timestamp_rounded

#: A header is a name, two spaces or more, and a clock; with one space only for names that were met with two.
STRICT, LOOSE = r"^(.+?)\s{2,}(\d{1,2}(?::\d{2}){1,2})\s*$", r"^(.+?)\s(\d{1,2}(?::\d{2}){1,2})\s*$"


def parse_transcript(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Turns of whole-file texts: path, turn, speaker, start (seconds), text. The first line is a title.

    Text lines belong to the header above them and are joined by spaces.
    """
    lines = files.select(path, F.posexplode(F.split(F.col(value), r"\r?\n")).alias("line", "text")).filter("line > 0")
    strict_name = F.trim(F.regexp_extract("text", STRICT, 1))
    known = lines.filter(strict_name != "").select(path, strict_name.alias("_known")).distinct()
    x = lines.withColumn("_loose", F.trim(F.regexp_extract("text", LOOSE, 1)))
    x = x.join(known.withColumnRenamed(path, "_path"), (F.col(path) == F.col("_path")) & (F.col("_loose") == F.col("_known")), "left").drop("_path")
    strict = F.col("text").rlike(STRICT)
    header = strict | F.col("_known").isNotNull()
    x = x.withColumn("_speaker", F.when(strict, strict_name).when(header, F.col("_loose"))).withColumn("_clock", F.when(strict, F.regexp_extract("text", STRICT, 2)).when(header, F.regexp_extract("text", LOOSE, 2)))
    w = Window.partitionBy(path).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("turn", F.sum(F.col("_clock").isNotNull().cast("long")).over(w) - 1).filter("turn >= 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_clock").isNull() & (F.trim("text") != ""), F.struct("line", F.trim("text").alias("t"))))), lambda s: s["t"]), " ")
    return x.groupBy(path, "turn").agg(F.max("_speaker").alias("speaker"), parse_clock(F.max("_clock")).alias("start"), body.alias("text"))


def turn_ends(turns: DataFrame, by: str = "path", media_end: float | None = None) -> DataFrame:
    """turns (turn, start, text) with end and overlapping: a turn lasts until the next later start.

    Of turns that share a start the one of most words (the first of them) runs on, the others end after words / 2.5 + 1
    seconds; the last turn ends at media_end or is estimated so.
    """
    words = F.size(F.filter(F.split("text", r"\s+"), lambda s: s != ""))
    estimate = F.col("start") + words / 2.5 + 1
    x = turns.withColumn("_ms", F.round(F.col("start") * 1000).cast("long"))
    x = x.withColumn("_next", F.min("_ms").over(Window.partitionBy(by).orderBy("_ms").rangeBetween(1, Window.unboundedFollowing)) / 1000)
    tie = Window.partitionBy(by, "_ms")
    x = x.withColumn("_n", F.count(F.lit(1)).over(tie)).withColumn("_r", F.row_number().over(tie.orderBy(words.desc(), "turn")))
    last = F.greatest(F.lit(media_end), F.col("start")) if media_end is not None else estimate
    end = F.when(F.col("_r") > 1, estimate).otherwise(F.coalesce("_next", last))
    return x.withColumn("end", end).withColumn("overlapping", F.col("_n") > 1).drop("_ms", "_next", "_n", "_r")


def ordered_text(order: list[str], line: Column, separator: str) -> Column:
    """Aggregate: lines joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda s: s["_line"]), separator)


def srt(lines: DataFrame, by: str) -> DataFrame:
    """A document a session: numbered cues of single lines, times truncated to ms."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("pos"))
    x = lines.withColumn("_n", n)
    cue = F.format_string("%d\n%s --> %s\n%s: %s\n\n", F.col("_n"), srt_timestamp(F.col("start_ms")), srt_timestamp(F.col("end_ms")), F.col("speaker"), F.col("text"))
    return x.groupBy(by).agg(ordered_text(["_n"], cue, "").alias("document"))


def paragraphs_text(paragraphs: DataFrame, by: str, markdown: bool) -> DataFrame:
    """A document a session: a head with title and duration, then a paragraph a turn, times rounded."""
    at = timestamp_rounded(F.col("start_ms") / 1000)
    line = F.format_string("**[%s] %s:** %s\n\n" if markdown else "[%s] %s: %s\n", at, F.col("speaker"), F.col("text"))
    x = paragraphs.groupBy(by).agg(F.max("end_ms").alias("_end"), ordered_text(["paragraph"], line, "").alias("_body"))
    title, length = F.format_string("Session %d", F.col(by)), duration(F.col("_end") / 1000)
    head = F.format_string("# %s\n\n**Duration:** %s\n\n" if markdown else "%s\nDuration: %s\n\n", title, length)
    return x.select(by, F.concat(head, F.col("_body")).alias("document"))
