"""Clock shifts between two time lines: overlap for every shift, from the corners of its course, and names by what then overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.joins import interval_join

STEP = 1000


def shifted_overlaps(lines: DataFrame, spans: DataFrame, most: int, step: int = STEP) -> DataFrame:
    """(session_id, speaker, name, shift, ms): how long lines (session_id, speaker, start_ms, end_ms) overlap spans (session_id, name,
    r_start_ms, r_end_ms) that are moved by each of the shifts -most to most, in steps; without those where they do not.

    The overlap of a line and a span rises, stays and falls as the shift grows: four corners tell its course. Their sums at or
    before a shift give the overlap there, so a pair costs four rows and not one for each shift at which it overlaps, and
    only a label and a name have one for each shift.
    """
    wide = spans.withColumn("_from", F.col("r_start_ms") - most * step).withColumn("_to", F.col("r_end_ms") + most * step)
    pairs = interval_join(lines, wide, ["session_id"], right_span=("_from", "_to"))
    a, b = F.col("start_ms") - F.col("r_start_ms"), F.col("end_ms") - F.col("r_end_ms")
    corner = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).cast("long").alias("sign"))
    corners = F.array(corner(F.col("start_ms") - F.col("r_end_ms"), 1), corner(F.least(a, b), -1), corner(F.greatest(a, b), -1), corner(F.col("end_ms") - F.col("r_start_ms"), 1))
    x = pairs.select("session_id", "speaker", "name", F.explode(corners).alias("c")).withColumn("k", F.greatest(F.ceil(F.col("c.at") / step), F.lit(-most)).cast("long")).filter(F.col("k") <= most)
    keys = ["session_id", "speaker", "name"]
    sums = x.groupBy(*keys, "k").agg(F.sum("c.sign").alias("n"), F.sum(F.col("c.sign") * F.col("c.at")).alias("s"))
    w = Window.partitionBy(*keys).orderBy("k")
    total = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    course = sums.select(*keys, "k", total("n").alias("n"), total("s").alias("s"), F.coalesce(F.lead("k").over(w) - 1, F.lit(most)).alias("to")).filter("n <> 0 OR s <> 0")
    x = course.select(*keys, "n", "s", F.explode(F.sequence("k", "to")).alias("k")).withColumn("shift", F.col("k") * step)
    return x.select(*keys, "shift", (F.col("shift") * F.col("n") - F.col("s")).cast("long").alias("ms")).filter("ms > 0")


def at_best_shift(overlaps: DataFrame) -> DataFrame:
    """overlaps at each session's best shift: that at which most time agrees, each speaker with the name of most overlap; of equals the
    smallest, then the later one. What belongs to a shift, a row for each label and name, goes along with its agreement."""
    per = overlaps.groupBy("session_id", "shift", "speaker").agg(F.max("ms").alias("best"), F.collect_list(F.struct("name", "ms")).alias("names"))
    per = per.groupBy("session_id", "shift").agg(F.sum("best").alias("agreement"), F.collect_list(F.struct("speaker", "names")).alias("rows"))
    top = per.groupBy("session_id").agg(F.max(F.struct("agreement", (-F.abs("shift")).alias("near"), "shift", "rows")).alias("_b"))
    x = top.select("session_id", "_b.shift", F.explode("_b.rows").alias("r"))
    return x.select("session_id", "shift", "r.speaker", F.explode("r.names").alias("n")).select("session_id", "shift", "speaker", "n.name", "n.ms")


def named_labels(overlaps: DataFrame, most: int, step: int = STEP) -> DataFrame:
    """(session_id, shift, speaker, name, ms, total_ms, outcome, at_edge): at the best shift the name of most overlap of each speaker.

    outcome: 'proposed', or why not: half a minute in common, three fifths of the speaker's overlap, and twice the next name's are
    needed; a name of several speakers also four fifths. at_edge: the best shift is the largest tried, so a larger one may be better.
    """
    x = at_best_shift(overlaps)
    own = Window.partitionBy("session_id", "speaker")
    order = own.orderBy(F.col("ms").desc(), "name")
    x = x.withColumn("total_ms", F.sum("ms").over(own)).withColumn("_second", F.coalesce(F.lead("ms").over(order), F.lit(0))).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    x = x.withColumn("_why", F.expr("CASE WHEN ms < 30000 THEN 'too little overlap' WHEN ms * 10 < total_ms * 6 THEN 'no clear majority' WHEN ms < 2 * _second THEN 'runner-up too close' ELSE 'proposed' END"))
    several = F.count(F.lit(1)).over(Window.partitionBy("session_id", "name", "_why")) > 1
    outcome = F.when((F.col("_why") == "proposed") & (F.col("ms") * 10 < F.col("total_ms") * 8) & several, "name of several labels").otherwise(F.col("_why"))
    return x.select("session_id", "shift", "speaker", "name", "ms", "total_ms", outcome.alias("outcome"), (F.abs("shift") == most * step).alias("at_edge"))
