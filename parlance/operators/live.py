"""Labels of lines while a session goes on: names read during a line, short lines, the order in which sources of a label count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.labels import NEW_SPEAKER, hint_name, normalized_name, same_name
from parlance.operators.joins import point_join

#: A line of at most so many ms is too little voice to tell who it is; how long the window lags behind the voice; slack to either side.
SHORT_LINE, LAG, SLACK = 1500, 0, 250


def during(lines: DataFrame, looks: DataFrame, lag: int = LAG, slack: int = 0) -> DataFrame:
    """Looks (session_id, look_id, t, name, several) within each line (session_id, pos, start_ms, end_ms), both ends included."""
    spans = lines.select("session_id", "pos", (F.col("start_ms") + lag - slack).alias("_from"), (F.col("end_ms") + lag + slack + 1).alias("_to"))
    return point_join(looks, spans, ["session_id"], "t", ("_from", "_to"))


def last_name(lines: DataFrame, looks: DataFrame) -> DataFrame:
    """(session_id, pos, hint): the name that the last look with a name within a line shows."""
    x = during(lines, looks).filter("name <> ''")
    return x.groupBy("session_id", "pos").agg(F.max_by("name", F.struct("t", "look_id")).alias("hint"))


def sole_name(lines: DataFrame, looks: DataFrame, lag: int = LAG, slack: int = SLACK) -> DataFrame:
    """(session_id, pos, name): the one name that all looks within a line show, as the first of them spells it.

    Lines without such a look are left out, as are those with a look at several candidates, or at a name that is not the first one's.
    """
    x = during(lines, looks, lag, slack).filter("name <> '' OR several")
    w = Window.partitionBy("session_id", "pos").orderBy("t", "look_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("name") != "", F.col("name")), ignorenulls=True).over(w)
    x = x.withColumn("_first", first).withColumn("_same", same_name(normalized_name(F.col("_first")), normalized_name(F.col("name"))) & (F.col("name") != ""))
    return x.groupBy("session_id", "pos").agg(F.min("_first").alias("name"), F.bool_and(F.coalesce("_same", F.lit(False))).alias("_sole")).filter("_sole").drop("_sole")


def label_named(names: DataFrame, people: DataFrame) -> DataFrame:
    """names (session_id, name) with the label of the one speaker of people (session_id, label, name) who carries it; others go."""
    p = people.filter("name <> ''").select("session_id", F.col("label").alias("_label"), F.col("name").alias("_name"))
    distinct = names.select("session_id", "name").distinct()
    hit = distinct.join(p, "session_id").filter(same_name(normalized_name(F.col("name")), normalized_name(F.col("_name"))))
    one = hit.groupBy("session_id", "name").agg(F.countDistinct("_label").alias("_n"), F.min("_label").alias("label")).filter("_n = 1").drop("_n")
    return names.join(one, ["session_id", "name"])


def short_line_labels(lines: DataFrame, looks: DataFrame, people: DataFrame, longest: int = SHORT_LINE) -> DataFrame:
    """(session_id, pos, label) of those short lines of others that the window names alone, and whose name one speaker carries."""
    short = lines.filter((F.col("source") == "monitor") & (F.col("end_ms") - F.col("start_ms") <= longest))
    return label_named(sole_name(short, looks), people).select("session_id", "pos", "label")


def provisional(placed: Column, mapped: Column, hinted: Column, hint: Column, live: Column, renamed: Column, hint_first: bool = True) -> Column:
    """The label of a new line.

    placed: that of the turns, where they reach so far. Else the speaker whom the window names (hinted) and the one that the
    live label has meant so far (mapped), the window's first if hint_first; else a new speaker, with the name that the live label
    carries. What the window reads (hint) is added in doubt where no name is known and the user gave none.
    """
    unknown = F.when(hint_name(live) != "", F.concat(F.lit(NEW_SPEAKER + " ("), hint_name(live), F.lit(")"))).otherwise(F.lit(NEW_SPEAKER))
    base = F.coalesce(*([hinted, mapped] if hint_first else [mapped, hinted]), unknown)
    doubtful = F.when(base == NEW_SPEAKER, F.concat(hint, F.lit("?"))).otherwise(F.concat(base, F.lit(" ("), hint, F.lit("?)")))
    adds = (F.coalesce(hint, F.lit("")) != "") & (hint_name(base) == "") & ~F.coalesce(renamed, F.lit(False))
    return F.coalesce(placed, F.when(adds, doubtful).otherwise(base))


def needs_names(turns: DataFrame, people: DataFrame, last: int = 60_000) -> DataFrame:
    """(session_id, needs): whether anyone without a name spoke in the last minute of the turns."""
    through = turns.groupBy("session_id").agg((F.max("end_ms") - last).alias("_from"))
    recent = turns.join(through, "session_id").groupBy("session_id", "cluster").agg(F.bool_or(F.col("end_ms") >= F.col("_from")).alias("_recent"))
    named = people.filter("name <> ''").select("session_id", "cluster").distinct().withColumn("_named", F.lit(True))
    x = recent.join(named, ["session_id", "cluster"], "left")
    return x.groupBy("session_id").agg(F.bool_or(F.col("_recent") & F.col("_named").isNull()).alias("needs"))


def planned_renames(labels: DataFrame, present: DataFrame) -> DataFrame:
    """labels (session_id, place, label, proposed, changes) with new_label and reason; present (session_id, label): all labels of lines.

    A label that changes becomes 'Person N (proposed)': with its own number, or the next free one. It does not where the new
    label is another's already, be it that of lines or one given to a label before it in order.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, r"^Person (\d+)", 1), F.lit("")).cast("long")
    highest = present.groupBy("session_id").agg(F.coalesce(F.max(number(F.col("label"))), F.lit(0)).alias("_most"))
    w = Window.partitionBy("session_id").orderBy("place")
    x = labels.join(highest, "session_id", "left").withColumn("_own", number(F.col("label")))
    fresh = F.sum((F.col("changes") & F.col("_own").isNull()).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_new", F.when(F.col("changes"), F.concat(F.lit("Person "), F.coalesce("_own", F.col("_most") + fresh).cast("string"), F.lit(" ("), F.col("proposed"), F.lit(")"))))
    x = x.join(present.select("session_id", F.col("label").alias("_new"), F.lit(True).alias("_taken")).distinct(), ["session_id", "_new"], "left")
    earlier = F.row_number().over(Window.partitionBy("session_id", "_new").orderBy("place")) > 1
    x = x.withColumn("_same", F.col("_new") == F.col("label")).withColumn("_blocked", F.coalesce("_taken", F.lit(False)) | earlier)
    fine = F.col("changes") & ~F.col("_same") & ~F.col("_blocked")
    reason = F.when(F.col("changes") & F.col("_same"), "agree").when(F.col("changes") & F.col("_blocked"), "new label already in use")
    return x.withColumn("new_label", F.when(fine, F.col("_new"))).withColumn("reason", reason).drop("_own", "_new", "_most", "_taken", "_same", "_blocked")


def nearest_window(words: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """words (on, w_pos, start_ms, end_ms, label) with `windowed`: the label of the window (on, w_start, w_end, w_label) around
    the word's middle whose own middle is nearest (the earlier one on ties), else the word's label."""
    points = words.withColumn("_mid", F.expr("(start_ms + end_ms) div 2"))
    spans = windows.withColumn("_to", F.col("w_end") + 1)
    hit = point_join(points, spans, on, "_mid", ("w_start", "_to"), how="left")
    apart = F.abs(2 * F.col("_mid") - (F.col("w_start") + F.col("w_end")))
    keys = [*on, "w_pos"]
    best = hit.groupBy(*keys).agg(F.min(F.when(F.col("w_start").isNotNull(), F.struct(apart.alias("d"), F.col("w_start"), F.col("w_label").alias("label")))).alias("_b"), F.first("label").alias("label"))
    return best.select(*keys, "label", F.coalesce("_b.label", "label").alias("windowed"))


def cut_at_changes(lines: DataFrame, changes: DataFrame, least: int = 400) -> DataFrame:
    """(session_id, pos, t): the changes at which lines (session_id, pos, start_ms, end_ms) are cut, in order of time.

    A change counts if it is `least` ms or more after the line's start or the last cut, and before the end. Within a line the
    cuts are a chain: each leads to the first change far enough after it, so they follow from those pointers.
    """
    spans = lines.select("session_id", "pos", "start_ms", "end_ms", (F.col("start_ms") + least).alias("_a"), (F.col("end_ms") - least + 1).alias("_b")).filter("_a < _b")
    inside = point_join(changes.select("session_id", "t").distinct(), spans, ["session_id"], "t", ("_a", "_b"))
    times = inside.groupBy("session_id", "pos").agg(F.sort_array(F.collect_list("t")).alias("_t"), F.min("start_ms").alias("start_ms"))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate("_t", none, lambda cuts, t: F.when(t - F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.col("start_ms")) >= least, F.concat(cuts, F.array(t))).otherwise(cuts))
    return times.select("session_id", "pos", F.explode(kept).alias("t"))
