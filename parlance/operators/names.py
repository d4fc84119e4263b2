"""Names read from windows and tiles: plausibility, cleaning, meeting titles, lookups."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.labels import same_name, snap_limit

# Words of overlays, badges and toolbars, prefixes and suffixes of titles, ranges of scripts.
NOISE = ("privacy", "muted", "mute", "recording", "live")
BADGES = ("voice isolation", "noise suppressed", "noise suppression")
TOOLBAR = ("take", "control", "annotate", "pop", "out", "chat", "people", "raise", "react", "view", "notes", "apps", "more", "camera", "mic", "share", "leave")
TITLE_PREFIXES, TITLE_SUFFIXES = ("Meeting join |", "Meeting compact view |"), ("| Microsoft Teams", "| Pinned window")
NO_TITLES = ("Calendar", "Sharing Indicator", "Microsoft Teams", "teams.microsoft.com/v2/", "Zoom Meeting", "Zoom Workplace", "Zoom")
NO_TITLE_PREFIXES = ("Calendar |", "Chat |", "Search |")
SIGNAL_BARS = r"^[.|lIi1!:']+$"
SCRIPTS = {
    "bn": (0x0980, 0x09FF), "hi": (0x0900, 0x097F), "ta": (0x0B80, 0x0BFF), "te": (0x0C00, 0x0C7F), "gu": (0x0A80, 0x0AFF),
    "kn": (0x0C80, 0x0CFF), "ml": (0x0D00, 0x0D7F), "pa": (0x0A00, 0x0A7F), "or": (0x0B00, 0x0B7F), "si": (0x0D80, 0x0DFF),
    "th": (0x0E00, 0x0E7F), "my": (0x1000, 0x109F), "ka": (0x10A0, 0x10FF), "am": (0x1200, 0x137F), "km": (0x1780, 0x17FF),
    "lo": (0x0E80, 0x0EFF), "ja": (0x3040, 0x309F), "ko": (0xAC00, 0xD7AF), "zh": (0x4E00, 0x9FFF), "ar": (0x0600, 0x06FF),
    "he": (0x0590, 0x05FF),
}


def contains_script(text: Column, lang: Column) -> Column:
    """The text has a character of the language's script; true for languages without a range of their own."""
    out = F.lit(True)
    for code, (a, b) in SCRIPTS.items():
        out = F.when(lang == code, text.rlike(f"[\\x{{{a:04X}}}-\\x{{{b:04X}}}]")).otherwise(out)
    return out


def validated(default: Column, other: Column, lang: Column) -> Column:
    """The other engine's text if it is not blank and in its script, else the default."""
    return F.when((F.trim(other) != "") & contains_script(other, lang), other).otherwise(default)


def plausible(name: Column, toolbar: tuple[str, ...] = TOOLBAR) -> Column:
    """Not a badge or signal bars, two letters at least, and fewer than two toolbar words or no more of them than half."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    ui = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"^[.,|…]+|[.,|…]+$", "").isin(*toolbar)))
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return ~name.rlike(SIGNAL_BARS) & ~F.lower(F.trim(name)).isin(*BADGES) & (letters >= 2) & ((ui < 2) | (2 * ui <= F.size(words)))


def meeting_name(window: Column) -> Column:
    """The meeting that a window '<app> — <title>' is titled for, else empty: only of meeting apps, without what they put around it."""
    either = lambda texts: "(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in texts) + ")"
    app, title = F.lower(F.substring_index(window, " — ", 1)), F.trim(F.regexp_extract(window, r"^(?s).*? — (.*)$", 1))
    title = F.trim(F.regexp_replace(title, rf"(?i)^(?:{either(TITLE_PREFIXES)}\s*)+", ""))
    title = F.trim(F.regexp_replace(title, rf"(?i)(?:\s*{either(TITLE_SUFFIXES)})+$", ""))
    other = title.rlike(rf"(?i)^{either(NO_TITLES)}$") | title.rlike(rf"(?i)^{either(NO_TITLE_PREFIXES)}")
    return F.when(window.contains(" — ") & (app.contains("teams") | app.contains("zoom")) & ~other, title).otherwise(F.lit(""))


def called_person(window: Column) -> Column:
    """Who a window of a call of two is titled for, without the app around the name; empty for titles of several parts or of the app."""
    title = F.when(window.contains(" — "), F.substring_index(window, " — ", -1)).otherwise(window)
    title = F.trim(F.regexp_replace(F.trim(title), re.escape(TITLE_SUFFIXES[0]).replace("\\ ", " ") + "$", ""))
    return F.when((title == "") | title.contains("|") | (F.lower(title) == F.lower(F.lit(NO_TITLES[2]))), F.lit("")).otherwise(title)


def call_toolbar(text: Column) -> Column:
    """A toolbar as only calls of two have it: hold, and one of transfer, dial pad and consult."""
    low = F.lower(text)
    return low.contains("hold") & (low.contains("transfer") | low.contains("dial pad") | low.contains("consult"))


def accepted_look(name: Column, usable: Column, fits: Column, cached: Column) -> Column:
    """The name of a look that is usable, plausible, and either remembered or read from a ring that can hold a label."""
    return F.when(usable & plausible(name) & (cached | fits), name)


def cleaned(name: str) -> str:
    """Without one overlay word at the end (or three letters of one), and without scraps after the name."""
    words = re.sub(r"^[.|lIi1!:']*[.|li1!:'] ?(?=[A-ZÀ-ÖØ-Þ])", "", name.strip()).split()
    while len(words) >= 2:
        last, low = words[-1], words[-1].lower()
        if any(low == w or (len(low.encode()) >= 3 and w.startswith(low)) for w in NOISE):
            words.pop()
            break
        if (len(last.encode()) <= 2 and last == low) or not any(c.isalpha() for c in last):
            words.pop()
            continue
        break
    return " ".join(words)


@F.pandas_udf(T.StringType())
def cleaned_udf(name: pd.Series) -> pd.Series:
    return name.map(cleaned, na_action="ignore")


def most_frequent(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group the most frequent value; a tie goes to the one seen first."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "_o")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_o")


def in_use(profiles: DataFrame, least: int = 8) -> DataFrame:
    """profiles (name, session_id, n, confirmed, by_user): names with enough fingerprints that are confirmed, heard in two
    meetings, or named by a user in one."""
    x = profiles.groupBy("name").agg(F.sum("n").alias("n"), F.countDistinct("session_id").alias("meetings"), F.bool_or("confirmed").alias("confirmed"), F.bool_or("by_user").alias("by_user"))
    return x.filter((F.col("n") >= least) & (F.col("confirmed") | (F.col("meetings") >= 2) | F.col("by_user")))


def evenly_picked(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Up to n rows of each group at floor(i (m - 1) / (n - 1)): the first, the last, and evenly between."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_m") - 1) / (n - 1)))
    return x.filter((F.col("_m") <= n) | F.array_contains(places, F.col("_r").cast("long"))).drop("_r", "_m")


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, parts: Callable[[Column], Column], lengths: Callable[[Column], Column], fits: Column, heads: bool = False) -> DataFrame:
    """Rows of left and right whose texts a and b are few edits apart, as `fits` tells; with heads also those of which one begins the other.

    No text meets all others. Of two that are d edits apart, the longer one cut in d + 1 parts has a part that stands in the
    other as it is: parts(text) is d + 1 for a longer text, lengths(text) are the lengths that a part may have for a shorter
    one, whose stretches of these lengths are joined to the parts. Beginnings are joined to whole texts.
    """

    def cut(df: DataFrame, key: str) -> DataFrame:
        text = F.col(key)
        n, k = F.length(text), parts(text).cast("int")
        at = lambda i: F.floor(n * i / k).cast("int")
        found = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(F.lit("="), text.substr(at(i) + 1, at(i + 1) - at(i))))
        if heads:
            found = F.concat(found, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("^"), text.substr(F.lit(1), i))))
        return df.withColumn("_key", F.explode(F.array_distinct(found)))

    def stretches(df: DataFrame, key: str) -> DataFrame:
        text = F.col(key)
        places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        found = F.flatten(F.transform(places, lambda i: F.transform(lengths(text), lambda k: F.concat(F.lit("="), text.substr(i, k.cast("int"))))))
        if heads:
            found = F.concat(found, F.array(F.concat(F.lit("^"), text)))
        return df.withColumn("_key", F.explode(F.array_distinct(found)))

    both = [cut(left, a).join(stretches(right, b), "_key"), stretches(left, a).join(cut(right, b), "_key")]
    first, second = [x.drop("_key").filter(fits).select(*left.columns, *right.columns) for x in both]
    return first.unionByName(second).distinct()


def alike_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (a, a_key, ...) with those of right (b, b_key, ...) whose keys (normalized names) are one person's by same_name.

    A name of n bytes may be n / 8 edits off (one at least), so no part of it is longer than 8.
    """
    parts = lambda k: F.greatest(F.lit(1), F.floor(F.octet_length(k) / 8)) + 1
    return near_pairs(left, right, "a_key", "b_key", parts, lambda k: F.sequence(F.lit(1), F.lit(8)), same_name(F.col("a_key"), F.col("b_key")), heads=True)


def snapped_pairs(read: DataFrame, invited: DataFrame) -> DataFrame:
    """(name, invitee) of read (name) and invited (invitee) that are within the edits of snap_limit."""
    limit = lambda n: F.least(F.lit(2), F.floor(n / 5))

    def lengths(k: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda more: F.floor((F.length(k) + more) / (limit(F.length(k) + more) + 1)))
        return F.array_distinct(F.flatten(F.transform(whole, lambda n: F.array(n, n + 1))))

    fits = F.levenshtein("name", "invitee") <= snap_limit(F.col("name"), F.col("invitee"))
    return near_pairs(read, invited, "name", "invitee", lambda k: limit(F.length(k)) + 1, lengths, fits)


def renamed(lines: DataFrame, names: DataFrame) -> DataFrame:
    """lines (speaker, live_speaker, ...) with labels renamed by names (label, new_label); what was live stays known."""
    x = lines.join(names, F.col("speaker") == F.col("label"), "left")
    live = F.when(F.col("new_label").isNotNull() & (F.coalesce("live_speaker", F.lit("")) == ""), F.col("speaker")).otherwise(F.col("live_speaker"))
    return x.withColumn("live_speaker", live).withColumn("speaker", F.coalesce("new_label", "speaker")).drop("label", "new_label")


def versions(sessions: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, version): a digest of the columns of a session's lines in order, to tell whether it changed since it was read."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.sort_array(F.collect_list(F.struct("pos", row.alias("_row"))))
    return sessions.groupBy(by).agg(F.substring(F.sha2(F.array_join(F.transform(rows, lambda s: s["_row"]), "\x1e"), 256), 1, 24).alias("version"))


def unchanged_updates(updates: DataFrame, read: DataFrame, now: DataFrame, by: str) -> DataFrame:
    """Compare and swap: the updates of sessions whose version is still the one that was read."""
    same = read.join(now.withColumnRenamed("version", "_now"), by).filter("version = _now").select(by)
    return updates.join(same, by, "left_semi")
