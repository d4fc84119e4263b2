"""Streams of samples and of what is recognised in them, as rows: fixed windows, schedules, partial lines, words in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = 16_000


def seconds(samples: Column, rate: int = RATE) -> Column:
    return samples / F.lit(float(rate))


def session_ms(at: Column, created: Column, offset_ms: Column | int = 0) -> Column:
    """An instant, or a time in a stream that began later, as ms since the session began; never negative."""
    return F.greatest(at - created + (F.lit(offset_ms) if isinstance(offset_ms, int) else offset_ms), F.lit(0))


def unpadded(ms: Column, pad_ms: int = 250) -> Column:
    """Times of what was decoded with silence around it, without that silence; never negative."""
    return F.greatest(ms - pad_ms, F.lit(0))


def fixed_windows(chunks: DataFrame, by: Sequence[str], order: Sequence[str], samples: str, size: int) -> DataFrame:
    """chunks with `windows`, how many windows of `size` samples each one completes, and `held`, the samples left over after it.

    Nothing is dropped: what is held at the end is the last, short window.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = chunks.withColumn("_total", F.sum(samples).over(w))
    done = lambda c: F.floor(c / F.lit(size))
    return x.withColumn("windows", done(F.col("_total")) - done(F.col("_total") - F.col(samples))).withColumn("held", F.col("_total") % size).drop("_total")


def recluster_times(windows: Column, every: int, settled: int) -> Column:
    """At which numbers of windows, of so many in all, everything is clustered again: `every` windows, and that times (n / settled)
    squared from n = settled on, as the work grows with the square of n."""
    none = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("bigint").alias("last"))

    def step(s: Column, n: Column) -> Column:
        wait = F.greatest(F.lit(float(every)), every * n * n / F.lit(float(settled) ** 2))
        due = n - s["last"] >= wait
        return F.when(due, F.struct(F.concat(s["at"], F.array(n)).alias("at"), n.alias("last"))).otherwise(s)

    numbers = F.when(windows > 0, F.sequence(F.lit(1).cast("bigint"), windows.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(numbers, none, step, lambda s: s["at"])


def partials(chunks: DataFrame, by: Sequence[str], order: str, ms: str, least: int = 500) -> DataFrame:
    """(by, first, updates): the chunk at which a line first shows, having `least` ms of sound by then, and how often it changes
    after that. Lines that never have so much show nothing."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = chunks.withColumn("_ms", F.sum(ms).over(w)).filter(F.col("_ms") >= least)
    return x.groupBy(*by).agg(F.min(order).alias("first"), (F.count(F.lit(1)) - 1).alias("updates"))


def refined(announced: Column, first: Column, second: Column) -> Column:
    """What a second pass makes of a line: its text replaces the first's; without text the line is withdrawn if it was shown,
    and never existed if not."""
    blank = F.coalesce(F.trim(second), F.lit("")) == ""
    return F.when(~blank & (second == first), "kept").when(~blank, "replaced").when(announced, "removed").otherwise("nothing")


def silent_stop(lines: DataFrame, by: Sequence[str], timeout: int = 5000) -> DataFrame:
    """(by, stop, heard): when a dictation stops: `timeout` ms after a line's end with no other by then; and the lines until then.

    The clock starts with the first line, so a silence before it does not count.
    """
    w = Window.partitionBy(*by).orderBy("end_ms")
    x = lines.withColumn("_next", F.lead("end_ms").over(w)).withColumn("_n", F.row_number().over(w))
    last = x.filter(F.col("_next").isNull() | (F.col("_next") - F.col("end_ms") > timeout))
    return last.groupBy(*by).agg((F.min("end_ms") + timeout).alias("stop"), F.min("_n").cast("long").alias("heard"))


def spread_words(lines: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by, w_pos, word, start_ms, end_ms): words of lines (by, text, start_ms, end_ms) in time, in proportion to their length and one."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    x = lines.select(*by, F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"), F.posexplode(words).alias("w_pos", "word")).withColumn("_n", F.length("word") + 1)
    whole = Window.partitionBy(*by)
    x = x.withColumn("_all", F.sum("_n").over(whole)).withColumn("_to", F.sum("_n").over(whole.orderBy("w_pos").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda n: F.col("_a") + F.floor((F.col("_b") - F.col("_a")) * n / F.col("_all"))
    return x.select(*by, F.col("w_pos").cast("long").alias("w_pos"), "word", at(F.col("_to") - F.col("_n")).alias("start_ms"), at(F.col("_to")).alias("end_ms"))


def token_words(tokens: DataFrame, by: Sequence[str], order: str = "t_pos") -> DataFrame:
    """(by, w_pos, word, start_ms): tokens (by, t_pos, token, start_ms) joined to words. One that begins with a blank (or ▁) and is not
    all punctuation starts a word, as does the first; blank ones say nothing."""
    bare = F.regexp_replace("token", "^[ ▁]+", "")
    x = tokens.withColumn("_bare", bare).filter("_bare <> ''")
    w = Window.partitionBy(*by).orderBy(order)
    starts = (F.row_number().over(w) == 1) | (F.col("token").rlike("^[ ▁]") & ~F.col("_bare").rlike(r"^[.,!?;:%)]+$"))
    x = x.withColumn("_s", starts.cast("long")).withColumn("w_pos", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.sort_array(F.collect_list(F.struct(order, "_bare")))
    return x.groupBy(*by, "w_pos").agg(F.array_join(F.transform(parts, lambda p: p["_bare"]), "").alias("word"), F.min("start_ms").alias("start_ms"))


def middles(words: Column, start: Column, end: Column) -> Column:
    """Words spread evenly over a stretch: the time of each one's middle."""
    n = F.size(words)
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), (start + (end - start) * (i + 0.5) / n).alias("at")))


def polling(looks: DataFrame, by: Sequence[str], at: str, value: str, burst_ms: int, fast_ms: int, slow_ms: int) -> DataFrame:
    """looks with `wait`: how soon to look again: fast for burst_ms after a value that differs from the one before, slow else."""
    w = Window.partitionBy(*by).orderBy(at)
    before = F.lag(value).over(w)
    x = looks.withColumn("_changed", F.when(before.isNotNull() & (before != F.col(value)), F.col(at)))
    since = F.col(at) - F.last("_changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("wait", F.when(since <= burst_ms, fast_ms).otherwise(slow_ms).cast("long")).drop("_changed")


def grid_signature(pixels: Column, width: int, height: int, across: int, down: int, points: int = 3) -> Column:
    """Mean brightness of the cells of a grid over an image (row by row), each cell read at points x points places."""

    def cell(c: int) -> Column:
        y, x = divmod(c, across)
        places = [((y * points + b) * height // (down * points)) * width + (x * points + a) * width // (across * points) for b in range(points) for a in range(points)]
        total = sum((F.element_at(pixels, p + 1) for p in places[1:]), F.element_at(pixels, places[0] + 1))
        return F.floor(total / len(places)).cast("long")

    return F.array(*[cell(c) for c in range(across * down)])


def signature_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two signatures, 255 if they cannot be compared."""
    fine = F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda acc, d: acc + d)
    return F.when(fine, total / F.size(a)).otherwise(F.lit(255.0))


def same_box(a: Column, b: Column) -> Column:
    """Two boxes (x, y, width, height) outline one tile: middles within 8 pixels, sizes within a tenth (or 4) of the first's."""
    near = lambda p, q, most: F.abs(p - q) <= most
    middle = lambda r, at, size: r[at] + F.floor(r[size] / 2)
    tenth = lambda size: F.greatest(F.lit(4), F.floor(a[size] / 10))
    centres = near(middle(a, "x", "width"), middle(b, "x", "width"), 8) & near(middle(a, "y", "height"), middle(b, "y", "height"), 8)
    return centres & near(a["width"], b["width"], tenth("width")) & near(a["height"], b["height"], tenth("height"))


def lit_tile(tiles: DataFrame, by: Sequence[str], place: str, least: float) -> DataFrame:
    """(by, stage, name) of tiles (by, place, name, highlight): the most lit one of those at `least` (the first of equals), else the only
    one there is, else none."""
    best = F.max(F.when(F.col("highlight") >= least, F.struct("highlight", (-F.col(place)).alias("_p"), "name")))
    x = tiles.groupBy(*by).agg(best.alias("_b"), F.count(F.lit(1)).alias("_n"), F.min("name").alias("_only"))
    stage = F.when(F.col("_b").isNotNull(), "highlight").when(F.col("_n") == 1, "speaker view").otherwise("no match")
    return x.select(*by, stage.alias("stage"), F.when(F.col("_b").isNotNull(), F.col("_b.name")).when(F.col("_n") == 1, F.col("_only")).alias("name"))
