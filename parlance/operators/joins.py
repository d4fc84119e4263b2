"""Interval, point, as-of and nearest joins over time lines that share an equality key.

Times are BIGINT milliseconds. Intervals are half open, [start, end). All joins need a key (`on`); `bin_ms` further
divides long time lines into bins that become part of the equality key, so that a hot key does not meet itself whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins unless said otherwise: ten minutes.
BIN_MS = 600_000


def _first_bin(start: str, bin_ms: int) -> Column:
    return F.floor(F.col(start) / F.lit(bin_ms))


def with_bins(df: DataFrame, start: str, end: str, bin_ms: int, out: str) -> DataFrame:
    """A row per bin that [start, end) touches; an empty interval has the bin of its start."""
    last = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / F.lit(bin_ms))
    return df.withColumn(out, F.explode(F.sequence(_first_bin(start, bin_ms), last)))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], bin_ms: int | None = None, how: str = "inner", left_span: tuple[str, str] = ("start_ms", "end_ms"), right_span: tuple[str, str] = ("r_start_ms", "r_end_ms")) -> DataFrame:
    """Pairs of equal `on` whose spans overlap, with column overlap_ms. Column names must differ but for `on`.

    how: inner, left or left_semi. A pair is kept in the first bin common to both only. For the other two, equal rows of left
    are counted as one before they are cut in bins, and are as many again after.
    """
    (ls, le), (rs, re), bin_ms = left_span, right_span, bin_ms or BIN_MS
    rb = with_bins(right, rs, re, bin_ms, "_bin")
    overlaps = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    columns = left.columns
    if how != "left_semi":
        pairs = with_bins(left, ls, le, bin_ms, "_bin").join(rb, [*on, "_bin"])
        pairs = pairs.filter((F.col("_bin") == F.greatest(_first_bin(ls, bin_ms), _first_bin(rs, bin_ms))) & overlaps).drop("_bin")
        pairs = pairs.withColumn("overlap_ms", F.least(F.col(le), F.col(re)) - F.greatest(F.col(ls), F.col(rs)))
        if how == "inner":
            return pairs
    rows = left.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    hit = with_bins(rows, ls, le, bin_ms, "_bin").join(rb.select(*on, "_bin", rs, re).distinct(), [*on, "_bin"]).filter(overlaps).select(*[F.col(c).alias(f"_h_{c}") for c in columns]).distinct()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    kept = rows.join(hit, same, "left_semi" if how == "left_semi" else "left_anti").withColumn("_copies", F.explode(F.expr("sequence(1, _copies)"))).select(*columns)
    return kept if how == "left_semi" else pairs.unionByName(kept, allowMissingColumns=True)


def point_join(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, span: tuple[str, str] = ("start_ms", "end_ms"), bin_ms: int = 600_000, how: str = "inner") -> DataFrame:
    """Points with the spans that contain them. A point has one bin, so no pair comes twice; how: inner or left."""
    p = points.withColumn("_bin", F.floor(F.col(at) / F.lit(bin_ms)))
    s = with_bins(spans, span[0], span[1], bin_ms, "_sbin")
    for c in on:
        s = s.withColumnRenamed(c, f"_s_{c}")
    condition = (F.col("_bin") == F.col("_sbin")) & (F.col(span[0]) <= F.col(at)) & (F.col(at) < F.col(span[1]))
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_s_{c}"))
    return p.join(s, condition, how).drop("_bin", "_sbin", *[f"_s_{c}" for c in on])


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, order: Sequence[str], columns: Sequence[str], tolerance: int | None = None) -> DataFrame:
    """left with `columns` of the last right row at or before `at`, of those with equal times the last by `order`.

    tolerance: right rows older than it give null. A right row whose columns are null still takes the place (it blanks
    the answer). One shuffle: both sides are united and a window carries the last right row forward.
    """
    payload = F.struct(F.col(right_at).alias("_at"), *[F.col(c) for c in columns])
    r = right.select(*on, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in order]).alias("_order"), payload.alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    empty = F.lit(None).cast(right.select(F.struct(*[F.col(c) for c in order])).schema[0].dataType)
    nothing = F.lit(None).cast(right.select(payload).schema[0].dataType)
    x = left.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_side"), empty.alias("_order"), nothing.alias("_right"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    w = Window.partitionBy(*on).orderBy("_t", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(x).withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    valid = F.lit(True) if tolerance is None else F.col("_t") - F.col("_hit._at") <= tolerance
    return both.select("_left.*", *[F.when(valid, F.col(f"_hit.{c}")).alias(c) for c in columns])


def nearest_join(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, key: Sequence[str], within: int, pick: Sequence[str], span: tuple[str, str] = ("start_ms", "end_ms"), order: Sequence[str] = ()) -> DataFrame:
    """Each point (identified by `key`) with `pick` of the nearest span at most `within` away, null if none.

    The distance is 0 inside; ties go by `order`. Bins of `within` bound what a point meets.
    """
    wide = spans.withColumn("_from", F.col(span[0]) - within).withColumn("_to", F.col(span[1]) + within + 1)
    pairs = point_join(points.select(*on, *[k for k in key if k not in on], at), wide.select(*on, "_from", "_to", *span, *[c for c in {*pick, *order} if c not in (*on, *span)]), on, at, ("_from", "_to"), max(within, 60_000))
    distance = F.greatest(F.col(span[0]) - F.col(at), F.col(at) - F.col(span[1]), F.lit(0))
    best = pairs.groupBy(*dict.fromkeys([*on, *key])).agg(F.min(F.struct(distance.alias("_d"), *[F.col(c) for c in order], *[F.col(c).alias(f"_p_{c}") for c in pick])).alias("_b"))
    best = best.select(*dict.fromkeys([*on, *key]), F.col("_b._d").alias("distance_ms"), *[F.col(f"_b._p_{c}").alias(c) for c in pick])
    return points.join(best, list(dict.fromkeys([*on, *key])), "left")
