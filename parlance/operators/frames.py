"""Operators on frames (activity in steps of time), on tokens over time, and on boxes of text."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, last): maximal runs of consecutive frames of each group; frame less its rank is the same within a run."""
    w = Window.partitionBy(*by).orderBy("frame")
    x = frames.withColumn("_g", F.col("frame") - F.row_number().over(w))
    return x.groupBy(*by, "_g").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("_g")


def alone(active: DataFrame, by: list[str], who: str, least: int = 10) -> DataFrame:
    """(by, who, first, last): runs of frames in which one alone is active, of those who are alone in `least` frames in all."""
    single = active.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("_n"), F.min(who).alias(who)).filter("_n = 1").drop("_n")
    enough = single.groupBy(*by, who).agg(F.count(F.lit(1)).alias("_t")).filter(F.col("_t") >= least).drop("_t")
    return runs(single.join(enough, [*by, who], "left_semi"), [*by, who])


def voted_turns(votes: DataFrame, by: list[str], who: str, vote: str, crowd: str, join_gap: int = 5, drop: int = 3) -> DataFrame:
    """Turns from votes (by, frame, who, vote, crowd): in each frame the `crowd` candidates of most votes are active; runs whose
    gap is at most join_gap frames are joined first, then those of at most `drop` frames go."""
    w = Window.partitionBy(*by, "frame").orderBy(F.col(vote).desc(), who)
    x = votes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col(crowd)).select(*by, who, "frame")
    t = Window.partitionBy(*by, who).orderBy("frame")
    x = x.withColumn("_new", F.coalesce((F.col("frame") - F.lag("frame").over(t) - 1 > join_gap).cast("long"), F.lit(1)))
    x = x.withColumn("_i", F.sum("_new").over(t.rowsBetween(Window.unboundedPreceding, 0)))
    out = x.groupBy(*by, who, "_i").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("_i")
    return out.filter(F.col("last") - F.col("first") + 1 > drop)


def new_voice_at_end(mask: Column, per_second: int) -> Column:
    """Active for a quarter of a second in the last second of the mask (0 or 1 a frame) and silent in the two before."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x.cast("int"))
    n = F.size(mask)
    end = F.slice(mask, F.greatest(n - per_second + 1, F.lit(1)), F.lit(per_second))
    before = F.slice(mask, F.greatest(n - 3 * per_second + 1, F.lit(1)), F.lit(2 * per_second))
    return (n >= 3 * per_second) & (total(end) * 4 >= per_second) & (total(before) == 0)


def span_of(mask: Column) -> Column:
    """First and last active frame (from 0, -1 if none) and the number of active ones."""
    on = F.filter(F.transform(mask, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return F.struct(F.coalesce(F.array_min(on), F.lit(-1)).alias("first"), F.coalesce(F.array_max(on), F.lit(-1)).alias("last"), F.size(on).alias("active"))


def powerset(speakers: int, most: int) -> list[list[int]]:
    """Which speakers each class means: no one, each one, each two, ... up to `most` at once, in order."""
    sets = itertools.chain.from_iterable(itertools.combinations(range(speakers), k) for k in range(most + 1))
    return [[int(s in chosen) for s in range(speakers)] for chosen in sets]


def greedy_text(best: Sequence[int], probability: Sequence[float], characters: Sequence[str]) -> tuple[str, float]:
    """Text and mean probability of the best classes over time: repeats and blanks (class 0) are dropped."""
    kept = [(c, p) for k, (c, p) in enumerate(zip(best, probability)) if c and (k == 0 or best[k - 1] != c)]
    return "".join(characters[c - 1] for c, _ in kept), sum(p for _, p in kept) / len(kept) if kept else 0.0


def text_lines(boxes: Sequence[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Boxes (x, y, width, height) joined to lines, left to right: half of the lower height in common, and a gap of a height at most."""
    lines: list[list[float]] = []
    for x, y, w, h in sorted(boxes):
        for line in lines:
            common = min(line[1] + line[3], y + h) - max(line[1], y)
            if 2 * common >= min(line[3], h) and x - (line[0] + line[2]) <= max(line[3], h):
                right, bottom = max(line[0] + line[2], x + w), max(line[1] + line[3], y + h)
                line[1] = min(line[1], y)
                line[2], line[3] = right - line[0], bottom - line[1]
                break
        else:
            lines.append([x, y, w, h])
    return [tuple(x) for x in lines]


def resampled(samples: Sequence[float], source: int, target: int) -> np.ndarray:
    """Linear interpolation at another rate; to a lower rate after four first-order low passes below half of it."""
    x = np.asarray(samples, dtype=float)
    if source == target or not len(x):
        return x
    if target < source:
        k = 1 / (1 + source / (2 * np.pi * 0.45 * target))
        for _ in range(4):
            y, state = np.empty_like(x), 0.0
            for i, v in enumerate(x):
                state += k * (v - state)
                y[i] = state
            x = y
    n = int(len(x) * target / source)
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x)


def words_moved(left: list[dict], right: list[dict], at: float, most: float) -> tuple[list[dict], list[dict], int]:
    """Words of two neighbouring lines after the border between them moves to `at`: words whose middle lies on the other
    side go there, if they are within `most` seconds of the old border; a line never loses all. Returns both and how many moved."""
    old = right[0]["start"] if right else at
    middle = lambda w: (w["start"] + w["end"]) / 2
    near = lambda w: abs(middle(w) - old) <= most
    moved = 0
    left, right = list(left), list(right)
    while len(left) > 1 and middle(left[-1]) > at and near(left[-1]):
        right.insert(0, left.pop())
        moved += 1
    while not moved and len(right) > 1 and middle(right[0]) < at and near(right[0]):
        left.append(right.pop(0))
        moved -= 1
    return left, right, abs(moved)
