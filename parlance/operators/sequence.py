"""Ordered operators: islands, next-later times, greedy folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], new: Column, out: str = "island") -> DataFrame:
    """Numbers maximal runs from 0 within `by`: a row starts a run where `new` (over lag/lead of the same order) is true or null."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def changed(column: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """True where the column differs from the row before (null before the first row)."""
    return F.col(column) != F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def next_later(df: DataFrame, by: Sequence[str], at: str, out: str = "next_at") -> DataFrame:
    """The least strictly greater time of the same group (rows of equal time see the same), null for the last."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.min(at).over(w))


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs `step` on each group's rows in order: for greedy rules whose decisions depend on earlier decisions.

    A group is one session, so it is bounded by a session's length. Partitions are sorted by group and order and streamed
    through; one group is held at a time, and results leave in batches, which spares an exchange of Arrow data per group.
    """
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            group = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist()]
            rest = rows.iloc[cuts[-1] :]
            done = [step(rows.iloc[i:j].reset_index(drop=True)) for i, j in zip(cuts, cuts[1:])]
            done = [x for x in done if len(x)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest is not None and len(rest):
            yield step(rest.reset_index(drop=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *[c for c in order if c not in keys]).mapInPandas(run, schema)


def thin(times: Sequence[int], gap: int) -> list[bool]:
    """Greedy thinning: a time is kept if it is at least `gap` after the last kept one."""
    out, last = [], None
    for t in times:
        keep = last is None or t - last >= gap
        out.append(keep)
        last = t if keep else last
    return out


def min_gap_thin(df: DataFrame, by: Sequence[str], at: str, tie: str, gap: int) -> DataFrame:
    """The rows that greedy thinning keeps (lag cannot tell: what counts is the last kept row)."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[thin(pdf[at].tolist(), gap)]

    return fold(df, by, [at, tie], step, df.schema.simpleString()[7:-1].replace(":", " "))


def nearest_rank(values: str, q: float) -> Column:
    """Aggregate, for groups that fit in a row: sorted[min(n - 1, int(q * n))], 0 for no values; not interpolated."""
    found = F.sort_array(F.collect_list(values))
    n = F.size(found)
    return F.when(n > 0, F.element_at(found, F.least(n - 1, F.floor(n * F.lit(q))).cast("int") + 1)).otherwise(F.lit(0))


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, a column for each quantile q, n): sorted[min(n - 1, int(q * n))] of each group's n values; not interpolated.

    The values of a group are ranked by a sort that can spill, not gathered.
    """
    w = Window.partitionBy(*by)
    x = df.select(*by, F.col(value).alias("_v")).withColumn("_r", F.row_number().over(w.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    return x.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == at(q), F.col("_v"))).alias(c) for c, q in quantiles.items()], F.count(F.lit(1)).alias("n"))


def every_nth(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r") % n == 0).drop("_r")


def evenly_thinned(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """At most `limit` rows of each group, those at floor(i * n / limit)."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    i = F.ceil(F.col("_r") * limit / F.col("_n"))
    return x.filter((F.col("_n") <= limit) | ((F.floor(i * F.col("_n") / limit) == F.col("_r")) & (i < limit))).drop("_r", "_n")
