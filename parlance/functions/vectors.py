"""Vector arithmetic on array columns, in double precision and on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; -2 if one is missing or they differ in length."""
    return F.when(F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False)), dot(a, b)).otherwise(F.lit(-2.0))


def normalized(a: Column) -> Column:
    """Unit length; null for empty, zero or not-a-number vectors."""
    n = norm(a)
    return F.when((F.size(a) > 0) & (n > 0) & ~F.isnan(n), F.transform(a, lambda x: x.cast("double") / n))


def vector_sum(df: DataFrame, by: list[str], vector: str, out: str = "sum", count: str = "n") -> DataFrame:
    """Element-wise sum and count per group: partial sums of single elements, so no group is gathered."""
    parts = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count(F.lit(1)).alias(count))
    row = F.sort_array(F.collect_list(F.struct("_i", "_s")))
    return parts.groupBy(*by).agg(F.transform(row, lambda r: r["_s"]).alias(out), F.max(count).alias(count))
