"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def pair_blocks(a: Column, b: Column) -> dict[str, Column]:
    """The six blocks of two chains' embeddings: both, mean, difference, absolute difference and product."""
    d = lambda x: x.cast("double")
    return {
        "vh": F.transform(a, d),
        "vl": F.transform(b, d),
        "mean": F.zip_with(a, b, lambda x, y: (d(x) + d(y)) / 2),
        "diff": F.zip_with(a, b, lambda x, y: d(x) - d(y)),
        "absdiff": F.zip_with(a, b, lambda x, y: F.abs(d(x) - d(y))),
        "prod": F.zip_with(a, b, lambda x, y: d(x) * d(y)),
    }


def mean_pool(frame: DataFrame, by: list[str], vector: str, mask: str) -> DataFrame:
    """Masked mean of vectors by group: sums by component over at least one count; partial sums travel, not vectors."""
    parts = frame.select(*by, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(*by, "i").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("x"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pooled"))
