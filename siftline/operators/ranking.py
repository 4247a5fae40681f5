"""Ranks, rank correlation and tail membership by group, without sorting a group in one task.

Distinct values are counted first (partial aggregation collapses ties), then dealt to equal-width buckets of the
group's range: cumulative counts run inside a bucket, and over the at most ``BUCKETS`` bucket totals of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.tables import both, pin

BUCKETS = 256


def value_positions(frame: DataFrame, by: list[str], x: str, *sums: str) -> DataFrame:
    """(by, x, n, below, total): how often each value occurs, rows below it and rows in its group; NULL values are left out.
    Columns named besides are summed by value."""
    values = frame.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    spread = values.groupBy(*by).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.sum("n").alias("total"))
    joined = values.join(F.broadcast(spread), by) if by else values.crossJoin(F.broadcast(spread))  # one row of a group
    width = (F.col("high") - F.col("low")).cast("double")
    at = F.when(width > 0, F.floor((F.col(x) - F.col("low")).cast("double") / width * (BUCKETS - 1))).otherwise(F.lit(0))
    dealt = joined.withColumn("bucket", at.cast("int"))
    inside = Window.partitionBy(*by, "bucket").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "bucket").agg(F.sum("n").alias("bucket_n"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("bucket_n").over(before), F.lit(0))).drop("bucket_n")
    return (
        dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*by, "bucket"])
        .select(*by, x, "n", (F.col("offset") + F.col("inside")).alias("below"), "total", *sums)
    )


def average_rank(frame: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """Adds the 1-based average rank of ``x`` in its group; NULL stays NULL."""
    ranks = value_positions(frame, by, x).select(*by, x, (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return frame.join(ranks, [*by, x], "left")


def guarded_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation; NULL for fewer than ``least`` rows or a constant side."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count(x) >= least)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pairs_of(frame: DataFrame, by: list[str], x: str, y: str, *keep: str, pinned: bool = False) -> DataFrame:
    """Pairwise complete rows (by, keep, x, y) of known groups, pinned unless ``frame`` comes from pinned rows without a shuffle."""
    own = frame.select(*by, *keep, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # Filtered behind the checkpoint: a filter on an expression before it would compute it twice.
    return (own if pinned else pin(own)).filter(both([F.col(c).isNotNull() for c in [*by, "x", "y"]]))


def _ranks(at: DataFrame, by: list[str], c: str) -> DataFrame:
    return at.select(*by, c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{c}"), F.col("total").alias(f"{c}_total"))


def both_ranked(frame: DataFrame, by: list[str], x: str, y: str, *keep: str) -> DataFrame:
    """Pairwise complete rows with x, y and their ranks, each side ranked from the pinned rows on its own."""
    pairs = pairs_of(frame, by, x, y, *keep)
    return pairs.join(_ranks(value_positions(pairs, by, "x"), by, "x"), [*by, "x"]).join(_ranks(value_positions(pairs, by, "y"), by, "y"), [*by, "y"])


def spearman(frame: DataFrame, by: list[str], x: str, y: str, out: str = "spearman", least: int = 3) -> DataFrame:
    """(by, n, out) over pairwise complete rows."""
    ranked = both_ranked(frame, by, x, y)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), guarded_corr(F.col("rx"), F.col("ry"), least).alias(out))


def tails_flagged(pairs: DataFrame, by: list[str], k: Callable[[Column], Column], tie: str, ranked: bool = True) -> DataFrame:
    """``pairs_of`` rows with ``bad`` and ``told``: among the k(total) largest x of their group, and y, ties at the border by least
    ``tie``. With ``ranked`` also their ranks.

    What is among the largest is told by one row of each group, so rows are not dealt for it and go to the ranks without ``tie``
    where nothing else needs it. Pinned rows have one place each, which parts rows that are equal in all.
    """
    rows = pairs.withColumn("__row", F.monotonically_increasing_id())
    at = {c: pin(value_positions(pairs, by, c)) for c in "xy"}
    for c, out in (("x", "bad"), ("y", "told")):
        rows = _among_top(rows, by, c, at[c], k(F.col("total")), tie, out)
    rows = rows.drop("__row")
    return rows.join(_ranks(at["x"], by, "x"), [*by, "x"]).join(_ranks(at["y"], by, "y"), [*by, "y"]) if ranked else rows


def _among_top(rows: DataFrame, by: list[str], x: str, at: DataFrame, k: Column, tie: str, out: str) -> DataFrame:
    """Adds whether a row is among the ``k`` largest ``x``, given the positions of values. Only rows at the border value are numbered."""
    above = F.col("total") - F.col("below") - F.col("n")
    least = (above < k) & ((above + F.col("n") >= k) | (F.col("below") == 0))
    border = at.filter(least).select(*by, F.col(x).alias("__least"), F.when(above + F.col("n") > k, k - above).alias("__taken"))
    on = lambda frame, one, how: frame.join(F.broadcast(one), by or F.lit(True), how)  # noqa: E731  a row of a group at most
    order = F.struct(tie, "__row")
    tied = on(rows, border.filter("__taken is not null"), "inner").filter(F.col(x) == F.col("__least"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(tie, "__row"))
    last = tied.withColumn("__place", place).filter("__place = __taken").select(*by, order.alias("__last"))
    told = on(on(rows, border, "left"), last, "left")
    taken = (F.col(x) > F.col("__least")) | ((F.col(x) == F.col("__least")) & (F.col("__taken").isNull() | (order <= F.col("__last"))))
    return told.withColumn(out, F.coalesce(taken, F.lit(False))).drop("__least", "__taken", "__last")
