"""Exact order inside groups of any size, without sorting a group in one task.

Rows are dealt to buckets whose order is the order asked for: by splitters, which an approximate sketch of every group finds in
one aggregation, or by the leading bits of a hash. Rows are numbered inside a bucket; counts of the buckets before, at most
``BUCKETS`` numbers a group, make the numbers whole. Splitters decide how even buckets are, never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.tables import both, pin

#: Buckets of a group by splitters, a power of two, and leading bits of a hash.
BUCKETS = 256
HASH_BITS = 12
#: Steps of a binary search through the splitters.
STEPS = [BUCKETS >> k for k in range(1, BUCKETS.bit_length())]


def met(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by``, where NULL is a group like any other; the right side's other columns are added."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({c: f"__on_{c}" for c in by})
    return left.join(named, both([F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in by]), how).drop(*[f"__on_{c}" for c in by])


#: A row's place: a hash of group and bucket, which sorts fast, and both.
PLACE = ["__s", "__k", "__bucket"]


def in_buckets(frame: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """Adds ``PLACE``. A group is one value that is never NULL: windows and plain joins on it share one shuffle and one sort, where
    null-safe joins would ask for others."""
    dealt = frame.withColumns({"__bucket": bucket, "__k": F.struct(*by) if by else F.struct(F.lit(0).alias("all"))})
    return dealt.withColumn("__s", F.xxhash64("__k", "__bucket"))


def splitters(frame: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, splits_<column>): about equally spaced values of every numeric column, all columns and groups in one aggregation."""
    at = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    return frame.groupBy(*by).agg(*[F.percentile_approx(c, at, F.lit(8 * BUCKETS)).alias(f"splits_{c}") for c in columns])


def bucket_of(x: Column, splits: Column) -> Column:
    """How many splitters are at or below a value: its bucket. NULL has none."""
    found = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda low, step: F.when(F.get(splits, low + step - 1) <= x, low + step).otherwise(low))
    return F.when(x.isNotNull(), found)


def numbered(frame: DataFrame, by: list[str], order: list[Column], bucket: Column, out: str, keep_size: str | None = None) -> DataFrame:
    """Adds ``out``: 1-based numbers of the rows of every group in an order, given buckets that follow it; with
    ``keep_size`` also the group's rows. Buckets are the unit of work."""
    dealt = in_buckets(frame, by, bucket)
    inside = F.row_number().over(Window.partitionBy(*PLACE).orderBy(*order))
    counts = dealt.groupBy(*PLACE).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    size = {keep_size: F.sum("__n").over(Window.partitionBy("__k"))} if keep_size else {}
    offsets = counts.select(*PLACE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *[v.alias(k) for k, v in size.items()])
    done = dealt.withColumn("__inside", inside).join(offsets, PLACE)
    return done.withColumn(out, F.col("__before") + F.col("__inside")).drop(*PLACE, "__inside", "__before")


def numbered_by(frame: DataFrame, by: list[str], key: str, out: str, *ties: str, keep_size: str | None = None) -> DataFrame:
    """Adds 1-based numbers by a numeric key (NULL keys last), ties by the columns named."""
    split = met(frame, splitters(frame, by, [key]), by)
    bucket = F.coalesce(bucket_of(F.col(key), F.col(f"splits_{key}")), F.lit(BUCKETS))
    return numbered(split, by, [F.asc_nulls_last(key), *ties], bucket, out, keep_size).drop(f"splits_{key}")


def hashed(seed: Column, key: str) -> Column:
    """60 bits of md5 over seed and key as text: a seeded order that any engine can follow."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def hash_bucket(h: Column) -> Column:
    """The leading bits of ``hashed``."""
    return F.shiftright(h, 60 - HASH_BITS).cast("int")


#: Distinct values of a group that one task sorts when a quantile is picked; above it the group is split again.
SORTED_VALUES = 1_000_000


def _select(values: DataFrame, group: list[str], targets: DataFrame, most: int, level: int = 0) -> DataFrame:
    """``targets`` (group, __rank from 0, any others) with ``__value``: the value that holds the rank among ``values`` (group, __v, so many times).

    Groups of more than ``most`` distinct values are cut at their splitters, and only the buckets that hold a rank are
    kept; so each step leaves a small part of a group, until what is left can be sorted.
    """
    largest = values.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        upto = F.sum("__times").over(Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        ranged = values.withColumn("__upto", upto)
        found = met(ranged, targets, group).filter((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__times")))
        return found.withColumn("__value", F.col("__v")).drop("__v", "__times", "__upto")
    bucket = f"__b{level}"
    dealt = met(values, splitters(values, group, ["__v"]), group).withColumn(bucket, bucket_of(F.col("__v"), F.col("splits___v"))).drop("splits___v")
    counts = dealt.groupBy(*group, bucket).agg(F.sum("__times").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = met(counts.withColumn("__before", before), targets, group).filter((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
    located = pin(located.withColumn("__rank", F.col("__rank") - F.col("__before")).drop("__before", "__n"))
    kept = pin(met(dealt, located.select(*group, bucket).distinct(), [*group, bucket]))
    return _select(kept, [*group, bucket], located, most, level + 1)


def quantiles(frame: DataFrame, by: list[str], fractions: dict[str, list[float]], most: int = SORTED_VALUES) -> DataFrame:
    """(by, one array of doubles for each column): exact quantiles, interpolated between neighbours, of all columns and groups at once.

    NULL values are left out. A column without values gives NULLs; a group without values in any column is not there (without
    ``by`` there is always one row). No buffer holds a group: values are counted first, then narrowed to brackets.
    """
    long = frame.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__v")) for c in fractions])).alias("__e")).select(*by, "__e.*")
    group = [*by, "__c"]
    values = pin(long.filter("__v is not null").groupBy(*group, "__v").agg(F.count("*").alias("__times")))
    asked = F.create_map(*[x for c, own in fractions.items() for x in (F.lit(c), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(own)]))])
    sizes = values.groupBy(*group).agg(F.sum("__times").alias("__total")).withColumn("__e", F.explode(asked[F.col("__c")]))
    at = F.col("__e.q") * (F.col("__total") - 1)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("__end"), F.floor(at).alias("__rank")), F.struct(F.lit(1).alias("__end"), F.ceil(at).alias("__rank")))).alias("t")
    targets = sizes.select(*group, F.col("__e.i").alias("__i"), at.alias("__at"), ends).select(*group, "__i", "__at", "t.*")
    found = _select(values, group, targets, most)
    side = lambda k: F.max(F.when(F.col("__end") == k, F.col("__value")))
    both_ends = found.groupBy(*group, "__i", "__at").agg(side(0).alias("__low"), side(1).alias("__high"))
    low = F.floor("__at")
    value = F.when(F.col("__at") == low, F.col("__low")).otherwise((low + 1 - F.col("__at")) * F.col("__low") + (F.col("__at") - low) * F.col("__high"))
    picked = both_ends.withColumn("__value", value)
    return picked.groupBy(*by).agg(*[F.array(*[F.max(F.when((F.col("__c") == c) & (F.col("__i") == i), F.col("__value"))) for i in range(len(own))]).alias(c) for c, own in fractions.items()])
