"""Preprocessing fitted fold by fold: medians, moments, modes and levels of every fold's training rows, and their use.

A fold's training rows are all others, so everything but medians is what all folds have less what the fold has: counts of
levels and sums of values are aggregated once by fold. The fitted state is a table of a row for each fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.order import met, quantiles
from siftline.tables import pin


def fit(frame: DataFrame, fold: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(fold, numeric, categorical): for each fold, arrays in the columns' order: structs of median, mean and deviation
    (population, missing values filled, 1 where constant), and structs of mode and levels (sorted, as maps to their place).

    The mode is the commonest level, ties to the least. A column without training values has median 0 and no mode.
    """
    rows = pin(frame.select(F.col(fold).alias("fold"), *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)], *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)]))
    state = folds = rows.select("fold").distinct()
    every = rows.select("*", F.explode(F.array_remove(F.array(*[F.lit(r[0]) for r in folds.collect()]).cast(f"array<{frame.schema[fold].dataType.simpleString()}>"), F.col("fold"))).alias("left_out")) if numeric else rows
    if numeric:
        names = [f"n{i}" for i in range(len(numeric))]
        medians = quantiles(every.drop("fold"), ["left_out"], {c: [0.5] for c in names}).select(F.col("left_out").alias("fold"), *[F.coalesce(F.get(c, F.lit(0)), F.lit(0.0)).alias(f"{c}_median") for c in names])
        sums = rows.groupBy("fold").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in names for k, f in (("known", F.count), ("sum", lambda x: F.coalesce(F.sum(x), F.lit(0.0))), ("squares", lambda x: F.coalesce(F.sum(F.col(x) * F.col(x)), F.lit(0.0))))])
        whole = Window.partitionBy()  # a row for each fold
        others = sums.select("fold", *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in sums.columns if c != "fold"])
        told = met(met(state, others, ["fold"], "left"), medians, ["fold"], "left")

        def moments(c: str):
            median = F.coalesce(f"{c}_median", F.lit(0.0))
            filled = F.col("n") - F.col(f"{c}_known")
            mean = F.try_divide(F.col(f"{c}_sum") + filled * median, F.col("n"))
            variance = F.try_divide(F.col(f"{c}_squares") + filled * median * median, F.col("n")) - mean * mean
            sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
            return F.struct(median.alias("median"), mean.alias("mean"), F.when(sd > 1e-7 * F.abs(mean), sd).otherwise(1.0).alias("sd"))

        state = told.select("fold", F.array(*map(moments, names)).alias("numeric"))
    else:
        state = state.withColumn("numeric", F.array().cast("array<struct<median:double,mean:double,sd:double>>"))
    levels = rows.select("fold", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("level")) for i in range(len(categorical))])).alias("e")).select("fold", "e.*").filter("level is not null") if categorical else None
    if levels is None:
        return pin(state.withColumn("categorical", F.array().cast("array<struct<mode:string,levels:map<string,int>>>")))
    own = levels.groupBy("i", "level", "fold").agg(F.count("*").alias("own"))
    counts = met(own.groupBy("i", "level").agg(F.sum("own").alias("n")).crossJoin(F.broadcast(folds)), own, ["i", "level", "fold"], "left")  # a row for each fold
    trained = counts.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).filter("n > 0")
    best = trained.groupBy("fold", "i").agg(F.min_by("level", F.struct((-F.col("n")).alias("n"), "level")).alias("mode"), F.array_sort(F.collect_list("level")).alias("sorted"))
    places = F.map_from_arrays("sorted", F.sequence(F.lit(0), F.size("sorted") - 1))
    maps = best.select("fold", "i", F.struct("mode", places.alias("levels")).alias("c"))
    none = F.struct(F.lit(None).cast("string").alias("mode"), F.create_map().cast("map<string,int>").alias("levels"))
    wide = maps.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("by"))
    told = met(state, wide, ["fold"], "left")
    return pin(told.select("fold", "numeric", F.array(*[F.coalesce(F.try_element_at("by", F.lit(i)), none) for i in range(len(categorical))]).alias("categorical")))


def transform(frame: DataFrame, fold: str, state: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Adds ``scaled`` (array<double>: filled with the median, less the mean, over the deviation) and ``hot`` (array<int>: the place
    of each column's level among the sorted levels of the fold's training rows). Missing levels take the mode; levels the
    training rows lack, and columns without any, are NULL: all zeros when spread out."""
    told = met(frame, state.withColumnsRenamed({"numeric": "__numeric", "categorical": "__categorical", "fold": fold}), [fold])
    scaled = [(F.coalesce(F.col(c).cast("double"), F.get("__numeric", F.lit(i))["median"]) - F.get("__numeric", F.lit(i))["mean"]) / F.get("__numeric", F.lit(i))["sd"] for i, c in enumerate(numeric)]
    place = lambda i, c: F.try_element_at(F.get("__categorical", F.lit(i))["levels"], F.coalesce(F.col(c).cast("string"), F.get("__categorical", F.lit(i))["mode"]))
    hot = [place(i, c) for i, c in enumerate(categorical)]
    return told.withColumns({"scaled": F.array(*scaled).cast("array<double>"), "hot": F.array(*hot).cast("array<int>")}).drop("__numeric", "__categorical")


def spread(transformed: DataFrame, widths: list[int], out: str = "features") -> DataFrame:
    """Adds ``out``: scaled columns and one 0/1 column for each level of columns with ``widths`` levels."""

    def flags_of(i: int, width: int):
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.get("hot", F.lit(i)) == k)

    ones = [flags_of(i, w) for i, w in enumerate(widths) if w]
    flags = F.transform(F.concat(*ones), lambda b: F.coalesce(b.cast("double"), F.lit(0.0))) if ones else F.array().cast("array<double>")
    return transformed.withColumn(out, F.concat("scaled", flags))
