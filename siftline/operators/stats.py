"""Evaluation statistics by group: errors, tail recall, AUROC, fold totals, nulls and empirical p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.order import met, quantiles
from siftline.operators.ranking import average_rank, guarded_corr, pairs_of, tails_flagged
from siftline.tables import pin, union


def missingness(frame: DataFrame) -> DataFrame:
    """column, n_missing, missing_fraction, dtype: one aggregation, most missing first."""
    kinds = dict(frame.dtypes)
    counts = frame.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in frame.columns])
    entries = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing"), F.lit(kinds[c]).alias("dtype")) for c in frame.columns])
    )
    long = counts.select("__n", entries.alias("e")).select("__n", "e.*")
    share = F.coalesce(F.try_divide(F.col("n_missing").cast("double"), F.col("__n")), F.lit(0.0))
    return long.select("column", "n_missing", share.alias("missing_fraction"), "dtype").orderBy(F.desc("missing_fraction"), F.desc("n_missing"), "column")


def fold_summary(frame: DataFrame, folds: list[str]) -> DataFrame:
    """Rows of each value (NULL included) of the fold columns that are there."""
    parts = [frame.groupBy(F.col(c).cast("string").alias("fold")).count().select(F.lit(c).alias("fold_column"), "fold", F.col("count").alias("n")) for c in folds if c in frame.columns]
    if not parts:
        raise ValueError("none of the fold columns is there")
    return union(parts)


def complete(frame: DataFrame, truth: str, prediction: str) -> DataFrame:
    return frame.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull())


def error_metrics(frame: DataFrame, by: list[str], truth: str, prediction: str, least: int = 3) -> DataFrame:
    """n, pearson, rmse, r2, label_sd (population), rmse_over_sd over complete pairs; NULL for fewer than ``least``."""
    t, p = F.col("t"), F.col("p")
    pairs = complete(frame, truth, prediction).select(*by, F.col(truth).cast("double").alias("t"), F.col(prediction).cast("double").alias("p"))
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        guarded_corr(t, p, least).alias("pearson"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.stddev_pop(t).alias("label_sd"),
        F.avg((t - p) * (t - p)).alias("mse"),
    )
    enough = F.col("n") >= least

    def shown(c: Column) -> Column:
        return F.when(enough, c)

    variance = F.col("label_sd") * F.col("label_sd")
    return sums.select(
        *by,
        "n",
        "pearson",
        shown(F.col("rmse")).alias("rmse"),
        shown(1 - F.try_divide(F.col("mse"), F.nullif(variance, F.lit(0.0)))).alias("r2"),
        shown(F.col("label_sd")).alias("label_sd"),
        shown(F.try_divide(F.col("rmse"), F.nullif(F.col("label_sd"), F.lit(0.0)))).alias("rmse_over_sd"),
    )


def ranked_tails(frame: DataFrame, by: list[str], truth: str, prediction: str, tie: str, bad_fraction: float = 0.2, pinned: bool = False) -> DataFrame:
    """Complete pairs (by, tie, x: truth, y: prediction) with their ranks ``rx`` and ``ry`` of ``x_total`` rows, and ``bad`` and ``told``: in
    the worst tail by truth, and by prediction. ``pinned``: the frame comes from pinned rows without a shuffle."""
    return tails_flagged(pairs_of(frame, by, truth, prediction, tie, pinned=pinned), by, lambda total: F.ceil(F.lit(bad_fraction) * total), tie)


def tail_flags(frame: DataFrame, by: list[str], truth: str, prediction: str, tie: str, bad_fraction: float = 0.2) -> DataFrame:
    """Complete pairs (by, tie, truth, prediction) with ``bad`` and ``told``: in the worst tail by truth, and by prediction."""
    flagged = tails_flagged(pairs_of(frame, by, truth, prediction, tie), by, lambda total: F.ceil(F.lit(bad_fraction) * total), tie, ranked=False)
    return flagged.select(*by, tie, F.col("x").alias(truth), F.col("y").alias(prediction), "bad", "told")


def _recall() -> Column:
    return F.try_divide(F.count_if(F.col("bad") & F.col("told")).cast("double"), F.count_if("bad"))


def auroc(frame: DataFrame, by: list[str], positive: str, score: str, out: str) -> DataFrame:
    """Rank-sum area under the ROC curve; NULL without both classes."""
    ranked = average_rank(frame.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()), by, score, "__r")
    n_pos = F.count_if(F.col(positive)).cast("double")
    n_neg = F.count_if(~F.col(positive)).cast("double")
    rank_sum = F.sum(F.when(F.col(positive), F.col("__r")))
    return ranked.groupBy(*by).agg(F.try_divide(rank_sum - n_pos * (n_pos + 1) / 2, F.nullif(n_pos * n_neg, F.lit(0.0))).alias(out))


def risk_oriented(frame: DataFrame, truth: str, prediction: str, low_is_risky: Column) -> DataFrame:
    """Truth and prediction negated where low values are the risky ones."""
    sign = F.when(low_is_risky, -1.0).otherwise(1.0)
    return frame.withColumn(truth, F.col(truth) * sign).withColumn(prediction, F.col(prediction) * sign)


def competitive_metrics(frame: DataFrame, by: list[str], truth: str, prediction: str, tie: str, bad_fraction: float = 0.2, pinned: bool = False) -> DataFrame:
    """The triage record of each group: rank and linear correlation, errors, recall and AUROC of the worst tail.

    Values are risk-oriented (high is bad). The tail holds ceil(bad_fraction x n) rows.
    """
    return triage_record(ranked_tails(frame, by, truth, prediction, tie, bad_fraction, pinned), by)


def triage_record(ranked: DataFrame, by: list[str]) -> DataFrame:
    """The record of ``competitive_metrics`` from ``ranked_tails``."""
    n_bad, n_good = F.count_if("bad").cast("double"), F.count_if(~F.col("bad")).cast("double")
    t, p = F.col("x"), F.col("y")
    enough = F.count("*") >= 3
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        guarded_corr(F.col("rx"), F.col("ry")).alias("spearman"),
        guarded_corr(t, p).alias("pearson"),
        F.when(enough, F.sqrt(F.avg((t - p) * (t - p)))).alias("rmse"),
        F.when(enough, 1 - F.try_divide(F.avg((t - p) * (t - p)), F.nullif(F.var_pop(t), F.lit(0.0)))).alias("r2"),
        F.when(enough, F.stddev_pop(t)).alias("label_sd"),
        F.when(enough, F.try_divide(F.sqrt(F.avg((t - p) * (t - p))), F.nullif(F.stddev_pop(t), F.lit(0.0)))).alias("rmse_over_sd"),
        F.when(enough, _recall()).alias("worst_recall"),
        F.when(enough, F.try_divide(F.sum(F.when(F.col("bad"), F.col("ry"))) - n_bad * (n_bad + 1) / 2, F.nullif(n_bad * n_good, F.lit(0.0)))).alias("worst_auroc"),
    )


def official_metrics(frame: DataFrame, by: list[str], truth: str, prediction: str, tie: str, fraction: float = 0.1, higher_is_better: bool = True) -> DataFrame:
    """n, spearman and recall of the best floor(fraction x n), at least one row; NULL below three rows."""
    sign = 1.0 if higher_is_better else -1.0
    pairs = frame.select(*by, tie, (F.col(truth) * sign).alias("t"), (F.col(prediction) * sign).alias("p"))
    tails = tails_flagged(pairs_of(pairs, by, "t", "p", tie), by, lambda total: F.greatest(F.lit(1), F.floor(F.lit(fraction) * total)), tie)
    return tails.groupBy(*by).agg(
        F.count("*").alias("n"), guarded_corr(F.col("rx"), F.col("ry")).alias("spearman"), F.when(F.count("*") >= 3, _recall()).alias("top_recall")
    )


def fold_totals(frame: DataFrame, by: list[str], fold: str, truth: str, prediction: str, tie: str) -> DataFrame:
    """Official metrics of each fold, of all folds together (``aggregated``) and the mean of the folds (``average``)."""
    each = official_metrics(frame, [*by, fold], truth, prediction, tie).withColumn(fold, F.col(fold).cast("string"))
    whole = official_metrics(frame, by, truth, prediction, tie).withColumn(fold, F.lit("aggregated"))
    mean = each.groupBy(*by).agg(F.sum("n").alias("n"), F.avg("spearman").alias("spearman"), F.avg("top_recall").alias("top_recall")).withColumn(fold, F.lit("average"))
    return union([each, whole, mean])


def failure_labels(frame: DataFrame, directions: dict[str, str], quantile: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Worst-quantile labels (NULL where not measured) and the table of thresholds, measured rows and failures."""
    found = quantiles(frame, [], {c: [1 - quantile if d == "high" else quantile] for c, d in directions.items()})
    bars = pin(found.select(*[F.get(c, F.lit(0)).alias(f"__{c}") for c in directions]))
    met = frame.crossJoin(F.broadcast(bars))  # one row
    labels = met.select(*[c for c in frame.columns if c not in directions], *[(F.col(c) >= F.col(f"__{c}") if d == "high" else F.col(c) <= F.col(f"__{c}")).alias(c) for c, d in directions.items()])
    summary = labels.agg(*[F.struct(F.count(c).alias("measured"), F.count_if(F.col(c)).alias("failures")).alias(c) for c in directions]).crossJoin(F.broadcast(bars))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("assay"), F.lit(d).alias("direction"), F.col(f"__{c}").alias("threshold"), F.col(c)["measured"].alias("measured"), F.col(c)["failures"].alias("failures")) for c, d in directions.items()]))
    return labels, summary.select(rows.alias("e")).select("e.*")


def jaccard_pairs(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Jaccard similarity of every pair of label columns over rows where both are known, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def of(a: str, b: str) -> Column:
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.try_divide(F.count_if(known & F.col(a) & F.col(b)).cast("double"), F.count_if(known & (F.col(a) | F.col(b))))

    wide = labels.agg(*[of(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("jaccard")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(rows.alias("e")).select("e.*")


def rank_of(frame: DataFrame, by: list[str], value: str, ours: Column) -> DataFrame:
    """(by, value, rank, n): the competition rank of each group's own row (the largest where several are ``ours``) among all known
    values, largest first. One aggregation finds the row, another counts what lies above it."""
    known = frame.filter(F.col(value).isNotNull())
    own = known.filter(ours).groupBy(*by).agg(F.max(value).alias("__own"))
    counted = met(known, own, by).groupBy(*by, "__own").agg(F.count_if(F.col(value) > F.col("__own")).alias("above"), F.count("*").alias("n"))
    return counted.select(*by, F.col("__own").alias(value), (F.col("above") + 1).alias("rank"), "n")


def empirical_p(observed: DataFrame, controls: DataFrame, by: list[str], value: str) -> DataFrame:
    """Null mean, 95 % quantile and (1 + controls at or above the observed value) / (controls + 1)."""
    met = controls.withColumnRenamed(value, "__null").join(observed.select(*by, value), by)
    return met.groupBy(*by).agg(
        F.first(value).alias("observed"),
        F.count("__null").alias("n_null"),
        F.avg("__null").alias("null_mean"),
        F.percentile("__null", F.lit(0.95)).alias("null_q95"),
        ((1 + F.count_if(F.col("__null") >= F.col(value))) / (F.count("__null") + 1)).alias("empirical_p"),
    )


def best_per(frame: DataFrame, by: list[str], metric: str, *ties: str) -> DataFrame:
    """The row with the largest metric of each group, whole; NULL metrics come last, ties by the columns named."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric), *ties)
    return frame.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def fold_calibration(frame: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x for each fold, fitted on all other folds: sums minus the fold's own sums."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = frame.filter(x_.isNotNull() & y_.isNotNull())
    per = pairs.groupBy(fold).agg(F.count("*").cast("double").alias("n"), F.sum(x_).alias("sx"), F.sum(y_).alias("sy"), F.sum(x_ * y_).alias("sxy"), F.sum(x_ * x_).alias("sxx"))
    every = per.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "sx", "sy", "sxy", "sxx")])
    rest = per.crossJoin(F.broadcast(every)).select(fold, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")])  # one row
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fitted = rest.withColumn("slope", slope)
    return fitted.select(fold, "slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n")).alias("intercept"))


def ridge_line(frame: DataFrame, fold: str, x: str, y: str, alpha: float) -> DataFrame:
    """One-feature ridge for each fold on all others, standardised x: closed form Sxy / (Sxx + alpha) from sums."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = frame.filter(x_.isNotNull() & y_.isNotNull())
    per = pairs.groupBy(fold).agg(F.count("*").cast("double").alias("n"), F.sum(x_).alias("sx"), F.sum(y_).alias("sy"), F.sum(x_ * y_).alias("sxy"), F.sum(x_ * x_).alias("sxx"))
    every = per.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "sx", "sy", "sxy", "sxx")])
    rest = per.crossJoin(F.broadcast(every)).select(fold, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")])  # one row
    c = F.col
    mean_x, mean_y = c("sx") / c("n"), c("sy") / c("n")
    scale = F.sqrt(c("sxx") / c("n") - mean_x * mean_x)
    centred = (c("sxy") - c("n") * mean_x * mean_y) / scale
    return rest.select(fold, mean_x.alias("mean_x"), mean_y.alias("mean_y"), scale.alias("scale"), (centred / (c("n") + alpha)).alias("weight"))
