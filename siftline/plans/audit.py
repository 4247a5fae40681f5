"""Audits behind a firewall: select on internal data, freeze the specification, then score once on external data.

``freeze`` returns the specification with its hash; ``evaluate_external`` takes only a frozen specification and is the
one place that reads external labels.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import compare, ridge, stats
from siftline.tables import load, union


class FrozenSpec(NamedTuple):
    """One (assay, feature_set, model) for each assay, as JSON, and the hash that identifies it."""

    text: str
    digest: str

    def rows(self) -> list[dict]:
        if hashlib.sha256(self.text.encode()).hexdigest() != self.digest:
            raise ValueError("the specification was changed after it was frozen")
        return json.loads(self.text)


def job_table(frame: DataFrame, key: str, feature_sets: dict[str, str], assays: list[str], fold: str) -> DataFrame:
    """Long jobs: one row per feature set, assay and labelled row, in place of nested loops."""
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_set"), F.col(c).cast("array<double>").alias("x")) for n, c in feature_sets.items()]))
    labels = F.explode(F.array(*[F.struct(F.lit(a).alias("assay"), F.col(a).cast("double").alias("y")) for a in assays]))
    return frame.select(key, fold, sets.alias("s"), *assays).select(key, fold, "s.*", labels.alias("l")).select(key, fold, "feature_set", "x", "l.*").filter("y is not null")


def internal_metrics(frame: DataFrame, key: str, feature_sets: dict[str, str], assays: list[str], fold: str, pca: int | None = None) -> DataFrame:
    """Out-of-fold competitive metrics of every feature set and assay; values are risk-oriented by assay."""
    found = ridge.fold_predictions(job_table(frame, key, feature_sets, assays, fold), ["feature_set", "assay"], key, "x", "y", fold, pca=pca)
    return stats.competitive_metrics(found, ["feature_set", "assay"], "y_true", "y_pred", key).withColumn("model", F.lit("ridge"))


def freeze(metrics: DataFrame, train: DataFrame, key: str, feature_sets: dict[str, str], metric: str = "spearman") -> FrozenSpec:
    """The best feature set of each assay with the penalty that all training rows choose for it, frozen. One row per
    assay reaches the driver."""
    best = stats.best_per(metrics, ["assay"], metric, "feature_set", "model").select("assay", "feature_set", "model", F.round(metric, 6).alias(metric)).orderBy("assay").collect()
    rows = [r.asDict() for r in best]
    for row in rows:
        none = train.filter("false")
        models, _ = ridge.external_predictions(_for(train, key, row, feature_sets), _for(none, key, row, feature_sets), ["assay", "feature_set"], key, "x", "y")
        row["alpha"] = models.first()["alpha"]
    text = json.dumps(rows, sort_keys=True)
    return FrozenSpec(text, hashlib.sha256(text.encode()).hexdigest())


def _for(frame: DataFrame, key: str, row: dict, feature_sets: dict[str, str]) -> DataFrame:
    """The features and labels of one row of the specification."""
    return frame.select(key, F.lit(row["assay"]).alias("assay"), F.lit(row["feature_set"]).alias("feature_set"), F.col(feature_sets[row["feature_set"]]).alias("x"), F.col(row["assay"]).cast("double").alias("y"))


def evaluate_external(spec: FrozenSpec, train: DataFrame, external: DataFrame, key: str, feature_sets: dict[str, str]) -> DataFrame:
    """Full-train fit with the frozen penalty and one external score for each frozen row."""
    parts = []
    for row in spec.rows():
        _, found = ridge.external_predictions(_for(train, key, row, feature_sets), _for(external, key, row, feature_sets), ["assay", "feature_set"], key, "x", "y", (row["alpha"],))
        parts.append(found.withColumnRenamed(key, "id"))
    return stats.competitive_metrics(union(parts), ["assay", "feature_set"], "y_true", "y_pred", "id")


def comparison(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Internal and external scores of the frozen rows side by side, deltas and verdict."""
    pick = ["spearman", "worst_recall", "worst_auroc", "n"]
    a = internal.select("assay", "feature_set", *[F.col(c).alias(f"internal_{c}") for c in pick])
    b = external.select("assay", "feature_set", *[F.col(c).alias(f"external_{c}") for c in pick])
    met = b.join(a, ["assay", "feature_set"], "left")
    deltas = met.withColumn("delta_spearman", F.col("external_spearman") - F.col("internal_spearman")).withColumn("delta_auroc", F.col("external_worst_auroc") - F.col("internal_worst_auroc"))
    return deltas.withColumn("verdict", compare.triage_verdict(F.col("external_worst_auroc"), F.col("external_spearman")))


def useful(external: DataFrame, rho: float, auroc: float) -> DataFrame:
    """Marks rows that reach both bars: 0.30 and 0.70 in one audit, 0.25 and 0.70 in the other."""
    return external.withColumn("useful", F.coalesce((F.col("spearman") >= rho) & (F.col("worst_auroc") >= auroc), F.lit(False)))


def audit(train: DataFrame, external: DataFrame, key: str, feature_sets: dict[str, str], assays: list[str], fold: str) -> tuple[FrozenSpec, DataFrame]:
    internal = internal_metrics(train, key, feature_sets, assays, fold)
    spec = freeze(internal, train, key, feature_sets)
    return spec, comparison(internal, evaluate_external(spec, train, external, key, feature_sets))


def audit_on_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The audit on embeddings: two slices as feature sets, two made-up assays, every fourth vector external."""
    e = F.col("embedding")

    def at(i: int):
        return F.get(e, F.lit(i)).cast("double")

    rows = load(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 5).alias("fold"), F.slice(e, 1, 16).alias("front"), F.slice(e, 17, 16).alias("back"), (at(0) * 2 - at(3) + at(20) / 4).alias("HIC"), (at(18) + at(2) / 3).alias("Titer")
    )
    train, external = rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0")
    return audit(train, external, "vec_id", {"front": "front", "back": "back"}, ["HIC", "Titer"], "fold")[1]
