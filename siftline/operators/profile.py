"""Axis profiles: percentiles in a reference, weighted scores, labels and drivers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.conditions import risk_label
from siftline.functions.text import fixed2, general3
from siftline.operators.ranking import value_positions
from siftline.tables import unpivot

class Axis(NamedTuple):
    """Weights of an axis' features, what the report says of it, and whether its score may be shown as a risk."""

    weights: dict[str, float]
    suggested_assay: str
    confidence: str = "low"
    evidence_strength: str = "low"
    benchmark_support: str = ""
    mutation_direction: str = ""
    mechanistic_note: str = ""
    assign_risk: bool = True


# The axes of a report in their order, with the words it prints.
AXES: dict[str, Axis] = {
    "Hydrophobicity": Axis(
        {"fv_cdr_hydrophobic_fraction": 0.35, "fv_cdr_aromatic_fraction": 0.30, "vh_hydrophobic_fraction": 0.15, "vl_hydrophobic_fraction": 0.15, "cdr_h3_length": 0.05},
        "HIC / SMAC", "medium-high", "medium-high",
        "HIC/SMAC-like endpoints align with hydrophobic/aromatic local features.",
        "Inspect exposed CDR/framework aromatic or bulky hydrophobic residues; consider reducing solvent-exposed aromatic clustering while preserving binding.",
        "Exposed aromatic or hydrophobic CDR/framework burden.",
    ),
    "Polyreactivity": Axis(
        {"fv_cdr_positive_count": 0.25, "fv_cdr_net_charge": 0.20, "cdr_charge_fraction_of_fv": 0.20, "vh_vl_charge_imbalance": 0.20, "fv_cdr_hydrophobic_fraction": 0.15},
        "PR_CHO / PR_Ova", "medium", "medium",
        "PR endpoints retain strong charge-baseline behavior with local-feature contribution.",
        "Reduce excessive positive CDR charge or charge imbalance; check hydrophobic CDR surfaces that may drive nonspecific biological matrix binding.",
        "Positive charge, CDR charge density, and nonspecific binding surfaces.",
    ),
    "Local self-association": Axis(
        {"heavy_cdr_positive_count": 0.25, "cdr_h3_length": 0.25, "fv_cdr_hydrophobic_fraction": 0.25, "fv_cdr_aromatic_fraction": 0.15, "fv_cdr_positive_count": 0.10},
        "AC-SINS", "medium", "medium",
        "AC-SINS residuals align better with local CDR patch features than network risk.",
        "Inspect H3 length, heavy-chain CDR positive charge, and aromatic/hydrophobic CDR burden; prioritize conservative edits outside binding-critical contacts.",
        "Local CDR patch stickiness and immobilized-assay geometry.",
    ),
    "Thermostability": Axis(
        {"cdr_h3_length": 0.30, "vh_vl_hydrophobicity_imbalance": 0.25, "vh_vl_charge_imbalance": 0.20, "fv_cdr_hydrophobic_fraction": 0.15, "fv_net_charge": 0.10},
        "DSF / DSC", "low", "low",
        "Current sequence-only descriptors are not validated for fold stability.",
        "Do not mutate from this module alone; run DSF/DSC or use a dedicated stability model.",
        "Crude sequence-only stability proxy; use structure or stability models when available.",
        False,
    ),
    "Titer / expression": Axis(
        {"vh_length": 0.20, "vl_length": 0.20, "fv_cdr_hydrophobic_fraction": 0.20, "fv_net_charge": 0.20, "vh_vl_charge_imbalance": 0.20},
        "Expression screen", "low", "low",
        "Titer prediction is process- and host-cell-dependent; current proxies are weak.",
        "Do not interpret molecular percentile proxies as expression liability; validate in the intended expression system.",
        "Weak-confidence process flag; expression is not purely molecular.",
        False,
    ),
}
# The network axis with a projection and without, its place, and the measures its drivers name.
NETWORK = "Bulk network / viscosity"
NETWORK_PLACE = 3
NETWORK_MEASURES = ("mapped_largest_cluster_fraction", "mapped_percolation_probability", "mapped_mean_degree")
NETWORK_ASSAY = "HAC / high-concentration viscosity"
PROJECTED = {
    "confidence": "low-medium",
    "evidence_strength": "suggestive",
    "benchmark_support": "HAC shows network-like residual structure in archetype diagnostics, but the strongest cluster-preserving permutation control did not pass.",
    "recommended_experiment": "HAC / high-concentration viscosity / DLS-SAXS if formulation risk matters",
    "mutation_direction": "Treat as a formulation hypothesis; inspect charge architecture and validate at high concentration before mutation decisions.",
    "mechanistic_note": "Literature-calibrated solution-regime projection; HAC network signal is suggestive but failed the strongest cluster-preserving permutation null.",
}
NOT_PROJECTED = {
    "confidence": "low",
    "evidence_strength": "low",
    "benchmark_support": "Network projection not supplied.",
    "recommended_experiment": "HAC / high-concentration viscosity",
    "mutation_direction": "No network-axis mutation recommendation without projection.",
    "mechanistic_note": "Needs literature-calibrated network projection.",
}


def percentiles(long: DataFrame, feature: str, value: str, out: str = "percentile") -> DataFrame:
    """Adds the share of the feature's rows at or below each value: positions of distinct values, then a join."""
    at = value_positions(long, [feature], value)
    share = at.select(feature, value, ((F.col("below") + F.col("n")) / F.col("total")).alias(out))
    return long.join(share, [feature, value], "left")


def reference_percentile(value: Column, reference: DataFrame, column: str) -> DataFrame:
    """One row: share of the reference at or below a value; NULL with an empty reference or a NULL value."""
    known = F.col(column).isNotNull()
    return reference.agg(F.when(value.isNotNull(), F.try_divide(F.count_if(known & (F.col(column) <= value)).cast("double"), F.count_if(known))).alias("percentile"))


def axis_report(frame: DataFrame, key: str, projection: DataFrame | None = None, axes: dict[str, Axis] = AXES, drivers: int = 3) -> DataFrame:
    """One row for each key and axis, the network axis always among them, in the order of ``axis_pos``.

    The score is the weighted mean of the features' percentiles; weights are renormalised over those that are known, and axes
    that stand for no risk show none. ``main_features`` names the features with the highest percentiles, ties by place
    in the axis, with value and percentile. ``projection`` (key, network_risk_score, mapped_regime and the mapped measures, if
    any) scores the network axis of the keys it has; the others' is unknown.
    """
    used = [c for c in dict.fromkeys(f for a in axes.values() for f in a.weights) if c in frame.columns]
    long = percentiles(unpivot(frame, [key], used, "feature", "value"), "feature", "value")
    at = lambda i: i + (i >= NETWORK_PLACE)
    weights = [(name, at(i), f, k, w) for i, (name, a) in enumerate(axes.items()) for k, (f, w) in enumerate(a.weights.items())]
    met = long.join(F.broadcast(frame.sparkSession.createDataFrame(weights, "axis string, axis_pos int, feature string, feature_pos int, weight double")), "feature")  # a row for each weight
    p, w = F.col("percentile"), F.col("weight")
    told = F.when(F.col("value").isNull(), F.concat("feature", F.lit(" high vs reference"))).otherwise(F.concat("feature", F.lit("="), general3(F.col("value")), F.lit(" (percentile "), fixed2(p), F.lit(")")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce(p, F.lit(-1.0))).alias("first"), "feature_pos", told.alias("told"))))
    scored = met.groupBy(key, "axis", "axis_pos").agg(
        F.try_divide(F.sum(w * p), F.sum(F.when(p.isNotNull(), w))).alias("score"), F.array_join(F.transform(F.slice(ordered, 1, drivers), lambda t: t["told"]), "; ").alias("main_features")
    )
    words = frame.sparkSession.createDataFrame(
        [(n, a.assign_risk, a.suggested_assay, a.confidence, a.evidence_strength, a.benchmark_support, a.suggested_assay, a.mutation_direction, a.mechanistic_note) for n, a in axes.items()],
        "axis string, assign_risk boolean, suggested_assay string, confidence string, evidence_strength string, benchmark_support string, recommended_experiment string, mutation_direction string, mechanistic_note string",
    )
    named = scored.join(F.broadcast(words), "axis")  # a row for each axis
    shown = F.col("assign_risk")
    report = named.withColumns({"risk_score": F.when(shown, F.col("score")), "risk_label": F.when(shown, risk_label(F.col("score"))).otherwise("not assigned")}).drop("score", "assign_risk")
    return report.unionByName(network_axis(frame.select(key), projection, key).withColumn("axis_pos", F.lit(min(NETWORK_PLACE, len(axes)))))


def network_axis(keys: DataFrame, projection: DataFrame | None, key: str) -> DataFrame:
    """The network axis' row of every key."""
    if projection is None:
        projection = keys.limit(0).select(key, F.lit(None).cast("double").alias("network_risk_score"), F.lit(None).cast("string").alias("mapped_regime"))
    met = keys.join(projection.withColumn("supplied", F.lit(True)), key, "left")
    has, score = F.coalesce("supplied", F.lit(False)), F.col("network_risk_score").cast("double")
    measures = [F.concat(F.lit(f"{c}="), general3(F.col(c).cast("double"))) for c in NETWORK_MEASURES if c in projection.columns]
    drivers = F.concat_ws("; ", F.concat(F.lit("network_risk_score="), F.coalesce(general3(score), F.lit("nan"))), F.concat(F.lit("mapped_regime="), F.coalesce("mapped_regime", F.lit("unknown regime"))), *measures)
    words = {c: F.when(has, PROJECTED[c]).otherwise(NOT_PROJECTED[c]).alias(c) for c in PROJECTED}
    return met.select(
        key, F.lit(NETWORK).alias("axis"), F.when(has, drivers).otherwise("network projection not supplied").alias("main_features"), F.lit(NETWORK_ASSAY).alias("suggested_assay"),
        *words.values(), score.alias("risk_score"), risk_label(score).alias("risk_label"),
    )
