"""Numbers and flags from curated text, and the maps from descriptors to regime coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, and texts that stand for none.
NUMBER = r"[-+]?(?:\d+\.\d+|\d+)(?:[eE][-+]?\d+)?"
MISSING = ("none", "nan", "not_used_for_v0_numeric_calibration")


def numeric_values(text: Column) -> Column:
    """All signed, decimal or exponent numbers of a text; none in NULL or a word for missing."""
    known = text.isNotNull() & ~F.lower(F.trim(text)).isin(*MISSING)
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.when(known, found).otherwise(F.array().cast("array<double>"))


def numeric_first(text: Column, default: float | None = None) -> Column:
    return F.coalesce(F.get(numeric_values(text), F.lit(0)), F.lit(default).cast("double"))


def numeric_max(text: Column, default: float | None = None) -> Column:
    return F.coalesce(F.array_max(numeric_values(text)), F.lit(default).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def joined(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


# Words that tell a mechanism, and those that tell an additive.
MECHANISMS = {
    "charge_mechanism_signal": "charge|electrostatic|fab-fc|fab fc|cation|anion|salt|pi",
    "hydrophobic_mechanism_signal": "hydrophobic|aromatic|short-range",
    "specific_interface_signal": "fab-fab|fab fab|fab-fc|fab fc|fv|patch|anisotropic",
}
ADDITIVES = "arg|trehalose|excipient|additive"


def condition_features(include_mechanism: bool = False) -> dict[str, Column]:
    """Features of a curated solution condition, by the names of its text columns."""
    salt = numeric_max(F.col("salt_mM"), 0.0)
    concentration = numeric_max(F.col("protein_concentration_mg_ml"), 0.0)
    ph = numeric_first(F.col("pH"))
    salt_text = F.lower(joined("salt_type", "salt_mM", "buffer"))
    additive = F.lower(joined("additive_type", "additive_concentration"))
    screening = ionic_strength_screening(salt)
    mechanism = F.lower(joined("reported_mechanism", "self_association_measure")) if include_mechanism else F.lit("")
    return {
        "pH_numeric": ph,
        "salt_mM_numeric": salt,
        "protein_concentration_mg_ml_numeric": concentration,
        "temperature_C_numeric": numeric_first(F.col("temperature_C"), 25.0),
        "has_salt": flag(salt > 0),
        "salt_screening_factor": screening,
        "salt_load": 1 - screening,
        "low_salt_condition": flag((salt > 0) & (salt <= 50)),
        "high_salt_condition": flag(salt >= 100),
        "arginine_or_excipient": flag(salt_text.contains("arg") | additive.rlike(ADDITIVES)),
        "concentration_scaled": clip(concentration / 200, 0.0, 1.5),
        "high_concentration": flag(concentration >= 100),
        "low_pH_charge_boost": clip(7.4 - F.coalesce(ph, F.lit(7.4)), 0.0, 2.0) / 2,
        **{k: flag(mechanism.rlike(p)) for k, p in MECHANISMS.items()},
    }


def ionic_strength_screening(ionic: Column, reference: float = 50.0) -> Column:
    return F.sqrt(reference / (reference + ionic))


def ph_charge_factor(ph: Column, reference: float = 7.4, slope: float = 0.12) -> Column:
    return clip(1 + slope * (reference - ph), 0.4, 1.8)


def solution_factors(ph: Column, ionic: Column) -> tuple[Column, Column]:
    """Factors of attraction and repulsion under a pH and an ionic strength."""
    screening, charge = ionic_strength_screening(ionic), ph_charge_factor(ph)
    return screening * charge, screening / charge


COEFFICIENTS = (
    "concentration_to_attraction",
    "salt_screening_to_attraction",
    "salt_to_repulsion",
    "additive_to_mitigation",
    "mechanism_to_attraction",
    "hydrophobic_to_attraction",
    "mechanism_to_valence",
)


def literature_coordinates() -> dict[str, Column]:
    """Attraction, repulsion and valence from ``condition_features`` and the coefficient columns of one grid row."""
    f = F.col
    relief = f("additive_to_mitigation") * f("arginine_or_excipient")
    attraction = (
        f("concentration_to_attraction") * f("concentration_scaled")
        + f("salt_screening_to_attraction") * f("salt_screening_factor")
        + f("mechanism_to_attraction") * f("charge_mechanism_signal")
        + f("hydrophobic_to_attraction") * f("hydrophobic_mechanism_signal")
        + 0.4 * f("low_pH_charge_boost")
        - relief
    )
    repulsion = f("salt_to_repulsion") * f("salt_load") + relief + 0.25 * f("high_salt_condition")
    valence = f("high_concentration") + f("low_salt_condition") + f("mechanism_to_valence") * f("specific_interface_signal")
    return {
        "attraction_strength": clip(attraction, 0.0, 4.0),
        "repulsion_strength": clip(repulsion, 0.0, 1.5),
        "patch_valence": F.when(valence < 0.75, 1).when(valence < 1.5, 3).otherwise(5),
    }


def network_risk_score() -> Column:
    f = F.col
    return f("largest_cluster_fraction") + f("percolation_probability") + 0.25 * f("mean_degree") - 0.25 * f("edge_turnover")


def classify_regime(largest: Column, percolated: Column, degree: Column, lifetime: Column) -> Column:
    return (
        F.when((percolated >= 0.35) | (largest >= 0.5), "percolated_network")
        .when((largest >= 0.18) | (degree >= 1.0) | (lifetime >= 2.5), "finite_reversible_clusters")
        .otherwise("dispersed_fluid")
    )


def archetype(net: Column, cdr: Column, imbalance: Column, hydrophobic: Column, imbalance_bar: Column, hydrophobic_bar: Column) -> Column:
    """Four charge and hydrophobicity states joined by ``|``; the bars are table-wide quantiles, not below 4 and 0.42."""
    return F.concat_ws(
        "|",
        F.when(net >= 3, "globally_positive").when(net <= -3, "globally_negative").otherwise("balanced_charge"),
        F.when(cdr >= 2, "cdr_positive").when(cdr <= -2, "cdr_negative").otherwise("cdr_balanced"),
        F.when(imbalance >= F.greatest(F.lit(4.0), imbalance_bar), "high_charge_asymmetry").otherwise("low_charge_asymmetry"),
        F.when(hydrophobic >= F.greatest(F.lit(0.42), hydrophobic_bar), "hydrophobic_cdr").otherwise("ordinary_cdr"),
    )


def particle_parameters(net: Column, cdr: Column, imbalance: Column, hydrophobic: Column) -> dict[str, Column]:
    """A particle's strengths and number of patches from charge and hydrophobicity descriptors."""
    direction = F.least((F.abs(cdr) + 0.5 * imbalance) / 14, F.lit(1.0))
    sticky = clip((hydrophobic - 0.28) / 0.28, 0.0, 1.0)
    return {
        "net_charge": net,
        "cdr_charge": cdr,
        "vh_vl_charge_imbalance": imbalance,
        "fab_charge_strength": 0.2 + 1.4 * direction,
        "core_charge_strength": 0.15 + 0.8 * F.least(F.abs(net) / 18, F.lit(1.0)),
        "same_charge_repulsion": 0.1 + 1.2 * F.least(F.abs(net) / 24, F.lit(1.0)),
        "hydrophobic_attraction": 0.05 + 1.1 * sticky,
        "patch_valence": clip(F.ceil(1 + direction + sticky).cast("double"), 1.0, 4.0).cast("int"),
    }


def risk_label(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def residue_charge(name: Column, ph: Column) -> Column:
    return (
        F.when(name.isin("LYS", "ARG"), 1.0)
        .when(name == "HIS", F.when(ph <= 6.0, 0.5).otherwise(0.05))
        .when(name.isin("ASP", "GLU"), -1.0)
        .otherwise(0.0)
    )
