"""Sequence descriptors as Column expressions: they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.tables import require_columns

# Residue classes and alignment windows (half-open, from 0).
POSITIVE, NEGATIVE, AROMATIC, HYDROPHOBIC = "KRH", "DE", "FWY", "AILMFWYVC"
HEAVY_REGIONS = {"cdr_h1": (25, 42), "cdr_h2": (56, 76), "cdr_h3": (105, 138)}
LIGHT_REGIONS = {"cdr_l1": (24, 42), "cdr_l2": (56, 72), "cdr_l3": (104, 130)}
GAPS = "-|*"


def ascii_upper(text: Column) -> Column:
    """a-z in upper case; other letters stay, so lengths and counts agree across engines."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def clean_sequence(sequence: Column) -> Column:
    """Without gaps, separators and stops; NULL stays NULL."""
    return F.translate(sequence, GAPS, "")


def count_of(sequence: Column, members: str) -> Column:
    """Characters of ``sequence`` that are in ``members``."""
    return F.regexp_count(sequence, F.lit(f"[{members}]")).cast("double")


def region(aligned: Column, window: tuple[int, int]) -> Column:
    """Slice of an aligned sequence; beyond its end there is nothing."""
    return F.substring(aligned, window[0] + 1, window[1] - window[0])


def regions(aligned: Column, windows: dict[str, tuple[int, int]]) -> Column:
    return F.concat(*[region(aligned, w) for w in windows.values()])


def composition(sequence: Column, prefix: str) -> dict[str, Column]:
    """Ten descriptors of one sequence. An empty one has zero counts and fractions; NULL gives NULL."""
    s = clean_sequence(sequence)
    length = F.length(s).cast("double")
    positive, negative = count_of(s, POSITIVE), count_of(s, NEGATIVE)
    aromatic, hydrophobic = count_of(s, AROMATIC), count_of(s, HYDROPHOBIC)
    share = F.greatest(length, F.lit(1.0))
    parts = {
        "length": length,
        "net_charge": positive - negative,
        "positive_count": positive,
        "negative_count": negative,
        "aromatic_count": aromatic,
        "hydrophobic_count": hydrophobic,
        "lys_arg_asymmetry": count_of(s, "K") - count_of(s, "R"),
        "acid_base_imbalance": F.abs(positive - negative),
        "hydrophobic_fraction": hydrophobic / share,
        "aromatic_fraction": aromatic / share,
    }
    return {f"{prefix}_{k}": v for k, v in parts.items()}


def physical_features(frame: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 55 sequence features of each row, after the columns named in ``keep``."""
    require_columns(frame, "vh_protein_sequence", "vl_protein_sequence", "heavy_aligned_aho", "light_aligned_aho")
    heavy = regions(F.col("heavy_aligned_aho"), HEAVY_REGIONS)
    light = regions(F.col("light_aligned_aho"), LIGHT_REGIONS)
    found: dict[str, Column] = {}
    for prefix, sequence in (
        ("vh", F.col("vh_protein_sequence")),
        ("vl", F.col("vl_protein_sequence")),
        ("heavy_cdr", heavy),
        ("light_cdr", light),
        ("fv_cdr", F.concat(heavy, light)),
    ):
        found |= composition(sequence, prefix)
    net = found["vh_net_charge"] + found["vl_net_charge"]
    found["cdr_h3_length"] = F.length(clean_sequence(region(F.col("heavy_aligned_aho"), HEAVY_REGIONS["cdr_h3"]))).cast("double")
    found["fv_net_charge"] = net
    found["vh_vl_charge_imbalance"] = F.abs(found["vh_net_charge"] - found["vl_net_charge"])
    found["vh_vl_hydrophobicity_imbalance"] = F.abs(found["vh_hydrophobic_fraction"] - found["vl_hydrophobic_fraction"])
    found["cdr_charge_fraction_of_fv"] = found["fv_cdr_net_charge"] / F.greatest(F.abs(net), F.lit(1.0))
    return frame.select(*keep, *[v.alias(k) for k, v in found.items()])


def aligned_identity(a: Column, b: Column, gap: str = "-") -> Column:
    """Equal positions over positions without a gap on either side; NULL where none is comparable."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(F.substring(a, i, F.lit(1)).alias("x"), F.substring(b, i, F.lit(1)).alias("y")),
    )
    open_ = F.filter(pairs, lambda p: (p["x"] != gap) & (p["y"] != gap) & (p["x"] != "") & (p["y"] != ""))
    same = F.size(F.filter(open_, lambda p: p["x"] == p["y"]))
    return F.when(n > 0, F.try_divide(same.cast("double"), F.size(open_)))


def feature_family(name: Column) -> dict[str, Column]:
    """Chain region and chemistry of a feature name, by prefix and then by substring; the first rule that fits counts."""
    place = (
        F.when(name.startswith("vh_"), "vh")
        .when(name.startswith("vl_"), "vl")
        .when(name.startswith("heavy_cdr_"), "heavy_cdr")
        .when(name.startswith("light_cdr_"), "light_cdr")
        .when(name.startswith("fv_cdr_") | name.startswith("cdr_"), "cdr")
        .otherwise("global")
    )
    chemistry = (
        F.when(name.rlike("hydrophobic|aromatic"), "hydrophobic_aromatic")
        .when(name.rlike("charge|positive|negative|lys_arg|acid_base"), "charge")
        .when(name.contains("length"), "length")
        .when(name.rlike("imbalance|asymmetry"), "imbalance")
        .otherwise("composition_other")
    )
    return {
        "chain_region": place,
        "chemistry": chemistry,
        "is_cdr": place.isin("heavy_cdr", "light_cdr", "cdr"),
        "is_framework_or_full_variable": place.isin("vh", "vl"),
    }
