import pytest

from siftline.functions import conditions as C
from siftline.functions import sequences as S
from siftline.functions import vectors as V
from siftline.tables import nan_to_null, require_columns, require_unique
from pyspark.sql import functions as F


def test_physical_features(spark):
    heavy = "-" * 25 + "KRHDE" + "-" * 119
    rows = [("KKRDE", "FWYAC", heavy, "-" * 149), (None, "A", heavy, heavy), ("", "", "", "")]
    frame = spark.createDataFrame(rows, "vh_protein_sequence string, vl_protein_sequence string, heavy_aligned_aho string, light_aligned_aho string")
    got = S.physical_features(frame).collect()
    assert len(got[0]) == 55
    assert (got[0].vh_net_charge, got[0].vh_length, got[0].vh_lys_arg_asymmetry) == (1.0, 5.0, 1.0)
    assert got[0].vl_hydrophobic_fraction == 1.0 and got[0].heavy_cdr_positive_count == 3.0
    assert got[1].vh_length is None and got[2].vh_hydrophobic_fraction == 0.0
    with pytest.raises(ValueError):
        S.physical_features(frame.drop("heavy_aligned_aho"))


def test_aligned_identity(spark):
    rows = [("AK-D", "AKCD", 1.0), ("AKD", "AR", 0.5), ("--", "AB", None), ("", "A", None), (None, "A", None)]
    frame = spark.createDataFrame(rows, "a string, b string, want double")
    for r in frame.select("want", S.aligned_identity(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want


def test_numbers(spark):
    rows = [("~14.5 at 60 mg/mL", 14.5, 60.0), ("60 for viscosity; 10 for DLS", 60.0, 60.0), ("none", None, None), (None, None, None), ("10-20 1e-3", 10.0, 10.0)]
    frame = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = frame.select(C.numeric_first(F.col("t")).alias("a"), C.numeric_max(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [r[1:] for r in rows]


def test_labels_and_regimes(spark):
    frame = spark.createDataFrame([(0.8,), (0.6,), (0.2,), (None,)], "s double")
    assert [r[0] for r in frame.select(C.risk_label(F.col("s"))).collect()] == ["high", "medium", "low", "unknown"]
    one = spark.range(1)
    regime = lambda *v: one.select(C.classify_regime(*[F.lit(float(x)) for x in v])).first()[0]
    assert [regime(0.6, 0, 0, 0), regime(0.2, 0, 0, 0), regime(0, 0.1, 0, 1)] == ["percolated_network", "finite_reversible_clusters", "dispersed_fluid"]
    charges = one.select(*[C.residue_charge(F.lit(n), F.lit(ph)) for n, ph in (("LYS", 7.4), ("HIS", 6.0), ("HIS", 7.4), ("ASP", 7.0), ("ALA", 7.0))]).first()
    assert list(charges) == [1.0, 0.5, 0.05, -1.0, 0.0]


def test_vectors(spark):
    frame = spark.createDataFrame([([0.0, 10.0], [10.0, 0.0])], "a array<double>, b array<double>")
    got = frame.select(*[v.alias(k) for k, v in V.pair_blocks(F.col("a"), F.col("b")).items()], V.distance(F.col("a"), F.col("b")).alias("d")).first()
    assert (list(got["mean"]), list(got["diff"]), list(got["absdiff"]), list(got["prod"])) == ([5.0, 5.0], [-10.0, 10.0], [10.0, 10.0], [0.0, 0.0])
    assert got.d == pytest.approx(200**0.5)
    masked = spark.createDataFrame([(1, [2.0, 4.0], 1), (1, [4.0, 8.0], 1), (1, [100.0, 100.0], 0), (2, [1.0, 1.0], 0)], "k int, v array<double>, m int")
    assert {r.k: list(r.pooled) for r in V.mean_pool(masked, ["k"], "v", "m").collect()} == {1: [3.0, 6.0], 2: [0.0, 0.0]}


def test_guards(spark):
    frame = spark.createDataFrame([(float("nan"), 1), (2.0, 1)], "x double, k int")
    assert nan_to_null(frame).filter("x is null").count() == 1
    for check in (lambda: require_columns(frame, "y"), lambda: require_unique(frame, "k")):
        with pytest.raises(ValueError):
            check()
