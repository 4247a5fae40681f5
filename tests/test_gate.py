import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import topology
from siftline.plans import gate
from test_topology import residues


def test_scramble_keeps_composition_and_places(spark):
    frame = topology.surface_residues(spark.createDataFrame(residues()))
    moved = gate.scramble(frame, 3)
    key = lambda f: sorted((r.structure_id, r.region_bin, r.resname) for r in f.collect())
    assert key(frame) == key(moved)
    assert moved.join(frame.select("residue_id", F.col("x").alias("x0")), "residue_id").filter("x <> x0").count() == 0


def test_blocks_and_gate(spark):
    pdf = residues(n=480)
    pdf["structure_id"] = [f"s{i % 24}" for i in range(480)]
    blocks = gate.feature_blocks(spark.createDataFrame(pdf), [1, 2])
    assert {r.feature_block for r in blocks.select("feature_block").distinct().collect()} == {"surface_composition", "real_topology", "scrambled_topology_1", "scrambled_topology_2"}
    labels = gate.synthetic_labels(blocks, 7)
    assert labels.groupBy("assay").count().count() == 3
    folds = labels.withColumn("fold", F.pmod(F.xxhash64("structure_id"), F.lit(4)).cast("int"))
    metrics = gate.block_metrics(blocks, folds, "fold", [1])
    assert metrics.count() == 3 * 5
    rho = {(r.assay, r.feature_block): r.spearman for r in metrics.collect()}
    assert rho["positive_control_composition", "surface_composition"] > 0.8
    assert gate.real_scrambled_correlation(blocks).count() == 2


def test_families_and_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6))
    y = x[:, 0] * 3 + x[:, 1] + rng.normal(size=60) / 10
    frame = spark.createDataFrame([(i, [float(v) for v in r], float(t), i % 5) for i, (r, t) in enumerate(zip(x, y))], "id int, x array<double>, y double, fold int")
    drops = {r.family_removed: r.spearman_drop for r in gate.leave_one_family_out(frame, "id", "x", {"a": [0, 1], "b": [2, 3]}, "y", "fold").collect()}
    assert drops["a"] > 0.3 > drops["b"]
    rows = [(k, m, c, [float(k), float(len(c))]) for k in (1, 2) for m in ("m1", "m2") for c in ("VH", "VL")] + [(3, "m1", "VH", [0.0, 0.0])]
    chains = spark.createDataFrame(rows, "row_index int, model_name string, chain string, embedding array<double>")
    assert {len(r.x) for r in gate.embedding_features(chains, "row_index", "m1").collect()} == {12}
    sets = gate.embedding_sets(chains, spark.createDataFrame([(1, 0.5), (2, 0.7)], "row_index int, charge double"), "row_index", ["m1", "m2"])
    assert {r.feature_set for r in sets.collect()} == {"physics", "m1", "m1_plus_physics", "m2", "m2_plus_physics", "all_plus_physics"}


def test_kill_test(spark):
    of = lambda v: spark.createDataFrame([(v,)], "spearman double")
    assert [r.verdict for r in gate.kill_test(of(0.3), of(0.5), of(0.1)).collect()] == ["pass", "pass", "fail"]
    assert gate.kill_test(of(0.5), of(0.4), of(0.3)).first().value == pytest.approx(0.5)
