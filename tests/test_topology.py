import numpy as np
import pandas as pd
import pytest

from siftline.functions.sequences import HEAVY_REGIONS
from siftline.operators import topology


def residues(seed=5, n=60):
    rng = np.random.default_rng(seed)
    names = rng.choice(["LYS", "ASP", "PHE", "ALA", "GLY", "HIS"], n)
    letters = dict(LYS="K", ASP="D", PHE="F", ALA="A", GLY="G", HIS="H")
    xyz = rng.uniform(0, 28, (n, 3))
    return pd.DataFrame({"structure_id": [f"s{i % 2}" for i in range(n)], "residue_id": range(n), "resname": names, "aa": [letters[x] for x in names], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "is_cdr": rng.random(n) < 0.4})


def components(ids, xyz, cutoff):
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and np.linalg.norm(xyz[i] - xyz[j]) <= cutoff and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_blocks(spark):
    pdf = residues()
    frame = spark.createDataFrame(pdf)
    surface = topology.surface_composition(frame)
    assert len(surface.columns) == 30
    got = topology.topology_features(frame)
    assert len(got.columns) == 51
    rows = {r.structure_id: r for r in got.collect()}
    for sid, part in pdf.groupby("structure_id"):
        xyz = {r.residue_id: np.array([r.x, r.y, r.z]) for r in part.itertuples()}
        ids = part.residue_id.tolist()
        edges = [(i, j) for i in ids for j in ids if i < j and np.linalg.norm(xyz[i] - xyz[j]) <= 10]
        positive = part[part.resname.isin(["LYS", "ARG", "HIS"])].residue_id.tolist()
        label = components(positive, xyz, 10)
        sizes = pd.Series(label).value_counts()
        r = rows[sid]
        assert (r.surface_graph_nodes, r.surface_graph_edges) == (len(ids), len(edges))
        assert (r.positive_patch_count, r.positive_largest_patch_size) == (len(sizes), sizes.max())
        negative = set(part[part.resname == "ASP"].residue_id)
        assert r.positive_negative_adjacent_edge_count == sum((i in positive) != (j in positive) and (i in negative) != (j in negative) for i, j in edges)
        assert r.surface_graph_mean_degree == pytest.approx(2 * len(edges) / len(ids))


def test_charge_topology(spark):
    pdf = residues()
    got = topology.charge_topology(spark.createDataFrame(pdf))
    assert len(got.columns) == 37
    frame = topology.surface_residues(spark.createDataFrame(pdf)).toPandas()
    rows = {r.structure_id: r.asDict() for r in got.collect()}
    for sid, part in frame.groupby("structure_id"):
        q = part.resname.map({"LYS": 1.0, "HIS": 0.5, "ASP": -1.0}).fillna(0.0)
        xyz = part[["x", "y", "z"]].to_numpy()
        assert rows[sid]["pH6p0_surface_net_charge"] == pytest.approx(q.sum())
        dipole = (q.to_numpy()[:, None] * (xyz - xyz.mean(0))).sum(0) / max(q.abs().sum(), 1)
        assert rows[sid]["pH6p0_charge_dipole_proxy"] == pytest.approx(np.linalg.norm(dipole))
        radial = np.linalg.norm(xyz[q.to_numpy() != 0] - xyz.mean(0), axis=1)
        assert rows[sid]["pH6p0_charge_radial_variance_proxy"] == pytest.approx(radial.var())


def test_missing_structure_and_positions(spark):
    features = topology.charge_topology(spark.createDataFrame(residues()))
    names = spark.createDataFrame([("S0",), ("absent",)], "antibody_name string")
    assert {r.antibody_name: r.structure_available for r in topology.with_missing_structures(names, features, "antibody_name").collect()} == {"S0": 1.0, "absent": 0.0}
    rows = spark.createDataFrame([(1, "-" * 24 + "AB" + "-" * 15 + "CD")], "k int, s string")
    got = topology.aligned_positions(rows, "k", "s", HEAVY_REGIONS).orderBy("position").collect()
    assert [(r.position, r.is_region) for r in got] == [(0, False), (1, True), (2, True), (3, False)]
