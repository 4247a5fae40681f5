"""Patchy-particle contact networks: independent runs are the rows of a parameter table, one group map each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.conditions import classify_regime

# Fixed values of the particle: patch radius and arc, core and hydrophobic patch, neighbour cutoff.
PATCH_RADIUS, PATCH_ARC, CORE, STICKY, NEIGHBOUR = 0.72, 0.85, (-0.38, 0.0), (0.12, 0.52), 2.0
PARAMETERS = ("net_charge", "cdr_charge", "vh_vl_charge_imbalance", "fab_charge_strength", "core_charge_strength", "same_charge_repulsion", "hydrophobic_attraction", "contact_cutoff", "patch_valence")
FRAME = ("n_edges", "attractive_edges", "mean_degree", "largest_cluster_fraction", "degree_cv", "repulsive_edge_fraction", "percolated", "edge_turnover")


def _offsets(valence: int) -> np.ndarray:
    arc = np.linspace(-PATCH_ARC, PATCH_ARC, valence) if valence > 1 else np.zeros(1)
    return np.vstack([PATCH_RADIUS * np.column_stack([np.cos(arc), np.sin(arc)]), [CORE], [STICKY]])


def _signs(p: dict) -> np.ndarray:
    """Sign of each charged patch; the core has the opposite of the net charge, or of the patches where it is zero."""
    patch = int(np.sign(p["cdr_charge"])) or int(p["vh_vl_charge_imbalance"] >= 4)
    return np.array([patch] * int(p["patch_valence"]) + [int(-np.sign(p["net_charge"] or patch))])


def contacts(positions: np.ndarray, angles: np.ndarray, p: dict, box: float) -> pd.DataFrame:
    """Edges (i, j, attraction, repulsion, kind) of one frame.

    Whether two particles are neighbours goes by the nearest periodic image; patch distances are plain, as defined.
    """
    i, j = np.triu_indices(len(positions), 1)
    gap = positions[i] - positions[j]
    gap -= box * np.round(gap / box)
    near = (gap * gap).sum(axis=1) <= NEIGHBOUR**2
    i, j = i[near], j[near]
    c, s = np.cos(angles), np.sin(angles)
    turn = np.stack([np.stack([c, -s], 1), np.stack([s, c], 1)], 1)
    patches = positions[:, None, :] + np.einsum("nij,kj->nki", turn, _offsets(int(p["patch_valence"])))
    signs = _signs(p)
    reach = {k: p["contact_cutoff"] * (0.7 + g * min(p[v], 2.0)) for k, g, v in (("a", 0.45, "fab_charge_strength"), ("r", 0.35, "same_charge_repulsion"), ("h", 0.45, "hydrophobic_attraction"))}
    charged = patches[:, :-1]
    apart = np.linalg.norm(charged[i][:, :, None] - charged[j][:, None], axis=3)
    product = signs[:, None] * signs[None, :]

    def closest(mask: np.ndarray, cutoff: float) -> np.ndarray:
        close = np.where(mask[None], 1 - apart / cutoff, 0.0)
        return np.maximum(close.max(axis=(1, 2), initial=0.0), 0.0)

    pull, push = closest(product < 0, reach["a"]), closest(product > 0, reach["r"])
    grease = np.maximum(1 - np.linalg.norm(patches[i, -1] - patches[j, -1], axis=1) / reach["h"], 0.0)
    attraction = p["fab_charge_strength"] * pull + p["hydrophobic_attraction"] * grease
    repulsion = p["same_charge_repulsion"] * push
    kind = np.select([(attraction > 0) & (repulsion > 0), (grease > 0) & (pull == 0), pull > 0], ["mixed", "hydrophobic", "charge_complementary"], "same_charge_repulsive")
    keep = (attraction > 0) | (repulsion > 0)
    return pd.DataFrame({"i": i[keep], "j": j[keep], "attraction": attraction[keep], "repulsion": repulsion[keep], "kind": kind[keep]})


def observables(n: int, edges: pd.DataFrame) -> dict[str, float]:
    """Size, degree and cluster measures of one frame; clusters by edges that attract more than they repel."""
    good = edges[edges["attraction"] > edges["repulsion"]]
    degree = np.bincount(np.concatenate([good["i"], good["j"]]).astype(int), minlength=n).astype(float)
    parent = np.arange(n)
    for a, b in zip(good["i"], good["j"], strict=True):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    largest = np.bincount(parent, minlength=1).max() / n
    return {
        "n_edges": float(len(edges)),
        "attractive_edges": float(len(good)),
        "mean_degree": degree.mean(),
        "largest_cluster_fraction": largest,
        "degree_cv": degree.std() / degree.mean() if degree.any() else 0.0,
        "repulsive_edge_fraction": (edges["kind"] == "same_charge_repulsive").sum() / max(1, len(edges)),
        "percolated": float(largest >= 0.5),
    }


def simulate(p: dict, particles: int = 150, steps: int = 100, density: float = 0.08, seed: int = 7, move: float = 0.18, turn: float = 0.25) -> tuple[pd.DataFrame, list[int]]:
    """Frames with their turnover, and the lifetimes of all contacts."""
    if particles <= 1 or steps <= 0 or density <= 0:
        raise ValueError("particles must be over 1, steps and density over 0")
    rng = np.random.default_rng(seed)
    box = float(np.sqrt(particles / density))
    at, angle = rng.uniform(0, box, (particles, 2)), rng.uniform(-np.pi, np.pi, particles)
    alive: dict[tuple[int, int], int] = {}
    ended: list[int] = []
    frames = []
    for step in range(steps):
        at = (at + rng.normal(0, move, at.shape)) % box
        angle = angle + rng.normal(0, turn, particles)
        edges = contacts(at, angle, p, box)
        good = edges[edges["attraction"] > edges["repulsion"]]
        now = set(zip(good["i"].tolist(), good["j"].tolist(), strict=True))
        either = now | alive.keys()
        turnover = 1 - len(now & alive.keys()) / len(either) if either else 0.0
        ended += [n for e, n in alive.items() if e not in now]
        alive = {e: alive.get(e, 0) + 1 for e in now}
        frames.append(observables(particles, edges) | {"step": step, "edge_turnover": turnover})
    return pd.DataFrame(frames), ended + list(alive.values())


def sweep(parameters: DataFrame, particles: int = 60, steps: int = 30, density: float = 0.08, seed: int = 7) -> DataFrame:
    """One row for each parameter row (run_id and ``PARAMETERS``): mean and maximum of each measure, lifetimes, regime."""
    fields = [f"{c}_{f} double" for c in FRAME for f in ("mean", "max")] + ["cluster_lifetime_mean double", "cluster_lifetime_p90 double"]
    kind = parameters.schema["run_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        p = {c: float(part[c].iloc[0]) for c in PARAMETERS}
        frames, lifetimes = simulate(p, particles, steps, density, seed)
        row = {"run_id": part["run_id"].iloc[0]}
        for c in FRAME:
            row[f"{c}_mean"], row[f"{c}_max"] = float(frames[c].mean()), float(frames[c].max())
        row["cluster_lifetime_mean"] = float(np.mean(lifetimes)) if lifetimes else None
        row["cluster_lifetime_p90"] = float(np.quantile(lifetimes, 0.9)) if lifetimes else None
        return pd.DataFrame([row])

    done = parameters.groupBy("run_id").applyInPandas(run, ", ".join([f"run_id {kind}", *fields]))
    c = F.col
    regime = classify_regime(c("largest_cluster_fraction_mean"), c("percolated_mean"), c("mean_degree_mean"), F.coalesce("cluster_lifetime_mean", F.lit(0.0)))
    return done.withColumn("regime", regime)


def regime_grid(spark, attraction: list[float], repulsion: list[float], valences: list[int], hydrophobic: float = 0.0, cutoff: float = 0.7) -> DataFrame:
    """Parameter rows of a sweep: the product of three short lists."""
    if min(attraction, default=0) < 0 or min(repulsion, default=0) < 0 or min(valences, default=1) < 1:
        raise ValueError("strengths must not be negative, valences at least 1")
    rows = [(a, r, v) for a in attraction for r in repulsion for v in valences]
    frame = spark.createDataFrame([(i, float(a), float(r), int(v)) for i, (a, r, v) in enumerate(rows)], "run_id int, attraction_strength double, repulsion_strength double, patch_valence int")
    c = F.col
    return frame.select(
        "*", c("repulsion_strength").alias("net_charge"), F.lit(1.0).alias("cdr_charge"), c("patch_valence").cast("double").alias("vh_vl_charge_imbalance"),
        c("attraction_strength").alias("fab_charge_strength"), c("attraction_strength").alias("core_charge_strength"),
        c("repulsion_strength").alias("same_charge_repulsion"), F.lit(hydrophobic).alias("hydrophobic_attraction"), F.lit(cutoff).alias("contact_cutoff"),
    )
