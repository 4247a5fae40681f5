import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.functions.text import fixed2, general3
from siftline.operators import compare, graph, models, nullmodels, order, pairs, profile, simulation, stats
from siftline.operators.ranking import average_rank, spearman


def frame_of(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_average_rank_and_spearman(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "x": rng.integers(0, 20, 500).astype(float), "y": rng.normal(size=500)})
    pdf.loc[::7, "x"] = np.nan
    frame = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = average_rank(frame, ["g"], "x", "r").toPandas()
    want = got.groupby("g")["x"].rank()
    assert np.allclose(got["r"].fillna(-1), want.fillna(-1))
    rho = {r.g: r.spearman for r in spearman(frame, ["g"], "x", "y").collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert rho[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()))
    constant = frame_of(spark, g=[1, 1, 1], x=[1.0, 1.0, 1.0], y=[1.0, 2.0, 3.0])
    assert spearman(constant, ["g"], "x", "y").first().spearman is None


def test_worst_tail(spark):
    values = [float(i) for i in range(10)]
    same = frame_of(spark, g=["a"] * 10, id=range(10), t=values, p=values)
    row = stats.competitive_metrics(same, ["g"], "t", "p", "id").first()
    assert (row.worst_recall, row.worst_auroc, row.spearman, row.rmse) == (1.0, 1.0, pytest.approx(1.0), 0.0)
    turned = frame_of(spark, g=["a"] * 10, id=range(10), t=values, p=values[::-1])
    assert stats.competitive_metrics(turned, ["g"], "t", "p", "id").first().worst_recall == 0.0
    low = stats.risk_oriented(turned, "t", "p", F.lit(True))
    assert stats.competitive_metrics(low, ["g"], "t", "p", "id").first().worst_recall == 0.0
    official = stats.official_metrics(same, ["g"], "t", "p", "id").first()
    assert (official.n, official.top_recall) == (10, 1.0)
    few = frame_of(spark, g=["a"] * 2, id=range(2), t=[1.0, 2.0], p=[1.0, 2.0])
    assert stats.official_metrics(few, ["g"], "t", "p", "id").first().top_recall is None


@pytest.mark.parametrize("by", [["g"], []])
def test_tails_are_exact_with_ties_and_equal_rows(spark, by):
    """Only border rows are numbered: ties by least id, NULL first; of rows equal in all, as many as are asked for. No row is dealt for it."""
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], None if i in (5, 6) else int(rng.integers(0, 30)), float(rng.integers(0, 4)), float(rng.integers(0, 60))) for i in range(120)]
    rows += [("same", 1, 2.0, 3.0)] * 7 + [("one", 1, 1.0, 1.0), (None, 2, 1.0, 1.0), ("a", 3, None, 1.0), ("b", 3, 1.0, None)]
    frame = spark.createDataFrame(rows, "g string, id long, t double, p double").repartition(5)
    for fraction in (0.0, 0.2, 0.5, 1.0):
        found = stats.ranked_tails(frame, by, "t", "p", "id", fraction).toPandas()
        known = pd.DataFrame([r for r in rows if (r[0] or not by) and None not in r[2:]], columns=["g", "id", "x", "y"])
        assert len(found) == len(known)
        for name, part in known.groupby("g") if by else [(None, known)]:
            own = found[found["g"] == name] if by else found
            k = int(np.ceil(fraction * len(part)))
            for c, out in (("x", "bad"), ("y", "told")):
                place = lambda f, c=c: sorted(zip(-f[c], f["id"].fillna(-1)))  # noqa: E731, B905
                assert place(own[own[out]]) == place(part)[:k]
                assert sorted(zip(own[c], own[f"r{c}"])) == sorted(zip(part[c], part[c].rank()))  # noqa: B905
    plan = stats.ranked_tails(frame, by, "t", "p", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert all("__taken" in x or "__place" in x for x in plan.splitlines() if x.strip(" :+-").startswith("Window"))


def test_fold_totals(spark):
    n = 50
    frame = frame_of(spark, g=["HIC"] * n, id=range(n), fold=[i % 5 for i in range(n)], t=[float(i) for i in range(n)], p=[float(i) for i in range(n)])
    got = {r.fold: r.spearman for r in stats.fold_totals(frame, ["g"], "fold", "t", "p", "id").collect()}
    assert got.keys() == {"0", "1", "2", "3", "4", "average", "aggregated"} and all(v == pytest.approx(1.0) for v in got.values())


def test_missingness_and_failures(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, 1.0)], "complete long, some_missing double")
    first = stats.missingness(frame).first()
    assert (first["column"], first.n_missing) == ("some_missing", 2)
    labels, table = stats.failure_labels(frame_of(spark, high_bad=range(1, 6), low_bad=range(1, 6)), {"high_bad": "high", "low_bad": "low"})
    assert [(r.high_bad, r.low_bad) for r in labels.collect()] == [(False, True), (False, False), (False, False), (False, False), (True, False)]
    assert {r.assay: r.failures for r in table.collect()} == {"high_bad": 1, "low_bad": 1}
    known = spark.createDataFrame([(True, True), (True, False), (None, True), (False, False)], "a boolean, b boolean")
    assert stats.jaccard_pairs(known, ["a", "b"]).first().jaccard == 0.5


def test_empirical_p(spark):
    observed = frame_of(spark, a=["x"], v=[0.5])
    controls = frame_of(spark, a=["x"] * 3, v=[0.1, 0.6, 0.2])
    assert stats.empirical_p(observed, controls, ["a"], "v").first().empirical_p == 0.5


def test_correlated_assays(spark):
    x = np.arange(5.0)
    edges = pairs.correlation_network(frame_of(spark, k=range(5), a=x, b=x * 2, c=[3.0, 1, 4, 1, 5]), "k", ["a", "b", "c"], 0.95).collect()
    assert [(e.a, e.b) for e in edges] == [("a", "b")]


@pytest.mark.parametrize("broadcast", [20_000, 2])
def test_correlation_network_ranks_a_column_once(spark, monkeypatch, broadcast):
    """Columns that share their missing rows are ranked once, others over the rows both have; as in pandas."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": range(300), **{c: rng.integers(0, n, 300).astype(float) for c, n in (("p.q", 4), ("b", 300), ("c", 9), ("d", 50), ("e", 1))}})
    pdf.loc[::7, ["c", "d"]] = np.nan
    pdf.loc[::5, "e"] = np.nan
    frame = spark.createDataFrame(pdf)
    frame = frame.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c.replace(".", "_")) if c != "k" else F.col(c) for c in pdf])
    pdf = pdf.rename(columns={"p.q": "p_q"})
    ranked = []
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(pairs, "value_positions", lambda rows, by, c, own=pairs.value_positions: ranked.append(c) or own(rows, by, c))
    columns = ["d", "p_q", "b", "c", "e"]
    got = {(e.a, e.b): (e.correlation, e.abs_correlation) for e in pairs.correlation_network(frame, "k", columns, 0.0).collect()}
    assert set(got) == {(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if "e" not in (a, b)}
    for (a, b), (rho, size) in got.items():
        assert rho == pytest.approx(pdf[[a, b]].corr("spearman").iloc[0, 1], abs=1e-12) and size == abs(rho)
    ranked.clear()
    pairs.correlation_network(frame, "k", ["p_q", "b"], 0.0)
    assert sorted(ranked) == ["c0", "c1"]
    assert pairs.correlation_network(frame, "k", ["b"], 0.0).collect() == []
    assert pairs.correlation_network(frame.limit(0), "k", ["b", "c"], 0.0).collect() == []


@pytest.mark.parametrize("scale", [0.0, 2.0])
def test_knn_in_blocks(spark, scale):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)) * np.exp(rng.normal(size=(60, 1)) * scale)
    v[7], v[8] = v[9], v[9]
    rows = [(i, i % 4, list(map(float, v[i])) if i != 13 else None, float(rng.normal()) if i % 9 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, g int, v array<double>, y double").repartition(3)
    for group in (None, "g"):
        want = {}
        for i, g, x, _ in rows:
            near = sorted((-round(float(np.dot(x, r[2])), 9), r[0], r[3]) for r in rows if x and r[2] and r[3] is not None and r[0] != i and (group is None or r[1] != g))[:3] if x else []
            if near:
                want[i] = (pytest.approx(np.mean([n[2] for n in near])), pytest.approx(-np.mean([n[0] for n in near])))
        for block in (7, 20_000):
            got = {r.q: (r.y_pred, r.mean_similarity) for r in pairs.knn_predictions(frame, "id", "v", "y", 3, group, block).collect()}
            assert got == want


def test_knn_skips_blocks_out_of_reach(spark):
    asked = frame_of(spark, key=[1, 2, 3], norm=[1.0, 1.0, 0.1], part=[0, 0, 0])
    first = frame_of(spark, q=[1, 1, 2, 3, 3], r=[8, 9, 8, 8, 9], similarity=[0.9, 0.5, 0.9, 0.6, 0.4])
    longest = frame_of(spark, block=[0, 1, 2], longest=[2.0, 0.6, 0.4])
    # the second of query 1 is out of reach for block 2; query 2 has found one only; query 3 is too short for both
    assert {(r.key, r.block) for r in pairs._in_reach(asked, first, longest, 2).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_contact_edges_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(-30, 30, (120, 3))
    frame = frame_of(spark, sid=[i % 2 for i in range(120)], id=range(120), x=pts[:, 0], y=pts[:, 1], z=pts[:, 2])
    got = {(r.src, r.dst) for r in graph.contact_edges(frame, "sid", "id", ("x", "y", "z"), 10.0).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and np.linalg.norm(pts[i] - pts[j]) <= 10}
    assert got == want
    edges = graph.contact_edges(frame, "sid", "id", ("x", "y", "z"), 10.0)
    a = {(r.id, r.component) for r in graph.component_labels(frame, edges, "sid", "id").collect()}
    assert a == {(r.id, r.component) for r in graph.spread_components(edges, frame, "id").collect()}


def test_contact_components_are_those_of_the_edges(spark, monkeypatch):
    """Two facing planes almost in contact, scattered points, copies, keys that come twice, rows without place."""
    monkeypatch.setattr(graph, "DIRECT_PAIRS", 4)
    rng = np.random.default_rng(5)
    plane = lambda x: [(x, y, z) for y in np.linspace(0, 3, 7) for z in np.linspace(0, 3, 7)]
    cloud = [tuple(p) for p in rng.uniform(-40, 40, (60, 3))]
    near = plane(100.0) + plane(110.0001) + plane(130.0) + plane(140.0) + [(-70.0, 0.0, 0.0)] * 5 + [(np.nan, 1.0, 1.0), (np.inf, 1.0, 1.0), (np.inf, 1.0, 1.0), (-80.0, 0.0, 0.0)]
    pts = cloud + near + [(60.0, 60.0, 60.0), (-60.0, 60.0, 60.0)]
    ids = [*range(3, len(pts) + 1), 1, 1]
    frame = frame_of(spark, sid=[i % 2 if i < 60 else 0 for i in range(len(pts))], id=ids, x=[p[0] for p in pts], y=[p[1] for p in pts], z=[p[2] for p in pts])
    frame = frame.unionByName(spark.createDataFrame([(0, 900, None, 1.0, 1.0)], "sid long, id long, x double, y double, z double"))
    for structure in (frame, frame.withColumn("sid", F.lit(0).cast("long"))):
        got = {(r.sid, r.id, r.component) for r in graph.contact_components(structure, "sid", "id", ("x", "y", "z"), 10.0).collect()}
        edges = graph.contact_edges(structure.filter(F.abs("x") < float("inf")), "sid", "id", ("x", "y", "z"), 10.0)
        assert got == {(r.sid, r.id, r.component) for r in graph.component_labels(structure, edges, "sid", "id").collect()}


def test_contact_components_of_a_crowd(spark):
    """A hundred million contacts, none of which is made."""
    crowd = spark.range(20000).select(F.lit(0).alias("sid"), "id", *[(F.rand(k) * 5 + F.when(F.col("id") % 2 == 0, 0).otherwise(100)).alias(c) for k, c in enumerate("xyz")])
    found = graph.contact_components(crowd, "sid", "id", ("x", "y", "z"), 10.0).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in found} == {(0, 10000), (1, 10000)}


def test_turnover_and_lifetimes(spark):
    frames = frame_of(spark, step=[0, 0, 1, 3], e=["a", "b", "a", "a"])
    assert {r.step: r.edge_turnover for r in graph.edge_turnover(frames, "step", ["e"]).collect()} == {0: 1.0, 1: 0.5, 3: 1.0}
    assert sorted((r.e, r.lifetime) for r in graph.contact_lifetimes(frames, "step", ["e"]).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_null_models(spark):
    frame = frame_of(spark, g=["a"] * 5 + ["b"], id=range(6), v=list("pqrstu"))
    moved = nullmodels.derange(frame, ["g"], "id", "v", 7).collect()
    assert all(r.v != r.scrambled for r in moved if r.g == "a") and sorted(r.scrambled for r in moved) == list("pqrstu")
    assert [r.non_derangeable for r in moved if r.g == "b"] == [True]
    assert sorted(r.shuffled for r in nullmodels.shuffle_labels(frame, ["g"], "id", "v", 1).collect()) == list("pqrstu")


def test_gate(spark):
    rows = [("HIC", "real_topology", 200, 0.6), ("HIC", "surface_composition", 200, 0.4), ("SMAC", "real_topology", 90, 0.41), ("SMAC", "surface_composition", 90, 0.4)]
    rows += [(a, f"scrambled_topology_{i}", 100, 0.4 + i / 100) for a in ("HIC", "SMAC") for i in range(3)] + [(a, "label_shuffle_0", 100, 0.02) for a in ("HIC", "SMAC")]
    got = {r.assay: r.verdict for r in nullmodels.gate_verdict(spark.createDataFrame(rows, "assay string, feature_block string, n int, spearman double")).collect()}
    assert got == {"HIC": "PASS", "SMAC": "FAIL; LOW-N CAUTION"}


def test_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=60) / 10
    m = models.ridge_fit(x, y, np.array([2.0]))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(m["weights"], np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (y - y.mean())))
    frame = frame_of(spark, a=["y"] * 60, id=range(60), fold=[i % 5 for i in range(60)], x=[list(map(float, r)) for r in x], y=y)
    w, b = models.ridge_from_sums(models.gram_sums(frame, "x", "y")["z"], 2.0)
    assert np.allclose(w * x.std(0), m["weights"]) and b == pytest.approx(y.mean() - w @ x.mean(0))
    wide = frame_of(spark, e=[list(map(float, r)) for r in rng.normal(size=(12, 30))])
    assert len(models.pca_columns(wide, "e", 64).first().pca) == 11


def test_clusters_and_alignment():
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1.0]])
    assert models.average_linkage(s, 0.85).tolist() == [1, 1, 2]

    def brute(a, b):
        best, h, e, f = 0.0, {}, {}, {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                e[i, j] = max(h[i - 1, j] - 0.5, e[i - 1, j] - 0.1) if i else -1e9
                f[i, j] = max(h[i, j - 1] - 0.5, f[i, j - 1] - 0.1) if j else -1e9
                m = h[i - 1, j - 1] + (a[i - 1] == b[j - 1]) if i and j else 0.0
                h[i, j] = max(0.0, m, e[i, j], f[i, j])
                best = max(best, h[i, j])
        return best

    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = ("".join(rng.choice(list("ACD"), int(rng.integers(0, 14)))) for _ in range(2))
        assert models.local_alignment(a, b) == pytest.approx(brute(a, b)), (a, b)


def test_profile(spark):
    names = list(dict.fromkeys(f for a in profile.AXES.values() for f in a.weights))
    rows = [(k, *[float(k * (i + 1)) / 10 if not (k == 2 and i == 4) else None for i in range(len(names))]) for k in range(1, 5)]
    frame = spark.createDataFrame(rows, ", ".join(["k long", *[f"{n} double" for n in names]]))
    projection = frame_of(spark, k=[4], network_risk_score=[0.8], mapped_regime=["finite_reversible_clusters"], mapped_largest_cluster_fraction=[0.4], mapped_percolation_probability=[0.2], mapped_mean_degree=[1.3])
    report = {k: sorted((r for r in profile.axis_report(frame, "k", projection).collect() if r.k == k), key=lambda r: r.axis_pos) for k in (2, 4)}
    assert [r.axis for r in report[4]] == ["Hydrophobicity", "Polyreactivity", "Local self-association", "Bulk network / viscosity", "Thermostability", "Titer / expression"]
    by = {k: {r.axis: r for r in own} for k, own in report.items()}
    assert by[4]["Hydrophobicity"].risk_score == 1.0 and by[4]["Hydrophobicity"].risk_label == "high"
    assert by[4]["Hydrophobicity"].main_features == "fv_cdr_hydrophobic_fraction=0.4 (percentile 1.00); fv_cdr_aromatic_fraction=0.8 (percentile 1.00); vh_hydrophobic_fraction=1.2 (percentile 1.00)"
    assert by[2]["Local self-association"].main_features.endswith("fv_cdr_aromatic_fraction=0.4 (percentile 0.50)") and by[2]["Local self-association"].risk_score == 0.5
    network = by[4]["Bulk network / viscosity"]
    assert (network.risk_label, network.confidence) == ("high", "low-medium")
    assert network.main_features == "network_risk_score=0.8; mapped_regime=finite_reversible_clusters; mapped_largest_cluster_fraction=0.4; mapped_percolation_probability=0.2; mapped_mean_degree=1.3"
    assert (by[2]["Bulk network / viscosity"].risk_label, by[2]["Bulk network / viscosity"].main_features) == ("unknown", "network projection not supplied")
    assert {r.risk_label for r in profile.axis_report(frame, "k").collect() if r.axis in ("Thermostability", "Titer / expression")} == {"not assigned"}
    assert all(r.main_features and r.mutation_direction and r.benchmark_support for r in report[4])
    assert profile.reference_percentile(F.lit(3.0), frame_of(spark, a=[1.0, 2.0, 3.0, 4.0]), "a").first()[0] == 0.75


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -2.5, 3.14159, 900.5, 999.5, 999.4, 1000.0, 1235.0, 1245.0, 123456.0, 0.0001234, 0.00001234, 99.95, 1e-5, 1e22, 1e100, -0.05, 10.0, 100.0, 0.3, 12.5, 0.999999]
    frame = frame_of(spark, x=values)
    assert [r[0] for r in frame.select(general3(F.col("x"))).collect()] == [f"{v:.3g}" for v in values]
    shares = [k / 2000 for k in range(0, 2001, 5)]
    assert [r[0] for r in frame_of(spark, x=shares).select(fixed2(F.col("x"))).collect()] == [f"{v:.2f}" for v in shares]



def test_compare(spark):
    assert compare.low_is_risky("Titer") and not compare.low_is_risky("HIC")
    with pytest.raises(ValueError):
        compare.low_is_risky("unheard of")
    metrics = spark.createDataFrame([("HIC", "m", 0.71), ("PR_CHO", "m", 0.20)], "assay string, model string, spearman double")
    got = {r.assay: r.status for r in compare.compare_to_targets(metrics, compare.target_table(spark)).collect()}
    assert got == {"HIC": "meets_or_beats_top", "PR_CHO": "below_bar"}
    predictions, external = frame_of(spark, h=["A", "B"], name=["x", "y"]), frame_of(spark, h=["A"], ext=["E1"])
    with pytest.raises(Exception, match="no external id"):
        compare.map_keys(predictions, external, ["h"], "name", "ext").collect()
    with pytest.raises(Exception, match="not unique"):
        compare.validated_left_join(predictions, external.union(external), ["h"]).collect()


def test_simulation(spark):
    grid = simulation.regime_grid(spark, [0.0, 1.4], [0.0, 1.0], [1, 3])
    got = simulation.sweep(grid, 20, 5)
    assert got.count() == 8 and got.filter("regime is null").count() == 0
    a, b = simulation.simulate({c: 1.0 for c in simulation.PARAMETERS}, 20, 5), simulation.simulate({c: 1.0 for c in simulation.PARAMETERS}, 20, 5)
    assert a[0].equals(b[0]) and a[1] == b[1]
    with pytest.raises(ValueError):
        simulation.simulate({}, 1)
    with pytest.raises(ValueError):
        simulation.regime_grid(spark, [-1.0], [0.0], [1])


def test_null_models_over_any_buckets(spark, monkeypatch):
    """Numbers, shifts and permutations against plain sorting, with hot groups, null groups and null values."""
    import hashlib

    rows = [(["a", "b", None, "c"][0 if i % 3 == 0 else i % 4], i * i - 40 * i if i % 2 else 10_000_000 + i, float(i) if i % 7 else None) for i in range(400)] + [("one", 3, 5.0)]
    frame = spark.createDataFrame(rows, "g string, id long, v double").repartition(5)
    place = lambda seed, key: (int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:15], 16), key)
    groups = {g: [r for r in rows if r[0] == g] for g in {r[0] for r in rows}}
    shifted, permuted = {}, {}
    for seed in (3, 4):
        for g, own in groups.items():
            line = sorted(own, key=lambda r: place(seed, r[1]))
            shifted |= {(seed, g, r[1]): n[2] for r, n in zip(line, line[1:] + line[:1], strict=True)}
            permuted |= {(seed, g, r[1]): n[2] for r, n in zip(line, sorted(own, key=lambda r: r[1]), strict=True)}
    for buckets in (256, 4):
        monkeypatch.setattr(order, "BUCKETS", buckets)
        monkeypatch.setattr(order, "STEPS", [buckets >> k for k in range(1, buckets.bit_length())])
        assert {(r.replicate, r.g, r.id): r.scrambled for r in nullmodels.derange_replicates(frame, ["g"], "id", "v", [3, 4]).collect()} == shifted
        assert {(r.replicate, r.g, r.id): r.shuffled for r in nullmodels.shuffle_replicates(frame, ["g"], "id", "v", [3, 4]).collect()} == permuted
        got = {(r.g, r.id): r.i for r in order.numbered_by(frame, ["g"], "id", "i").collect()}
        assert got == {(g, r[1]): i + 1 for g, own in groups.items() for i, r in enumerate(sorted(own, key=lambda r: r[1]))}


def test_nulls_ranked_once_equal_nulls_ranked_each(spark):
    rng = np.random.default_rng(8)
    frame = frame_of(spark, g=["a", "b"] * 60, id=range(120), x=[float(v) for v in rng.integers(0, 9, 120)], y=rng.normal(size=120))
    once = nullmodels.ranked_once(frame, ["g"], "id", "x", "y")
    for how, many, out in (("shuffle", nullmodels.shuffle_replicates, "shuffled"), ("derange", nullmodels.derange_replicates, "scrambled")):
        each = spearman(many(frame, ["g"], "id", "x", [1, 2, 3]), ["g", "replicate"], out, "y")
        got = nullmodels.null_correlations(once, ["g"], "id", [1, 2, 3], "cx", how)
        key = lambda f: {(r.g, r.replicate): (r.n, pytest.approx(r.spearman, abs=1e-12)) for r in f.collect()}
        assert key(got) == key(each)


def test_nulls_by_slices_equal_nulls_by_rows(spark, monkeypatch):
    """Slices, packs of a few rows, null groups, keys that are text or missing, and groups of equal hashes; nothing is copied for a seed."""
    monkeypatch.setattr(nullmodels, "SLICE_ROWS", 2)
    monkeypatch.setattr(nullmodels, "PACKED_ROWS", 50)
    rng = np.random.default_rng(9)
    rows = [(["a", "b", None][i % 3] if i else "one", int(k), float(rng.integers(0, 40)), float(rng.normal())) for i, k in enumerate(rng.permutation(700))]
    frame = spark.createDataFrame(rows, "g string, id long, x double, y double").repartition(5)
    text = frame.withColumn("id", F.concat(F.lit("k"), "id"))
    missing = frame.unionByName(frame.filter("id = 9").withColumn("id", F.lit(None).cast("long")))
    for own, by, how, moved in ((frame, ["g"], "shuffle", "cx"), (frame, ["g"], "derange", "cy"), (text, ["g"], "shuffle", "cy"), (missing, ["g"], "derange", "cx"), (missing, [], "shuffle", "cx")):
        ranked, other = own.select("g", "id", F.col("x").alias("cx"), F.col("y").alias("cy")), "cy" if moved == "cx" else "cx"
        many = nullmodels.shuffle_replicates if how == "shuffle" else nullmodels.derange_replicates
        want = nullmodels.rank_correlations(many(ranked, by, "id", moved, [3, 4], "m"), [*by, "replicate"], "m", other)
        got = nullmodels.null_correlations(ranked, by, "id", [3, 4], moved, how)
        told = lambda f: {(r["g"] if "g" in f.columns else "", r.replicate): (r.n, None if r.spearman is None else round(r.spearman, 11)) for r in f.collect()}
        assert told(got) == told(want) and len(told(want)) == (8 if by else 2)
    # Rows of one key have one hash: those seeds are done row by row.
    twice = nullmodels.ranked_once(spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, 3.0, 1.0), (3, 5.0, 4.0)], "id long, x double, y double"), [], "id", "x", "y")
    want = nullmodels.rank_correlations(nullmodels.derange_replicates(twice, [], "id", "cx", [1, 2], "m"), ["replicate"], "m", "cy")
    assert sorted(nullmodels.null_correlations(twice, [], "id", [1, 2], "cx", "derange").collect()) == sorted(want.select("replicate", "n", "spearman").collect())


@pytest.mark.parametrize("second", [False, True])
def test_a_row_costs_a_seed_nine_bytes(second):
    """Packed hashes and values: six bytes, of which the codec leaves out most leading ones, and three for a rank; they come back whole."""
    import pyarrow as pa

    n, rng = 5000, np.random.default_rng(2)
    v, w = (rng.permutation(n) - (n - 1) / 2 for _ in range(2))
    given = pa.RecordBatch.from_pydict({"__g": np.zeros(n, np.int64), "__bits": np.full(n, 3, np.int32), "key": [str(i) for i in range(n)], "v": v, "w": w})
    slices = [r for b in nullmodels._seeded([7], second)(iter([given])) for r in b.to_pylist()]
    assert sum(r["n"] for r in slices) == n and sum(len(r["h"]) + len(r["v"]) for r in slices) <= 9 * n
    hashes = [nullmodels._hashes(r["h"], r["n"]) for r in slices]
    assert all((np.diff(h.astype(np.int64)) > 0).all() for h in hashes)
    assert sorted(np.concatenate([nullmodels._floats(r["v"], r["n"]) for r in slices])) == sorted(v)
    for x in ([0.5, -7.0, 4194303.5], [0.25, 1e6], [1 / 3, 1e300], [float(1 << 23), 1.0], [-float(1 << 22), 0.0]):
        assert nullmodels._floats(nullmodels._bytes_of(np.array(x)).tobytes(), len(x)).tolist() == x


def test_exact_quantiles_by_brackets(spark):
    rng = np.random.default_rng(4)
    rows = [(["a", None, "b"][i % 3], float(v) if i % 11 else None, 7.0 if i % 4 else float(i)) for i, v in enumerate(rng.lognormal(0, 3, 900))] + [("none", None, None), ("one", 2.5, None)]
    frame = spark.createDataFrame(rows, "g string, x double, hot double").repartition(4)
    asked = {"x": [0.0, 0.2, 0.5, 0.975, 1.0], "hot": [0.5, 0.9]}
    for most in (1_000_000, 20):
        got = {r.g: (r.x, r.hot) for r in order.quantiles(frame, ["g"], asked, most).collect()}
        assert got.keys() == {"a", None, "b", "one"}
        for g, (x, hot) in got.items():
            for found, at, qs in ((x, 1, asked["x"]), (hot, 2, asked["hot"])):
                own = [r[at] for r in rows if r[0] == g and r[at] is not None]
                assert found == ([pytest.approx(v) for v in np.quantile(own, qs)] if own else [None] * len(qs))
        assert order.quantiles(frame, [], {"x": [0.25]}, most).first().x == [pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], 0.25))]
    assert order.quantiles(frame.filter("false"), [], {"x": [0.5]}).first().x == [None]


def test_joins_check_themselves(spark):
    from pyspark.sql import Observation

    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (9, "f")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, None), (None, 5), (None, 6)], "k int, w int")
    seen = Observation("seen")
    got = compare.validated_left_join(left, right, ["k"], "many_to_one", seen)
    assert sorted((r.v, r.w) for r in got.collect()) == [("a", 10), ("b", 10), ("c", None), ("d", None), ("e", None), ("f", None)]
    assert seen.get == {"rows": 6, "unmatched": 3, "doubled": 0, "repeated": 0}
    for bad, how in ((left, "one_to_one"), (left.filter("v <> 'b'"), "many_to_one")):
        with pytest.raises(Exception, match="not unique"):
            compare.validated_left_join(bad, right if how == "one_to_one" else right.union(right), ["k"], how).collect()
    assert compare.validated_left_join(left.filter("v <> 'b'"), right, ["k"], "one_to_one").count() == 5


def test_periodic_edges_equal_all_pairs(spark):
    rng = np.random.default_rng(12)
    pts = rng.uniform(-50, 50, (90, 3))
    frame = frame_of(spark, sid=[i % 2 for i in range(90)], id=range(90), x=pts[:, 0], y=pts[:, 1], z=pts[:, 2])
    for cutoff, box in ((7.0, 30.0), (7.0, 15.0), (7.0, 14.0), (3.0, 100.0)):
        step = pts[:, None] - pts[None]
        near = np.sqrt(((step - box * np.rint(step / box)) ** 2).sum(axis=2))
        want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and near[i, j] <= cutoff}
        assert {(r.src, r.dst) for r in graph.periodic_edges(frame, "sid", "id", ("x", "y", "z"), cutoff, box).collect()} == want
    with pytest.raises(ValueError, match="half"):
        graph.periodic_edges(frame, "sid", "id", ("x", "y", "z"), 8.0, 15.0)


def test_label_auroc_reads_the_texts_once(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["label_auroc"](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in found._jdf.queryExecution().toString() and found.count() > 0


def test_a_tile_of_neighbours_holds_few_products_at_once(spark, monkeypatch):
    """However many queries a batch has, they meet a block in steps of ``PRODUCTS``; so memory does not follow the number of rows."""
    import pyarrow as pa

    seen, best = [], pairs._best
    monkeypatch.setattr(pairs, "_best", lambda keys, v, g, part, k, itself: (seen.append(len(keys) * part.num_rows), best(keys, v, g, part, k, itself))[1])
    rng = np.random.default_rng(1)
    rows = lambda kind, n: pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array([kind] * n), pa.array(range(n)), pa.array(rng.random((n, 3)).tolist())], names=["tile", "kind", "key", "v"])
    found = sum(b.num_rows for b in pairs._tiles(2, True)(iter([rows(0, 20_000), rows(1, 200)])))
    assert found == 400 and max(seen) <= 1 << 20 and sum(seen) == 20_000 * 200


def test_boosting_fits_folds_side_by_side(spark, monkeypatch):
    """All folds are in hand at once, and predict what fits one after the other predict."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 3, [float(v) for v in x], float(x[0])) for i, x in enumerate(rng.normal(size=(90, 3)))], "id long, fold int, x array<double>, y double")
    real, meet = models.ml_regressor, threading.Barrier(3, timeout=60)

    def short(*given):
        regressor = real(*given).setMaxIter(2)
        own = regressor.fit
        regressor.fit = lambda frame: (meet.wait(), own(frame))[1]
        return regressor

    predict = lambda: {tuple(r) for r in models.ml_fold_predictions(rows, "id", "x", "y", "fold", "hist_gradient_boosting").collect()}
    monkeypatch.setattr(models, "ml_regressor", short)
    got = predict()
    monkeypatch.setattr(models, "ml_regressor", lambda *given: real(*given).setMaxIter(2))
    monkeypatch.setattr(models, "FITS_AT_ONCE", {})
    assert got == predict() and len(got) == 90
