"""Ridge by sums against refits that leave every single row out."""

import numpy as np
import pytest

from siftline.operators import ridge
from siftline.plans import audit


def brute(x, y, test, pca=None, alphas=ridge.ALPHAS):
    """(penalty, predictions of ``test``) of training rows x, y: every penalty, every row left out once."""
    if pca:
        x, test = np.nan_to_num(x), np.nan_to_num(test)
        centre = x.mean(axis=0)
        turn = np.linalg.svd(x - centre, full_matrices=False)[2][: min(pca, len(x) - 1, x.shape[1])].T
        x, test = (x - centre) @ turn, (test - centre) @ turn
    else:
        median = np.nan_to_num(np.nanmedian(x, axis=0))
        x, test = np.where(np.isnan(x), median, x), np.where(np.isnan(test), median, test)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    t = np.column_stack([np.ones(len(test)), (test - mean) / scale])
    fit = lambda rows, a: np.linalg.solve(z[rows].T @ z[rows] + a * np.diag([0] + [1] * x.shape[1]), z[rows].T @ y[rows])
    every = np.arange(len(x))
    errors = [sum((y[i] - z[i] @ fit(np.delete(every, i), a)) ** 2 for i in every) for a in alphas]
    a = alphas[int(np.argmin(errors))]
    return a, t @ fit(every, a)


def table(spark, gone, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for job, width in (("wide", 6), ("thin", 2), (None, 3)):
        x = rng.normal(size=(48, width)) * [10**k for k in range(width)] + 3
        x[:, -1] = 4.0 if job == "wide" else x[:, -1]
        y = x[:, 0] - x[:, 1] / 20 + rng.normal(size=48) * 2
        x[rng.random(x.shape) < gone] = np.nan
        for i in range(48):
            rows.append((job, i, i * 7 % 3, [None if np.isnan(v) and i % 2 else float(v) for v in x[i]], float(y[i]) if i != 11 else None))
    rows += [("few", i, i % 2, [float(i), None], float(i)) for i in range(6)] + [("one fold", i, 0, [1.0 * i], 1.0 * i) for i in range(30)]
    return spark.createDataFrame(rows, "job string, id int, fold int, x array<double>, y double").repartition(5), rows


@pytest.mark.parametrize(("gone", "pca", "task_rows"), [(0.0, None, 50_000), (0.15, None, 9), (0.15, 2, 50_000)])
def test_fold_predictions_equal_refits(spark, monkeypatch, gone, pca, task_rows):
    monkeypatch.setattr(ridge, "TASK_ROWS", task_rows)
    frame, rows = table(spark, gone)
    got = {(r.job, r.id): r for r in ridge.fold_predictions(frame, ["job"], "id", "x", "y", "fold", pca=pca).collect()}
    assert len(got) == sum(r[4] is not None for r in rows)
    for job in ("wide", "thin", None):
        own = [r for r in rows if r[0] == job and r[4] is not None]
        x, y, f = np.array([r[3] for r in own], dtype=float), np.array([r[4] for r in own]), np.array([r[2] for r in own])
        for fold in range(3):
            want = brute(x[f != fold], y[f != fold], x[f == fold], pca)[1]
            ids = [r[1] for r in own if r[2] == fold]
            assert [got[job, i].y_pred for i in ids] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6)
            assert {got[job, i].fold for i in ids} == {str(fold)}
    assert all(r.y_pred is None for (job, _), r in got.items() if job in ("few", "one fold"))


def test_external_predictions_choose_on_training_rows_alone(spark):
    frame, rows = table(spark, 0.1)
    train, outside = frame.filter("id < 36 and job = 'wide'"), frame.filter("id >= 36 and job = 'wide'")
    models, found = ridge.external_predictions(train, outside, ["job"], "id", "x", "y")
    own = [r for r in rows if r[0] == "wide" and r[4] is not None]
    x, y, i = np.array([r[3] for r in own], dtype=float), np.array([r[4] for r in own]), np.array([r[1] for r in own])
    alpha, want = brute(x[i < 36], y[i < 36], x[i >= 36])
    assert models.first().alpha == pytest.approx(alpha)
    assert {r.id: r.y_pred for r in found.collect()} == {int(k): pytest.approx(v, rel=1e-6) for k, v in zip(i[i >= 36], want, strict=True)}
    blind = outside.selectExpr("job", "id", "x", "cast(null as double) as y")
    unseen = {r.id: r.y_pred for r in ridge.external_predictions(train, blind, ["job"], "id", "x", "y")[1].collect()}
    assert {i: unseen[i] for i in map(int, i[i >= 36])} == {r.id: pytest.approx(r.y_pred, rel=1e-9) for r in found.collect()}


def test_audit_freezes_the_penalty(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    frame = spark.createDataFrame([(i, i % 5, list(map(float, r[:2])), list(map(float, r[2:])), float(r[0] + rng.normal() * 2)) for i, r in enumerate(x)], "id int, fold int, a array<double>, b array<double>, HIC double")
    train, outside = frame.filter("id < 60"), frame.filter("id >= 60")
    spec, compared = audit.audit(train, outside, "id", {"a": "a", "b": "b"}, ["HIC"], "fold")
    (row,) = spec.rows()
    assert row["feature_set"] == "a"
    y = np.array([r.HIC for r in train.orderBy("id").collect()])
    assert row["alpha"] == pytest.approx(brute(x[:60, :2], y, x[60:, :2])[0])
    assert compared.first().external_n == 30
    with pytest.raises(ValueError, match="changed"):
        audit.evaluate_external(spec._replace(text=spec.text.replace(str(row["alpha"]), "1.0")), train, outside, "id", {"a": "a", "b": "b"})


def test_bootstrap_equals_fits_of_drawn_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from siftline.operators.models import ridge_fit

    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 3)) * [1, 10, 0.1] + 5
    y = x[:, 0] * 2 - x[:, 1] / 5 + rng.normal(size=70)
    rows = [(i, list(map(float, v)), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(100, [1.0, None, 2.0], 3.0), (101, [1.0, 2.0, 3.0], None)]
    frame = spark.createDataFrame(rows, "id int, x array<double>, y double").repartition(3)
    h = np.array([r[0] for r in frame.filter("id < 100").orderBy("id").select(F.xxhash64("id")).collect()])
    m = ridge.multiplicities(h, np.arange(12), 7).astype(int)
    assert 0.9 < m.mean() < 1.1 and 0.8 < m.var() < 1.25
    for size in (ridge.BLOCK_BYTES, 1):
        monkeypatch.setattr(ridge, "BLOCK_BYTES", size)
        got = {r.b: r for r in ridge.bootstrap_weights(frame, "id", "x", "y", 12).collect()}
        assert len(got) == 12
        for b, r in got.items():
            pick = np.repeat(np.arange(70), m[:, b])
            want = ridge_fit(x[pick], y[pick])
            assert r.alpha == pytest.approx(want["alpha"]) and r.weights == pytest.approx(want["weights"].tolist(), rel=1e-6)
    table = {r.feature: r for r in ridge.bootstrap_coefficients(frame, "id", "x", ["a", "b", "c"], "y", 30).collect()}
    assert table["a"].mean > 1 and table["a"].low < table["a"].mean < table["a"].high and table["b"].sign_agreement == 1.0


def test_importance_permutes_shares(spark):
    import hashlib

    rng = np.random.default_rng(14)
    x = rng.normal(size=(40, 3))
    y = x[:, 0] * 2 + x[:, 1] + rng.normal(size=40) / 3
    frame = spark.createDataFrame([(i, list(map(float, v)), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y double").repartition(3)
    got = {r.feature: r for r in ridge.permutation_importance(frame, "id", "x", ["a", "b", "c"], "y", 4).collect()}
    alpha, predicted = brute(x, y, x)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    weights = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean())) / scale
    rank = lambda v: np.argsort(np.argsort(v))
    rho = lambda a, b: np.corrcoef(rank(a), rank(b))[0, 1]
    for k, name in enumerate("abc"):
        drops = []
        for seed in range(7, 11):
            line = sorted(range(40), key=lambda i: int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:15], 16))
            other = np.empty(40)
            other[line] = x[:, k]  # the i-th row of the order gets the i-th row's share
            drops.append(rho(y, predicted) - rho(y, predicted + weights[k] * (other - x[:, k])))
        assert got[name].importance == pytest.approx(np.mean(drops)) and got[name].sd == pytest.approx(np.std(drops))
    assert got["a"].importance > got["b"].importance > got["c"].importance


def test_importance_moves_a_row_once_for_a_repeat(spark, monkeypatch):
    """All features are permuted alike, so what is shuffled are rows, not rows times features."""
    seen, plain = [], ridge.shuffle_replicates
    monkeypatch.setattr(ridge, "shuffle_replicates", lambda frame, *more: (seen.append(frame.count()), plain(frame, *more))[1])
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    frame = spark.createDataFrame([(i, v.tolist(), float(v[0] + 0.1 * v[1])) for i, v in enumerate(x)], "id long, x array<double>, y double")
    ridge.permutation_importance(frame, "id", "x", ["a", "b", "c"], "y", 2)
    assert seen == [60]


def test_importance_ranks_slices_of_a_repeat(spark, monkeypatch):
    """Several slices, ties and equal rows give what one gives; a row and feature cost a repeat some 12 bytes and are shuffled once."""
    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(1500, 3)), 1)
    y = np.round(x[:, 0] + 0.2 * x[:, 1] ** 2 + 0.1 * rng.normal(size=1500), 1)
    frame = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    rows, sent, kind = {}, [], type(frame)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a: sent.append((schema, out := real(self, f, schema, *a))) or out)
    for size in (1 << 16, 200):
        monkeypatch.setattr(ridge, "SLICE_ROWS", size)
        rows[size] = {r.feature: (r.importance, r.sd) for r in ridge.permutation_importance(frame, "id", "x", ["a", "b", "c"], "y", 3).collect()}
    for f, got in rows[200].items():
        assert got == pytest.approx(rows[1 << 16][f], abs=1e-9)
    packs = [out for schema, out in sent if "slice" in schema]
    assert [p.selectExpr("sum(octet_length(p) + octet_length(ry))").first()[0] for p in packs] == [1500 * 3 * 3 * 12] * 2
    assert packs[1].select("slice").distinct().count() == 8
