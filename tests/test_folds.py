import hashlib

import numpy as np
import pytest

from siftline.operators import folds, prepare, ridge


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for g, n in sizes:
        f = loads.index(min(loads))
        out[g] = f
        loads[f] += n
    return out


@pytest.mark.parametrize("sizes", [[1] * 50, [1000] + [1] * 300, [7, 7, 7, 3, 3, 1], [40, 9, 9, 9, 9, 9, 5, 5, 2] + [1] * 80, [5], [3, 2, 2, 2, 1, 1]])
def test_deal_equals_the_greedy_one(sizes):
    for k in (1, 2, 3, 5):
        histogram = sorted({n: sizes.count(n) for n in sizes}.items(), reverse=True)
        dealt = [None] * len(sizes)
        begin = {n: sorted(sizes, reverse=True).index(n) for n in sizes}
        rows = list(folds.deal(histogram, k))
        for n, first, last, cycle in rows:
            for i in range(first, last + 1):
                dealt[begin[n] + i - 1] = cycle[(i - first) % len(cycle)]
        want = greedy(list(enumerate(sorted(sizes, reverse=True))), k)
        assert dealt == [want[i] for i in range(len(sizes))]
    assert len(list(folds.deal([(1000, 1), (1, 10_000_000)], 5))) < 30


def test_group_folds_keep_groups_whole(spark):
    rows = [(g, i) for g, n in [("a", 60), ("b", 9), (None, 9), ("d", 9), *[(f"s{i}", 1) for i in range(40)]] for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int").repartition(4)
    got = {(r.g, r.i): r.fold for r in folds.group_folds(frame, "g", 3).collect()}
    assert len(got) == len(rows)
    place = lambda g: (int(hashlib.md5(("7" if g is None else f"7|{g}").encode()).hexdigest()[:15], 16), g)
    sizes = sorted({g: sum(r[0] == g for r in rows) for g in {r[0] for r in rows}}.items(), key=lambda x: (-x[1], place(x[0])))
    want = greedy(sizes, 3)
    assert all(got[g, i] == want[g] for g, i in rows)
    assert {r.fold for r in folds.group_folds(spark.createDataFrame([("x",), ("x",), ("y",)], "g string"), "g").collect()} == {0, 1}


def test_preprocessing_uses_the_other_folds(spark):
    rows = [(i, i % 3, float(i * i % 17) if i % 4 else None, 2.5, ["u", "v", None, "w"][i % 4] if i != 30 else "seen in its own fold only", None) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, fold long, x double, same double, level string, none string").repartition(3)
    numeric, levels = ["x", "same"], ["level", "none"]
    done = prepare.transform(frame, "fold", prepare.fit(frame, "fold", numeric, levels), numeric, levels)
    got = {r.id: r for r in prepare.spread(done, [4, 2]).collect()}
    for i, f, x, _, level, _ in rows:
        train = [r for r in rows if r[1] != f]
        median = np.median([r[2] for r in train if r[2] is not None])
        filled = [median if r[2] is None else r[2] for r in train]
        known = [r[4] for r in train if r[4]]
        place = sorted(set(known))
        mode = min(place, key=lambda v: (-known.count(v), v))
        assert got[i].scaled == pytest.approx([((median if x is None else x) - np.mean(filled)) / np.std(filled), 0.0])
        own = level or mode
        assert got[i].hot == [place.index(own) if own in place else None, None]
        assert got[i].features[2:] == [float(own in place and place.index(own) == k) for k in range(4)] + [0.0, 0.0]
    assert got[30].hot == [None, None]


def test_residuals_equal_dense_refits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None, "c"][int(rng.integers(4))], int(rng.integers(3)), 5.0 * int(rng.integers(2)) + float(rng.normal())) for i in range(50)]
    frame = spark.createDataFrame([*rows, (99, "a", 1, None)], "id int, `sub.type` string, n int, y double").repartition(3)
    residuals, summary = ridge.residualise(frame, "y", ["sub.type", "n"])
    columns = [[str(r[k]) for r in rows] for k in (1, 2)]
    x = np.column_stack([np.array(c) == v for c in columns for v in sorted(set(c))]).astype(float)
    y = np.array([r[3] for r in rows])
    z = np.column_stack([np.ones(50), x - x.mean(axis=0)])
    fit = lambda keep, a: np.linalg.solve(z[keep].T @ z[keep] + a * np.diag([0] + [1] * x.shape[1]), z[keep].T @ y[keep])
    every = np.arange(50)
    errors = [sum((y[i] - z[i] @ fit(np.delete(every, i), a)) ** 2 for i in every) for a in ridge.ALPHAS]
    alpha = ridge.ALPHAS[int(np.argmin(errors))]
    want = y - z @ fit(every, alpha)
    got = {r.id: r.y_residual for r in residuals.collect()}
    assert got.pop(99) is None and got == {i: pytest.approx(v, abs=1e-8) for i, v in enumerate(want)}
    s = summary.first()
    assert s.n == 50 and s.alpha == pytest.approx(alpha) and s.residual_sd == pytest.approx(want.std()) and s.control_r2 == pytest.approx(1 - (want**2).sum() / ((y - y.mean()) ** 2).sum())
    assert abs(want.mean()) < 1e-8
    assert ridge.residualise(frame.filter("id = 99"), "y", ["n"])[1].first().n == 0
