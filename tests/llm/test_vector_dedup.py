import numpy as np
import pytest

from siftline.llm import vector_dedup as vd


def brute(rows, threshold):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {k: vd.unit(np.array([rows[k][1]], dtype=np.float64))[0] for k in good}
    links = {k: {j for j in good if j != k and len(units[j]) == len(units[k]) and (units[k] * units[j]).sum() >= threshold} for k in good}
    last = 2**63 - 1
    label = {k: last if i is None else i for k, (i, _) in enumerate(rows)}
    group = dict(label)
    moved = True
    while moved:
        moved = False
        for k, others in links.items():
            least = min([group[k], *[group[j] for j in others]])
            moved |= least < group[k]
            group[k] = least
    out = [(i, len(links.get(k, ())), None if group[k] == last else group[k], group[k] == label[k]) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=str)


def found(spark, rows, threshold=0.9, kind="float", **more):
    frame = spark.createDataFrame([(i, v, 1.5, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, n double, `a.b` string")
    got = vd.near_vectors(frame, threshold, **more)
    assert got.schema["row"].dataType.names == ["embedding", "n", "a.b"]
    return sorted([tuple(r) for r in got.drop("row").collect()], key=str)


def families(n, d, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * spread
    return [(int(i), [float(c) for c in v.astype(np.float32)]) for i, v in zip(rng.permutation(n), x * rng.uniform(0.1, 9, (n, 1)), strict=True)]


@pytest.mark.parametrize(("spread", "threshold", "tile"), [(0.25, 0.9, 64), (0.4, 0.9, 50), (0.1, 0.99, 300), (2.0, 0.5, 40)])
def test_many_tiles_and_cells_lose_no_link(spark, spread, threshold, tile):
    rows = families(600, 24, spread, int(tile))
    want = brute(rows, threshold)
    assert any(r[1] for r in want)
    assert found(spark, rows, threshold, tile=tile) == want


def test_nulls_ties_repeats_and_lengths(spark):
    rows = families(60, 8, 0.3, 5)
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(40)] + [(1010, same), (None, same), (None, [9.0] * 7 + [-50.0]), (7, None), (8, []), (9, [0.0] * 8)]
    rows += [(2000, [1.0] * 7 + [None]), (2001, [float("nan")] + [1.0] * 7), (2002, [float("inf")] + [1.0] * 7), (2003, [1.0, 2.0]), (2004, [2.0, 4.0]), (2005, [-1.0, -2.0])]
    assert found(spark, rows, tile=16) == brute(rows, 0.9)


def test_any_scale_in_double(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [3e-310, 6e-310]), (4, [2.0, -1.0])]
    assert found(spark, rows, kind="double") == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_empty(spark):
    assert found(spark, []) == []


def test_bounds_hold_and_few_pairs_are_computed_again():
    x = vd.unit(np.random.default_rng(3).normal(size=(400, 64)))
    q, scale, gone = vd.quantise(x)
    near = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale[None]
    off = gone[:, None] + (1 + gone[:, None]) * gone[None]
    assert (np.abs(near - x @ x.T) <= off).all() and off.max() < 0.03


def test_copies_of_a_row_do_not_grow_with_the_blocks(spark, monkeypatch):
    """Where no cell can be skipped, a row goes to a bounded number of tiles, as floats."""
    rows, sent = families(800, 24, 2.0, 8), []
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kind = type(frame)
    real = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: sent.append(self) or real(self, *a))
    got = vd.near_vectors(frame, 0.5, tile=8).drop("row")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, 0.5)
    assert [sent[0].count() <= 2 * vd.BLOCKS * 800, sent[0].selectExpr("max(octet_length(v))").first()[0]] == [True, 4 * 24]
