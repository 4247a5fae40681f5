import numpy as np

from siftline.llm import hnsw


def brute(rows, query_ids, k):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        seen[i] = min(seen.get(i, tuple(v)), tuple(v))
    out = {}
    for q in query_ids:
        if q in seen:
            scores = [(-float((np.array(seen[q]) * np.array(v)).sum()), i) for i, v in seen.items() if i != q and len(v) == len(seen[q])]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(spark, rows, **k):
    frame = spark.createDataFrame([(i, v, 1.0, "c") for i, v in rows], "vec_id long, embedding array<float>, score double, ids string")
    out = {}
    for r in hnsw.nearest_neighbours(frame, lambda i: i % 10 == 0, **k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def vectors(n, d=16, seed=13, unit=False):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    x *= 1 if not unit else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(c) for c in v]) for i, v in zip(np.random.default_rng(seed).permutation(n), x)]


def test_recall_with_any_norms(spark):
    for unit in (True, False):
        rows = vectors(1500, unit=unit)
        got, want = found(spark, rows, least_shards=3), brute(rows, range(0, 1500, 10), 20)
        assert got.keys() == want.keys()
        hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
        assert np.mean(hits) >= 0.9
        for q, r in got.items():
            assert [s for _, s in r] == sorted((s for _, s in r), reverse=True) and len(r) == 20
            exact = dict(brute(rows, [q], 2000)[q])
            assert all(abs(exact[i] - s) < 1e-12 for i, s in r)


def test_ties_nulls_and_copies(spark):
    rows = vectors(80)
    same = rows[0][1]
    rows += [(1000 + i, same) for i in range(60)] + [(1010, same), (20, [float("nan")] * 16), (3000, None), (None, same), (3010, [0.0] * 16)]
    rows += [(3020, [1.0] * 15 + [None]), (3030, [float("inf")] + [0.0] * 15), (3040, [1.0, 2.0]), (3050, [2.0, 1.0]), (30, rows[5][1]), (3060, [])]
    rows = [r for r in rows if r[0] != 20] + [(20, [float("nan")] * 16)]
    got, want = found(spark, rows, least_shards=2), brute(rows, [i for i in range(0, 4000, 10)], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q


def test_few_and_none(spark):
    assert found(spark, []) == {}
    assert found(spark, [(10, [1.0, 0.0])]) == {}
    assert found(spark, [(10, [1.0, 0.0]), (11, [0.5, 0.5]), (20, [1.0, 0.0])]) == {10: [(20, 1.0), (11, 0.5)], 20: [(10, 1.0), (11, 0.5)]}
    assert found(spark, [(10, [1.0, 0.0]), (10, [1.0, 0.0])]) == {}
