import itertools

import numpy as np
import pytest

from siftline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, range int"


def brute_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def mixed(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    return mixing.mix(docs).select("row.source", "size", "source_size", "target", "copies", "taken").collect()


def test_targets_and_takes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        source = [None, "a", "b", "B", "é", "z", ""][min(6, int(rng.exponential(1.5)))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 90))), source))
    rows += [(600, None, "a"), (601, "", "b"), (None, "x y z", "a"), (5, "again", "a"), (5, "again", "a"), (602, "  \t", "only blank")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1, (source, words, want[source])
    again = mixed(spark, rows)
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_one_long_document_and_empty_tables(spark):
    assert mixed(spark, []) == []
    assert [r.taken for r in mixed(spark, [(1, None, None)])] == [0]
    (r,) = mixed(spark, [(1, "w " * 100_000, "s")])
    assert r.size == 100_000 and r.target == 150_000 and r.taken in (100_000, 200_000)


def test_reachable_is_the_best_subset_sum():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(1, 120))
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := int((np.array(c) * lengths).sum())) <= budget)
        taken = mixing.reachable(lengths, counts, budget)
        assert sum(n * c for n, c in taken.items()) == best
        assert all(taken.get(n, 0) <= c for n, c in zip(lengths.tolist(), counts.tolist()))


def test_fit_lengths_stays_near_a_large_budget():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 20_000, 900))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.001, 0.1, 0.37, 0.9, 0.9999):
        take = mixing.fit_lengths(lengths, counts, share * total)
        assert ((take >= 0) & (take <= counts)).all()
        assert abs(int((take * lengths).sum()) - share * total) <= 1


def test_long_documents_are_not_preferred():
    """A rest far beyond the programme's span goes to the lengths by share, not to the longest."""
    rng = np.random.default_rng(7)
    lengths = np.arange(50, 20_000, 7)
    counts = rng.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    take = mixing.fit_lengths(lengths, counts, 0.3 * total)
    assert abs(int((take * lengths).sum()) - 0.3 * total) <= 1
    halves = np.array_split(np.arange(len(lengths)), 2)
    shares = [take[h].sum() / counts[h].sum() for h in halves]
    assert abs(shares[0] - shares[1]) < 0.03, shares


def test_documents_longer_than_the_span():
    lengths, counts = np.array([90_001, 120_000, 150_000]), np.array([4, 4, 4])
    for budget in (89_000, 210_001, 500_000, 700_003):
        take = mixing.fit_lengths(lengths, counts, budget)
        best = max(s for c in itertools.product(range(5), repeat=3) if (s := int((np.array(c) * lengths).sum())) <= budget)
        assert (take <= counts).all() and budget - int((take * lengths).sum()) <= max(budget - best, 150_000)


def test_many_rows_without_id(spark):
    """Unlike texts of one length and no id are told apart by their text; equal rows are interchangeable."""
    rows = [(None, f"a{i} b c", "s") for i in range(300)] + [(None, "x y z", "s")] * 300 + [(i, "u v", "t") for i in range(10)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    once = sorted((r["row"]["text"], r.taken) for r in mixing.mix(docs, keep_text=True).collect())
    again = sorted((r["row"]["text"], r.taken) for r in mixing.mix(docs.repartition(5), keep_text=True).collect())
    assert once == again and len(once) == len(rows)
    want = brute_targets({"s": 1800, "t": 20})
    assert abs(sum(t for x, t in once if x != "u v") - want["s"]) <= 3


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_sharing_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 6)) for i in range(40)} | {None: 77, "": 5}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
